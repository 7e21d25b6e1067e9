"""SimHash near-duplicate classes: fingerprints within a Hamming distance link, found by the general pigeonhole principle.

A document's shingles of ``width`` words (lower-cased in A to Z, repeats included, one space between; with fewer words the
whole sequence) are hashed by XXH64; a bit of its 64-bit fingerprint is 1 if it is set in over half of the hashes.

1. Distinct fingerprints are the nodes, so exact copies cost one row. One pass over all nodes sums up how often two bits are set
   together, and a sketch of how often two nodes agree on a group of bits.
2. Bits are grouped into partitions, correlated ones together, for several numbers of partitions.
3. If thresholds t of m partitions add up to distance - m + 1, two fingerprints that link are within t in some
   partition; -1 skips a partition. A dynamic program allots the thresholds that cost least, by the estimated number of
   candidate pairs and of rows to send; partitions whose values are frequent get the low ones.
4. Probing. A node sends its value in each partition, and all values within the threshold; equal ones meet in a cell.
   There the whole fingerprints of the pairs are compared, and a spanning forest of the links is returned. The value of more than
   ``CELL`` nodes is split into pairs of blocks. Nodes of a value of more than ``WIDE`` nodes ask for all fingerprints within
   the distance instead: about 2,000 rows a node, whatever the number of nodes.
5. Components of the forests.

Defined cases: a document without words, or with a null text, has fingerprint zero and is linked like any other; rows with
a null doc_id are too, and get the smallest id of their component, or null if none has one; rows with equal ids are
rows of their own; extra columns are ignored; an empty table gives no rows; texts of any length are read whole, and their
shingles are hashed in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks_for, discard, small, stored, text_of
from .components import components
from .hashing import SLICE, SPACES, U, first_of_runs, mixed, released
from .ngram_join import _slices

WIDTH, DISTANCE, SEED = 3, 2, 42
BITS = 64
#: Numbers of partitions that are weighed against each other.
PARTITIONS = (2, 3, 4)
#: Counters of the sketch of a partition: its error is about 4 % of the sum of squares.
COUNTERS = 1024
#: A row that is sent costs as much as so many comparisons.
ROW_COST = 500
#: Nodes of a block of a frequent value; of a value whose nodes ask for all fingerprints near theirs.
CELL, WIDE = 1 << 14, 1 << 21
#: Rows that one cell task compares, and shingles and words that are hashed at once.
CELL_ROWS, PIECE = 1 << 19, 1 << 17
#: Runs of equal values up to this length are compared by shifts of all rows at once.
SHORT = 32

# XXH64: fixed values.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _round(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _turn(acc + word * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the runs of bytes of ``data``, all at once. ``data`` has at least eight more bytes behind the last run."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    four = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    with np.errstate(over="ignore"):
        first = U(seed)
        h = np.full(len(start), first + P5, U)
        at, left = start.astype(np.int64), length.astype(np.int64)
        long = np.flatnonzero(left >= 32)
        if len(long):
            acc = [np.full(len(long), x, U) for x in (first + P1 + P2, first + P2, first, first - P1)]
            place, stripes = at[long], left[long] // 32
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k)
                for lane in range(4):
                    acc[lane][on] = _round(acc[lane][on], eight[place[on] + 32 * k + 8 * lane])
            whole = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for lane in acc:
                whole = (whole ^ _round(np.zeros(len(long), U), lane)) * P1 + P4
            h[long] = whole
            at[long] += 32 * stripes
            left[long] %= 32
        h += length.astype(U)
        for _ in range(3):
            on = np.flatnonzero(left >= 8)
            h[on] = _turn(h[on] ^ _round(np.zeros(len(on), U), eight[at[on]]), 27) * P1 + P4
            at[on] += 8
            left[on] -= 8
        on = np.flatnonzero(left >= 4)
        h[on] = _turn(h[on] ^ (four[at[on]].astype(U) * P1), 23) * P2 + P3
        at[on] += 4
        left[on] -= 4
        for _ in range(3):
            on = np.flatnonzero(left > 0)
            h[on] = _turn(h[on] ^ (data[at[on]].astype(U) * P5), 11) * P1
            at[on] += 1
            left[on] -= 1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        return h ^ (h >> U(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words lower-cased with one space behind each, and eight more bytes; and where each starts."""
    at = np.concatenate([[0], np.cumsum(end - start + 1)])
    out = np.full(int(at[-1]) + 8, 32, np.uint8)
    for low in range(0, len(start), PIECE):
        high = min(low + PIECE, len(start))
        size = end[low:high] - start[low:high]
        inside = np.ones(int(at[high] - at[low]), bool)
        inside[at[low + 1 : high + 1] - 1 - at[low]] = False
        source = np.repeat(start[low:high] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[at[low] : at[high]][inside] = _LOWER[data[source]]
    return out, at[:-1]


def fingerprints(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of every text of an Arrow column."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, U)
    _, offsets, raw = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    low = int(offsets[0])
    data = np.frombuffer(raw, np.uint8)[low : int(offsets[-1])] if raw is not None else np.zeros(0, np.uint8)
    space = SPACES[data]
    apart = np.ones(len(data) + 1, bool)
    apart[1:-1] = space[:-1] | space[1:]
    apart[offsets - low] = True
    start, end = np.flatnonzero(~space & apart[:-1]), np.flatnonzero(~space & apart[1:]) + 1
    doc = np.searchsorted(offsets, start + low, "right") - 1
    words = np.bincount(doc, minlength=n)
    joined, at = _joined(data, start, end)
    stop = np.cumsum(words)
    # A shingle starts at each word that has enough behind it, or at the first one of a short text.
    place = np.arange(len(doc)) - (stop - words)[doc]
    first = np.flatnonzero(place < np.maximum(words[doc] - (width - 1), 1))
    last = np.minimum(first + width - 1, stop[doc[first]] - 1)
    length = at[last] + (end - start)[last] - at[first]
    counts = np.zeros((n, BITS), np.int64)
    lanes = U(0x0101010101010101)
    for k in range(0, len(first), PIECE):
        h = xxh64(joined, at[first[k : k + PIECE]], length[k : k + PIECE])
        d = doc[first[k : k + PIECE]]
        runs = np.flatnonzero(first_of_runs(d))
        within = np.arange(len(d)) - np.repeat(runs, np.diff(np.append(runs, len(d))))
        # Eight counters of a byte each in a word: they hold the sums of 255 hashes.
        cut = np.flatnonzero(within % 255 == 0)
        for bit in range(8):
            sums = np.add.reduceat((h >> U(bit)) & lanes, cut).astype("<u8").view(np.uint8).reshape(-1, 8)
            np.add.at(counts[:, bit::8], d[cut], sums)
    total = np.bincount(doc[first], minlength=n)
    return ((2 * counts > total[:, None]).astype(U) << np.arange(BITS, dtype=U)).sum(1, dtype=U)


def fingerprinted(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, size=2 * SLICE):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fingerprints(b["text"], width).view(np.int64))], ["doc_id", "fp"])
        released()

    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Part:
    """A group of bits, and the distance up to which its values are probed."""

    bits: tuple[int, ...]
    threshold: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def flips(self) -> list[int]:
        """What to add to a value for all others within the threshold."""
        return [sum(1 << b for b in c) for k in range(1, self.threshold + 1) for c in combinations(self.bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def grouped_bits(correlation: np.ndarray, parts: int) -> list[Part]:
    """The bits in groups of about equal size: each starts with the bit that is most correlated with those left, and takes those most correlated with it."""
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        own = [max(left, key=lambda b: (correlation[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda b: (correlation[b, own].sum(), -b)))
            left.remove(own[-1])
        out.append(Part(tuple(sorted(own))))
    return out


def _together(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many nodes there are, and how many have both of two bits set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BITS * BITS + 1)
        for b in batches:
            has = np.unpackbits(b["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total[:-1] += (has.T @ has).ravel()
            total[-1] += len(has)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total))), "n": pa.array(total.astype(np.int64))})

    # As many rows as there are pairs of bits.
    rows = nodes.select("fp").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for place, n in rows:
        out[place] = n
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def _agreeing(nodes: DataFrame, masks: list[int]) -> list[float]:
    """Estimates, for each mask, of the pairs of nodes that agree on it: sums of squares of signed counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(masks) * COUNTERS, np.int64)
        for b in batches:
            fp = b["fp"].to_numpy().view(U)
            for k, mask in enumerate(masks):
                h = mixed(fp & U(mask))
                total += np.bincount((k * COUNTERS + (h % U(COUNTERS)).astype(np.int64)), np.where(h >> U(63), 1, -1), len(total)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total))), "n": pa.array(total)})

    counters = nodes.select("fp").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    part = F.expr(f"place div {COUNTERS}").alias("part")
    rows = dict(counters.groupBy(part).agg(F.sum(F.col("n").cast("double") ** 2)).collect())
    return [rows.get(k, 0.0) for k in range(len(masks))]


def costs(n: int, ones: np.ndarray, part: Part, agreeing: float, distance: int) -> list[float]:
    """Estimated costs of a partition with thresholds -1, 0, ... distance."""
    p = ones[list(part.bits)] / max(1, n)
    same = np.maximum(p * p + (1 - p) * (1 - p), 1e-9)
    ratio = 2 * p * (1 - p) / same
    pairs = max(0.0, agreeing - n) / 2
    out, near, rows, w = [0.0], 1.0, 1, len(part.bits)
    for t in range(distance + 1):
        if t:
            # Pairs at distance t for one that agrees, if bits differ independently: an elementary symmetric sum.
            near += ratio.sum() if t == 1 else (ratio.sum() ** 2 - (ratio**2).sum()) / 2 if t == 2 else ratio.sum() ** t
            rows += len(list(combinations(range(w), t)))
        out.append(n * rows * ROW_COST + pairs * near * (1 if t == 0 else 2))
    return out


def allotted(table: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """The thresholds, one a partition, that add up to distance - partitions + 1 at the least cost. ``table``: costs of thresholds from -1 on."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in table:
        following: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, ts) in best.items():
            for t, c in enumerate(row, -1):
                if total + t not in following or cost + c < following[total + t][0]:
                    following[total + t] = (cost + c, [*ts, t])
        best = following
    return best[distance - len(table) + 1]


def planned(nodes: DataFrame, distance: int = DISTANCE, numbers: tuple[int, ...] = PARTITIONS) -> list[Part]:
    """The partitions that are probed, with their thresholds."""
    n, both = _together(nodes)
    ones = np.diag(both)
    p = ones / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    correlation = np.abs(both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    ways = [grouped_bits(correlation, m) for m in numbers]
    agreeing = iter(_agreeing(nodes, [x.mask for way in ways for x in way]))
    chosen = []
    for way in ways:
        cost, ts = allotted([costs(n, ones, x, next(agreeing), distance) for x in way], distance)
        chosen.append((cost, [Part(x.bits, t) for x, t in zip(way, ts, strict=True) if t >= 0]))
    return min(chosen, key=lambda x: x[0])[1]


def _keys(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """part, value, fp, own: the values by which a node is found (own) and those by which it looks for others."""

    def sent(k: int, part: Part) -> Column:
        value = F.col("fp").bitwiseAND(F.lit(_signed(part.mask)))
        row = lambda v, own: F.struct(F.lit(k).alias("part"), v.alias("value"), F.lit(own).alias("own"))
        if not part.threshold:
            return F.array(row(value, True))
        flips = F.array(*[F.lit(_signed(x)) for x in part.flips()])
        return F.concat(F.array(row(value, True)), F.transform(flips, lambda x: row(value.bitwiseXOR(x), False)))

    return nodes.select("fp", F.explode(F.concat(*[sent(k, p) for k, p in enumerate(parts)])).alias("k")).select("k.part", "k.value", "fp", "k.own")


def _hooked(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins the trees of u and v: afterwards ``root`` is the smallest of each component."""
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _links(distance: int):
    """Compares the rows of a cell that have equal values; the links as a forest."""

    def links(table: pa.Table) -> pa.Table:
        part, i, j, block = (table[c].to_numpy() for c in ("part", "i", "j", "block"))
        value, fp, own = table["value"].to_numpy(), table["fp"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
        order = np.lexsort((block, j, i, value, part))
        part, i, j, block, value, fp, own = (x[order] for x in (part, i, j, block, value, fp.view(U), own))
        names, node = np.unique(fp, return_inverse=True)
        root = np.arange(len(names))
        new = first_of_runs(part) | first_of_runs(value) | first_of_runs(i) | first_of_runs(j)
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(fp)))
        length = np.repeat(size, size)
        place = np.arange(len(fp)) - np.repeat(starts, size)
        short = int(size[size <= SHORT].max(initial=0))
        for k in range(1, short):
            a = np.flatnonzero((length <= SHORT) & (place + k < length))
            good = (np.bitwise_count(fp[a] ^ fp[a + k]) <= distance) & (own[a] | own[a + k])
            _hooked(root, node[a[good]], node[a[good] + k])
        for s, n in zip(starts[size > SHORT], size[size > SHORT], strict=True):
            cross = i[s] != j[s]
            middle = s + int(np.searchsorted(block[s : s + n], j[s])) if cross else s
            for low in range(s, middle if cross else s + n, 512):
                high = min(low + 512, middle if cross else s + n)
                right = slice(middle if cross else low, s + n)
                near = (np.bitwise_count(fp[low:high, None] ^ fp[None, right]) <= distance) & (own[low:high, None] | own[None, right])
                u, v = np.nonzero(near)
                _hooked(root, node[u + low], node[v + right.start])
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": pa.array(names[tied].view(np.int64)), "v": pa.array(names[root[tied]].view(np.int64))})

    return links


def _near(fp: Column, distance: int) -> Column:
    """All smaller fingerprints within the distance, as an array."""
    near = F.array(fp)
    for _ in range(distance):
        near = F.array_distinct(F.flatten(F.transform(near, lambda x: F.concat(F.array(x), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))))))
    return F.filter(near, lambda x: x < fp)


def edges(nodes: DataFrame, parts: list[Part], distance: int = DISTANCE, cell: int = CELL, wide: int = WIDE) -> DataFrame:
    """u, v: links between nodes whose components are those of all links."""
    keys = stored(_keys(nodes, parts))
    total = keys.count()
    cells = blocks_for(total, CELL_ROWS, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = stored(keys.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell))
    none = F.lit(-1)
    here = F.pmod(F.xxhash64("part", "value", "i", "j"), F.lit(cells)).alias("cell")
    plain = keys.join(small(often), ["part", "value"], "left_anti").withColumns({"i": none, "j": none, "block": none})
    blocks = F.ceil(F.col("n") / cell).cast("int")
    split = keys.join(small(often.where(F.col("n") <= wide)), ["part", "value"]).withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    columns = ["part", "value", "i", "j", "block", "fp", "own"]
    dealt = plain.select(here, *columns).unionByName(split.select(here, *columns))
    found = dealt.groupBy("cell").applyInArrow(_links(distance), "u long, v long")
    asking = keys.join(small(often.where(F.col("n") > wide)), ["part", "value"], "left_semi").select("fp").distinct()
    asked = asking.select(F.col("fp").alias("u"), F.explode(_near(F.col("fp"), distance)).alias("v"))
    met = asked.join(nodes.select(F.col("fp").alias("v")), "v", "left_semi").select("u", "v")
    out = stored(found.unionByName(met))
    discard(keys, often)
    return out


def classes(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE, cell: int = CELL, wide: int = WIDE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (smallest doc_id reachable by links, itself included)."""
    rows = stored(fingerprinted(documents, width))
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    links = edges(nodes, planned(nodes, distance), distance, cell, wide)
    stars = components(links)
    member = stored(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct()))
    joined = nodes.join(small(member), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows")
    known = stored(joined.select("fp", "root").join(small(stored(smallest)), "root").select("fp", "component_id"))
    discard(links, member, nodes)
    return rows.join(small(known), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
