"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

A document's set is its distinct shingles of ``width`` words, lower-cased in A to Z; with fewer
words the whole sequence is its one shingle. Two documents link if
100 * intersection >= percent * union. Documents with equal sets (equal 128-bit sums of mixed
hashes) are one class and always link.

1. Candidates. Of s shingles a set that needs m in common with another can miss s - m, so in any global
   order of the shingles two linked sets of different classes have two of their first s - m + 2 in common. First the
   order is that of the hashes: each class sends its first 4 / 3 * (s - m) + 2 shingles, once a batch of documents, to
   the parts of the hash space and hears how many another class has too. Of these at most s - m may be
   missing; classes that miss more are done, and that is nearly all of ordinary text.
2. The shingles of the rest get a global order by estimated frequency, rare first. Prefixes of the same length in it
   have at least ``_shared`` of their shingles in common if two sets link (that many are left of the prefix that ends first). Classes
   of a shingle of at most ``RARE`` classes are paired if their sizes allow a link, and a pair stays with enough shingles in common, less the more
   frequent ones that both may have. Only classes whose prefixes have so many frequent ones that a link might show in these
   alone are tied, to the smallest such class of each that is of about their size. Every link lies inside a component of that graph, which is no larger than a constant times the prefixes.
3. Candidate components are dealt into cells of bounded size, a large one as pairs of its blocks.
4. Vertical partitioning. Pivots cut the global order into ``FRAGMENTS`` of equal mass and every set into as many
   segments. Each fragment is joined on its own: it counts, for the pairs of a cell, the overlap of their
   segments. The partial counts of a cell meet in a shuffle, are summed per pair and tested against the
   condition. Pairs are places in a vector that all fragments share, so no row is made for a pair; a cell
   returns a spanning forest of its links.
5. Components of the forests are the components of all links.

Frequencies come from one counter sketch, whose size grows with the input up to ``MOST_COUNTERS``
bytes. They only order the shingles: any order gives the same links.

Defined cases: a document without words has an empty set and links with nothing; rows with equal
sets are of one class, whatever their ids; a row with a null doc_id is searched and linked like any other, and gets
the component of its links, or null if none of them has an id; extra columns are ignored; an empty
table gives no rows; texts of any length are read whole, in slices of rows of a few MB.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import wraps
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_rows, blocks_for, discard, fresh, shuffles_dropped, small, stored, text_of
from .components import components
from .decontaminate import BITS_EACH, BLOOM_BITS, bloom, in_bloom
from .exchange import by_hash
from .hashing import SLICE, U, Words, first_of_runs, mixed, released, windows

WIDTH, PERCENT = 5, 80
#: Classes, and shingles, that a block of a large candidate component holds.
CELL_NODES, CELL_GRAMS = 512, 500_000
#: Classes of a prefix shingle that are paired one by one; beyond, they are tied to one of them.
RARE = 32
#: Parts of the global order.
FRAGMENTS = 8
#: Distinct shingles whose overlaps are counted at once in a cell.
COLUMNS = 2048
MOST_COUNTERS = 1 << 24
#: Prefix shingles that one task compares.
PART_GRAMS = 1 << 20
SLICES = 16
#: Rows of text that a worker is sent at once: with 10,000, Spark's own number, a worker took 341 MB for documents of 3 KB.
BATCH_ROWS = 1000


def _sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every text, text after text; how many each has, and how many words."""
    words = Words(texts, fold_case=True)
    grams, within = windows(words, width)
    owner = words.doc[: len(grams)][within]
    grams = grams[within]
    for n in set(words.counts[(words.counts > 0) & (words.counts < width)].tolist()):
        short = np.flatnonzero(words.counts == n)
        first = np.searchsorted(words.doc, short)
        at = np.searchsorted(owner, short)
        grams, owner = np.insert(grams, at, windows(words, n)[0][first]), np.insert(owner, at, short)
    ends = np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
    low = 0
    for high in ends:
        grams[low:high].sort()
        low = high
    new = first_of_runs(grams) | first_of_runs(owner)
    return grams[new], np.bincount(owner[new], minlength=len(texts)), words.counts


def _slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 * SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``size`` bytes of a column, or one row."""
    for b in batches:
        data = b[column].cast(pa.large_binary())
        at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
        low = 0
        while low < len(data):
            high = max(low + 1, int(np.searchsorted(at, at[low] + size, "right")) - 1)
            yield b.slice(low, min(high, len(data)) - low)
            low = high


def _names(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of mixed hashes that tell sets apart; 0 for an empty set."""
    full = counts > 0
    starts = (np.cumsum(counts) - counts)[full]
    out = np.zeros((2, len(counts)), U)
    if len(grams):
        out[0, full] = np.add.reduceat(mixed(grams), starts)
        out[1, full] = np.add.reduceat(mixed(grams ^ U(0xA5A5A5A5A5A5A5A5)), starts)
    return out[0].view(np.int64), out[1].view(np.int64)


def _binary(grams: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One value of bytes for each run of counts hashes."""
    at = np.concatenate([[0], np.cumsum(8 * counts)])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(grams))]).cast(pa.binary())


def met(percent: int) -> int:
    """How many prefix shingles two different sets that link have in common at least, whatever their sizes: 2, or 1 for low similarities."""
    return 2 if percent >= 67 else 1


def _looked_at(n: np.ndarray, percent: int) -> np.ndarray:
    """The length of a prefix of a set of n: a third more than may be missing, so that a quarter of it must be shared."""
    return np.minimum(n, -(-4 * (n + (-percent * n // 100)) // 3) + met(percent))


def _shared(n: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles of its prefix a set of n has in common with any set that it links with, at least. It grows with n."""
    return _looked_at(n, percent) - (n + (-percent * n // 100))


SIGNED = "doc_id long, rkey long, n long, s1 long, s2 long, words long, asks int, prefix binary"


def _signed(width: int, percent: int, kept: tuple[str, ...] = ()):
    """Every row's class, and the prefix of its set in the order of the hashes; ``kept`` columns go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            grams, n, words = _sets(b["text"], width)
            asks = _looked_at(n, percent)
            first = np.cumsum(n) - n
            prefix = grams[np.arange(len(grams)) - np.repeat(first, n) < np.repeat(asks, n)]
            s1, s2 = (pa.array(x, pa.int64(), mask=n == 0) for x in _names(grams, n))
            cols = [b["doc_id"], b["rkey"], pa.array(n, pa.int64()), s1, s2, pa.array(words, pa.int64()), pa.array(asks, pa.int32()), _binary(prefix, asks)]
            yield pa.RecordBatch.from_arrays([*cols, *(b[c] for c in kept)], ["doc_id", "rkey", "n", "s1", "s2", "words", "asks", "prefix", *kept])
        released()

    return run


# What times says in a question: asked, asked but already known to be shared, or (from 1 up) an answer.
ASKED, TOLD = 0, -1
QUESTIONS = "hash long, key long, times int"


def _questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a distinct prefix shingle of the batch, and for each class how many of its own another class of the batch has."""
    for b in batches:
        keys, first = np.unique(b["s1"].to_numpy(zero_copy_only=False), return_index=True)
        if not len(keys):
            continue
        gram = np.frombuffer(b"".join(b["prefix"].take(pa.array(first)).to_pylist()), np.int64)
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), b["asks"].to_numpy()[first])
        order = np.argsort(gram)
        gram, owner = gram[order], owner[order]
        new = first_of_runs(gram)
        starts = np.flatnonzero(new)
        held = np.diff(np.append(starts, len(gram)))
        known = np.bincount(owner[np.repeat(held > 1, held)], minlength=len(keys))
        told = np.flatnonzero(known)
        yield pa.RecordBatch.from_pydict(
            {
                "hash": pa.array(np.concatenate([gram[starts], keys[told]])),
                "key": pa.array(np.concatenate([keys[owner[starts]], keys[told]])),
                "times": pa.array(np.concatenate([np.where(held > 1, TOLD, ASKED), known[told]]).astype(np.int32)),
            }
        )
    released()


def _answers(table: pa.Table) -> pa.Table:
    """key, times: a row for each prefix shingle of a class that another class has too, and what batches knew already.

    They are added up per class behind the part: sums per part would be as many as there are parts.
    """
    gram, key, times = (table[c].to_numpy() for c in ("hash", "key", "times"))
    asked = times <= 0
    g, k, told = gram[asked], key[asked], times[asked] == TOLD
    # Most shingles of ordinary text are met once: only the others are ordered by class too.
    order = np.argsort(g)
    new = first_of_runs(g[order])
    often = np.diff(np.append(np.flatnonzero(new), len(g))) > 1
    order = order[np.repeat(often, np.diff(np.append(np.flatnonzero(new), len(g)))) | told[order]]
    g, k, told = g[order], k[order], told[order]
    order = np.lexsort((k, g))
    g, k, told = g[order], k[order], told[order]
    new = first_of_runs(g)
    starts = np.flatnonzero(new)
    other = new | first_of_runs(k)
    shared = (np.add.reduceat(other.astype(np.int64), starts) > 1) | np.maximum.reduceat(told, starts) if len(g) else np.zeros(0, bool)
    hit = shared[np.cumsum(new) - 1] & other & ~told if len(g) else np.zeros(0, bool)
    return pa.table({"key": pa.array(np.concatenate([k[hit], key[~asked]])), "times": pa.array(np.concatenate([np.ones(int(hit.sum()), np.int64), times[~asked].astype(np.int64)]))})


def _live(signed: DataFrame, percent: int) -> DataFrame:
    """s1 of the classes that may link with another one."""
    asking = signed.where(F.col("s1").isNotNull()).select("s1", "asks", "prefix")
    grams = signed.agg(F.coalesce(F.sum("asks"), F.lit(0))).first()[0]
    parts = blocks_for(grams, PART_GRAMS, int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heard = by_hash(asking.mapInArrow(_questions, QUESTIONS), parts, _answers, "key long, times long")
    heard = heard.groupBy(F.col("key").alias("s1")).agg(F.sum("times").alias("times"))
    may_miss = F.col("n") - F.ceil(F.col("n") * percent / 100)
    known = signed.where(F.col("s1").isNotNull()).select("s1", (F.col("asks") - may_miss).alias("least")).distinct()
    return known.join(heard, "s1").where(F.col("times") >= F.greatest("least", F.lit(1))).select("s1").distinct()


GRAMS = "s1 long, s2 long, n long, grams binary"


def _grams(width: int):
    """The whole sets of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            grams, n, _ = _sets(b["text"], width)
            n = n[n > 0]
            s1, s2 = _names(grams, n)
            yield pa.RecordBatch.from_pydict({"s1": pa.array(s1), "s2": pa.array(s2), "n": pa.array(n, pa.int64()), "grams": _binary(grams, n)})
        released()

    return run


class Order:
    """The global order of the shingles: by level (of estimated frequency), then by hash; and its pivots."""

    def __init__(self, levels: np.ndarray, mass: np.ndarray) -> None:
        self.levels, self.mass = levels, mass
        self.before = np.concatenate([[0.0], np.cumsum(mass)[:-1]])

    def level(self, grams: np.ndarray) -> np.ndarray:
        return self.levels[(grams % U(len(self.levels))).astype(np.int64)]

    def fragment(self, grams: np.ndarray) -> np.ndarray:
        level = self.level(grams)
        place = self.before[level] + self.mass[level] * (grams / 2.0**64)
        return np.minimum((FRAGMENTS * place / max(1.0, self.mass.sum())).astype(np.int64), FRAGMENTS - 1)


def _order(sets: DataFrame) -> Order:
    """Counts how often each hash modulo the sketch's size occurs; a level is a power of two of that."""
    grams = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = min(MOST_COUNTERS, max(1 << 12, 1 << int(grams / 8).bit_length()))
    # Counts up to what chance puts in a counter say nothing.
    fair = 2 * grams // size + 4

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for b in _slices(batches, "grams"):
            for x in b["grams"]:
                np.add.at(total, (np.frombuffer(x.as_buffer(), U) % U(size)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "data": pa.array([zlib.compress(c.tobytes(), 1) for c in np.split(total, SLICES)], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(size // SLICES, np.uint64)
        for x in t["data"]:
            total += np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
        level = np.where(total <= fair, 0, np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pa.table({"slice": t["slice"][:1], "data": pa.array([level.tobytes()], pa.binary()), "mass": pa.array([np.bincount(level, total, 64).tolist()], pa.list_(pa.float64()))})

    # One byte a counter, so at most MOST_COUNTERS of them, comes to the driver.
    rows = sets.select("grams").mapInArrow(count, "slice int, data binary").groupBy("slice").applyInArrow(add, "slice int, data binary, mass array<double>").collect()
    levels, mass = np.zeros((SLICES, size // SLICES), np.uint8), np.zeros(64)
    for r in rows:
        levels[r["slice"]] = np.frombuffer(r["data"], np.uint8)
        mass += r["mass"]
    return Order(levels.ravel(), mass)


def _prefixes(sets: DataFrame, percent: int, order) -> DataFrame:
    """gram, node, n, shared, tied: the prefix of every class in the global order. Shared is for the class itself, tied for the smallest that it can link with."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "grams"):
            grams = [np.zeros(0, U)]
            n = b["n"].to_numpy()
            for size, x in zip(_looked_at(n, percent).tolist(), b["grams"], strict=True):
                s = np.frombuffer(x.as_buffer(), U)
                grams.append(s[np.lexsort((s, order.value.level(s)))[:size]])
            facts = {"node": b["s1"].to_numpy(), "n": n, "shared": _shared(n, percent), "tied": _shared(-(-percent * n // 100), percent)}
            each = [len(g) for g in grams[1:]]
            yield pa.RecordBatch.from_pydict({"gram": pa.array(np.concatenate(grams).view(np.int64))} | {k: pa.array(np.repeat(v, each)) for k, v in facts.items()})

    return sets.select("s1", "n", "grams").mapInArrow(prefix, "gram long, node long, n long, shared long, tied long")


def _proposed(prefixes: DataFrame, times: DataFrame, percent: int) -> DataFrame:
    """u, v: pairs of classes that may link by their shingles of at most ``RARE`` classes, and classes that may link by more frequent ones with the smallest of these."""
    some = prefixes.join(times.where(F.col("times") <= RARE).select("gram"), "gram", "left_semi").select("gram", "node", "n", "shared")
    a, b = some.alias("a"), some.alias("b")
    near = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    paired = a.join(b, "gram").where(near & (F.col("a.node") > F.col("b.node"))).groupBy(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    paired = stored(paired.agg(F.count(F.lit(1)).alias("times"), F.min(F.least("a.shared", "b.shared")).alias("least")))
    often = stored(prefixes.join(small(times.where(F.col("times") > RARE).select("gram")), "gram", "left_semi"))
    # What both may have in common of the frequent shingles is added.
    held = stored(often.groupBy("node").agg(F.count(F.lit(1)).alias("often"), F.min("tied").alias("tied")))
    sure = paired.where(F.col("times") >= F.col("least")).select("u", "v")
    more = paired.where(F.col("times") < F.col("least"))
    for end in ("u", "v"):
        more = more.join(small(held.select(F.col("node").alias(end), F.col("often").alias(f"often_{end}"))), end)
    more = more.where(F.col("times") + F.least("often_u", "often_v") >= F.col("least")).select("u", "v")
    bound = held.where(F.col("often") >= F.col("tied")).select("node")
    # Sizes that allow a link are in one band or in two that are neighbours; bands are a little wider than need be, for rounding.
    band = F.floor(F.log("n") / (1.001 * max(log(100 / percent), 1e-3)))
    bound = stored(often.join(small(bound), "node", "left_semi").select("gram", "node", F.explode(F.array(band, band + 1)).alias("band")))
    stars = bound.join(bound.groupBy("gram", "band").agg(F.min("node").alias("v")), ["gram", "band"]).select(F.col("node").alias("u"), "v").distinct()
    found = stored(sure.unionByName(more).unionByName(stars))
    discard(paired, often, held, bound)
    return found


def _candidates(sets: DataFrame, percent: int, order) -> DataFrame:
    """node, candidate: the classes of each candidate component of two or more."""
    prefixes = stored(_prefixes(sets, percent, order))
    times = stored(prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    proposed = _proposed(prefixes, times, percent)
    discard(prefixes, times)
    stars = components(proposed)
    discard(proposed)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("candidate")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("candidate")).distinct()
    )


def _seats(sets: DataFrame, members: DataFrame) -> DataFrame:
    """s1, s2, candidate, own, cell, i, j: the cells that a class takes part in. Small components share cells, with i = -1."""
    placed = sets.select("s1", "s2", "n", F.col("s1").alias("node")).join(small(members), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / CELL_NODES), F.ceil(F.sum("n") / CELL_GRAMS)).cast("int")
    sizes = placed.groupBy("candidate").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams")).where("members > 1")
    sizes = stored(sizes)
    total = sizes.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    deals = blocks_for(int(total), CELL_GRAMS, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int")
    seats = placed.join(small(sizes.drop("members", "grams")), "candidate").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    alone = F.col("blocks") == 1
    return seats.select(
        "s1", "s2", "candidate", "own",
        F.when(alone, F.pmod(F.xxhash64("candidate"), F.lit(deals))).otherwise(F.col("candidate")).alias("cell"),
        F.when(alone, F.lit(-1)).otherwise(F.least("own", "other")).alias("i"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("own", "other")).alias("j"),
    )


SEGMENTS = "cell long, i int, j int, fragment int, candidate long, own int, s1 long, s2 long, n long, grams binary"


def _segments(order):
    """Each set cut at the pivots: one row a fragment, an empty one too, so that all fragments of a cell number its classes alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "grams"):
            data = []
            for x in b["grams"]:
                s = np.frombuffer(x.as_buffer(), U)
                f = order.value.fragment(s)
                by = np.argsort(f, kind="stable")
                data += [c.tobytes() for c in np.split(s[by], np.searchsorted(f[by], np.arange(1, FRAGMENTS)))]
            again = pa.array(np.repeat(np.arange(b.num_rows), FRAGMENTS))
            cols = {c: b[c].take(again) for c in ("cell", "i", "j", "candidate", "own", "s1", "s2", "n")}
            cols["fragment"] = pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), b.num_rows))
            cols["grams"] = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_pydict({c.split()[0]: cols[c.split()[0]] for c in SEGMENTS.split(", ")})

    return run


def _overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections: of all pairs among ``sets``, or with ``split`` of those before it with those behind."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    two = times[column] > 1
    owner, column = owner[two], rank[column[two]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((split or len(sets), len(sets) - split), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, int(column[b - 1]) + 1 - low)), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        out += (has[:split] if split else has) @ has[split:].T
    return out


def _groups(candidate: np.ndarray) -> list[np.ndarray]:
    return np.split(np.arange(len(candidate)), np.flatnonzero(np.diff(candidate)) + 1)


HEAD = ("candidate", "own", "s1", "s2", "n")
PARTIAL = "cell long, i int, j int, fragment int, head binary, counts binary"


def _partial(table: pa.Table) -> pa.Table:
    """A fragment's overlaps of all pairs of a cell, as one vector: component after component, pairs in the order of the classes."""
    head = {c: table[c].to_numpy().astype(np.int64) for c in HEAD}
    order = np.lexsort((head["s2"], head["s1"], head["own"], head["candidate"]))
    head = {c: v[order] for c, v in head.items()}
    data = table["grams"].take(pa.array(order)).to_pylist()
    cross = table["i"][0].as_py() != table["j"][0].as_py()
    counts = []
    for at in _groups(head["candidate"]):
        split = int(np.searchsorted(head["own"][at], head["own"][at[0]], "right")) if cross else 0
        if len(at) > 1 and split < len(at):
            o = _overlaps([np.frombuffer(data[k], U) for k in at], split)
            counts.append(o.ravel() if cross else o[np.triu_indices(len(at), 1)])
    vector = np.concatenate([np.zeros(0), *counts]).astype(np.uint32)
    fragment = table["fragment"][0].as_py()
    packed = np.array([head[c] for c in HEAD]).tobytes() if fragment == 0 else None
    cols = {c: table[c][:1] for c in ("cell", "i", "j", "fragment")}
    return pa.table(cols | {"head": pa.array([packed], pa.binary()), "counts": pa.array([zlib.compress(vector.tobytes(), 1)], pa.binary())})


def _forest(percent: int):
    """Sums the fragments' counts per pair and tests the condition; the links as edges to the smallest class of each component of them."""

    def names(s1: np.ndarray, s2: np.ndarray) -> pa.Array:
        raw = np.column_stack([s1, s2]).astype(">i8")
        at = np.arange(len(s1) + 1, dtype=np.int32) * 16
        return pa.Array.from_buffers(pa.binary(), len(s1), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])

    def forest(table: pa.Table) -> pa.Table:
        total = None
        for x in table["counts"]:
            part = np.frombuffer(zlib.decompress(x.as_buffer()), np.uint32)
            total = part.astype(np.int64) if total is None else total + part
        blob = next(x for x in table["head"].to_pylist() if x is not None)
        candidate, own, s1, s2, n = np.frombuffer(blob, np.int64).reshape(len(HEAD), -1)
        cross = table["i"][0].as_py() != table["j"][0].as_py()
        low, us, vs = 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in _groups(candidate):
            split = int(np.searchsorted(own[at], own[at[0]], "right")) if cross else 0
            if len(at) < 2 or split >= len(at):
                continue
            rows, columns = (x.ravel() for x in np.indices((split, len(at) - split))) if cross else np.triu_indices(len(at), 1)
            overlap = total[low : low + len(rows)]
            low += len(rows)
            columns = columns + split
            union = n[at][rows] + n[at][columns] - overlap
            linked = np.zeros((len(at), len(at)), bool)
            good = 100 * overlap >= percent * union
            linked[rows[good], columns[good]] = linked[columns[good], rows[good]] = True
            np.fill_diagonal(linked, True)
            root = np.arange(len(at))
            while True:
                least = np.where(linked, root[None, :], len(at)).min(1)
                if (least == root).all():
                    break
                root = least
            tied = np.flatnonzero(root != np.arange(len(at)))
            us.append(at[tied])
            vs.append(at[root[tied]])
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.table({"u": names(s1[u], s2[u]), "v": names(s1[v], s2[v])})

    return forest


def _name(s1: str, s2: str) -> Column:
    half = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    return F.concat(half(s1), half(s2))


def row_key() -> Column:
    return F.xxhash64("doc_id", text_of())


def _held(keys: DataFrame, name: str, n: int):
    """A test of a hash column: may it be among the n keys? Of others, one in thousands passes while the filter is below ``BLOOM_BITS``."""
    each = F.explode(F.array(F.col(name), F.xxhash64(name))).alias("hash")
    bits = min(BLOOM_BITS, 1 << max(13, (2 * BITS_EACH * n - 1).bit_length()))
    known = stored(bloom(keys.select(each), bits))
    return lambda hash_: in_bloom(known.scalar(), hash_, bits) & in_bloom(known.scalar(), F.xxhash64(hash_), bits)


def _among(texts: DataFrame, keys: DataFrame, named: DataFrame) -> DataFrame:
    """The texts whose rkey is among ``keys``. ``named`` has the rkeys of all.

    Keys too many to broadcast are told by a filter, and what passes it by chance is found among the rkeys alone: no text moves.
    """
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return texts.join(F.broadcast(keys), "rkey", "left_semi")
    may = _held(keys, "rkey", n)
    chance = stored(named.select("rkey").where(may(F.col("rkey"))).join(keys.hint("merge"), "rkey", "left_anti"))
    return texts.where(may(F.col("rkey"))).join(small(chance), "rkey", "left_anti")


def _met(rows: DataFrame, row: str, keys: DataFrame, key: str, on, how: str) -> DataFrame:
    """``rows`` joined with ``keys`` on a condition that equates ``row`` and ``key``. If the keys are too many to broadcast, only rows that a filter of them holds move."""
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), on, how)
    may = _held(keys, key, n)(F.col(row))
    met_ = rows.where(may).join(keys.hint("merge"), on, how)
    return met_ if how == "left_semi" else met_.unionByName(rows.where(~may), allowMissingColumns=True)


def _classified(documents: DataFrame, width: int, percent: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, rkey (of id and text), n, words (how many), name (of the class; null without words), root (the name that its component goes by) and ``kept`` columns."""
    texts = documents.select("doc_id", text_of().alias("text"), row_key().alias("rkey"), *kept)
    schema = ", ".join([SIGNED, *(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)])
    with arrow_rows(documents.sparkSession, BATCH_ROWS):
        signed = stored(texts.mapInArrow(_signed(width, percent, kept), schema))
    with arrow_rows(documents.sparkSession, 4 * BATCH_ROWS):
        live = stored(_live(signed, percent))
    # Any row of a class has its set.
    wanted = stored(signed.join(small(live), "s1", "left_semi").groupBy("s1", "s2").agg(F.min("rkey").alias("rkey")).select("rkey"))
    # The prefixes have been asked about; the rest is about names.
    asked, signed = signed, stored(signed.drop("prefix"))
    discard(asked)
    found = _among(texts.select("rkey", "text"), wanted, signed)
    with arrow_rows(documents.sparkSession, BATCH_ROWS):
        sets = stored(found.mapInArrow(_grams(width), GRAMS))
    n, different = sets.agg(F.count(F.lit(1)), F.count_distinct("s1", "s2")).first()
    if n > different:
        again, sets = sets, stored(sets.dropDuplicates(["s1", "s2"]))
        discard(again)
    order = documents.sparkSession.sparkContext.broadcast(_order(sets))
    members = stored(_candidates(sets, percent, order))
    seats = stored(_seats(sets, members))
    cells = sets.join(small(seats), ["s1", "s2"]).select("cell", "i", "j", "candidate", "own", "s1", "s2", "n", "grams")
    partial = cells.mapInArrow(_segments(order), SEGMENTS).groupBy("cell", "i", "j", "fragment").applyInArrow(_partial, PARTIAL)
    forest = partial.groupBy("cell", "i", "j").applyInArrow(_forest(percent), "u binary, v binary")
    roots = components(forest).select(F.col("u").alias("name"), F.col("v").alias("root"))
    discard(live, wanted, sets, members, seats)
    rows = signed.select("doc_id", "rkey", "n", "words", *kept, F.when(F.col("s1").isNotNull(), _name("s1", "s2")).alias("name"))
    return rows.join(small(roots), "name", "left").withColumn("root", F.coalesce("root", "name"))


def _tidy(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The step, whose runs leave no shuffle files; the rows that it returns are up to the caller."""

    @wraps(step)
    def run(documents: DataFrame, *more, **named) -> DataFrame:
        with shuffles_dropped(documents.sparkSession):
            return step(documents, *more, **named)

    return run


@_tidy
def linked(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    rows = stored(_classified(documents, width, percent).select("doc_id", "n", "root"))
    shared = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("least")).where("rows > 1").drop("rows")
    return rows.join(small(stored(shared)), "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def _groups_of(rows: DataFrame, name: str) -> DataFrame:
    """root, and a number of the group of near duplicates that it stands for: those with two rows or more."""
    groups = rows.where(F.col("root").isNotNull()).groupBy("root").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return stored(groups.select("root", F.xxhash64("root").alias(name)))


@_tidy
def with_groups(documents: DataFrame, name: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents with a new column ``name``: a number of their group of near duplicates, null for those alone."""
    rows = stored(_classified(documents, width, percent).where(F.col("root").isNotNull()).select("rkey", "root"))
    key = fresh(documents, "_nj_key")
    known = stored(rows.join(small(_groups_of(rows, name)), "root").select(F.col("rkey").alias(key), name).distinct())
    return _met(documents.withColumn(key, row_key()), key, known, key, key, "left").drop(key)


@_tidy
def measured(documents: DataFrame, name: str, kept: tuple[str, ...], width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Of every row doc_id, ``kept`` columns, words (how many) and ``name`` as in ``with_groups``: the texts are read once, and none is moved."""
    rows = stored(_classified(documents, width, percent, kept).select("doc_id", *kept, "words", "root"))
    return rows.join(small(_groups_of(rows, name)), "root", "left").drop("root")


@_tidy
def deduplicated(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of every component, with all columns: that with the smallest id (null last), of equal ids with the smallest key of its text.

    Rows without words stay.
    """
    rows = stored(_classified(documents, width, percent).where(F.col("root").isNotNull()).select("doc_id", "rkey", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rkey")
    first = rows.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min(order).alias("first")).where("rows > 1").select("root", "first.doc_id", "first.rkey")
    first = stored(first)
    joined = rows.join(small(first.select("root", F.col("rkey").alias("kept"), F.col("doc_id").alias("kept_id"))), "root")
    same = (F.col("rkey") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("kept_id"))
    row, key, id_, kept, n = (fresh(documents, f"_nj_{x}") for x in ("row", "key", "id", "kept", "n"))
    keys = stored(joined.groupBy(F.col("doc_id").alias(id_), F.col("rkey").alias(key), same.alias(kept)).agg(F.count(F.lit(1)).alias(n)))
    mine = lambda df, how: _met(documents.withColumn(row, row_key()), row, df, key, (F.col(row) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_)), how).drop(row)
    gone = keys.where(~F.col(kept)).select(id_, key)
    again = stored(keys.where(F.col(kept) & (F.col(n) > 1)).select(id_, key))
    if again.isEmpty():
        return mine(gone, "left_anti")
    one = mine(again, "left_semi").withColumn(row, row_key()).dropDuplicates(["doc_id", row]).drop(row)
    return mine(gone.unionByName(again), "left_anti").unionByName(one)
