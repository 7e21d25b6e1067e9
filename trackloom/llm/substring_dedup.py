"""Substring dedup by level-wise doubling.

Which runs of ``window`` words of a document also start in a document with a smaller id? Levels
start from short windows and double: only where the windows of a level recur in another document is
the window of twice the length looked at (the two halves may share words, so that the last level is
``window`` exactly). It ends at ``window``, or as soon as a level leaves no candidate: then no text is
moved at all.

At the first level a window of the second level is stood for by the least hash of the short windows in it.
Two equal windows have the same least one, so asking about these alone, a quarter of all, loses none. From the second
level on, a window is a candidate if its two halves recur.

A level is a filter exchange (see ``exchange``). At the last level, blocks send 96 bits of each
surviving window and the smallest doc_id that holds it in the block, and hear whether another block
has a smaller one. One row a block and window travels, so very frequent passages cost no more
than rare ones, and no task holds more than a block or a part.

Defined cases: a null text is empty; a row whose doc_id is null keeps all its words and takes none
from others; rows with equal ids take nothing from each other; extra columns are ignored; texts of
any length, with or without white space, are handled whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .exchange import ANSWER, ASKS, BOTH, KNOWS, QUESTION, answered, block_count, blocked, by_hash
from .hashing import SLICE, U, Words, first_of_runs, released, windows
from .ngram_join import _slices

WINDOW = 13
#: Levels are halved down to no fewer words than this.
LEAST = 6
#: Hashes that a task remembers to have told of; beyond, it tells of some again.
MOST_TOLD = 1 << 20
LAST = "block int, hash long, more int, low long"
HEARD = "level int, block int, hash long, more int"


def level_lengths(window: int) -> list[int]:
    out = [window]
    while (out[0] + 1) // 2 >= LEAST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _known(table: pa.Table | pa.RecordBatch, words: Words, good: np.ndarray) -> np.ndarray:
    """Windows (``good`` so far) of documents that have an id."""
    return good & np.asarray(table["doc_id"].is_valid())[words.doc[: len(good)]] if len(good) else good


def _picked(table: pa.Table | pa.RecordBatch, words: Words, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``long`` words the least hash of the windows of ``short`` words in it, and where it starts."""
    hashed = windows(words, short)[0]
    good = _known(table, words, windows(words, long)[1])
    least = hashed[: len(good)].copy()
    for k in range(1, long - short + 1):
        np.minimum(least, hashed[k : k + len(good)], out=least)
    at = np.flatnonzero(good)
    return least[at], at


def _first(lengths: list[int]):
    """The first level's questions, asked by batches of documents as they are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = np.zeros(0, U)  # shared hashes that this task has told of
        for b in _slices(batches, size=2 * SLICE):
            words = Words(b["text"])
            hashed, at = _picked(b, words, *lengths[:2])
            doc, block = words.doc[at], b["block"].to_numpy()
            order = np.lexsort((doc, hashed))
            h, d = hashed[order], doc[order]
            once = first_of_runs(h) | first_of_runs(d)
            h, d = h[once], d[once]
            starts = np.flatnonzero(first_of_runs(h))
            held = np.diff(np.append(starts, len(h)))
            # Documents that share a hash within the batch know it; one row a task tells the others.
            mine = np.flatnonzero(np.repeat(held > 1, held))
            new = (held == 1) | ~np.isin(h[starts], told)
            if len(told) < MOST_TOLD:
                told = np.concatenate([told, h[starts][new & (held > 1)]])
            starts, held = starts[new], held[new]
            say = np.concatenate([np.where(held > 1, KNOWS, ASKS), np.full(len(mine), BOTH)]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {"asked": pa.array((4 * np.concatenate([block[d[starts]], block[d[mine]]]) + say).astype(np.int32)), "hash": pa.array(np.concatenate([h[starts], h[mine]]).view(np.int64))}
            )

    return run


class _Block:
    """The state of one block, recomputed from its documents and the answers so far."""

    def __init__(self, table: pa.Table, answers: pa.Table | None, window: int) -> None:
        self.table, self.answers = table, answers
        self.ids = table["doc_id"].fill_null(2**63 - 1).to_numpy()
        self.block = table["block"][0].as_py()
        self.words = Words(table["text"])
        self.lengths = level_lengths(window)

    def _told(self, level: int) -> pa.Table:
        return self.answers.filter(pa.array(self.answers["level"].to_numpy() == level))

    def _recurs(self, level: int) -> np.ndarray:
        """For each word: does the window of the level that starts there recur? At the first level, that of the second may."""
        hashed, at = self.tested(level)
        out = np.zeros(len(self.words.hash) + 1, bool)
        out[at] = np.isin(hashed, self._told(level)["hash"].to_numpy().view(U))
        return out

    def tested(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the candidates of a level, and where they start."""
        long = self.lengths[level]
        if level == 0 and len(self.lengths) > 1:
            return _picked(self.table, self.words, long, self.lengths[1])
        hashed, good = windows(self.words, long)
        good = _known(self.table, self.words, good)
        if level and len(good):
            before = self._recurs(level - 1)
            good &= before[: len(good)]
            if level > 1:
                # The other half stands at the last place where the short window fits.
                step = long - self.lengths[level - 1]
                good &= before[step : step + len(good)]
        at = np.flatnonzero(good)
        return hashed[at], at

    def ask(self, level: int) -> pa.Table:
        """The questions of a level between the first and the last."""
        hashed, at = self.tested(level)
        doc = self.words.doc[at]
        order = np.lexsort((doc, hashed))
        h, d = hashed[order], doc[order]
        starts = np.flatnonzero(first_of_runs(h))
        two = (np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)) if len(d) else np.zeros(0, bool)
        say = np.concatenate([np.where(two, BOTH, ASKS), np.full(int(two.sum()), KNOWS)])
        return pa.table({"asked": pa.array((4 * self.block + say).astype(np.int32)), "hash": pa.array(np.concatenate([h[starts], h[starts][two]]).view(np.int64))})

    def _distinct(self):
        """The distinct candidates of the last level: hash, 32 further bits, smallest doc_id; each candidate's number among them; its place and id."""
        hashed, at = self.tested(len(self.lengths) - 1)
        again = (windows(self.words, self.lengths[-1], 1)[0][at] >> U(32)).astype(np.uint32).view(np.int32)
        ids = self.ids[self.words.doc[at]]
        order = np.lexsort((ids, again, hashed))
        h, g = hashed[order], again[order]
        new = first_of_runs(h) | first_of_runs(g)
        number = np.empty(len(at), np.int64)
        number[order] = np.cumsum(new) - 1
        return h[new], g[new], ids[order][new], number, at, ids

    def ask_last(self) -> pa.Table:
        h, g, low = self._distinct()[:3]
        return pa.table({"block": pa.array(np.full(len(h), self.block, np.int32)), "hash": pa.array(h.view(np.int64)), "more": pa.array(g), "low": pa.array(low)})

    def covered(self) -> np.ndarray:
        """For each word: is it in a window that starts in a document with a smaller id?"""
        h, g, low, number, at, ids = self._distinct()
        told = self._told(len(self.lengths) - 1)
        # Of the distinct candidates and what was told, sorted together: a candidate beside an equal one that was told.
        first, more = np.concatenate([h.view(np.int64), told["hash"].to_numpy()]), np.concatenate([g, told["more"].to_numpy()])
        order = np.lexsort((more, first))
        new = np.flatnonzero(first_of_runs(first[order]) | first_of_runs(more[order]))
        earlier = np.zeros(len(first), bool)
        earlier[order] = np.repeat(np.maximum.reduceat(order >= len(h), new), np.diff(np.append(new, len(order)))) if len(order) else False
        gone = at[earlier[number] | (ids > low[number])] if len(at) else at
        edge = np.zeros(len(self.words.hash) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.subtract.at(edge, gone + self.lengths[-1], 1)
        return np.cumsum(edge)[:-1] > 0


def _earlier(table: pa.Table) -> pa.Table:
    """The last level's answer: the blocks whose window another block holds in a document with a smaller id."""
    h, g, d = (table[c].to_numpy() for c in ("hash", "more", "low"))
    order = np.lexsort((d, g, h))
    new = first_of_runs(h[order]) | first_of_runs(g[order])
    least = d[order][new][np.cumsum(new) - 1] if len(h) else d
    late = order[d[order] > least]
    return table.select(["block", "hash", "more"]).take(pa.array(late))


REMOVED = "doc_id long, n_words long, n_removed long, text string, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
EMPTY = {
    QUESTION: pa.schema([("asked", pa.int32()), ("hash", pa.int64())]),
    LAST: pa.schema([("block", pa.int32()), ("hash", pa.int64()), ("more", pa.int32()), ("low", pa.int64())]),
    REMOVED: pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", SPANS)]),
}


def _removed(table: pa.Table | pa.RecordBatch, words: Words, gone: np.ndarray) -> dict[str, pa.Array]:
    data, offsets, counts = words.data.tobytes(), words.offsets, words.counts
    ends = np.cumsum(counts)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], ends])])
    texts, spans = [], []
    for i in range(table.num_rows):
        said = data[offsets[i] : offsets[i + 1]].split()  # bytes split at these very six characters
        if removed[i]:
            mine = gone[ends[i] - counts[i] : ends[i]]
            said = list(compress(said, ~mine))
            edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
        else:
            spans.append([])
        texts.append(b" ".join(said))
    return {"doc_id": table["doc_id"], "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string()), "spans": pa.array(spans, SPANS)}


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches, size=2 * SLICE):
        words = Words(b["text"])
        yield pa.RecordBatch.from_pydict(_removed(b, words, np.zeros(len(words.hash), bool)))


def _heard(answers: DataFrame, level: int) -> DataFrame:
    more = F.col("more") if "more" in answers.columns else F.lit(0)
    return answers.select(F.lit(level).alias("level"), "block", "hash", more.alias("more"))


def repeats_removed(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words, one space between), spans (removed runs of words, [start, end))."""
    parts = block_count(documents)
    blocks = blocked(documents, parts)
    lengths = level_lengths(window)
    last = len(lengths) - 1
    heard: DataFrame | None = None

    def each(work, schema: str) -> DataFrame:
        """``work`` on every block that has documents, with what it has heard."""

        def one(t: pa.Table, a: pa.Table | None) -> pa.Table:
            out = work(_Block(t, a, window)) if t.num_rows else EMPTY[schema].empty_table()
            released()
            return out

        if heard is None:
            return blocks.groupBy("block").applyInArrow(lambda t: one(t, None), schema)
        return blocks.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(one, schema)

    for level in range(last):
        asked = blocks.mapInArrow(_first(lengths), QUESTION) if level == 0 else each(lambda b, k=level: b.ask(k), QUESTION)
        answers = stored(answered(asked, parts))
        if answers.isEmpty():
            return blocks.mapInArrow(_whole, REMOVED)
        answers = _heard(answers, level)
        heard = answers if heard is None else heard.unionByName(answers)
    answers = _heard(by_hash(each(lambda b: b.ask_last(), LAST), parts, _earlier, f"{ANSWER}, more int"), last)
    heard = answers if heard is None else heard.unionByName(answers)
    return each(lambda b: pa.table(_removed(b.table, b.words, b.covered())), REMOVED)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
