"""Ranked lexical search of a set of items in all documents, by presence masks.

Terms are the runs of characters other than ASCII ones that are no letters or digits, with A to Z lower-cased. An item
scores each document by BM25 in integers (see ``ranked``) and gets its ``k`` best.

1. Index. Every whole document is cut into terms once, and the terms that an item asks for are kept with their
   frequencies: one row a document. Counts of documents, terms and documents a term come from these rows.
2. Presence masks. For each item, the bitmaps of its terms over a slice of documents are turned into one mask a
   document, and the documents are grouped by mask. The most a mask can score is the sum over its terms of the most that the
   term adds to any document of the slice. Masks are evaluated by that maximum, descending, until the next one's is less
   than the k-th best score so far. Nothing is dropped: a document left out can't score as much.
3. A task returns its k best documents for each item; these meet per item and part, then per item.

The items are dealt into blocks of about ``BLOCK_TERMS`` terms; only a block's terms, weights and masks are sent to the
executors. Terms are compared by 64-bit hashes with the block's few ones.

Defined cases: a null text, or one without terms, is no document for the counts and ranks nowhere; rows are documents of their own
whatever their ids, and rows with equal scores and ids are interchangeable; a null doc_id is ranked like any other, behind equal scores with an
id; items with equal ids are one, whose terms are added up; a null item_id is an item; an item without terms, or whose terms no document
holds, has no rows; extra columns are ignored; with an empty table on either side there are no rows; texts of any length are read
whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks_for, discard, stored, text_of
from .hashing import SLICE, TERM_BREAKS, Words
from .ngram_join import _slices

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents that an item gets.
BEST = 10
#: Terms of the items that are searched at once, about.
BLOCK_TERMS = 50_000
#: Places of a slice's table of terms by documents.
CELLS = 1 << 22
#: Documents whose exact scores are computed at once.
STEP = 64
#: Parts in which the tasks' best documents of an item meet first.
MEETING = 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, LETTERS, LETTERS.lower()), F.lit(f"({TERM})"), F.lit(1))


def asked(items: DataFrame) -> DataFrame:
    """item_id, term, times: what each item asks for."""
    return items.select("item_id", F.explode(terms_of(text_of())).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _hashes(terms: list[str]) -> np.ndarray:
    return Words(pa.array(terms, pa.string()), fold_case=True, breaks=TERM_BREAKS).hash


INDEX = "doc_id long, n long, terms array<int>, times array<long>"


def indexed(documents: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in the list) and times (how often each occurs): documents with a term."""
    hashed = _hashes(terms)
    order = np.argsort(hashed)
    known = documents.sparkSession.sparkContext.broadcast((hashed[order], order.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought, number = known.value
        for b in _slices(batches, size=2 * SLICE):
            words = Words(b["text"], fold_case=True, breaks=TERM_BREAKS)
            at = np.minimum(np.searchsorted(sought, words.hash), len(sought) - 1)
            hit = sought[at] == words.hash
            pairs, times = np.unique(words.doc[hit].astype(np.int64) * len(sought) + number[at[hit]], return_counts=True)
            doc, term = np.divmod(pairs, len(sought))
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
            out = pa.RecordBatch.from_arrays([b["doc_id"], pa.array(words.counts, pa.int64()), lists(term, pa.int32()), lists(times, pa.int64())], [x.split()[0] for x in INDEX.split(", ")])
            yield out.filter(pa.array(words.counts > 0))

    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, INDEX)


class Item:
    """The terms (numbers) an item asks for, what each weighs, and its best documents so far."""

    def __init__(self, terms: np.ndarray, weight: np.ndarray, best: int) -> None:
        self.terms, self.weight, self.best = terms, weight, best
        self.score, self.id, self.unnamed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """What a document must score to be among the best."""
        return int(self.score[-1]) if len(self.score) == self.best else 1

    def add(self, score: np.ndarray, id_: np.ndarray, unnamed: np.ndarray) -> None:
        good = score >= self.least()
        score, id_, unnamed = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.id, id_), (self.unnamed, unnamed)))
        order = np.lexsort((id_, unnamed, -score))[: self.best]
        self.score, self.id, self.unnamed = score[order], id_[order], unnamed[order]

    def search(self, held: np.ndarray, value: np.ndarray, most: np.ndarray, id_: np.ndarray, unnamed: np.ndarray) -> int:
        """Takes a slice: which document holds which term, what that is worth, and the most it is worth in the slice. Returns how many documents were scored."""
        bitmaps = held[self.terms]
        packed = np.packbits(bitmaps, axis=0)
        masks = np.zeros((bitmaps.shape[1], -(-len(packed) // 8) * 8), np.uint8)
        masks[:, : len(packed)] = packed.T
        masks = masks.view(np.uint64) if masks.shape[1] == 8 else masks.view(f"V{masks.shape[1]}")
        _, first, group = np.unique(masks.ravel(), return_index=True, return_inverse=True)
        # Sums stay below 2**53, so they are exact in doubles.
        reach = (self.weight * most[self.terms]).astype(np.float64) @ bitmaps[:, first].astype(np.float64)
        open_ = np.flatnonzero(reach[group] >= self.least())
        open_ = open_[np.lexsort((group[open_], -reach[group[open_]]))]
        reach = reach[group[open_]]
        done = 0
        while done < len(open_) and reach[done] >= self.least():
            docs = open_[done : done + STEP]
            self.add(self.weight @ value[np.ix_(self.terms, docs)].astype(np.int64), id_[docs], unnamed[docs])
            done += len(docs)
        return done


FOUND = "item_id long, doc_id long, score long"


def _searched(index: DataFrame, items: list[tuple[int | None, list[int], list[int]]], terms: int, n: int, total: int, best: int) -> DataFrame:
    """Every task's best documents of each item."""
    sent = index.sparkSession.sparkContext.broadcast(items)
    rows = max(STEP, CELLS // terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Item(np.array(t, np.int64), np.array(w, np.int64), best) for _, t, w in sent.value]
        held, value = np.zeros((terms, rows), bool), np.zeros((terms, rows), np.int32)
        for b in (batch.slice(k, rows) for batch in batches for k in range(0, batch.num_rows, rows)):
            id_, unnamed = b["doc_id"].fill_null(0).to_numpy(), b["doc_id"].is_null().to_numpy(zero_copy_only=False)
            size = b["n"].to_numpy()
            m = 100 - 75 + 75 * size * n // total
            doc = np.repeat(np.arange(b.num_rows), b["terms"].value_lengths().to_numpy())
            term, tf = b["terms"].flatten().to_numpy(), b["times"].flatten().to_numpy()
            worth = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
            held[term, doc], value[term, doc] = True, worth
            most = np.zeros(terms, np.int64)
            np.maximum.at(most, term, worth)
            for item in own:
                item.search(held[:, : b.num_rows], value, most, id_, unnamed)
            held[term, doc], value[term, doc] = False, 0
        ids = np.repeat(np.arange(len(own)), [len(x.score) for x in own])
        if len(ids):
            names = pa.array([x[0] for x in sent.value], pa.int64())
            join = lambda k: np.concatenate([getattr(x, k) for x in own])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(ids)), pa.array(join("id"), mask=join("unnamed")), pa.array(join("score"))], [x.split()[0] for x in FOUND.split(", ")])

    return index.mapInArrow(run, FOUND)


def _best(found: DataFrame, best: int) -> DataFrame:
    """The best of what the tasks have found: first in parts of an item, so that no task gets those of all tasks."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(MEETING))
    near = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "part").orderBy(*by))).where(F.col("rank") <= best)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by))).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents.

    With N documents that have terms, L terms in all, n in a document and df documents with a term, a term
    weighs w = floor(1000 * ln((2 * N + 2) / (2 * df + 1))), a document has m = 25 + 75 * n * N div L, and a
    term that occurs tf times adds w * (1000000000 * tf div (1000 * tf + 8 * m)), as often as the item has it.
    """
    spark = documents.sparkSession
    wanted = stored(asked(items))
    blocks = blocks_for(wanted.count(), BLOCK_TERMS)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for k in range(blocks):
        # One block of the items at a time: about BLOCK_TERMS rows.
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        terms = sorted({r["term"] for r in own})
        if not terms:
            continue
        index = stored(indexed(documents, terms))
        n, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n:
            continue
        df = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        # One row a term of the block.
        weighs = dict(df.select("term", weight.alias("w")).collect())
        number = {t: i for i, t in enumerate(terms)}
        by_item: dict[int | None, tuple[list[int], list[int]]] = {}
        for r in own:
            if w := weighs.get(number[r["term"]]):
                t, ws = by_item.setdefault(r["item_id"], ([], []))
                t.append(number[r["term"]])
                ws.append(w * r["times"])
        out = out.unionByName(_best(_searched(index, [(i, t, w) for i, (t, w) in by_item.items()], len(terms), n, total, best), best))
    discard(wanted)
    return out
