"""Best-fit packing of documents into sequences, with conflicts.

A document is cut into pieces of at most ``capacity`` units (words, or the tokens that ``units`` counts); whole
pieces fill bins of their own and the rest is packed best-fit decreasing: bins are ordered by residual capacity, and from the
smallest residual that is large enough a successor search goes on until the first, that is the
tightest, bin whose bitmaps of sources and duplicate clusters hold neither of the piece's. If none
is compatible a bin is opened. So no bin holds two pieces of one source among the packed rests, or
two texts of one duplicate cluster: by default equal texts, up to case and white space; the query gives
groups of near duplicates (``ngram_join.with_groups``: five words, 0.8).

Documents are dealt into shards by a hash of their id, so a hot source spreads over all of them; a
shard is packed in one task and holds lengths and ids, not texts. The tightest bin is that of the shard (README has the
loss against one packing of all). A source with a third of all
documents still needs a bin for each: that is what the condition says.

Search within a shard: bins are kept in buckets of equal residual. A bucket keeps the bins in order
of opening; a source's own bins are skipped by looking at one bit each, so a step costs no more than
an integer operation.

``written`` puts the words of every bin together.

Defined cases: documents without words take no bin and get one row with bin null; null source or
cluster values conflict with nothing; repeated rows are packed separately (and conflict as one
cluster); null doc_ids are dealt by text; ties in size are broken by hash, then id; a text of any length fills as many bins as it
needs; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, blocks_for, text_of, words_of

CAPACITY = 2048
SHARD = 4_096
RESULT = "doc_id long, bin string, place int, start long, end long, residual long"


def same_text() -> Column:
    """The default duplicate cluster: equal texts up to case and white space; null if there are no words."""
    said = F.trim(F.regexp_replace(F.lower(text_of()), SPACE, " "))
    return F.when(said != "", F.sha2(said, 256))


def dealt_by() -> Column:
    """What deals documents into shards: a hash of the id, or of the text where that is null."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text_of()))


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each item, and the residuals of the bins. Items are taken in the order given.

    sources and clusters: a number from 0, or -1 for none.
    """
    bins: list[list] = []  # residual, sources and clusters as bitmaps
    residuals: list[int] = []  # those that occur, in order
    buckets: dict[int, dict[int, None]] = {}
    out = []

    def put(b: int) -> None:
        r = bins[b][0]
        if r not in buckets:
            buckets[r] = {}
            insort(residuals, r)
        buckets[r][b] = None

    def take(b: int) -> None:
        r = bins[b][0]
        del buckets[r][b]
        if not buckets[r]:
            del buckets[r]
            del residuals[bisect_left(residuals, r)]

    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 1 << source if source >= 0 else 0
        c = 1 << cluster if cluster >= 0 else 0
        found = -1
        for r in residuals[bisect_left(residuals, size) :]:
            for b in buckets[r]:
                if not (bins[b][1] & s or bins[b][2] & c):
                    found = b
                    break
            if found >= 0:
                break
        if found < 0:
            found = len(bins)
            bins.append([capacity, 0, 0])
        else:
            take(found)
        it = bins[found]
        it[0] -= size
        it[1] |= s
        it[2] |= c
        if it[0]:
            put(found)
        out.append(found)
    return out, [b[0] for b in bins]


def _numbers(values: pd.Series) -> list[int]:
    return pd.factorize(values, sort=True)[0].tolist()


def pack(documents: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, units: Column | None = None, shard_size: int = SHARD, deal: Column | None = None) -> DataFrame:
    """doc_id, bin, place (in the bin), start, end (units of the document), residual (of the bin, at the end).

    units: the length of each document, such as n_tokens of ``token_counts.trees``; words by default. deal: ``dealt_by`` of each, where that is known.
    With cluster, units and deal no text is read.
    """
    length = (F.size(words_of(text_of())) if units is None else F.coalesce(units, F.lit(0))).cast("long")
    items = documents.select("doc_id", F.col("source").alias("source"), (same_text() if cluster is None else cluster).alias("cluster"), length.alias("units"), (dealt_by() if deal is None else deal).alias("deal"))
    shards = blocks_for(documents.count(), shard_size)

    def shard(key: tuple[int], f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(rest=f["units"] % capacity).sort_values(["rest", "deal", "doc_id", "units"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        rows = []
        for i, n in zip(f["doc_id"].tolist(), f["units"].tolist(), strict=True):
            i = None if pd.isna(i) else int(i)
            if not n:
                rows.append((i, None, None, 0, 0, None))
            for k in range(n // capacity):
                rows.append((i, f"{key[0]}f{len(rows)}", 0, k * capacity, (k + 1) * capacity, 0))
        own = f[f["rest"] > 0]
        where, left = best_fit(own["rest"].tolist(), _numbers(own["source"]), _numbers(own["cluster"]), capacity)
        filled: dict[int, int] = {}
        for i, n, r, b in zip(own["doc_id"].tolist(), own["units"].tolist(), own["rest"].tolist(), where, strict=True):
            place = filled[b] = filled.get(b, -1) + 1
            rows.append((None if pd.isna(i) else int(i), f"{key[0]}b{b}", place, n - r, n, left[b]))
        out = pd.DataFrame(rows, columns=["doc_id", "bin", "place", "start", "end", "residual"])
        return out.astype({"doc_id": "Int64", "place": "Int32", "start": "int64", "end": "int64", "residual": "Int64"})

    dealt = items.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(shard, RESULT)


def written(documents: DataFrame, packed: DataFrame) -> DataFrame:
    """bin, text (its pieces in order, a blank line between), doc_ids, n_words: the sequences of a packing by words.

    A bin holds at most its capacity, so its pieces fit a row. Ids must be unique; rows without one are left out.
    """
    pieces = packed.where(F.col("bin").isNotNull() & F.col("doc_id").isNotNull())
    words = documents.select("doc_id", words_of(text_of()).alias("words"))
    said = pieces.join(words, "doc_id").select("bin", "place", "doc_id", F.array_join(F.slice("words", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int")), " ").alias("said"), (F.col("end") - F.col("start")).alias("n"))
    one = F.array_sort(F.collect_list(F.struct("place", "doc_id", "said")))
    return said.groupBy("bin").agg(one.alias("pieces"), F.sum("n").alias("n_words")).select(
        "bin", F.array_join(F.transform("pieces", lambda p: p["said"]), "\n\n").alias("text"), F.transform("pieces", lambda p: p["doc_id"]).alias("doc_ids"), "n_words"
    )
