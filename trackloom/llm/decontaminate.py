"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Texts are lower-cased, stripped of everything but letters, digits and white space, and cut into
shingles of ``width`` words; an item with fewer words is one shingle, all of it. An item leaks into a
document if the document holds at least ``containment`` of the item's distinct shingles.

Search. A shingle's hash is its place in a random order. Both sides are sketched by it, in partitions of
the items by size (powers of two of their shingle count). An item's sketch is the bottom of its hashes: as many as
its shingles that may be missing, and ``SPARE`` more. A document's sketch in a partition is all its
hashes up to the largest one in the partition's item sketches (MinHash at a threshold), so that a short passage in a
long document is in it; a document has a sketch only in partitions whose smallest item it is long enough
to contain. Rows with equal ids are one document whose length isn't known from one row; they have sketches in all partitions. The share of an item's sketch that a document's has estimates the containment; a pair is a
candidate if it is as much as a true pair can't fall below: of a sketch, at most the shingles that may
be missing are missing. So no true pair is lost.

Of a document's sketch only hashes that a Bloom filter of the item sketches holds leave the row: it grows with the items'
sketches (``BITS_EACH``) up to a bound (``BLOOM_BITS``), so it can go to all executors.

Verification. Candidate documents are read again and the real shingles are compared.

Defined cases: a null or empty text has no shingles, and an item without words matches nothing; repeated
shingles count once; rows with equal ids are one document (or item) whose shingles are the union; a
document with a null doc_id has no leaks; equal items are found each; texts of any length are read whole; extra columns are ignored,
and ``decontaminate`` keeps them; with an empty table on either side there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, rolled, small, stored, text_of, words_of

WIDTH = 5
#: Share of an item's shingles, in hundredths.
CONTAINMENT = 80
#: Hashes of an item's sketch beyond those that may be missing: a true pair has so many in common at least.
SPARE = 4
#: Bits of the filter for each hash of the item sketches, and at most: 64 MB, enough for 30 million hashes. Beyond, more pass and nothing else changes.
BITS_EACH, BLOOM_BITS = 16, 1 << 29
#: Shingles of the items are sent to all executors only up to so many bytes.
BROADCAST_BYTES = 32 << 20


def clean_words(text: Column) -> Column:
    return words_of(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))


def _hashed(text: Column) -> Column:
    return F.transform(clean_words(text), lambda w: F.xxhash64(w))


def document_hashes(text: Column, widths: list[int]) -> Column:
    """Hashes of all shingles of the given widths."""
    return let(_hashed(text), lambda h: F.concat(*[rolled(h, w) for w in widths]))


def item_hashes(text: Column, width: int) -> Column:
    """Hashes of the distinct shingles, or of the whole if it is shorter than one."""

    def own(h: Column) -> Column:
        out = F.when(F.size(h) >= width, rolled(h, width))
        for k in range(1, width):
            out = out.when(F.size(h) == k, rolled(h, k))
        return out.otherwise(F.array().cast("array<bigint>"))

    return F.array_distinct(let(_hashed(text), own))


def shingles(words: Column, width: int) -> Column:
    """The shingles of ``width`` words themselves; none if there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))
    return F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<string>"))


def sketches(benchmark: DataFrame, width: int = WIDTH, containment: int = CONTAINMENT) -> DataFrame:
    """item_id, n (shingles), part (size partition), need (hashes of the sketch that a true pair has in common), hash: one row a hash of an item's sketch."""
    own = benchmark.select("item_id", F.explode(item_hashes(text_of(), width)).alias("hash")).distinct()
    per = own.groupBy("item_id").agg(F.array_sort(F.collect_list("hash")).alias("all"))
    n = F.size("all")
    may_miss = F.floor(n * (100 - containment) / 100).cast("int")
    length = F.least(n, may_miss + SPARE)
    return per.select(
        "item_id",
        n.alias("n"),
        F.floor(F.log2(n.cast("double"))).cast("int").alias("part"),
        (length - may_miss).alias("need"),
        F.explode(F.slice("all", 1, length)).alias("hash"),
    )


def _places(hash_: Column, bits: int) -> list[Column]:
    return [F.pmod(hash_, F.lit(bits)), F.pmod(F.shiftrightunsigned(hash_, 32), F.lit(bits))]


def in_bloom(filter_: Column, hash_: Column, bits: int) -> Column:
    """Does the filter hold a hash? Always, if it was put in."""
    one, two = (F.getbit(F.get(filter_, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _places(hash_, bits))
    return one & two


def bloom(hashes: DataFrame, bits: int) -> DataFrame:
    """One row with ``bloom``: the filter of the column ``hash`` as an array of 64-bit words."""
    placed = hashes.select(F.explode(F.array(*_places(F.col("hash"), bits))).alias("bit"))
    held = placed.select(F.expr("bit div 64").alias("word"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("one"))
    none = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("one"))
    words = held.unionByName(none).groupBy("word").agg(F.bit_or("one").alias("one"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "one"))), lambda x: x["one"]).alias("bloom"))


def _widths(benchmark: DataFrame, width: int) -> list[int]:
    """The shingle widths that occur among the items: at most ``width`` numbers."""
    n = F.size(clean_words(text_of()))
    return sorted(r["w"] for r in benchmark.select(F.least(n, F.lit(width)).alias("w")).where("w > 0").distinct().collect())


def search(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: int = CONTAINMENT) -> DataFrame:
    """Candidate pairs (doc_id, item_id): every pair that verification could confirm, and few others."""
    sketch = stored(sketches(benchmark, width, containment))
    # One row for each power of two, so at most 31.
    parts = sketch.groupBy("part").agg(F.min("n").alias("least"), F.max("hash").alias("limit")).collect()
    bits = min(BLOOM_BITS, 1 << max(13, (BITS_EACH * sketch.count() - 1).bit_length()))
    known = stored(bloom(sketch.select("hash"), bits))

    def held(x: Column) -> Column:
        return in_bloom(F.col("_bloom"), x, bits)

    def under(h: Column, x: Column) -> Column:
        return x <= F.array_max(F.array(F.lit(-(2**63)), *[F.when(F.col("_again") | (F.size(h) * 100 >= p["least"] * containment), F.lit(p["limit"])) for p in parts]))

    found = let(document_hashes(text_of(), _widths(benchmark, width) or [width]), lambda h: F.array_distinct(F.filter(h, lambda x: held(x) & under(h, x))))
    repeated = stored(documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("again")))
    named = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").join(small(repeated), "doc_id", "left").select("doc_id", "text", F.coalesce("again", F.lit(False)).alias("_again"), known.scalar().alias("_bloom"))
    sent = named.select("doc_id", F.explode(found).alias("hash"))
    met = sent.join(small(sketch.select("item_id", "need", "hash")), "hash").distinct()
    return met.groupBy("doc_id", "item_id", "need").agg(F.count(F.lit(1)).alias("common")).where("common >= need").select("doc_id", "item_id")


def contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: int = CONTAINMENT) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_matched: pairs with n_matched * 100 >= n_shingles * containment."""
    pairs = stored(search(documents, benchmark, width, containment))
    suspects = documents.join(small(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    own = let(clean_words(text_of()), lambda w: F.when(F.size(w) >= width, shingles(w, width)).when(F.size(w) > 0, F.array(F.array_join(w, " "))))
    items = benchmark.select("item_id", F.explode(own).alias("shingle")).distinct()
    sizes = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    # Only shingles of candidate items are looked up, each in the documents it is a candidate for.
    wanted = items.join(small(pairs.select("item_id").distinct()), "item_id", "left_semi")
    widths = _widths(benchmark, width) or [width]
    said = suspects.select("doc_id", F.explode(F.array_distinct(let(clean_words(text_of()), lambda w: F.concat(*[shingles(w, k) for k in widths])))).alias("shingle"))
    wanted = stored(wanted)
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("shingle")), F.lit(0))).first()[0]
    matched = said.join(small(wanted) if size <= BROADCAST_BYTES else wanted.hint("merge"), "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_matched"))
    return (
        matched.join(pairs, ["doc_id", "item_id"], "left_semi")
        .join(sizes, "item_id")
        .where(F.col("n_matched") * 100 >= F.col("n_shingles") * containment)
        .select("doc_id", "item_id", "n_shingles", "n_matched")
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: int = CONTAINMENT) -> DataFrame:
    """The documents into which no item leaks, with all their columns; those with a null doc_id stay."""
    bad = stored(contaminated(documents, benchmark, width, containment).select("doc_id").distinct())
    return documents.join(small(bad), "doc_id", "left_anti")
