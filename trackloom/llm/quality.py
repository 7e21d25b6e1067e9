"""Quality rules: a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits and runs of other visible characters;
tokens and pairs of neighbours are hashed into ``buckets`` counts. One pass over the corpus counts
them for all documents (the raw multinomial, over every text) and for the trusted ones (the target
multinomial). A document's score is the mean over its n-grams of log(target / raw) of their
buckets, both smoothed: its log-likelihood ratio, normalised by length. It is kept if the score
reaches the threshold, a parameter, so that the verdict depends on the two counts and the text alone.

The trusted side is fitted on at most ``TRUSTED_ROWS`` rows labelled 1 (those with the smallest
hash of doc_id), whose ids can so be broadcast; everything else covers all rows.

Base rules, before the score: see ``base_stats``.

Defined cases: a null text has no words and fails the base rules; a document without n-grams scores
0; with no trusted rows all scores are 0; a repeated doc_id is trusted in all its rows; a null
doc_id is never trusted; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, rolled, stored, text_of, words_of

BUCKETS = 8192
TRUSTED_ROWS = 20_000
#: Nats an n-gram. Ordinary prose scores about 0; markup and noise lie far below.
THRESHOLD = -0.25
SMOOTHING = 1.0
MIN_WORDS = 20
MAX_REPEATED = 30
WINDOW = 8
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"


def _covered(windows: Column, width: int) -> Column:
    """How many positions lie in a window whose hash occurs twice or more."""

    def repeated(pairs: Column) -> Column:
        same = lambda a, b: F.coalesce(F.get(pairs, a)["h"] == F.get(pairs, b)["h"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), lambda i: same(i, i + 1) | ((i > 0) & same(i, i - 1)))
        starts = F.array_sort(F.transform(at, lambda i: F.get(pairs, i)["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, s: F.struct((a["n"] + s + width - F.greatest(s, a["end"])).alias("n"), (s + width).alias("end")),
            lambda a: a["n"],
        )

    def count(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, repeated))

    return let(windows, count)


def base_stats(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text, as a struct of longs."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    repeats = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _covered(rolled(h, WINDOW), WINDOW)).alias("r")))
    return let(
        repeats,
        lambda r: F.struct(
            r["n"].cast("long").alias("n_words"),
            r["c"].cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            r["r"].cast("long").alias("n_repeat_words"),
        ),
    )


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of all tokens and of all pairs of neighbours of a text."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    place = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return let(
        F.transform(tokens, lambda t: F.xxhash64(t)),
        lambda h: F.concat(F.transform(h, place), F.transform(rolled(h, 2), place)),
    )


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row with ``ratio``: the log ratio of every bucket, an array of ``buckets`` doubles."""
    spark = documents.sparkSession
    ids = F.broadcast(trusted_ids(labels, rows).withColumn("trusted", F.lit(1)))
    grams = documents.select("doc_id", F.explode(ngram_buckets(text_of(), buckets)).alias("bucket"))
    # Counting by document would shuffle more; by task, a bucket is one row.
    counted = grams.join(ids, "doc_id", "left").groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
    none = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("raw"), F.lit(0).cast("long").alias("target"))
    all_ = counted.union(none).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    one = all_.agg(
        F.array_sort(F.collect_list(F.struct("bucket", "raw", "target"))).alias("cells"),
        F.sum("raw").alias("n_raw"),
        F.sum("target").alias("n_target"),
    )
    share = lambda c, n: F.log((c + SMOOTHING) / (n + SMOOTHING * buckets))
    ratio = F.transform("cells", lambda c: F.when(F.col("n_target") > 0, share(c["target"], F.col("n_target")) - share(c["raw"], F.col("n_raw"))).otherwise(0.0))
    return one.select(ratio.alias("ratio"))


def judge(documents: DataFrame, model: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, score (per n-gram), n_ngrams."""
    held = stored(model)
    stats = documents.withColumn("_text", text_of()).withColumn("_ratio", held.scalar()).select(
        "doc_id",
        base_stats(F.col("_text")).alias("s"),
        let(
            ngram_buckets(F.col("_text"), buckets),
            lambda b: F.struct(
                F.size(b).cast("long").alias("n_ngrams"),
                F.when(F.size(b) > 0, F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(F.col("_ratio"), x)) / F.size(b)).otherwise(0.0).alias("score"),
            ),
        ).alias("g"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (
        stats.select("doc_id", "s.*", "g.score", "g.n_ngrams")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "n_ngrams")
    )


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(documents, fit(documents, labels))
