"""Toxicity: a weighted lexicon matched by Aho-Corasick, with folding and exceptions.

Texts are folded before anything else: lower case, look-alike letters of other scripts and
full-width forms to Latin ones, and digits and signs inside words to the letters they stand for.

The lexicon is learned from labelled rows: whole words, and beginnings of words of ``SHORTEST`` to
``LONGEST`` letters, that are far commoner in toxic texts; a term's weight is its smoothed
log-odds. Words that a beginning would catch but that occur in clean texts, and never in toxic
ones, become exceptions; further exception phrases are a parameter. A match of an exception
covers the term matches that start inside it.

A text's score is a logistic function of the sum of its matches' weights and of that sum per 100
words, fitted to the labelled rows by weighted least squares.

The fit reads a bounded sample: labelled rows in the order of a hash of doc_id, at most
``LABELLED_ROWS`` of them and, as whole texts, at most ``LABELLED_CHARS`` code points together. Every
term and every exception that the sample bears out is kept, none is cut off: a term has at least
``SHORTEST`` letters and stands in at least ``LEAST_TEXTS`` texts, so the bound on the sample bounds the
lexicon that is sent to all executors. Scoring covers every whole text, in time linear in its length.

Defined cases: a null text is empty; empty texts get the score of a text without matches; without
toxic or without clean labels no lexicon is learned and all scores are 0; a doc_id labelled twice
is toxic if one label says so; rows that repeat a doc_id are learned from once (the smallest of
their texts) and scored each; equal texts get equal scores; null doc_ids are scored and never held out;
a labelled text longer than the bound on the sample is not learned from; texts of any length, with or
without spaces, are scored whole; extra columns are ignored, and ``harmless`` keeps them whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh
from .hashing import released

LABELLED_ROWS = 20_000
LABELLED_CHARS = 100_000_000
SHORTEST, LONGEST = 4, 7
LEAST_WEIGHT = 2.5
LEAST_TEXTS = 5
#: A beginning is a term only if it begins so many different words of toxic texts.
FORMS = 3
THRESHOLD = 0.3
EXCEPTIONS = ("trash can", "trash bin", "recycling bin")

# Look-alike letters (Cyrillic, Greek) and what digits and signs stand for.
LOOKALIKE = dict(zip("абвгеёзіїјкмнорстухѕ", "abbreeziijkmhopctyxs", strict=True)) | dict(zip("αβεικνορτυχ", "abeikvoptyx", strict=True))
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
FOLD = str.maketrans(LOOKALIKE | {chr(0xFF41 + i): chr(0x61 + i) for i in range(26)})
FOREIGN = re.compile("[" + "".join(map(re.escape, LOOKALIKE)) + "ａ-ｚ]")
# A run of letters, digits and signs with a digit or sign that may stand for a letter. Possessive: a run is read once, whatever its length.
DISGUISED = re.compile(r"(?<![\w@$!])[^\W0134578]*+[0134578@$!][\w@$!]*+")
PLAIN = str.maketrans(STANDS_FOR)
WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    text = text.lower()
    if not text.isascii() and FOREIGN.search(text):
        text = text.translate(FOLD)
    if any(c in text for c in STANDS_FOR):
        text = DISGUISED.sub(_plain, text)
    return text


def _plain(m: re.Match) -> str:
    word = m[0].rstrip("!")  # an exclamation mark at the end is one
    return word.translate(PLAIN) + m[0][len(word) :] if any(c.isalpha() for c in word) else m[0]


@dataclass
class Lexicon:
    """Terms: a word's beginning, or a whole word followed by a space. Exceptions: words and phrases."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    fit: tuple[float, float, float] | None = None

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            a.add_word(term.rstrip(" "), (len(term.rstrip(" ")), weight, term.endswith(" ")))
        for phrase in self.exceptions:
            if phrase in a:
                continue
            a.add_word(phrase, (len(phrase), None, True))
        a.make_automaton()
        return a


def evidence(text: str, automaton) -> tuple[float, float]:
    """The sum of the weights matched, and that sum per 100 words."""
    if not len(automaton):
        return 0.0, 0.0
    text = folded(text)
    hits, covers, end_of_text = {}, [], len(text)
    for last, (size, weight, whole) in automaton.iter(text):
        start = last - size + 1
        if (start and text[start - 1].isalpha()) or (whole and last + 1 < end_of_text and text[last + 1].isalpha()):
            continue
        if weight is None:
            covers.append((start, last))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    if covers:
        # Up to which place the exceptions that start at or before a place cover the text.
        covers.sort()
        starts, reach = [], []
        for start, last in covers:
            starts.append(start)
            reach.append(max(last, reach[-1]) if reach else last)
        covered = lambda s: (k := bisect_right(starts, s)) and s <= reach[k - 1]
        hits = {s: w for s, w in hits.items() if not covered(s)}
    total = sum(hits.values())
    return total, 100 * total / max(1, len(text.split()))


def _inputs(total: np.ndarray, dense: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(dense)])


def labelled(documents: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, chars: int = LABELLED_CHARS) -> DataFrame:
    """text, toxic of the rows to learn from: never one whose crc32(doc_id as text) mod 4 is 2."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    # At most ``rows`` rows of two numbers meet in this window.
    upto = F.sum("chars").over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))
    sizes = texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")).where(F.col("chars") <= chars)
    fit = sizes.withColumn("upto", upto).where(F.col("upto") <= chars).select("doc_id")
    return texts.join(F.broadcast(fit), "doc_id").select("text", "toxic")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(sample: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon and its scale from a bounded sample (see ``labelled``) of text and toxic (0 or 1)."""
    sample = sample.cache()
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        sample.unpersist()
        return Lexicon()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                seen[int(toxic)].update(set(WORD.findall(folded(text or ""))))
            for toxic, c in seen.items():
                if c:
                    yield pd.DataFrame({"word": list(c), "toxic": np.where(toxic, list(c.values()), 0), "clean": np.where(toxic, 0, list(c.values()))})

    words = sample.mapInPandas(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).cache()
    starts = F.filter(F.transform(F.sequence(F.lit(SHORTEST), F.lit(LONGEST)), lambda k: F.when(F.length("word") >= k, F.substring(F.col("word"), F.lit(1), k))), lambda x: x.isNotNull())
    each = words.select("t", "c", F.explode(F.concat(F.array_distinct(starts), F.array(F.concat("word", F.lit(" "))))).alias("term"))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    # The bound on the sample bounds the rows that come to the driver.
    found = (
        each.groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if(F.col("t") > 0).alias("forms"))
        .where(F.col("term").endswith(" ") | (F.col("forms") >= FORMS))
        .where((F.col("t") >= max(LEAST_TEXTS, n_toxic // 1000)) & (F.length(F.trim("term")) >= SHORTEST))
        .withColumn("weight", weight)
        .where((F.col("weight") >= LEAST_WEIGHT) & (20 * F.col("c") <= F.col("t")))
        .collect()
    )
    weights = {r["term"]: float(r["weight"]) for r in found}
    # A longer term says no more than a beginning of it that is in the lexicon.
    kept = {t: w for t, w in weights.items() if not any(t[:k] in weights and t[:k] != t for k in range(SHORTEST, min(LONGEST, len(t)) + 1))}
    begins = [t for t in kept if not t.endswith(" ")]
    harmless = words.where((F.col("t") == 0) & (F.col("c") >= 2) & F.substring("word", 1, SHORTEST).isin(sorted({b[:SHORTEST] for b in begins}) or [""]))
    learned = [r["word"] for r in harmless.orderBy("word").collect() if any(r["word"].startswith(b) for b in begins)]
    lexicon = Lexicon(kept, tuple([*learned, *map(folded, exceptions)]))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = lexicon.automaton()
        for f in frames:
            got = [evidence(x or "", a) for x in f["text"]]
            yield pd.DataFrame({"total": [g[0] for g in got], "dense": [g[1] for g in got], "toxic": f["toxic"].astype("int64")})
        released()

    rows = sample.mapInPandas(measure, "total double, dense double, toxic long").toPandas()
    sample.unpersist()
    words.unpersist()
    lexicon.fit = _logistic(_inputs(rows["total"].to_numpy(), rows["dense"].to_numpy()), rows["toxic"].to_numpy(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by iteratively reweighted least squares."""
    order = np.lexsort((y, *x.T))  # whatever the order of the rows, sums are the same
    x, y = x[order], y[order]
    b, keep = np.zeros(x.shape[1]), np.diag([1e-6, 1e-1, 1e-1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + keep, x.T @ (y - p) - keep @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def scored(documents: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """The documents with a column ``name``, 0 to 1."""
    spark = documents.sparkSession
    held = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held.value
        a = own.automaton()
        for s in texts:
            if own.fit is None:
                yield pd.Series(np.zeros(len(s)))
                continue
            got = [evidence(x or "", a) for x in s]
            z = _inputs(np.array([g[0] for g in got]), np.array([g[1] for g in got])) @ np.array(own.fit)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        released()

    return documents.withColumn(name, score(F.col("text")))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= THRESHOLD)."""
    found = scored(documents.select("doc_id", "text"), learn(labelled(documents, labels)))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def harmless(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns."""
    name = fresh(documents, "_tox_score")
    rated = scored(documents, learn(labelled(documents, labels)), name)
    return rated.where(F.col(name) < THRESHOLD).drop(name)
