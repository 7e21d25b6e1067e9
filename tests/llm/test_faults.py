"""Cases that earlier forms of the operators got wrong, or took too long over."""

from __future__ import annotations

import random
import re
import time
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from tests.llm import brute
from trackloom.llm import decontaminate, line_dedup, ngram_join, secret_scan
from trackloom.llm.common import arrow_rows


def test_decontamination_unites_rows_with_equal_ids(spark):
    """An item of 40 words, no row of the document long enough to hold its shingles by itself."""
    words = [f"w{n}" for n in range(40)]
    rows = [(1, " ".join(words[:21])), (1, " ".join(words[17:])), (2, " ".join(words)), (3, " ".join(words[:21])), (4, "w1 w2"), (4, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_matched) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 9, 36), (2, 9, 36)}


def test_filter_lets_few_others_pass(spark):
    """The filter grows with the item sketches: of foreign hashes fewer than one in twenty pass."""
    items = spark.range(60_000).selectExpr("id AS item_id", "array_join(transform(sequence(1, 60), k -> concat('i', id, '_', k)), ' ') AS text")
    sketch = decontaminate.sketches(items)
    bits = min(decontaminate.BLOOM_BITS, 1 << max(13, (decontaminate.BITS_EACH * sketch.count() - 1).bit_length()))
    filled = sketch.selectExpr("explode(array(pmod(hash, {0}L), pmod(shiftrightunsigned(hash, 32), {0}L))) AS bit".format(bits)).distinct().count() / bits
    assert filled**2 < 0.05


PREFIX = {"assign": "password", "access": "AKIA", "hex": "0a", "private_key": "-----BEGIN ", "hub_token": "ghp_", "jwt": "eyJ", "chat_token": "xoxb-", "cloud_key": "AIza", "live_key": "sk_live_"}
#: What makes the index pass a text on to each rule.
SEEN = " password AKIA -----BEGIN PRIVATE KEY----- ghp_ eyJ .eyJ xoxb- AIza sk_live_ rk_test_"


@pytest.mark.parametrize("kind", sorted(PREFIX))
def test_rules_are_linear_on_their_own_prefix(spark, kind):
    rules = tuple(r for r in secret_scan.RULES if r.kind == kind)
    took = []
    for size in (1_000, 100_000, 1_000_000):
        docs = spark.createDataFrame([(1, PREFIX[kind] * (size // len(PREFIX[kind])) + SEEN)], "doc_id long, text string")
        began = time.perf_counter()
        secret_scan.scan(docs, rules).selectExpr("size(spans)").collect()
        took.append(time.perf_counter() - began)
    assert took[2] < 30 * max(0.5, took[1])  # ten times the text; the square would be a hundred


def test_tokens_of_three_parts_stand_apart(spark):
    token = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    text = f"{token} {token},x{token} -{token}\n{token}"
    docs = spark.createDataFrame([(None, text), (None, "hex " + "0" * 40), (None, None)], "doc_id long, text string")
    got = {r.spans for r in secret_scan.digest(secret_scan.scan(docs)).collect()}
    want = ",".join(f"jwt:{m.start()}:{m.end()}" for m in re.finditer(rf"(?<![A-Za-z0-9_-]){re.escape(token)}", text))
    assert got == {want, "hex:4:44", ""} and want.count("jwt") == 3


def test_texts_of_many_classes_stay_where_they_are(spark, monkeypatch):
    """Keys too many to broadcast: same links, groups and copies as with a broadcast, also where most rows pass the filter by chance; no exchange of texts."""
    rng = random.Random(21)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[:58])) if i % 3 else (None, None), (3 * i + 2, " ".join(words)) if i % 2 else (3 * i, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda: [sorted(map(str, f(docs).collect())) for f in (lambda d: ngram_join.with_groups(d, "near"), ngram_join.deduplicated)]
    want, plain = told(), ngram_join.small
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    texts = docs.select("text", ngram_join.row_key().alias("rkey"))
    keys = texts.where("text IS NOT NULL").limit(40).select("rkey").distinct()
    found = ngram_join._among(texts, keys, texts)
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.rkey for r in found.collect()) == sorted(r.rkey for r in texts.join(keys, "rkey").collect())
    monkeypatch.setattr(ngram_join, "small", lambda df: plain(df, 0))
    monkeypatch.setattr(ngram_join, "BLOOM_BITS", 64)
    assert told() == want
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(docs, 4, 85).collect()) == Counter(brute.links(rows, 4, 85))


def test_line_dedup_parses_every_text_once_a_pass(spark, monkeypatch):
    """Spark makes a filter of ``explode``, which split and parsed every text a second time."""
    plans, plain = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    docs = spark.createDataFrame([(i, f"  a  1b c{i} d \n\tx 2 y\v{i}z w@\r\n\n{'q  ' * 49}q") for i in range(9)], "doc_id long, text string")
    lines = line_dedup.lines_of(docs.repartition(2))
    assert [p.count("split(") for p in plans] == [1, 1]
    assert {r.said for r in lines.collect()} == {"a  * * d", "x * y * *", ("q  " * 49) + "q"}
    # The long line has 50 words; of 49 words and as many tokens it is none.
    assert {r.line for r in line_dedup.passages(lines, 10).collect()} == {3}
    fewer = spark.createDataFrame([(i, ("q  " * 48) + "q") for i in range(9)], "doc_id long, text string").union(spark.createDataFrame([(20, ("q  " * 48) + "q\n")], "doc_id long, text string"))
    assert line_dedup.passages(line_dedup.lines_of(fewer), 20).isEmpty()


def test_workers_hold_little_of_a_batch_of_texts():
    """14 MB of text in one batch; slices of 8 MB took 34 MB beside it."""
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(5000)]
    ids = pa.array(range(4000), pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([" ".join(rng.choices(vocabulary, k=400)) for _ in range(4000)])], ["doc_id", "rkey", "text"])
    run = ngram_join._signed(5, 80)
    rows = sum(b.num_rows for b in run([batch]))  # the tables of powers stay
    tracemalloc.start()
    rows += sum(b.num_rows for b in run([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 8000 and peak < 30e6


def test_workers_are_sent_few_rows_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    with arrow_rows(spark, 7):
        assert max(r.n for r in spark.range(0, 50, 1, 2).mapInArrow(sizes, "n long").collect()) == 7
    assert spark.conf.get(name) == before


def test_measured_rows_are_those_of_the_groups_without_texts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 40]))]
        rows += [(2 * i, " ".join(words), f"s{i % 4}"), (2 * i + 1 if i % 5 else None, "\n ".join([*words, "x"]) if i % 3 else None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = ngram_join.measured(docs, "near", ("source",))
    assert got.columns == ["doc_id", "source", "words", "near"]
    want = ngram_join.with_groups(docs, "near").selectExpr("doc_id", "source", "size(array_remove(split(coalesce(text, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), ''))", "near")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
