"""SimHash classes, ranked search and conversation repair against plain versions, on odd rows too."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tests.llm.test_operators import SCHEMA, corpus
from trackloom.llm import repair, search, simhash

low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{n % 3}", len(t or ""), "h", 1, 0.5, 2, "c", 3, 4, "w") for n, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


# SimHash


def fingerprint(text) -> int:
    w = low(text).encode().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked_by_fingerprint(rows, distance=2):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)].append(i)
    return Counter((i, f"{fps[a]:016x}", min(least[find(a)], default=None)) for a, (i, _) in enumerate(rows))


def test_xxh64_is_the_published_function():
    rng = random.Random(1)
    runs = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(70), 95, 96, 97, 1000] * 3]
    size = np.array([len(x) for x in runs])
    data = np.frombuffer(b"".join(runs) + bytes(8), np.uint8)
    for seed in (0, 42):
        assert [int(x) for x in simhash.xxh64(data, np.cumsum(size) - size, size, seed)] == [xxhash.xxh64_intdigest(x, seed) for x in runs]


def test_fingerprints_of_odd_and_long_texts():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["aB", "cd", "é", "日本語", "xyzzy" * 9, "Q"], k=n)) + e for n in (0, 1, 2, 3, 4, 254, 255, 256, 257, 600) for e in ("", " ", "\n", "\x0b")]
    texts += ["", "  ", "a\t\tb  c\nD", "x" * 3_000_000 + " y z", "w " * 300_000]
    assert [int(x) for x in simhash.fingerprints(pa.array(["zz", *texts]).slice(1))] == [fingerprint(t) for t in texts]
    assert len(simhash.fingerprints(pa.array([], pa.string()))) == 0


@pytest.mark.parametrize(("cell", "wide"), [(simhash.CELL, simhash.WIDE), (3, 1 << 20), (2, 4)])
def test_simhash_classes(docs, cell, wide):
    """Also with values that are frequent: split into blocks, and asked about one by one."""
    out = simhash.classes(docs, cell=cell, wide=wide)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()) == linked_by_fingerprint(corpus())


def test_simhash_of_nothing(spark):
    assert simhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("parts", [[simhash.Part(tuple(range(32)), 1), simhash.Part(tuple(range(32, 64)), 0)], [simhash.Part(tuple(range(20)), 2)], None])
def test_every_allotment_finds_all_links(spark, parts):
    """Random fingerprints around a few centres; every pair within the distance must be tied."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(4)]
    # Where only 20 bits are probed, fingerprints differ in these alone.
    bits = 20 if parts and len(parts) == 1 else 64
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(bits), rng.choice([1, 2, 3]))) for c in centres for _ in range(60)})
    long = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(long(x), k) for k, x in enumerate(fps)], "fp long, least long")
    found = simhash.edges(nodes, parts or simhash.planned(nodes), cell=8).collect()
    root = {long(x): long(x) for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        assert ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 2 or find(r.u) is not None
        root[find(r.u)] = find(r.v)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                assert find(long(a)) == find(long(b))


def test_thresholds_add_up_and_spare_frequent_values():
    assert simhash.allotted([[0, 1, 5, 9], [0, 1, 5, 9], [0, 1, 5, 9], [0, 900, 950, 999]], 2) == (3, [0, 0, 0, -1])
    assert sum(simhash.allotted([[0, 7, 8, 9], [0, 100, 200, 300]], 2)[1]) == 1
    correlation = np.zeros((64, 64))
    for group in range(4):
        own = [4 * k + group for k in range(16)]
        correlation[np.ix_(own, own)] = 0.5
    parts = simhash.grouped_bits(correlation, 4)
    assert sorted(b for p in parts for b in p.bits) == list(range(64)) and all(len({b % 4 for b in p.bits}) == 1 for p in parts)


# Ranked search

ITEMS = [(1, "W1 w2, w3! don't"), (2, "w1 w1 w7 é"), (3, "日本 a"), (4, None), (5, "zzz"), (2, "w9"), (None, "w5 w6"), (7, " ".join(f"w{n}" for n in range(90)))]


def best_documents(rows, items, best):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    said = [(i, Counter(cut(t))) for i, t in rows]
    said = [(i, c) for i, c in said if c]
    n, total = len(said), sum(c.total() for _, c in said)
    df = Counter(t for _, c in said for t in c)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(cut(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in said:
            m = 100 - 75 + (75 * c.total() * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in terms.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:best])]
    return Counter(out)


@pytest.mark.parametrize(("best", "block", "cells", "step"), [(10, 50_000, 1 << 22, 64), (3, 50_000, 1, 2), (10, 5, 1, 1)])
def test_ranked_search(spark, docs, monkeypatch, best, block, cells, step):
    """Also in blocks of few items, slices of few documents and steps of few scores."""
    monkeypatch.setattr(search, "BLOCK_TERMS", block)
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "STEP", step)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = search.ranked(docs, items, best)
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in out.collect()) == best_documents(corpus(), ITEMS, best)


def test_ranked_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.ranked(docs.limit(0), items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0
    assert search.ranked(docs, items.where("item_id = 5")).count() == 0


def test_masks_that_cannot_reach_are_not_scored():
    """Of 1,000 documents with a common term, ten hold a rare one too: no other is scored once these are found."""
    held = np.zeros((2, 1000), bool)
    held[0], held[1, :10] = True, True
    value = np.where(held, 500, 0).astype(np.int32)
    item = search.Item(np.array([0, 1]), np.array([10, 1000]), 10)
    assert item.search(held, value, value.max(1).astype(np.int64), np.arange(1000), np.zeros(1000, bool)) <= search.STEP
    assert item.id.tolist() == list(range(10))


# Conversation repair


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def plain_repair(rows):
    """The repair of one conversation's rows, by dynamic programming over whole strings of edits from the end."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    goes = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    best = [{} for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        now = {}
        for s in range(4):
            ways = [(0, "")] if i == len(rows) and s in (0, 3) else []
            if i < len(rows):
                ways += [(3 + best[i + 1][s][0], "D" + best[i + 1][s][1])]
                if faults[i] not in ("blank", "duplicate"):
                    more = faults[i] == "truncated"
                    for c, price, e in [(rows[i][2][:1], 0, "K"), ("u", 2, "R"), ("a", 2, "R")]:
                        if (c, s) in goes:
                            rest = best[i + 1][goes[c, s]]
                            ways.append((price + more + rest[0], e + rest[1]))
            now[s] = min(ways, default=(10**9, ""))
        for _ in range(3):
            now = {s: min([now[s], *((2 + now[goes[c, s]][0], "I" + now[goes[c, s]][1]) for c in "ua" if (c, s) in goes)]) for s in range(4)}
        best[i] = now
    cost, audit = best[0][0]
    length = sum(e != "D" for e in audit)
    out, k, o = [], 0, 0
    for e in audit:
        o += e != "D"
        role = "user" if (o + length) % 2 == 1 else "assistant"
        if e == "I":
            out.append(f"{role}:")
            continue
        row, k = rows[k], k + 1
        if e != "D":
            out.append(f"{row[2] if e == 'K' else role}:{row[3]}")
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in repair.FAULTS), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def odd_conversations():
    rng = random.Random(7)
    say = lambda: rng.choice(["Yes.", "No!", "open", "", " \n", "Why?  ", "ok\t", None, "é?", "same.", "same."])
    rows = [(c, rng.choice([None, k, k, k, k // 2]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", None, ""]), say()) for c in [*range(40), None] for k in range(rng.randrange(1, 12))]
    # One conversation holds more than a third of all rows, and one is regular.
    rows += [(500, k, ("user", "assistant")[k % 2] if rng.random() < 0.8 else rng.choice(["system", "tool"]), rng.choice([f"Number {k}.", f"Number {k}", "again?"])) for k in range(400)]
    return rows + [(501, 0, "system", "Be good."), (501, 1, "user", "Hi."), (501, 2, "assistant", "Hello.")]


def test_structure_repair(spark):
    rows = odd_conversations()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, block int").repartition(6)
    by = defaultdict(list)
    for r in harmed(rows):
        by[r[0]].append(r)
    want = Counter((i, *(plain_repair(by[i]))) for i in {r[0] for r in rows})
    got = repair.digest(frame, repair.damaged(frame)).collect()
    assert Counter(tuple(r) for r in got) == want


def test_repaired_turns_alternate(spark):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = defaultdict(list)
    for r in sorted(repair.repaired(frame).collect(), key=lambda r: (r.place, r.k)):
        said[r.conv_id].append(r.role[0])
    assert said[501] == ["s", "u", "a"] and len(said[500]) > 200
    assert all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in said.values())


def test_structure_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.digest(none, repair.damaged(none)).count() == 0
