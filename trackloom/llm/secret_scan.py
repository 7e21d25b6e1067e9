"""Secret scans with a trigram inverted index, in DataFrame functions only.

For every rule, a Boolean query over trigrams is derived from its regular expression: for each run of
characters that a match must contain, a text the rule matches holds all trigrams of one of the run's alternatives. ``postings`` is the inverted
index over the trigrams that the rules ask for, ``candidates`` intersects the postings of every
rule, and ``scan`` runs a rule's expression only on its candidates. A rule without a mandatory
trigram is run on every text.

Defined cases: a null text is empty; documents with a null or repeated doc_id are scanned row by
row like any other (candidates of a repeated id are the union of its rows', those of rows without one go by their texts); extra columns are
ignored; an empty table gives no rows; whole texts of any length are scanned.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, small, stored, text_of


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans. A match counts if its group ``group`` (0: all of it) has ``least`` code points.

    ``apart``: a class of characters none of which stands right before a match. A pattern that begins inside its own first run needs
    it: else a long run is read again from each place where it could begin.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    apart: str = ""

    @property
    def bounded(self) -> str:
        return f"(?<!{self.apart}){self.pattern}" if self.apart else self.pattern


#: The base kinds, in the order that breaks ties, then the method's own.
BASE = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
EXTRA = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", apart="[A-Za-z0-9_-]"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live_key", r"[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
)
RULES = BASE + EXTRA

#: An expression is expanded to at most so many exact strings before it is cut there.
EXPANSIONS = 64
#: Matches whose places are put together at a time.
PIECE = 256


def _strings(tree) -> list[set[str] | None]:
    """An expression as consecutive pieces: the lower-cased strings a piece can be, or None for anything."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        if op is sre.LITERAL:
            out.append({chr(arg).lower()})
        elif op is sre.IN:
            chars = {chr(v).lower() for k, v in arg if k is sre.LITERAL}
            simple = all(k is sre.LITERAL for k, _ in arg)
            out.append(chars if simple and len(chars) <= 8 else None)
        elif op is sre.SUBPATTERN:
            out += _strings(arg[-1])
        elif op is sre.BRANCH:
            whole = [_joined(_strings(x)) for x in arg[1]]
            out.append(set().union(*whole) if all(x is not None for x in whole) else None)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = _joined(_strings(inner))
            if one is not None and high == 1 and low == 0:
                out.append(one | {""})
            elif low >= 1:
                # The part that must be there, then an unknown rest.
                out += _strings(inner)
                if high != 1:
                    out.append(None)
            else:
                out.append(None)
        elif op is sre.AT:
            continue
        else:
            out.append(None)
    return out


def _joined(pieces) -> set[str] | None:
    """All strings a run of pieces can be, or None if that can't be told."""
    have = {""}
    for p in pieces:
        if p is None or len(have) * len(p) > EXPANSIONS:
            return None
        have = {a + b for a in have for b in p}
    return have


def trigram_clauses(pattern: str) -> list[list[frozenset[str]]]:
    """For every run that a match must contain, its alternatives of trigrams: a matching text, lower-cased, holds all of one alternative's, for each run."""
    clauses: list[list[frozenset[str]]] = []
    run: set[str] = {""}

    def keep() -> None:
        found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        # An alternative that holds another one adds nothing; one without trigrams makes the run useless.
        if all(found) and found:
            least = sorted((x for x in found if not any(y < x for y in found)), key=sorted)
            if least not in clauses:
                clauses.append(least)

    for p in [*_strings(sre_parse.parse(pattern)), None]:
        if p is None or len(run) * len(p) > EXPANSIONS:
            keep()
            run = {""} if p is None else set(p)
        else:
            run = {a + b for a in run for b in p}
    return clauses


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The most selective of a rule's clauses; []: no mandatory trigram."""
    return max(trigram_clauses(pattern), key=lambda c: min(map(len, c)), default=[])


def row_key() -> list[Column]:
    """What a row's candidates are found by: its id, or its text if it has none, so that rows without an id are no one key."""
    return [F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.xxhash64(text_of())).alias("key")]


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index over ``trigrams``: (trigram number, unnamed, key), one row for each document that holds it."""
    low = F.lower(text_of())
    held = let(low, lambda t: F.filter(F.array(*[F.when(t.contains(g), F.lit(i)) for i, g in enumerate(trigrams)]), lambda x: x.isNotNull()))
    return documents.select(*row_key(), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: list[list[list[frozenset[str]]]], trigrams: list[str]) -> DataFrame:
    """(unnamed, key, rules): the rules, as an array of numbers, whose Boolean query (all clauses, of each one alternative) the document's postings meet.

    Postings are intersected as bit sets: one bit a trigram, ored together before the shuffle.
    """
    words = -(-len(trigrams) // 60)
    bit = lambda w: F.bit_or(F.when((F.col("trigram") / 60).cast("int") == w, F.expr("shiftleft(1L, trigram % 60)")).otherwise(F.lit(0).cast("long"))).alias(f"b{w}")
    have = index.groupBy("unnamed", "key").agg(*[bit(w) for w in range(words)])
    place = {g: i for i, g in enumerate(trigrams)}

    def holds(grams: frozenset[str]) -> Column:
        masks = [sum(1 << place[g] % 60 for g in grams if place[g] // 60 == w) for w in range(words)]
        return reduce(lambda a, b: a & b, [F.col(f"b{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(masks) if m])

    def met(clauses: list[list[frozenset[str]]]) -> Column:
        return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(holds, ways)) for ways in clauses])

    rules = F.array(*[F.when(met(q), F.lit(r)) for r, q in enumerate(queries) if q])
    return have.select("unnamed", "key", F.array_compact(rules).alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """All matches of a rule as structs (start, order, end, kind): code points, end exclusive, leftmost and not overlapping."""
    whole = F.regexp_extract_all(text, F.lit(f"({rule.bounded})"), F.lit(1))
    if rule.kind == "hex":
        # Runs are maximal either way; the shorter ones needn't be listed first.
        whole = F.regexp_extract_all(text, F.lit("([0-9a-f]{32,})"), F.lit(1))
    between = F.split(text, "[0-9a-f]{32,}" if rule.kind == "hex" else rule.bounded, -1)

    def placed(found: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.length(x["m"])
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            good = F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least
            return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        spans = "array<struct<start:int,order:int,end:int,kind:string>>"
        pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))

        def piece(acc: Column, own: Column) -> Column:
            inner = F.aggregate(own, F.struct(acc["at"].alias("at"), F.array().cast(spans).alias("spans")), step)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["spans"], F.array(x["spans"])).alias("spans")))

        def pieces(all_: Column) -> Column:
            # An array that grows by one is copied each time, so matches are put together piece by piece.
            cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PIECE).cast("int")), lambda k: F.slice(all_, k * PIECE + 1, PIECE))
            return F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans}>").alias("spans")), piece, lambda a: F.flatten(a["spans"]))

        return let(pairs, pieces)

    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    return let(whole, lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(none))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array of (start, order, end, kind) by start, then by the order of the rules."""
    queries = [trigram_clauses(r.pattern) for r in rules]
    trigrams = sorted({g for clauses in queries for ways in clauses for way in ways for g in way})
    marked = documents.select("doc_id", text_of().alias("text"), *row_key())
    if trigrams:
        found = stored(candidates(postings(documents, trigrams), queries, trigrams))
        marked = marked.join(small(found), ["unnamed", "key"], "left")
    parts = []
    for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        spans = _spans(F.col("text"), rule, n)
        none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
        parts.append(F.when(F.array_contains("rules", n), spans).otherwise(none) if query else spans)
    return marked.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def digest(found: DataFrame, base: int = len(BASE)) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    shown = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda n: F.size(F.filter("spans", lambda s: s["order"] == n)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(shown(F.filter("spans", lambda s: s["order"] < base)), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )
