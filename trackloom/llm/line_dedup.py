"""Line dedup with a log-template tree, in DataFrame functions only.

A line is parsed by a tree of fixed depth: its token count, then its leading tokens, lead to a leaf.
Tokens are what single spaces separate in the trimmed line; those with a digit or an @ (numbers,
dates, addresses) are variable fields and read as ``*`` everywhere, so also in the tree.

Only leaves met in at least ``min_documents`` documents (two for long lines) can hold a recurring template. In
them a line's template is first its tokens as they are, with ``*``. Lines whose template recurs, in
at least ``min_documents`` documents, are dropped. The others are generalised: a token is as frequent as the
documents with lines of the leaf that have it at its place, and for every bar of ``min_documents`` times a power of
``STEP`` a line's template is its tokens that reach the bar, the other places being variable fields, if at least
``CONSTANT`` hundredths of its tokens are constant. A line is dropped if one of its templates recurs. Bars are
absolute and each template's recurrence is judged on its own, so neither ordinary lines nor other templates of
the leaf hide it. Not found: a template with a field whose values are each more frequent than a ``STEP`` th of the
template, in lines that recur together with too few others.

A line of at least ``LONG`` words whose template as it is stands in fewer documents, but in two, is a
repeated passage and no boilerplate: the document with the smallest id keeps it, and it is dropped
from the others.

Documents with equal texts count as one, so that copies alone make no line recur: document-level dedup
handles them. ``group`` extends this to groups of near copies (see ``ngram_join.with_groups``): all their lines count
once, and a passage stays in all documents of the first one's group. There is no other exception: a document loses its recurring
lines, whatever share of it they are.

Defined cases: a null text stays null and has no lines; empty lines are kept and count as no
template; rows that repeat both id and text are treated alike; a null id comes after all others; of
equal ids the document with the smaller hash of id and text is first; a null ``group`` is that of the text; lines and texts of any
length are read whole; extra columns stay as they are, but for ``_ld_dropped`` and ``_ld_lines``, which are the
result's; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, small, stored, text_of
from .decontaminate import BITS_EACH, BLOOM_BITS, bloom, in_bloom

MIN_DOCUMENTS = 8
#: Words of a line that is dropped from its second document on.
LONG = 50
#: Leading tokens on the way to a leaf.
DEPTH = 3
CONSTANT = 70
STEP = 4
#: Bars go up to MIN_DOCUMENTS * STEP ** BARS, over 10 ** 18.
BARS = 28
_FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*"


def _masked(said: Column) -> Column:
    """The text with ``*`` for its variable fields. Few lines have one, and looking for one is much cheaper than replacing."""
    return F.when(said.rlike("[0-9@]"), F.regexp_replace(said, _FIELD, "*")).otherwise(said)


def _lines(text: Column) -> Column:
    """All lines of a text as structs: number, trimmed line, its leaf (null for blank lines), and whether it may be long.

    Masking changes no number of tokens, so a leaf takes that of the leading ones alone.
    """
    spaced = [text.contains(c) for c in "\t\v\f\r"]
    plain = F.when(spaced[0] | spaced[1] | spaced[2] | spaced[3], F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)

    def parsed(said: Column, i: Column) -> Column:
        tokens = F.octet_length(said) - F.octet_length(F.replace(said, F.lit(" "), F.lit(""))) + 1
        head = let(F.substring_index(said, " ", DEPTH), _masked)
        return let(tokens, lambda n: F.struct(i.alias("line"), said.alias("said"), F.when(said != "", F.xxhash64(n, head)).alias("leaf"), (n >= LONG).alias("long")))

    return F.transform(F.split(plain, "\n"), lambda line, i: let(F.trim(line), lambda said: parsed(said, i)))


def _name(*parts: Column | str) -> Column:
    """A name of 128 bits: two hashes. Of 10 ** 12 things no two share one, but for a chance of less than 10 ** -14."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("b"), *parts).alias("b"))


def _key() -> Column:
    return _name("doc_id", text_of())


def lines_of(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, group: Column | None = None) -> DataFrame:
    """The lines that may recur: _ld_key (of the document), _ld_group (what counts as one), doc_id, line (numbered from 0), said, leaf, long (may have LONG words), template."""
    own = _name(text_of())
    if group is not None:
        own = F.when(group.isNotNull(), _name(F.lit("group"), group)).otherwise(_name(text_of()))
    parsed = documents.select(_key().alias("_ld_key"), own.alias("_ld_group"), "doc_id", _lines(text_of()).alias("lines"))
    # No array is empty, and of ``explode`` Spark would make a filter that parses every text once more.
    leaves = parsed.select(F.explode_outer(F.array_distinct(F.transform("lines", lambda x: F.struct(x["leaf"], x["long"])))).alias("x")).select("x.leaf", "x.long")
    # Documents of one group are counted each here and once below: this is only the filter.
    heavy = leaves.where("leaf is not null").groupBy("leaf", "long").count().where(F.col("count") >= F.when(F.col("long"), 2).otherwise(min_documents))
    lines = parsed.select("_ld_key", "_ld_group", "doc_id", F.explode_outer("lines").alias("x")).select("_ld_key", "_ld_group", "doc_id", "x.line", "x.said", "x.leaf", "x.long")
    heavy = stored(heavy.select("leaf"))
    return stored(lines.join(small(heavy), "leaf", "left_semi").withColumn("said", _masked(F.col("said"))).withColumn("template", _name("said")))


def passages(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """_ld_key, line: long lines in two groups or more, but fewer than min_documents, outside the first document's group."""
    # Without an empty token there are as many words as tokens, and those of a long line are enough.
    wordy = ~F.col("said").contains("  ") | (F.size(F.array_remove(F.split("said", " "), "")) >= LONG)
    held = lines.where(F.col("long") & wordy).select("leaf", "template", "_ld_key", "_ld_group", "doc_id", "line")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_ld_key", "_ld_group")
    # One row a group and line first, so that a passage in a third of all documents is counted from partial sums.
    per = held.groupBy("leaf", "template", "_ld_group").agg(F.min(order).alias("x"))
    first = per.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x")).where((F.col("n") >= 2) & (F.col("n") < min_documents))
    first = small(stored(first.select("leaf", "template", F.col("x._ld_group").alias("first"))))
    return held.join(first, ["leaf", "template"]).where("first != _ld_group").select("_ld_key", "line")


def _often(df: DataFrame, keys: list[str], min_documents: int) -> DataFrame:
    """The keys that stand in min_documents groups."""
    return stored(df.select(*keys, "_ld_group").distinct().groupBy(*keys).count().where(F.col("count") >= min_documents).select(*keys))


def recurring(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """_ld_key, line: the lines of each document whose template recurs."""
    same = small(_often(lines, ["leaf", "template"], min_documents))
    found = lines.join(same, ["leaf", "template"], "left_semi").select("_ld_key", "line")
    rest = lines.join(same, ["leaf", "template"], "left_anti").where(F.instr(F.col("said"), " ") > 0)
    leftover = _often(rest, ["leaf"], min_documents)
    rest = stored(rest.join(small(leftover), "leaf", "left_semi").select("_ld_key", "_ld_group", "line", "leaf", "template", "said"))
    shaped = stored(_shaped(rest, min_documents))
    # A line has at most as many templates as there are bars below its leaf's size.
    every = rest.select("leaf", "template", "_ld_group").join(small(shaped), ["leaf", "template"])
    general = small(stored(shaped.join(small(_often(every, ["leaf", "shape"], min_documents)), ["leaf", "shape"], "left_semi").select("leaf", "template").distinct()))
    return found.unionByName(rest.join(general, ["leaf", "template"], "left_semi").select("_ld_key", "line"))


def _shaped(lines: DataFrame, min_documents: int) -> DataFrame:
    """leaf, template, shape: the generalised templates of each masked line that have enough constants."""
    masked = lines.select("leaf", "template", "said", "_ld_group").distinct().groupBy("leaf", "template").agg(F.any_value("said").alias("said"), F.count(F.lit(1)).alias("documents"))
    masked = stored(masked.withColumn("tokens", F.split("said", " ")).where(F.size("tokens") > DEPTH).drop("said"))
    n = F.size("tokens")
    # The leading tokens are the leaf's, the same in all its lines.
    lead = F.size(F.filter(F.slice("tokens", 1, DEPTH), lambda t: t != "*"))
    rest = F.slice("tokens", DEPTH + 1, n - DEPTH)
    placed = masked.select("leaf", "template", "documents", n.alias("n"), lead.alias("lead"), F.posexplode_outer(rest).alias("place", "token")).where("token != '*'")
    seen = stored(placed.groupBy("leaf", "place", "token").agg(F.sum("documents").alias("times")).where(F.col("times") >= min_documents))
    own = placed.join(small(seen), ["leaf", "place", "token"]).groupBy("leaf", "template", "n", "lead").agg(F.array_sort(F.collect_list(F.struct("place", "token", "times"))).alias("own"))
    over = lambda bar: F.filter("own", lambda x: x["times"] >= bar)
    bars = F.array(*[F.lit(min_documents * STEP**k) for k in range(BARS)])
    most = F.array_max(F.transform("own", lambda x: x["times"]))
    good = F.filter(bars, lambda b: (b <= most) & (100 * (F.size(over(b)) + F.col("lead")) >= CONSTANT * F.col("n")))
    shapes = F.transform(good, lambda b: _name(F.transform(over(b), lambda x: F.struct(x["place"], x["token"]))))
    return own.select("leaf", "template", F.explode(F.array_distinct(shapes)).alias("shape"))


def cleaned(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, group: Column | None = None) -> DataFrame:
    """The documents with recurring lines dropped from ``text``, and _ld_dropped (numbers of the lines) and _ld_lines (how many there were).

    group: a column, not one that starts with ``_ld_``, whose equal values make documents count as one.
    """
    clash = {c: f"_of{c}" for c in documents.columns if c.startswith("_ld_")}
    documents = documents.withColumnsRenamed(clash)
    lines = lines_of(documents, min_documents, group)
    drops = recurring(lines, min_documents).unionByName(passages(lines, min_documents))
    drops = stored(drops.groupBy("_ld_key").agg(F.array_sort(F.collect_set("line")).alias("_ld_drops")))
    discard(lines)
    # Only documents that may lose lines are sent to meet them; a filter that goes to all executors tells the others, which stay where they are.
    size = min(BLOOM_BITS, 1 << max(13, (BITS_EACH * drops.count() - 1).bit_length()))
    known = stored(bloom(drops.select(F.col("_ld_key.a").alias("hash")), size))
    named = documents.withColumn("_ld_key", _key()).withColumn("_ld_bloom", known.scalar())
    may = in_bloom(F.col("_ld_bloom"), F.col("_ld_key.a"), size)
    marked = named.where(may).drop("_ld_bloom").join(drops.hint("merge"), "_ld_key", "left")
    none = F.array().cast("array<int>")
    still = named.where(~may).drop("_ld_bloom").withColumn("_ld_drops", none)
    out = marked.unionByName(still).withColumn("_ld_split", F.split(text_of(), "\n")).withColumn("_ld_dropped", F.coalesce(F.col("_ld_drops"), none))
    kept = F.filter("_ld_split", lambda x, i: ~F.array_contains("_ld_dropped", i))
    return out.withColumns(
        {
            "text": F.when(F.size("_ld_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")),
            "_ld_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("_ld_split")).cast("long"),
        }
    ).drop("_ld_key", "_ld_drops", "_ld_split", "_of_ld_dropped", "_of_ld_lines").withColumnsRenamed({v: k for k, v in clash.items() if k not in ("_ld_dropped", "_ld_lines")})


def digest(done: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (their numbers, comma-joined), kept_sha256 (null for a null text)."""
    return done.select(
        "doc_id", F.col("_ld_lines").alias("n_lines"), F.size("_ld_dropped").cast("long").alias("n_dropped"), F.array_join("_ld_dropped", ",").alias("dropped"), F.sha2("text", 256).alias("kept_sha256")
    )
