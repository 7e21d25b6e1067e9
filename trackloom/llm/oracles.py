"""DuckDB twins of the queries that SQL can express.

The others are held against plain versions in the tests: op1 (its hash isn't DuckDB's; ``quality_base`` has its base rules), op3
(tokenizer), op8 (a fitted model), op10 (packing), and the pipeline.
"""

from __future__ import annotations

from .chat_format import CONTROL, END, SEP, START
from .line_dedup import CONSTANT, DEPTH, LONG, MIN_DOCUMENTS, STEP
from .quality import MAX_REPEATED, MIN_WORDS
from .search import BEST, TERM
from .secret_scan import BASE, RULES

SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}'), lambda x: x<>'')"


def _runs(source: str, key: str, k: int) -> str:
    """key, p (from 1), g (k words joined) of a table with key and a list of words w."""
    return f"SELECT {key}, p, array_to_string(w[p:p+{k - 1}], ' ') AS g FROM {source}, unnest(range(1, len(w)-({k - 2}))) r(p)"


_CLEAN = r"regexp_replace(lower(coalesce(text,'')), '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g')"

OP2 = f"""
WITH d AS (SELECT doc_id, {_words(_CLEAN)} AS w FROM documents), b AS (SELECT item_id, {_words(_CLEAN)} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, g FROM ({_runs("d", "doc_id", 5)}{"".join(f" UNION ALL SELECT * FROM ({_runs('d', 'doc_id', k)}) WHERE {k} IN (SELECT len(w) FROM b)" for k in range(1, 5))})),
bs AS (SELECT DISTINCT item_id, g FROM ({_runs("b", "item_id", 5)} UNION ALL SELECT item_id, 1, array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 4)),
sizes AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_matched FROM ds JOIN bs USING (g) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n HAVING count(*)*100 >= n*80
"""

QUALITY_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text,'') AS t, {_words("coalesce(text,'')")} AS w, list_filter(string_split(coalesce(text,''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS ({_runs("d", "doc_id", 8)}), again AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p+k) AS n FROM win JOIN again USING (doc_id, g), range(8) r(k) GROUP BY doc_id),
s AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id)
SELECT *, n_words < {MIN_WORDS} OR 100*n_repeat_words > {MAX_REPEATED}*n_words AS base_failed FROM s
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text,'')")} AS w FROM documents), win AS ({_runs("d", "doc_id", 13)}),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p+k AS p FROM (SELECT doc_id, p FROM win JOIN first USING (g) WHERE m < doc_id), range(13) r(k)),
each AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w)+1)) r(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def _kind(n: int) -> str:
    r = RULES[n]
    # DuckDB's expressions can't look behind: the character before is part of the match, and taken off.
    p, group = (f"(?:^|[^{r.apart[1:-1]}])({r.pattern})", 1) if r.apart else (r.pattern, r.group)
    p = p.replace("'", "''")
    own = f"regexp_extract(m, '{p}', {1 if r.apart else 0})"
    return f"""SELECT doc_id, {n} AS k, '{r.kind}' AS kind, s+length(m)-length({own}) AS s, s+length(m) AS e FROM (SELECT doc_id, ms[i] AS m,
      (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d), unnest(range(1, len(ms)+1)) r(i)) WHERE length(regexp_extract(m, '{p}', {group})) >= {r.least}"""


OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents), f AS ({" UNION ALL ".join(map(_kind, range(len(RULES))))}),
g AS (SELECT doc_id, count(*) FILTER (k=0) AS n_assign, count(*) FILTER (k=1) AS n_access, count(*) FILTER (k=2) AS n_hex,
  string_agg(kind||':'||s||':'||e, ',' ORDER BY s, k) FILTER (k<{len(BASE)}) AS base, string_agg(kind||':'||s||':'||e, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign,0) AS n_assign, coalesce(n_access,0) AS n_access, coalesce(n_hex,0) AS n_hex, sha256(coalesce(base,'')) AS base_sha256, coalesce(spans,'') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def _escaped(x: str) -> str:
    doubled = f"replace(coalesce({x},''), '\\', '\\\\')"
    for c in CONTROL:
        doubled = f"replace({doubled}, '{c}', '{c[0]}\\{c[1:]}')"
    return doubled


OP6 = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  length({_escaped("role")}) + length({_escaped("text")}) + {len(START) + len(SEP) + len(END)} AS chars FROM c),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role,'')||chr(10)||coalesce(text,'')||chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role='assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role='assistant'), '')) AS loss_sha256,
  (sum(CASE WHEN role='assistant' OR i=n THEN upto ELSE 0 END))::BIGINT AS formatted_chars, count(*) FILTER (role='assistant' OR i=n) AS n_examples FROM s GROUP BY conv_id
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(coalesce(text,''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, g FROM ({_runs("d", "doc_id", 4)}) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*o >= 85*(x.n + y.n - o)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT ways.b, cc.c FROM cc JOIN ways ON ways.a = cc.doc_id WHERE cc.c < ways.b)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN cc ON cc.doc_id = d.doc_id GROUP BY d.doc_id
"""

# A leaf is a token count and leading tokens; documents of equal texts are one group, told apart by id and text (key) and row (r).
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, md5(coalesce(text,'')) AS grp, string_split(coalesce(text,''), chr(10)) AS ls FROM documents),
cut AS (SELECT r, doc_id, grp, (i-1)::INTEGER AS line, list_transform(string_split(trim(regexp_replace(ls[i], '[\\x09\\x0B-\\x0D]', ' ', 'g'), ' '), ' '),
  lambda x: CASE WHEN regexp_matches(x, '[0-9@]') THEN '*' ELSE x END) AS tokens FROM d, unnest(range(1, len(ls)+1)) u(i)),
l AS (SELECT *, array_to_string(tokens, ' ') AS said, len(tokens)||':'||array_to_string(tokens[1:{DEPTH}], ' ') AS leaf FROM cut WHERE array_to_string(tokens, ' ') <> ''),
same AS (SELECT said FROM l GROUP BY said HAVING count(DISTINCT grp) >= {MIN_DOCUMENTS}),
others AS (SELECT * FROM l ANTI JOIN same USING (said) WHERE len(tokens) > {DEPTH}),
leaves AS (SELECT leaf FROM others GROUP BY leaf HAVING count(DISTINCT grp) >= {MIN_DOCUMENTS}),
masked AS (SELECT leaf, said, any_value(tokens) AS tokens, count(DISTINCT grp) AS n FROM others SEMI JOIN leaves USING (leaf) GROUP BY leaf, said),
placed AS (SELECT leaf, said, n, i AS place, tokens[i] AS token FROM masked, unnest(range({DEPTH + 1}, len(tokens)+1)) u(i) WHERE tokens[i] <> '*'),
seen AS (SELECT leaf, place, token, sum(n)::BIGINT AS times FROM placed GROUP BY ALL HAVING sum(n) >= {MIN_DOCUMENTS}),
own AS (SELECT leaf, said, list(struct_pack(place := place, token := token, times := times) ORDER BY place) AS own FROM placed JOIN seen USING (leaf, place, token) GROUP BY leaf, said),
barred AS (SELECT leaf, said, list_filter(own, lambda x: x.times >= {MIN_DOCUMENTS}*{STEP}::BIGINT**k) AS over, tokens FROM own JOIN masked USING (leaf, said), range(0, 20) b(k)),
shaped AS (SELECT DISTINCT leaf, said, list_transform(over, lambda x: x.place||':'||x.token) AS shape FROM barred
  WHERE len(over) > 0 AND 100*(len(over) + len(list_filter(tokens[1:{DEPTH}], lambda t: t <> '*'))) >= {CONSTANT}*len(tokens)),
often AS (SELECT leaf, shape FROM shaped JOIN others USING (leaf, said) GROUP BY leaf, shape HAVING count(DISTINCT grp) >= {MIN_DOCUMENTS}),
general AS (SELECT DISTINCT leaf, said FROM shaped SEMI JOIN often USING (leaf, shape)),
long AS (SELECT * FROM l WHERE len(list_filter(tokens, lambda x: x <> '')) >= {LONG}),
first AS (SELECT said, arg_min(grp, struct_pack(u := doc_id IS NULL, i := doc_id, r := r)) AS grp FROM long GROUP BY said HAVING count(DISTINCT grp) BETWEEN 2 AND {MIN_DOCUMENTS - 1}),
gone AS (SELECT r, line FROM l SEMI JOIN same USING (said) UNION SELECT r, line FROM others SEMI JOIN general USING (leaf, said)
  UNION SELECT long.r, long.line FROM long JOIN first ON first.said = long.said WHERE first.grp <> long.grp),
listed AS (SELECT r, list(line ORDER BY line) AS gone FROM gone GROUP BY r),
done AS (SELECT doc_id, text, ls, coalesce(gone, []) AS gone FROM d LEFT JOIN listed ON listed.r = d.r)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines, len(gone)::BIGINT AS n_dropped, array_to_string(gone, ',') AS dropped,
  sha256(CASE WHEN len(gone) > 0 THEN array_to_string(list_transform(list_filter(range(1, len(ls)+1), lambda i: NOT list_contains(gone, i-1)), lambda i: ls[i]), chr(10)) ELSE text END) AS kept_sha256 FROM done
"""

_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '{TERM}')"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
own AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0), s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM own),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000*ln((2*docs+2)/(2*df+1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY 1), s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, r, sum(times*w*((1000000000*tf)//(1000*tf+8*(100-75+((75*n*docs)//total)))))::BIGINT AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN own USING (r), s GROUP BY ALL),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored JOIN own USING (r) WHERE score > 0)
SELECT * FROM placed WHERE rank <= {BEST}
"""

# CRC-32, bit by bit: its polynomial, reversed, is a fixed value.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k)+1), lambda i: ascii(k[i])::BIGINT)), lambda h, c: list_reduce(list_prepend(xor(h, c), list_transform(range(8), lambda x: x::BIGINT)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"
_BLANK = r"[\x20\x09-\x0D]"
# States: 0 empty, 1 behind the system turn, 2 behind a user's, 3 behind an assistant's. Best ends of a conversation, from its last row back.
OP13 = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role,' ') AS role, coalesce(text,' ') AS text, coalesce(conv_id::VARCHAR,' ')||':'||coalesce(turn::VARCHAR,' ') AS k FROM conversations),
hit AS (SELECT *, {_CRC} % 20 AS f FROM keyed),
rows_ AS (SELECT conv_id, turn, CASE WHEN f=4 THEN 'user' ELSE role END AS role, CASE WHEN f=1 THEN '' WHEN f=2 THEN translate(text, '.!?', '') ELSE text END AS text FROM hit, range(CASE WHEN f=0 THEN 0 WHEN f=3 THEN 2 ELSE 1 END) r(again)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, left(role, 1) AS c FROM rows_),
marked AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?]{_BLANK}*$') THEN 'truncated' ELSE '' END AS fault,
  lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM placed),
goes(c, s, t) AS (VALUES ('s',0,1), ('u',0,2), ('u',1,2), ('u',3,2), ('a',2,3)),
adds(s, n, t) AS (SELECT s, 0, s FROM range(4) x(s) UNION ALL SELECT s, 1, t FROM goes WHERE c<>'s' UNION ALL SELECT a.s, 2, b.t FROM goes a JOIN goes b ON a.c<>'s' AND b.c<>'s' AND a.t=b.s),
ways AS (SELECT m.conv_id, m.i, adds.s, g.t, 2*n + price + CASE WHEN e<>'D' AND fault='truncated' THEN 1 ELSE 0 END AS cost, repeat('I', n)||e AS said
  FROM marked m, adds, (SELECT c, s, t, 'K' AS e, 0 AS price FROM goes UNION ALL SELECT NULL, s, t, 'R', 2 FROM goes WHERE c<>'s' UNION ALL SELECT NULL, s, s, 'D', 3 FROM range(4) x(s)) g
  WHERE g.s = adds.t AND (g.c IS NULL OR g.c = m.c) AND (e='D' OR fault NOT IN ('blank','duplicate'))),
n AS (SELECT conv_id, count(*) AS n FROM marked GROUP BY 1),
best(conv_id, i, s, cost, said) AS (SELECT conv_id, n+1, s, 2*v, repeat('I', v) FROM n, (VALUES (0,0), (1,2), (2,1), (3,0)) x(s, v)
  UNION ALL (SELECT w.conv_id, w.i, w.s, min(w.cost+b.cost), arg_min(w.said||b.said, struct_pack(c := w.cost+b.cost, x := w.said||b.said))
    FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.i = b.i-1 AND w.t = b.s GROUP BY ALL)),
chosen AS (SELECT conv_id, cost, said FROM best WHERE i=1 AND s=0),
letters AS (SELECT conv_id, said, p, said[p] AS e, count(*) FILTER (said[p]<>'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
  count(*) FILTER (said[p]<>'D') OVER (PARTITION BY conv_id ORDER BY p) AS o FROM chosen, unnest(range(1, length(said)+1)) u(p)),
turns AS (SELECT l.conv_id, l.p, CASE WHEN e='K' THEN m.role ELSE CASE WHEN (o + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END||':'||CASE WHEN e='I' THEN '' ELSE m.text END AS line
  FROM letters l JOIN (SELECT conv_id, count(*) FILTER (e<>'D') % 2 AS odd FROM letters GROUP BY 1) q ON q.conv_id IS NOT DISTINCT FROM l.conv_id LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i WHERE e<>'D'),
hashed AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS whole FROM turns GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn)-min(turn)+1-count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault='blank') AS blank, count(*) FILTER (fault='duplicate') AS duplicate, count(*) FILTER (fault='truncated') AS truncated,
  count(*) FILTER (pair NOT IN ('su','ua','au')) AS illegal FROM marked GROUP BY 1)
SELECT c.conv_id, coalesce(gaps,0)::BIGINT AS gaps, coalesce(blank,0) AS blank, coalesce(duplicate,0) AS duplicate, coalesce(truncated,0) AS truncated, coalesce(illegal,0) AS illegal, coalesce(cost,0)::BIGINT AS cost, coalesce(said,'') AS audit, sha256(coalesce(whole,'')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN chosen b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashed h ON h.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLES: dict[str, str] = {
    "quality_base": QUALITY_BASE,
    "op2_decontamination": OP2,
    "op4_substring_dedup": OP4,
    "op5_secret_scan": OP5,
    "op6_chat_format": OP6,
    "op7_ngram_join": OP7,
    "op9_line_dedup": OP9,
    "op12_ranked_search": OP12,
    "op13_structure_repair": OP13,
}
