"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from quern.llm import url_filter

_WS = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM n WINDOW w AS (PARTITION BY text_sha256)"""

OP2 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('h' || source, 'n') AS host, md5(coalesce(text, '')) AS same FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
base AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars FROM w),
sym AS (SELECT doc_id, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
lines AS (SELECT doc_id, host, same, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT doc_id, host, same, line, trim(lower(regexp_replace(line, '{_WS}', ' ', 'g'))) AS norm, len(regexp_extract_all(line, '{_WORD}')) AS k FROM lines WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY doc_id),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM again) GROUP BY doc_id),
freq AS (SELECT host, norm FROM worded GROUP BY ALL HAVING count(DISTINCT same) > 10),
gone AS (SELECT doc_id, sum(k)::BIGINT AS removed_words FROM worded JOIN freq USING (host, norm) GROUP BY doc_id),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words FROM base JOIN sym USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT ((n_words - removed_words) * 100 < n_words * 30) AS kept FROM f"""

_ESC = r"regexp_replace({0}, '<(\\*)\|', '<\\\1|', 'g')"

OP4 = rf"""WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS raw FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
t AS (SELECT *, length('<|im_start|>' || {_ESC.format("replace(replace(role, '%', '%25'), chr(10), '%0A')")} || chr(10) || {_ESC.format("raw")} || '<|im_end|>' || chr(10)) AS size FROM src),
a AS (SELECT *, (size + 3) // 4 AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(raw)) AS nth FROM t),
b AS (SELECT *, nth = 1 AND role = 'system' AS is_system FROM a),
c AS (SELECT *, coalesce(max(CASE WHEN is_system THEN tok END) OVER (PARTITION BY conv_id), 0) AS sys FROM b),
m AS (SELECT *, greatest(1, 2048 - sys) AS room, NOT is_system AND role = 'assistant' AS target, CASE WHEN is_system THEN 0 ELSE tok END AS own FROM c),
g AS (SELECT *, sum(own) OVER w AS upto, sum(own) OVER w - own AS start, least(count(*) FILTER (target) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), count(*) FILTER (target) OVER (PARTITION BY conv_id) - 1) AS x FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
u AS (SELECT *, max(CASE WHEN target THEN upto END) OVER (PARTITION BY conv_id, x) AS t_to FROM g),
v AS (SELECT *, NOT is_system AND upto < t_to AND t_to - start <= room AS ahead FROM u),
y AS (SELECT *, min(CASE WHEN target OR ahead THEN start END) OVER (PARTITION BY conv_id, x) AS begun FROM v),
z AS (SELECT *, coalesce(target OR ahead OR (NOT is_system AND upto > t_to AND upto - begun <= room), false) AS joined FROM y),
i AS (SELECT *, NOT is_system AND NOT (joined AND coalesce(lag(joined) OVER w AND lag(x) OVER w = x, false)) AS begins FROM z WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
j AS (SELECT *, sum(begins::INT) OVER (PARTITION BY conv_id ORDER BY nth) AS item FROM i),
k AS (SELECT *, sum(own) OVER (PARTITION BY conv_id, item) AS item_tok FROM j),
l AS (SELECT *, NOT is_system AND item_tok > room // 2 AS is_long FROM k),
o AS (SELECT *, greatest(1, room - coalesce(max(CASE WHEN NOT is_system AND NOT is_long THEN item_tok END) OVER (PARTITION BY conv_id), 0)) AS stride, 2 * sum((is_long AND begins)::INT) OVER (PARTITION BY conv_id ORDER BY nth) - is_long::INT AS own_seg FROM l),
q AS (SELECT *, CASE WHEN is_system THEN coalesce(lead(own_seg) OVER (PARTITION BY conv_id ORDER BY nth), 0) ELSE own_seg END AS seg FROM o),
s AS (SELECT *, CASE WHEN is_system THEN 0 ELSE (min(CASE WHEN NOT is_system THEN start END) OVER (PARTITION BY conv_id, item) - min(CASE WHEN NOT is_system THEN start END) OVER (PARTITION BY conv_id, seg)) // stride END AS span FROM q),
spans AS (SELECT conv_id, seg, span, coalesce(min(CASE WHEN NOT is_system THEN start END), 0) AS first, coalesce(max(CASE WHEN NOT is_system THEN upto END), 0) AS last, max(sys) AS sys, bool_or(is_system) AS has_system FROM s GROUP BY conv_id, seg, span),
rooms AS (SELECT *, least(512, 2048 - sys - (last - first)) AS room FROM spans),
pieces AS (SELECT conv_id, size FROM s
 UNION ALL SELECT s.conv_id, size FROM s JOIN rooms r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND NOT s.is_system AND s.upto <= r.first AND s.start >= r.first - r.room
 UNION ALL SELECT s.conv_id, size FROM s JOIN rooms r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.is_system AND NOT r.has_system),
chars AS (SELECT conv_id, sum(size)::BIGINT AS formatted_chars FROM pieces GROUP BY conv_id),
wins AS (SELECT conv_id, count(*) AS n_windows FROM spans GROUP BY conv_id),
said AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || raw || chr(10), '' ORDER BY turn, role, md5(raw))) AS turns_sha256, coalesce(string_agg(CASE WHEN role = 'assistant' THEN raw END, '' ORDER BY turn, role, md5(raw)), '') AS loss FROM src GROUP BY conv_id)
SELECT said.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, n_windows FROM said JOIN chars ON said.conv_id IS NOT DISTINCT FROM chars.conv_id JOIN wins ON said.conv_id IS NOT DISTINCT FROM wins.conv_id"""

_UNIT = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296::DOUBLE)"

OP6 = rf"""WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, length(bin(size)) * 4 + ((size >> greatest(length(bin(size)) - 3, 0)) & 3) AS cls FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cls, h, doc_id) AS nth FROM k),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, [3.0::DOUBLE, 1, 2][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / nullif(sum(w) OVER () - coalesce(sum(w) OVER b, 0), 0) AS level FROM w WINDOW b AS (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT arg_min(level, cap / w) AS common FROM l WHERE cap / w > level),
t AS (SELECT src, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * w) END AS target FROM l, g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, {_UNIT.format("'mix:' || src")} AS o FROM t),
c AS (SELECT doc_id, size, source_size, target, (floor(o + rate * nth) - floor(o + rate * (nth - 1)))::INT AS copies FROM r JOIN p USING (src))
SELECT *, copies * size AS taken FROM c"""


def _op9() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    weights = " + ".join(f"CASE WHEN regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END" for t, w in url_filter.VOCABULARY.items())
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    fit = lambda h, p: f"(host = {quoted(h)} OR ends_with(host, {quoted('.' + h)})) AND starts_with(path, {quoted(p)})"
    pick = lambda k: "CASE " + " ".join(f"WHEN {fit(h, p)} THEN {quoted((h + p, v)[k])}" for h, p, v in rules) + " END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH u AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {pick(0)} AS rule, coalesce({pick(1)}, CASE WHEN {weights} >= 1 THEN 'block' ELSE 'allow' END) AS verdict FROM s"""


OP9 = _op9()

OP10 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
edges AS (SELECT x, y, k = sx.n AND k = sy.n AS same FROM inter JOIN sizes sx ON x = sx.doc_id JOIN sizes sy ON y = sy.doc_id WHERE k >= 0.8::DOUBLE * (sx.n + sy.n - k) - 1e-9),
reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT e.y, r.low FROM reach r JOIN edges e ON r.node = e.x AND r.low < e.y),
cls AS (SELECT node AS doc_id, min(low) AS class_id FROM reach GROUP BY node),
rep AS (SELECT x AS doc_id, least(x, min(y)) AS rep_id, count(*) + 1 AS copies FROM edges WHERE same GROUP BY x),
deg AS (SELECT x AS doc_id, count(*) AS n_links FROM edges GROUP BY x)
SELECT doc_id, class_id, coalesce(rep_id, doc_id) AS rep_id, coalesce(copies, 1) AS copies, coalesce(n_links, 0) AS n_links FROM cls LEFT JOIN rep USING (doc_id) LEFT JOIN deg USING (doc_id)"""



def _op11() -> str:
    """The least (cost, audit) of each state, row by row; the repair is read off the audit."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
    step = lambda s, cost, letter: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}}"
    never = "{'c': 1000000000::BIGINT, 'a': '~'}"
    edited = lambda s, initial, rerole=True: f"CASE WHEN gone THEN {never} WHEN init = '{initial}' THEN {step(s, 'late', 'K')} ELSE {step(s, '1 + late', 'R') if rerole else never} END"
    return rf"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hit AS (SELECT *, {crc} % 20 AS k FROM src),
left_over AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM left_over),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM placed),
told AS (SELECT *, substr(role, 1, 1) AS init, CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1, 1) || substr(role, 1, 1) AS pair FROM seen),
steps AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': ''}} AS st, {never} AS op, {{'c': 5::BIGINT, 'a': 'I'}} AS asked, {{'c': 10::BIGINT, 'a': 'II'}} AS answered FROM conversations
 UNION ALL
 SELECT conv_id, n, st, op, asked, least(answered, {step('asked', 5, 'I')}) AS answered
 FROM (SELECT conv_id, n, st, op, least(asked, {step('st', 5, 'I')}, {step('op', 5, 'I')}, {step('answered', 5, 'I')}) AS asked, answered
 FROM (SELECT conv_id, n, {step('st', 2, 'D')} AS st, least({step('op', 2, 'D')}, {edited('st', 's', False)}) AS op, least({step('asked', 2, 'D')}, {edited('ready', 'u')}) AS asked, least({step('answered', 2, 'D')}, {edited('asked', 'a')}) AS answered
 FROM (SELECT t.conv_id, t.n, st, op, asked, answered, least(st, op, answered) AS ready, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late, init FROM steps s JOIN told t ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = s.n + 1)))),
done AS (SELECT conv_id, least(st, answered).c AS cost, least(st, answered).a AS audit FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
letters AS (SELECT conv_id, p, substr(audit, p, 1) AS letter, length(replace(substr(audit, 1, p), 'I', '')) AS n, length(replace(substr(audit, 1, p), 'D', '')) AS place FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM done)),
written AS (SELECT l.conv_id, p, letter, place, CASE WHEN letter <> 'I' THEN role END AS role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, max(CASE WHEN place = 1 AND letter = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS opened FROM letters l LEFT JOIN told t ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.n = t.n WHERE letter <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS lines FROM written GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM told GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM done d LEFT JOIN counts c ON d.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON d.conv_id IS NOT DISTINCT FROM r.conv_id"""


def _op13(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """A chain of rounds, written out; components are rows."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) AS n
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT n, unnest(range({dim})) AS p, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT n - 1 AS c, p, x FROM x WHERE n <= {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT n, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT n, c, sum((x.x - k.x) * (x.x - k.x))::BIGINT AS d FROM x JOIN c{r} k USING (p) GROUP BY n, c) GROUP BY n)")
        if r < rounds:
            floored = "((s - ((s % m) + m) % m) // m)::BIGINT"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, p, coalesce(f, k.x) AS x FROM c{r} k LEFT JOIN (SELECT c, p, {floored} AS f FROM (SELECT c, p, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS m FROM x JOIN a{r} USING (n) GROUP BY c, p)) USING (c, p))")
    return "WITH " + ",\n".join(parts) + f""",
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM kept JOIN a{rounds} USING (n) JOIN h USING (c)"""


SQL = {"op1_exact_dedup": OP1, "op2_quality_rules": OP2, "op4_chat_formatting": OP4, "op6_mixing": OP6, "op9_url_filter": OP9, "op10_ngram_jaccard_join": OP10, "op11_conversation_repair": _op11(), "op13_centroids": _op13()}
