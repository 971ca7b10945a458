"""SQL that must give the rows of those operator queries that SQL can express."""

from __future__ import annotations

from buildgraph.llm import lines as ln
from buildgraph.llm import quality as q

SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALPHANUMERIC = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {ALPHANUMERIC} AS ws FROM documents),
bw AS (SELECT item_id, {ALPHANUMERIC} AS ws FROM benchmark),
bwin AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + 9], ' ') AS k, least(len(ws), 10) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM bw WHERE len(ws) > 0)),
dwin AS (SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p
    FROM dw, (SELECT DISTINCT n FROM bwin) WHERE len(ws) >= n)),
hits AS (SELECT doc_id, p, d.n, item_id FROM dwin d JOIN bwin b ON d.n = b.n AND d.k = b.k),
pos AS (SELECT doc_id, count(DISTINCT w) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM (SELECT DISTINCT doc_id, p, n FROM hits)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {SPACED} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM d WHERE len(ws) >= 20)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later),
each AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
left_over AS (SELECT e.doc_id, string_agg(w, ' ' ORDER BY e.p) AS kept, count(*) AS n
  FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)"""


def _line_windows() -> str:
    parts = []
    for m in range(1, ln.MIN_LINES + 1):
        enough = "true" if m >= ln.MIN_LINES else f"list_sum(nw[p:p + {m - 1}]) >= {ln.MIN_WORDS}"
        parts.append(
            f"SELECT doc_id, p, {m} AS m, array_to_string(ts[p:p + {m - 1}], chr(10)) AS k "
            f"FROM (SELECT *, unnest(range(1, len(ts) - {m} + 2)) AS p FROM rows WHERE len(ts) >= {m}) WHERE {enough}"
        )
    return " UNION ALL ".join(parts)


LINES = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, i, trim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d)),
rows AS (SELECT doc_id, list(i ORDER BY i) AS ps, list(t ORDER BY i) AS ts,
  list(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) ORDER BY i) AS nw FROM e WHERE t <> '' GROUP BY doc_id),
win AS ({_line_windows()}),
later AS (SELECT doc_id, p, m FROM (SELECT doc_id, p, m, row_number() OVER (PARTITION BY m, k ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, ps[x] AS i FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM later) JOIN rows USING (doc_id)),
kept AS (SELECT e.doc_id, string_agg(l, chr(10) ORDER BY e.i) AS k
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d) e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, coalesce(len(rows.ts), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed,
  sha256(coalesce(k, '')) AS kept_sha256, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k, '') END AS kept_text
FROM d LEFT JOIN rows USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _quality() -> str:
    rates = ", ".join(f"count(*) FILTER (v_{r} > {strict}) AS f_{r}" for r, (strict, _) in q.RULES.items())
    means = ", ".join(
        f"least(greatest(sum(f_{r}) / sum(n), 1e-6), 1 - 1e-6) AS m_{r}, sum(f_{r} * f_{r} / n) / sum(n) AS s_{r}" for r in q.RULES
    )
    strengths = ", ".join(
        f"m_{r}, least(greatest(m_{r} * (1 - m_{r}) / greatest(greatest(s_{r} - m_{r} * m_{r}, 0) - m_{r} * (1 - m_{r}) * hosts / total, 1e-9) - 1, "
        f"{q.LEAST_STRENGTH}), 1e4) AS g_{r}"
        for r in q.RULES
    )
    flags = ", ".join(f"(f_{r} + m_{r} * g_{r}) / (n + g_{r}) > {q.SUSPICIOUS} AS bad_{r}" for r in q.RULES)
    broken = " OR ".join(f"v_{r} > CASE WHEN bad_{r} THEN {strict} ELSE {loose} END" for r, (strict, loose) in q.RULES.items())
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS t, {SPACED} AS ws FROM documents),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c
  FROM (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM d WHERE len(ws) >= 5))),
rep AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS w FROM win WHERE c > 1) GROUP BY 1),
c AS (SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d) LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS v_symbols,
  CASE WHEN n_words > 0 THEN capitals / word_chars ELSE 0 END AS v_shouted,
  CASE WHEN n_words > 0 THEN n_dup_lines / n_lines ELSE 0 END AS v_repeated,
  CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS v_long_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
h AS (SELECT host, count(*) AS n, {rates} FROM v GROUP BY 1),
m AS (SELECT count(*) AS hosts, sum(n) AS total, {means} FROM h),
g AS (SELECT {strengths} FROM m),
b AS (SELECT host, {flags} FROM h, g)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {broken}) AS kept
FROM v JOIN b USING (host)"""


FILL_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM g"""

SHINGLE_GROUPS = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS p FROM d WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN edges ON a = r),
least_of AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least_of USING (doc_id) LEFT JOIN size USING (doc_id)"""


def _vector_codes(parts: int = 16, entries: int = 64, width: int = 4, rounds: int = 2) -> str:
    """Plain k-means in SQL; ``width`` components a part, as the table has them."""
    each = range(1, width + 1)
    far = " + ".join(f"(r.v[{i}] - c.v[{i}]) * (r.v[{i}] - c.v[{i}])" for i in each)
    mean = ", ".join(f"floor(sum(v[{i}])::DOUBLE / count(*))::BIGINT" for i in each)
    steps = []
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT vec_id, label, p, any_value(r.v) AS v, min(({far}) * {entries} + e) AS m "
                     f"FROM parts r JOIN c{t} c USING (p) GROUP BY vec_id, label, p)")
        if t < rounds:
            steps.append(f"m{t} AS (SELECT p, m % {entries} AS e, [{mean}] AS v FROM a{t} GROUP BY 1, 2)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m{t}.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} ON c.p = m{t}.p AND c.e = m{t}.e)")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, x[p * {width} + 1:p * {width} + {width}] AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
c0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {entries}),
{", ".join(steps)},
coded AS (SELECT vec_id, label, string_agg(lower(lpad(to_hex((m % {entries})::BIGINT), 2, '0')), '' ORDER BY p) AS code,
  sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY 1, 2),
by_label AS (SELECT label, sum(error)::BIGINT AS label_error FROM coded GROUP BY 1),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) AS s
  FROM (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM c{rounds}))
SELECT vec_id, code, error, label_error, s AS codebooks_sha256
FROM coded JOIN by_label ON coded.label IS NOT DISTINCT FROM by_label.label, digest"""


VECTOR_CODES = _vector_codes()

ORACLES = {
    "op3_decontamination": DECONTAMINATION,
    "op4_line_dedup": LINES,
    "op5_substrings": SUBSTRINGS,
    "op7_quality": _quality(),
    "op11_fill_middle": FILL_MIDDLE,
    "op12_minhash": SHINGLE_GROUPS,
    "op13_vector_codes": VECTOR_CODES,
}
