"""SQL for the queries of this folder that SQL can express on whole tables (DuckDB)."""

from __future__ import annotations

from trackgraph.llm.quality_rules import BUDGETS, RULES

#: Words of a text: everything between space and 0x09-0x0D.
_WORDS = r"[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> '']"

WINDOW_DEDUP = rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM starts),
again AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
lost AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
parts AS (SELECT d.doc_id, w, coalesce(len(g), 0) AS n_removed, [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(coalesce(g, []), i)] AS kept
  FROM docs d LEFT JOIN lost l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM parts
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, [translate(y, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR y IN {_WORDS}] AS w FROM documents),
runs AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
shingles AS (SELECT DISTINCT doc_id, s FROM runs),
sizes AS (SELECT d.doc_id, count(s) AS n FROM docs d LEFT JOIN shingles x ON d.doc_id = x.doc_id GROUP BY d.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common >= 90 * (x.n + y.n - common)),
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM ends UNION SELECT r.node, e.b FROM reach r JOIN ends e ON r.other = e.a),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, coalesce(component, doc_id) AS component_id FROM sizes LEFT JOIN least ON doc_id = node
"""


def _risk_rules(risk: float = 0.05, delta: float = 0.05) -> str:
    def test(stat: str, above: bool, cut: str) -> str:
        return f"100 * {stat} {'>' if above else '<'} {cut} * n_words"

    counts = ", ".join(f"sum(CASE WHEN {test(stat, above, str(c))} THEN 1 ELSE 0 END) AS {rule}_{k}" for rule, (stat, above, cuts) in RULES.items() for k, c in enumerate(cuts))

    def strictest(rule: str, budget: float) -> str:
        return "CASE " + " ".join(f"WHEN {rule}_{k} <= CAST({budget} AS DOUBLE) * n THEN {c}" for k, c in enumerate(RULES[rule][2])) + " END"

    levels = " UNION ALL ".join(f"SELECT stratum, {k} AS level, " + ", ".join(f"{strictest(rule, b)} AS cut_{rule}" for rule in RULES) + " FROM counted" for k, b in enumerate(BUDGETS))
    bad = " OR ".join(f"coalesce({test(stat, above, 'cut_' + rule)}, false)" for rule, (stat, above, _) in RULES.items())
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
runs AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM runs) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_replace(x, '[\x20\x09-\x0D]', '', 'g') <> ''] AS l FROM docs),
base AS (SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM docs d JOIN lines x ON d.doc_id = x.doc_id LEFT JOIN covered c ON d.doc_id = c.doc_id),
stats AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT stats.*, md5(CAST(stats.doc_id AS VARCHAR)) < '8' AS proposing FROM stats JOIN good ON stats.doc_id = good.doc_id WHERE NOT base_failed),
counted AS (SELECT stratum, count(*) AS n, {counts} FROM held WHERE proposing GROUP BY stratum),
levels AS ({levels}),
tested AS (SELECT stratum, level, count(*) AS n, sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS rejected FROM held JOIN levels USING (stratum) WHERE NOT proposing GROUP BY stratum, level),
terms AS (SELECT stratum, level, n, rejected, unnest(range(0, CAST(rejected AS BIGINT) + 1)) AS i FROM tested),
tails AS (SELECT stratum, level, any_value(n) AS n, any_value(rejected) AS rejected, sum({term}) AS p FROM terms GROUP BY stratum, level),
sure AS (SELECT stratum, level, rejected <= n * {risk} AND p <= {delta} / (SELECT count(DISTINCT stratum) FROM levels) AS ok FROM tails),
last AS (SELECT stratum, max(level) AS level FROM (SELECT *, min(ok) OVER (PARTITION BY stratum ORDER BY level) AS so_far FROM sure) WHERE so_far GROUP BY stratum),
cuts AS (SELECT levels.* FROM levels JOIN last USING (stratum, level))
SELECT doc_id, stats.stratum AS stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({bad}) AS kept
FROM stats LEFT JOIN cuts ON stats.stratum = cuts.stratum
"""


FILL_IN_MIDDLE = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
units AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS d FROM docs),
cuts AS (SELECT *, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts
"""


def sql() -> dict[str, str]:
    return {"op13_escaped_marker_fim": FILL_IN_MIDDLE, "op3_risk_controlled_rules": _risk_rules(), "op4_super_kmer_dedup": WINDOW_DEDUP, "op10_token_group_join": NGRAM_JOIN}
