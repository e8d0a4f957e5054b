"""Queries over chunks as LaTeX: escaping, symbols, checks, references, units, compiler logs.

The documents hold no LaTeX of their own, so snippets are made from their chunks, and
logs from events, by the same rules in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import latex as L
from docloom.operators import latex as X
from docloom.plans import _chunks, query, table


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(expression: str, pairs) -> str:
    for a, b in pairs:
        expression = f"replace({expression}, {_quote(a)}, {_quote(b)})"
    return expression


def _escaped(column: str, newline: str = r"replace({}, chr(10), '\\ ')") -> str:
    held = f"replace(replace(replace({column}, '\\', chr(1)), '~', chr(2)), '^', chr(3))"
    held = rf"regexp_replace({held}, '([&%$#_{{}}])', '\\\1', 'g')"
    return newline.format(rf"replace(replace(replace({held}, chr(1), '\textbackslash{{}}'), chr(2), '\textasciitilde{{}}'), chr(3), '\textasciicircum{{}}')")


_COLUMNS = "greatest(1, coalesce(list_max(list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: len(list_filter(string_split(x, '|'), lambda c: trim(c) <> '')))), 1))"
SNIPPETS = rf"""sn0 AS (SELECT *, {_escaped('text')} AS esc, max(CASE WHEN region_type = 'heading' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM chunks),
snips AS (SELECT chunk_id, doc_id, pos, page, region_type, header_level, text, CASE region_type
  WHEN 'heading' THEN CASE WHEN header_level <= 1 THEN '\section{{' ELSE '\subsection{{' END || esc || '}}\label{{sec:' || doc_id || '-' || pos || '}}'
  WHEN 'formula' THEN '\begin{{equation}}' || chr(10) || esc || chr(10) || '\end{{equation}}\label{{eq:' || doc_id || '-' || pos || '}}'
  WHEN 'list' THEN '\begin{{itemize}}' || chr(10) || '\item ' || esc || chr(10) || '\end{{itemize}}'
  WHEN 'table' THEN '\begin{{table}}' || chr(10) || '\begin{{tabular}}{{' || repeat('c', {_COLUMNS}) || '}}' || chr(10) || '\toprule' || chr(10) || replace(esc, '|', '&') || chr(10) || '\end{{tabular}}' || chr(10) || '\caption{{' || chunk_id || '}}\label{{tbl:' || doc_id || '-' || pos || '}}' || chr(10) || '\end{{table}}'
  ELSE esc || CASE WHEN sec IS NOT NULL THEN ' (\ref{{sec:' || doc_id || '-' || sec || '}})' ELSE '' END END AS latex FROM sn0)"""
LABELS = r"lab0 AS (SELECT doc_id, chunk_id, pos, unnest(regexp_extract_all(latex, '\\label\{([^}]+)\}', 1)) AS name FROM snips), lab AS (SELECT doc_id, name, arg_max(chunk_id, pos) AS chunk_id FROM lab0 GROUP BY ALL)"
LOG_LINES = (
    "! LaTeX Error: File `tikz.sty' not found.",
    "! Undefined control sequence.\nl.12 \\foo",
    "! LaTeX Error: Environment align undefined.",
    "! Missing $ inserted.",
    "! Extra alignment tab has been changed to\\cr.",
    "LaTeX Warning: Citation `x' on page 3 undefined\nThere were undefined references.",
    "Overfull \\hbox\n! Emergency stop.",
)
LOGS = "logs AS (SELECT event_id, CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {_quote(x)}" for i, x in enumerate(LOG_LINES)) + r" END || chr(10) || 'l.' || event_id % 500 || ' \cmd' AS log FROM events)"
_ISSUES = r"""iss AS (SELECT event_id, 'missing-package' AS code, unnest(regexp_extract_all(log, 'File `([^`]+)\.sty'' not found', 1)) AS detail FROM logs
  UNION ALL SELECT event_id, 'undefined-command', unnest(regexp_extract_all(log, 'Undefined control sequence[^\\]{0,120}\\([A-Za-z@]+)', 1)) FROM logs
  UNION ALL SELECT event_id, 'environment-undefined', unnest(regexp_extract_all(log, 'Environment ([A-Za-z*]+) undefined', 1)) FROM logs
  UNION ALL SELECT event_id, 'math-mode', NULL FROM logs WHERE regexp_matches(log, 'Missing \$ inserted|Illegal math')
  UNION ALL SELECT event_id, 'alignment-tabs', NULL FROM logs WHERE regexp_matches(log, 'Extra alignment tab has been changed to\\cr'))"""
_UNITS = r"""u0 AS (SELECT *, sum(CASE WHEN starts_with(latex, '\section{') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS unit FROM snips),
u1 AS (SELECT doc_id, unit, string_agg(latex, chr(10) ORDER BY pos) AS body, sum(len(regexp_extract_all(latex, '\n')) + 1)::BIGINT AS lines FROM u0 GROUP BY ALL),
units AS (SELECT doc_id, (row_number() OVER w - 1)::INT AS ordinal, 'section-' || lpad((row_number() OVER w - 1)::VARCHAR, 3, '0') AS name, (sum(lines) OVER w)::BIGINT - lines AS start_line, (sum(lines) OVER w)::BIGINT AS end_line, sha1(body) AS checksum FROM u1 WINDOW w AS (PARTITION BY doc_id ORDER BY unit))"""


def _reduced(column: str, pairs: tuple[str, ...], rounds: int = 12) -> str:
    """What is left of a text's brackets when pairs are struck out again and again; exact up to ``rounds`` levels."""
    keep = "".join("\\" + c for p in pairs for c in p)
    out = f"array_to_string(regexp_extract_all({column}, '[{keep}]'), '')"
    for _ in range(rounds):
        out = _replaced(out, [(p, "") for p in pairs])
    return out


def _count(column: str, token: str) -> str:
    return f"((length({column}) - length(replace({column}, {_quote(token)}, ''))) // {len(token)})"


def _over(sql: str, *views: str) -> str:
    sql = sql.strip()
    return "WITH " + ", ".join(views) + (", " + sql.removeprefix("WITH") if sql.startswith("WITH") else " " + sql)


def _snippets(spark, sf):
    return X.snippets(_chunks(spark, sf))


def _logs(spark, sf):
    n = F.col("event_id")
    line = F.element_at(F.array(*(F.lit(x) for x in LOG_LINES)), (n % 7 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.concat(line, F.lit("\nl."), n % 500, F.lit(" \\cmd")).alias("log"))


@query("r16_r17_symbols", "SELECT doc_id, " + _replaced(r"regexp_replace(text || ' 5 ≤ x² → ∞ ↦ ~', '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g')", L.SEQUENCES + L.GLYPHS + L.MORE_GLYPHS) + " AS text FROM documents")
def r16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.symbols(F.concat("text", F.lit(" 5 ≤ x² → ∞ ↦ ~"))).alias("text"))


@query("r18_r54_escapes", rf"""WITH t AS (SELECT doc_id, text || ' \a_b{{c}}~^' AS text FROM documents) SELECT doc_id, {_escaped('text')} AS escaped, {_escaped('text', '{}')} AS rendered,
  regexp_replace(text, '([&%])', '\\\1', 'g') AS plain, trim({_replaced('text', ((chr(92), chr(92) + 'textbackslash{}'), *((c, chr(92) + c) for c in '&%$#_{}')))}) AS candidate FROM t""")
def r18(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(r" \a_b{c}~^")).alias("text"))
    return t.select("doc_id", L.escape(F.col("text")).alias("escaped"), L.escape(F.col("text"), None).alias("rendered"), L.escape_plain(F.col("text")).alias("plain"), L.fallback_candidate(F.col("text")).alias("candidate"))


def _plain(column: str) -> str:
    for p in L.PLAIN:
        column = f"regexp_replace({column}, {_quote(p)}, ' ', 'g')"
    return f"trim({column})"


@query("r19_m11_plain_text", _over(f"""SELECT chunk_id, {_plain('latex')} AS plain, round(CASE WHEN length(trim(text)) = 0 OR length(trim(latex)) = 0 THEN 0 WHEN length(trim(latex)) / greatest(length(trim(text)), 1) > 1.5 OR length(trim(latex)) / greatest(length(trim(text)), 1) < 0.5 THEN 0.2
  ELSE least(1.0, 1.0 - abs(1 - length(trim(latex)) / greatest(length(trim(text)), 1))) END, 6)::DOUBLE AS similarity FROM snips""", SNIPPETS), True)
def r19(spark, sf):
    return _snippets(spark, sf).select("chunk_id", L.plain_text(F.col("latex")).alias("plain"), F.round(L.length_similarity(F.col("text"), F.col("latex")), 6).alias("similarity"))


@query("r21_code_fences", r"""SELECT doc_id, regexp_replace('Before' || chr(10) || '```' || chr(10) || text || chr(10) || '``` after', '(?s)```\n*(.*?)\n*```', '\\begin{verbatim}' || chr(10) || '\1' || chr(10) || '\\end{verbatim}', 'g') AS text FROM documents""")
def r21(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.fences(F.concat(F.lit("Before\n```\n"), "text", F.lit("\n``` after"))).alias("text"))


@query("r22_r45_headings", r"""SELECT chunk_id, header_level AS level, CASE WHEN header_level = 1 THEN '\section{' ELSE '\subsection{' END || trim(text) || '}' AS heading, CASE WHEN header_level = 1 THEN '\chapter' ELSE '\section' END AS command FROM chunks WHERE header_level > 0""", True)
def r22(spark, sf):
    rows = _chunks(spark, sf).where("header_level > 0")
    level, latex = L.markdown_heading(F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.col("header_level")), F.lit(" "), F.col("text"), F.lit("\nbody")))
    named = F.when(F.col("header_level") == 1, "chapter").otherwise("section")
    return rows.select("chunk_id", level.alias("level"), latex.alias("heading"), L.section_command(named, "book").alias("command"))


@query("r30_f24_packages", _over(f"""SELECT chunk_id, array_to_string(list_filter([{', '.join("CASE WHEN " + " OR ".join(f"contains(latex, {_quote(m)})" for m in marks) + f" THEN {_quote(p)} END" for p, marks in L.PACKAGES.items())}], lambda x: x IS NOT NULL), ',') AS packages,
  {_count('latex', chr(92) + 'begin{figure}')} <> {_count('latex', chr(92) + 'includegraphics')} AS figure_mismatch FROM snips""", SNIPPETS), True)
def r30(spark, sf):
    latex = F.col("latex")
    return _snippets(spark, sf).select("chunk_id", F.array_join(L.packages(latex), ",").alias("packages"), (L.count_of(latex, r"\begin{figure}") != L.count_of(latex, r"\includegraphics")).alias("figure_mismatch"))


@query("j07_j15_r31_references", _over(r"""WITH refs AS (SELECT doc_id, chunk_id AS source, 'ref' AS command, unnest(regexp_extract_all(latex, '\\ref\{([^}]+)\}', 1)) AS target FROM snips
  UNION ALL SELECT doc_id, chunk_id, 'eqref', chunk_id FROM snips WHERE region_type <> 'text'),
bc AS (SELECT doc_id, chunk_id, min(name) AS name FROM lab GROUP BY ALL)
SELECT source, command, target, coalesce(l.name, bc.name) AS label, CASE WHEN coalesce(l.name, bc.name) IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM refs LEFT JOIN lab l ON l.doc_id = refs.doc_id AND l.name = refs.target LEFT JOIN bc ON bc.doc_id = refs.doc_id AND bc.chunk_id = refs.target""", SNIPPETS, LABELS), True)
def j07(spark, sf):
    rows = _snippets(spark, sf)
    named = X.references(rows).select("doc_id", "source", "command", "target")
    direct = rows.where("region_type <> 'text'").select("doc_id", F.col("chunk_id").alias("source"), F.lit("eqref").alias("command"), F.col("chunk_id").alias("target"))
    return X.link_references(named.unionByName(direct), X.labels(rows))


@query("j16_g03_reference_context", _over(r"""WITH refs AS (SELECT doc_id, chunk_id AS source, unnest(regexp_extract_all(latex, '\\ref\{([^}]+)\}', 1)) AS name, generate_subscripts(regexp_extract_all(latex, '\\ref\{([^}]+)\}', 1), 1) AS k FROM snips)
SELECT source, string_agg('% Reference Context (' || s.region_type || '):' || chr(10) || s.latex, chr(10) || chr(10) ORDER BY k) AS context
FROM refs JOIN lab USING (doc_id, name) JOIN snips s ON s.chunk_id = lab.chunk_id GROUP BY source""", SNIPPETS, LABELS), True)
def j16(spark, sf):
    return X.reference_contexts(_snippets(spark, sf))


@query("r32_feedback", _over("""SELECT event_id, code, detail, CASE code WHEN 'missing-package' THEN '{"type":"add-package","package":"' || detail || '"}' WHEN 'undefined-command' THEN '{"type":"define-command","command":"' || detail || '"}'
  WHEN 'environment-undefined' THEN '{"type":"add-package","package":"amsmath"}' ELSE '{"type":"math-mode-fix"}' END AS action FROM iss""", LOGS, _ISSUES))
def r32(spark, sf):
    return X.log_issues(_logs(spark, sf), "event_id", "log").drop("at")


@query("u09_distinct_actions", _over("""WITH a AS (SELECT event_id, CASE code WHEN 'missing-package' THEN '{"type":"add-package","package":"' || detail || '"}' WHEN 'undefined-command' THEN '{"type":"define-command","command":"' || detail || '"}'
  WHEN 'environment-undefined' THEN '{"type":"add-package","package":"amsmath"}' ELSE '{"type":"math-mode-fix"}' END AS action FROM iss) SELECT action, min(event_id) AS first_issue, count(*) AS issues FROM a GROUP BY action""", LOGS, _ISSUES))
def u09(spark, sf):
    return X.plan_actions(X.log_issues(_logs(spark, sf), "event_id", "log"), "event_id")


@query("r33_log_classes", _over("SELECT event_id, code FROM (" + " UNION ALL ".join(f"SELECT event_id, {_quote(c)} AS code FROM logs WHERE regexp_matches(log, {_quote(p)})" for c, p in X.LOG_CLASSES) + ")", LOGS))
def r33(spark, sf):
    return X.log_classes(_logs(spark, sf), "event_id", "log")


@query("r34_t16_repair_windows", _over(r"""WITH w AS (SELECT event_id, regexp_extract_all(log, 'l\.([0-9]+)', 1)[1:3] AS n FROM logs), k AS (SELECT event_id, unnest(n)::INT AS line, generate_subscripts(n, 1) - 1 AS "at" FROM w)
SELECT event_id, "at"::INT AS "at", greatest(1, line - 6) AS first, line + 6 AS last FROM k""", LOGS))
def r34(spark, sf):
    return X.repair_windows(_logs(spark, sf), "event_id", "log")


@query("r35_r36_math_classes", _over(rf"""WITH m AS (SELECT chunk_id, region_type AS kind, trim(latex) AS t FROM snips)
SELECT chunk_id, CASE WHEN t = '' THEN 'empty' WHEN regexp_matches(t, {_quote(L.MATH_CLASSES[0][0])}) THEN 'display-equation' WHEN regexp_matches(t, {_quote(L.MATH_CLASSES[1][0])}) AND length(t) < 256 THEN 'inline-equation'
  WHEN regexp_matches(t, {_quote(L.MATH_CLASSES[2][0])}) OR starts_with(lower(t), 'proof') THEN 'proof-step' WHEN regexp_matches(t, {_quote(L.MATH_CLASSES[3][0])}) THEN 'derivation' WHEN regexp_matches(t, {_quote(L.MATH_CLASSES[4][0])}) THEN 'function-definition'
  WHEN starts_with(lower(t), 'question') OR starts_with(lower(t), 'problem') THEN 'question-stem' WHEN starts_with(lower(t), 'solution') OR starts_with(lower(t), 'answer') THEN 'solution-text' ELSE 'paragraph' END AS class,
  CASE WHEN t = '' THEN NULL WHEN starts_with(t, '\[') AND ends_with(t, '\]') THEN 'displaymath' WHEN regexp_extract(t, '\\begin\{{([a-z*]+)\}}', 1) <> '' THEN regexp_extract(t, '\\begin\{{([a-z*]+)\}}', 1) WHEN kind = 'table' THEN NULL
  WHEN regexp_matches(t, '(?i)(cases|piecewise)') THEN 'cases' WHEN contains(t, '&') OR contains(t, '\') THEN 'align*' WHEN kind IN ('equation', 'formula') OR regexp_matches(t, '\$[^$].*?\$') THEN 'equation' END AS environment FROM m""", SNIPPETS), True)
def r35(spark, sf):
    name, _ = L.math_class(F.col("latex"))
    return _snippets(spark, sf).select("chunk_id", name.alias("class"), L.math_environment(F.col("region_type"), F.col("latex")).alias("environment"))


_PARENS, _BRACES, _NESTED = _reduced("t", ("()",)), _reduced("t", ("{}",)), _reduced("t", ("{}", "[]"))
_UNKNOWN = " + ".join(f"(contains(t, '{f}') AND NOT contains(t, '\\{f}'))::INT" for f in L.FUNCTIONS)


@query("r38_r39_w20_f30_equation_checks", _over(rf"""WITH a AS (SELECT chunk_id, trim(latex) || CASE WHEN pos % 3 = 0 THEN ' {{' WHEN pos % 3 = 1 THEN ' }} (' ELSE '' END AS t FROM snips),
b AS (SELECT chunk_id, {_NESTED} = '' AS nested, {_PARENS} = '' AS parens, {_count('t', chr(92) + 'left')} = {_count('t', chr(92) + 'right')} AS sides, {_UNKNOWN} AS unknown, {_BRACES} AS br, contains(t, '?') AS hole FROM a),
c AS (SELECT *, len(replace(br, '{{', '')) AS extra, len(replace(br, '}}', '')) AS opened, (NOT nested)::INT + (NOT parens)::INT AS errors, (NOT sides)::INT + unknown AS warnings FROM b)
SELECT chunk_id, errors, warnings, round(CASE WHEN errors + warnings = 0 THEN 0.95 ELSE greatest(0.0, 0.8 - (errors * 0.25 + warnings * 0.1)) END, 6)::DOUBLE AS score,
  (extra > 0)::INT + (extra = 0 AND opened > 0)::INT + (NOT sides)::INT + hole::INT AS notes, round(greatest(0.0, 1.0 - least(1.0, (extra + opened) / 6.0)), 6)::DOUBLE AS syntax, round(greatest(0.0, 1.0 - least(1.0, opened / 10.0)), 6)::DOUBLE AS document_syntax FROM c""", SNIPPETS), True)
def r38(spark, sf):
    t = F.concat(F.trim("latex"), F.when(F.col("pos") % 3 == 0, " {").when(F.col("pos") % 3 == 1, " } (").otherwise(""))
    rows = _snippets(spark, sf).select("chunk_id", t.alias("t"))
    rows = rows.select("chunk_id", "t", L.equation_issues(F.col("t")).alias("issues"))
    warnings = F.size(F.filter("issues", lambda x: x.isin("unmatched-left-right", "unknown-function")))
    return rows.select("chunk_id", (F.size("issues") - warnings).alias("errors"), warnings.alias("warnings"), F.round(L.equation_score(F.col("issues")), 6).alias("score"), F.size(L.equation_health(F.col("t"))).alias("notes"), F.round(L.snippet_syntax(F.col("t")), 6).alias("syntax"), F.round(L.document_syntax(F.col("t")), 6).alias("document_syntax"))


@query("r37_equation_normalise", r"""WITH t AS (SELECT chunk_id, text || ' sin x+y = \frac 1 2 - \frac34 (a' AS t FROM chunks),
f AS (SELECT chunk_id, regexp_replace(regexp_replace(t, '\\frac\s+([^\s\\{}]+)\s+([^\s\\{}]+)', '\\frac{\1}{\2}', 'g'), '\\frac\s*([0-9A-Za-z])([0-9A-Za-z])', '\\frac{\1}{\2}', 'g') AS t FROM t),
g AS (SELECT chunk_id, regexp_replace(t, '(^|[^\\A-Za-z0-9_])(sin|cos|tan|log|ln|exp)\b', '\1\\\2', 'g') AS t FROM f)
SELECT chunk_id, trim(regexp_replace(regexp_replace(t, '\s*([=+\-*/])\s*', ' \1 ', 'g'), '\s{2,}', ' ', 'g')) AS latex FROM g""", True)
def r37(spark, sf):
    return _chunks(spark, sf).select("chunk_id", L.normalise_equation(F.concat("text", F.lit(r" sin x+y = \frac 1 2 - \frac34 (a"))).alias("latex"))


@query("r46_m17_m25_tables", """WITH t AS (SELECT chunk_id, text, """ + _COLUMNS + r""" AS columns, list_distinct(list_filter(regexp_split_to_array(trim(lower(substr(text, 1, 60) || ' overview')), '\s+'), lambda x: x <> '')) AS own, list_filter(regexp_split_to_array(trim(lower(text)), '\s+'), lambda x: x <> '') AS there FROM chunks WHERE region_type = 'table')
SELECT chunk_id, columns::INT AS columns, round(greatest(0.65, least(0.95, 0.6 + columns * 0.05)), 6)::DOUBLE AS width, round(least(1.0, len(own) / 12.0) * 0.6 + least(1.0, len(list_intersect(own, there)) / greatest(len(own), 1) + 0.2) * 0.4, 6)::DOUBLE AS caption_score FROM t""", True)
def r46(spark, sf):
    from docloom.functions import text as T

    rows = _chunks(spark, sf).where("region_type = 'table'").withColumn("columns", T.table_columns(F.col("text")))
    caption = F.concat(F.substring("text", 1, 60), F.lit(" overview"))
    return rows.select("chunk_id", "columns", F.round(F.greatest(F.lit(0.65), F.least(F.lit(0.95), 0.6 + F.col("columns") * 0.05)), 6).alias("width"), F.round(L.caption_score(caption, F.col("text")), 6).alias("caption_score"))


@query("s27_r47_r48_f21_documents", _over(r"""WITH d AS (SELECT doc_id, string_agg(latex, chr(10) ORDER BY pos) AS tex, count(*) FILTER (region_type = 'heading') AS sections, count(*) FILTER (region_type = 'formula') AS equations FROM snips GROUP BY doc_id)
SELECT doc_id, md5(replace(replace(tex, '\toprule', '\hline'), '\midrule', '\hline')) AS mutated, sections, equations, len(regexp_extract_all(tex, '(?s)\\begin\{equation\}(.*?)\\end\{equation\}', 1))::INT AS found,
  array_to_string(list_filter([CASE WHEN sections = 0 THEN 'missing-sections' END, CASE WHEN len(regexp_extract_all(tex, '(?s)\\begin\{equation\}(.*?)\\end\{equation\}', 1)) < equations THEN 'equation-count-mismatch' END], lambda x: x IS NOT NULL), ',') AS issues FROM d""", SNIPPETS), True)
def s27(spark, sf):
    rows = _snippets(spark, sf)
    plan = rows.groupBy("doc_id").agg(F.count_if(F.col("region_type") == "heading").alias("sections"), F.count_if(F.col("region_type") == "formula").alias("equations"))
    out = X.assemble(rows).join(plan, "doc_id")
    found = F.size(F.regexp_extract_all("tex", F.lit(r"(?s)\\begin\{equation\}(.*?)\\end\{equation\}"), F.lit(1)))
    issues = F.array_join(F.array_compact(F.array(F.when(F.col("sections") == 0, "missing-sections"), F.when(found < F.col("equations"), "equation-count-mismatch"))), ",")
    return out.select("doc_id", F.md5(L.replace_all(F.col("tex"), L.MUTATIONS).cast("binary")).alias("mutated"), "sections", "equations", found.alias("found"), issues.alias("issues"))


@query("w12_section_units", _over("SELECT * FROM units", SNIPPETS, _UNITS), True)
def w12(spark, sf):
    return X.section_units(_snippets(spark, sf))


@query("c04_changed_units", _over("SELECT checksum, doc_id, ordinal, name, start_line, end_line FROM units WHERE checksum NOT IN (SELECT checksum FROM units WHERE doc_id % 2 = 0)", SNIPPETS, _UNITS), True)
def c04(spark, sf):
    units = X.section_units(_snippets(spark, sf))
    return X.changed_units(units, units.where("doc_id % 2 = 0"))


@query("m09_m13_m21_snippet_scores", _over(rf"""WITH s AS (SELECT chunk_id, latex AS t FROM snips) SELECT chunk_id, round(greatest(0.0, least(1.0, 0.3 + CASE WHEN contains(t, '\toprule') THEN 0.2 ELSE 0 END + CASE WHEN contains(t, '\begin{{align') OR contains(t, '\begin{{equation}}') THEN 0.1 ELSE 0 END
  + CASE WHEN contains(t, '\begin{{table}}') AND contains(t, '\caption') THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS aesthetic, round(least(1.0, ({' + '.join(f"contains(t, {_quote(x)})::INT" for x in L.STYLE)}) * 0.2), 6)::DOUBLE AS style,
  round(greatest(0.1, 1.0 - ({_count('lower(t)', 'error')} * 0.05 + {_count('lower(t)', 'warning')} * 0.01)), 6)::DOUBLE AS evaluator FROM s""", SNIPPETS), True)
def m09(spark, sf):
    t, low = F.col("latex"), F.lower("latex")
    evaluator = F.greatest(F.lit(0.1), 1.0 - (L.count_of(low, "error") * 0.05 + L.count_of(low, "warning") * 0.01))
    return _snippets(spark, sf).select("chunk_id", F.round(L.aesthetic_score(t), 6).alias("aesthetic"), F.round(L.style_score(t), 6).alias("style"), F.round(evaluator, 6).alias("evaluator"))
