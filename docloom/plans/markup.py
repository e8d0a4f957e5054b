"""Queries over Markdown and LaTeX as text: conversion, repairs, environments, preambles, buffered chunks.

The documents hold plain lines only, so Markdown and faulty LaTeX are planted in them by
the same rules in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import markup as M
from docloom.operators import markup as X
from docloom.plans import CHUNKS, _chunks, query, table
from docloom.plans.latex import SNIPPETS, _escaped, _over, _quote, _replaced, _snippets


def _lit(s: str) -> str:
    """A SQL text with its line ends as chr(10)."""
    return " || chr(10) || ".join(_quote(p) for p in s.split("\n"))


# Markdown

_MD = r"""md AS (SELECT doc_id, pos, CASE WHEN region_type = 'heading' THEN repeat('#', 1 + pos % 3) || ' ' || text WHEN region_type = 'list' OR pos % 7 IN (2, 3) THEN '- ' || text
  WHEN region_type = 'table' OR pos % 7 IN (4, 6) THEN '| ' || text || ' | ' || pos || ' |' WHEN pos % 7 = 5 THEN '|---|:--|' ELSE text END AS line FROM chunks)"""


def _markdown(spark, sf):
    c, p = _chunks(spark, sf), F.col("pos")
    line = (
        F.when(F.col("region_type") == "heading", F.concat(F.repeat(F.lit("#"), 1 + p % 3), F.lit(" "), "text"))
        .when((F.col("region_type") == "list") | (p % 7).isin(2, 3), F.concat(F.lit("- "), "text"))
        .when((F.col("region_type") == "table") | (p % 7).isin(4, 6), F.concat(F.lit("| "), "text", F.lit(" | "), p, F.lit(" |")))
        .when(p % 7 == 5, "|---|:--|")
        .otherwise(F.col("text"))
    )
    return c.select("doc_id", "pos", line.alias("line"))


_CELLS = rf"list_transform(string_split(regexp_replace(t, '^\|+|\|+$', '', 'g'), '|'), lambda c: {_escaped(r'''(CASE WHEN trim(c) = '' THEN '\,' ELSE trim(c) END)''', '{}')})"
_ROW = r"'    ' || array_to_string({}, ' & ') || ' \\'"


@query("r23_w16_markdown", _over(rf"""WITH m0 AS (SELECT doc_id, pos, rtrim(line) AS raw, trim(line) AS t, starts_with(trim(line), '|') AS bar, len(regexp_extract_all(trim(line), '\|')) >= 2 AS wide FROM md),
m1 AS (SELECT *, sum((NOT bar)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM m0),
m2 AS (SELECT *, bar AND max((bar AND wide)::INT) OVER (PARTITION BY doc_id, island ORDER BY pos) = 1 AS in_table FROM m1),
m3 AS (SELECT *, CASE WHEN raw = '' THEN 'blank' WHEN starts_with(raw, '### ') THEN 'h3' WHEN starts_with(raw, '## ') THEN 'h2' WHEN starts_with(raw, '# ') THEN 'h1' WHEN starts_with(t, '- ') THEN 'bullet' WHEN in_table THEN 'table' ELSE 'paragraph' END AS kind FROM m2),
m4 AS (SELECT *, coalesce(lag(kind) OVER w, '') AS b, coalesce(lead(kind) OVER w, '') AS a FROM m3 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
m5 AS (SELECT *, CASE WHEN kind = 'table' THEN sum((kind = 'table' AND b <> 'table')::INT) OVER (PARTITION BY doc_id ORDER BY pos) ELSE -pos END AS block FROM m4),
tb AS (SELECT doc_id, block, min(pos) AS pos, list({_CELLS} ORDER BY pos) AS rs FROM m5 WHERE kind = 'table' GROUP BY doc_id, block),
tc AS (SELECT *, len(rs[1]) AS width, CASE WHEN len(rs) > 1 AND len(list_filter(rs[2], lambda c: NOT regexp_matches(c, '^[-: ]*$'))) = 0 THEN rs[3:] ELSE rs[2:] END AS body FROM tb),
td AS (SELECT doc_id, pos, '\begin{{table}}[H]' || chr(10) || '  \centering' || chr(10) || '  \begin{{tabular}}{{' || repeat('l', width) || '}}' || chr(10) || '    \toprule' || chr(10) || {_ROW.format('rs[1]')}
  || CASE WHEN len(body) > 0 THEN chr(10) || '    \midrule' || chr(10) || array_to_string(list_transform(body, lambda r: {_ROW.format("r || list_resize([]::VARCHAR[], greatest(width - len(r), 0), '')")}), chr(10)) ELSE '' END
  || chr(10) || '    \bottomrule' || chr(10) || '  \end{{tabular}}' || chr(10) || '\end{{table}}' AS body FROM tc),
me AS (SELECT doc_id, pos, CASE WHEN kind = 'bullet' AND b <> 'bullet' THEN '\begin{{itemize}}' || chr(10) ELSE '' END || CASE kind WHEN 'h3' THEN '\paragraph*{{' || {_escaped('trim(raw[5:])', '{}')} || '}}' WHEN 'h2' THEN '\subsection*{{' || {_escaped('trim(raw[4:])', '{}')} || '}}'
  WHEN 'h1' THEN '\section*{{' || {_escaped('trim(raw[3:])', '{}')} || '}}' WHEN 'bullet' THEN '  \item ' || {_escaped('trim(t[3:])', '{}')} WHEN 'paragraph' THEN '\noindent ' || {_escaped("trim(regexp_replace(raw, '\\s+', ' ', 'g'))", '{}')} || '\\' ELSE '' END
  || CASE WHEN kind = 'bullet' AND a <> 'bullet' THEN chr(10) || '\end{{itemize}}' ELSE '' END AS body FROM m5 WHERE kind <> 'table' UNION ALL SELECT * FROM td)
SELECT doc_id, trim(string_agg(body, chr(10) ORDER BY pos), ' ' || chr(10) || chr(9)) AS latex FROM me GROUP BY doc_id""", _MD), True)
def r23(spark, sf):
    return X.markdown_to_latex(_markdown(spark, sf))


_MARKED = r"repeat('#', pos % 5 + 1) || ' **' || word || '** and *it* with __b__ _u_ `c`'"


@query("r20_inline_markdown", rf"""WITH w AS (SELECT chunk_id, pos, regexp_extract(text, '([A-Za-z]+)', 1) AS word FROM chunks),
k AS (SELECT chunk_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '(\*\*([^*]+)\*\*)', '\\textbf{{\2}}', 'g'), '__([^_]+)__', '\\textbf{{\1}}', 'g'), '\*([^*]+)\*', '\\textit{{\1}}', 'g'), '_([^_]+)_', '\\textit{{\1}}', 'g') AS line FROM w WHERE word <> '')
SELECT chunk_id, CASE pos % 5 WHEN 0 THEN '\section' WHEN 1 THEN '\subsection' WHEN 2 THEN '\subsubsection' ELSE '\paragraph' END || '{{' || ltrim(regexp_replace(line, '`([^`]+)`', '\\texttt{{\1}}', 'g'), '# ') || '}}' AS latex FROM k""", True)
def r20(spark, sf):
    c = _chunks(spark, sf).select("chunk_id", "pos", F.regexp_extract("text", "([A-Za-z]+)", 1).alias("word")).where("word <> ''")
    line = F.concat(F.repeat(F.lit("#"), F.col("pos") % 5 + 1), F.lit(" **"), "word", F.lit("** and *it* with __b__ _u_ `c`"))
    return c.select("chunk_id", M.inline_markdown(line).alias("latex"))


@query("r14_glyph_cleanup", r"""WITH t AS (SELECT doc_id, text || ' 1 2  3 4 − ﬁx =   y   + z — 7' AS t FROM documents), g AS (SELECT doc_id, """ + _replaced("t", M.OCR_GLYPHS) + r""" AS t FROM t)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '([0-9])\s+([0-9])', '\1\2', 'g'), '([0-9])\s+([0-9])', '\1\2', 'g'), '([=+\-])\s{2,}', '\1 ', 'g'), '\s{2,}([=+\-])', ' \1', 'g') AS text FROM g""")
def r14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.clean_glyphs(F.concat("text", F.lit(" 1 2  3 4 − ﬁx =   y   + z — 7"))).alias("text"))


# Repairs

_F15 = "\\providecommand{\\enit@x}{}\nend \\providecommand{\\y}{}\n\\providecommand{\\z}{\\endtable}"


@query("f15_internal_macros", rf"SELECT doc_id, array_to_string(list_filter(string_split(text || chr(10) || {_lit(_F15)}, chr(10)), lambda x: NOT regexp_matches(x, '{M.INTERNAL_MACRO}')), chr(10)) AS text FROM documents")
def f15(spark, sf):
    text = F.concat("text", F.lit("\n" + _F15))
    return table(spark, sf, "documents").select("doc_id", M.keep_lines(text, lambda x: ~x.rlike(M.INTERNAL_MACRO)).alias("text"))


_MATHY = r"trim(line) <> '' AND NOT starts_with(trim(line), '\') AND NOT regexp_matches(line, 'Section|Question|Introduction') AND regexp_matches(trim(line), '[=+−*/^±∞√<>≤≥≈≡]') AND len(regexp_extract_all(trim(line), '\p{L}')) <= length(trim(line)) * 0.7"
_RUNS = "r0 AS (SELECT doc_id, pos, line, {} AS held FROM li), r1 AS (SELECT *, coalesce(lag(held) OVER w, false) AS b, coalesce(lead(held) OVER w, false) AS a FROM r0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"


@query("r40_w14_formula_blocks", _over(rf"""SELECT doc_id, string_agg(CASE WHEN held THEN CASE WHEN b THEN '' ELSE '\begin{{align*}}' || chr(10) END || trim(line) || CASE WHEN a THEN ' \\' ELSE chr(10) || '\end{{align*}}' END ELSE line END, chr(10) ORDER BY pos) AS latex FROM r1 GROUP BY doc_id""",
  "li AS (SELECT doc_id, pos, CASE WHEN pos % 5 IN (1, 2) THEN 'x = ' || pos || '^2' ELSE text END AS line FROM chunks)", _RUNS.format(_MATHY)), True)
def r40(spark, sf):
    line = F.when((F.col("pos") % 5).isin(1, 2), F.concat(F.lit("x = "), "pos", F.lit("^2"))).otherwise(F.col("text"))
    return X.wrap_formulas(_chunks(spark, sf).select("doc_id", "pos", line.alias("line")))


_ALIGNED = r"CASE WHEN contains({0}, '=') AND NOT contains({0}, '&') THEN trim({0}[:instr({0}, '=') - 1]) || ' & = ' || trim({0}[instr({0}, '=') + 1:]) ELSE {0} END"
_BODY = r"trim(regexp_replace(regexp_replace(trim(line), '^(\[|\\\[)', ''), '(\\\]|\])$', ''))"


@query("w15_r40_aligned_displays", _over(rf"""SELECT doc_id, string_agg(CASE WHEN held AND (a OR b) THEN CASE WHEN b THEN '' ELSE '\begin{{align*}}' || chr(10) END || {_ALIGNED.format(_BODY)} || CASE WHEN a THEN ' \' ELSE chr(10) || '\end{{align*}}' END ELSE line END, chr(10) ORDER BY pos) AS latex FROM r1 GROUP BY doc_id""",
  r"li AS (SELECT doc_id, pos, CASE WHEN pos % 5 IN (1, 2, 4) THEN '\[ a' || pos || ' = b \]' ELSE text END AS line FROM chunks)", _RUNS.format(r"regexp_matches(line, '^\\\[.*=.*\\\]\s*$')")), True)
def w15(spark, sf):
    line = F.when((F.col("pos") % 5).isin(1, 2, 4), F.concat(F.lit("\\[ a"), "pos", F.lit(" = b \\]"))).otherwise(F.col("text"))
    return X.align_displays(_chunks(spark, sf).select("doc_id", "pos", line.alias("line")))


def _macros_sql(column: str) -> str:
    out = _replaced(column, M.JOINED)
    for m in ("Rightarrow", "rightarrow"):
        out = rf"regexp_replace({out}, '\\{m}([a-zA-Z])', '\\{m} \1', 'g')"
    out = rf"regexp_replace({out}, '\\sqrt([^a-zA-Z]|$)', '\\ensuremath{{\\surd}}\1', 'g')"
    for m in M.MATH_MACROS:
        out = rf"regexp_replace({out}, '\\{m}([^a-zA-Z]|$)', '\\ensuremath{{\\{m}}}\1', 'g')"
    return out


_SAMPLE = r" \inR \Rightarrowgraph \sqrt x \pm 3 \le 4 \times. \in Z \alphax \alpha"


@query("r40_math_macros", f"SELECT doc_id, {_macros_sql('text || ' + _quote(_SAMPLE))} AS text FROM documents")
def r40m(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.math_macros(F.concat("text", F.lit(_SAMPLE))).alias("text"))


_KEPT = "list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query("r40_force_align", rf"""WITH c AS (SELECT chunk_id, text || chr(10) || 'y = ' || pos || chr(10) || 'z & = 1' || CASE WHEN pos % 4 = 0 THEN chr(10) || '\begin{{align}}' ELSE '' END AS t FROM chunks)
SELECT chunk_id, CASE WHEN contains(lower(t), '\begin{{align') THEN t ELSE '\begin{{align*}}' || chr(10) || array_to_string(list_transform({_KEPT.format('t')}, lambda v: {_ALIGNED.format('v')}), ' \' || chr(10)) || chr(10) || '\end{{align*}}' END AS latex FROM c""", True)
def r40f(spark, sf):
    t = F.concat("text", F.lit("\ny = "), "pos", F.lit("\nz & = 1"), F.when(F.col("pos") % 4 == 0, "\n\\begin{align}").otherwise(""))
    return _chunks(spark, sf).select("chunk_id", M.force_align(t).alias("latex"))


_PLAIN = r"(letters > 20 AND length(b) - length(replace(b, '\', '')) <= 1 AND len(regexp_extract_all(b, '[=+\-/*_^]')) < letters / 4)"


@query("r40_demoted_equations", rf"""WITH c AS (SELECT chunk_id, pos, trim(CASE WHEN pos % 3 = 0 THEN 'x = 1' ELSE text END) AS b FROM chunks), k AS (SELECT *, len(regexp_extract_all(b, '\p{{L}}')) AS letters FROM c)
SELECT chunk_id, 'A ' || CASE WHEN b <> '' AND (contains(b, '```') OR starts_with(b, '%') OR {_PLAIN}) THEN '\par ' || {_escaped('b', '{}')} || '\par' || chr(10) ELSE '\begin{{equation}}' || chr(10) || b || chr(10) || '\end{{equation}}' END || ' B' AS latex FROM k""", True)
def r40d(spark, sf):
    body = F.trim(F.when(F.col("pos") % 3 == 0, "x = 1").otherwise(F.col("text")))
    return _chunks(spark, sf).select("chunk_id", M.demote_equations(F.concat(F.lit("A \\begin{equation}\n"), body, F.lit("\n\\end{equation} B"))).alias("latex"))


def _refined_sql(column: str) -> str:
    out = rf"regexp_replace({_replaced(column, M.OUTPUT_GLYPHS)}, '\\Rightarrow([a-zA-Z0-9])', '\\Rightarrow \1', 'g')"
    for m in M.OUTPUT_MACROS:
        out = rf"regexp_replace({out}, '(^|[^{{])\\{m}([^a-zA-Z]|$)', '\1\\ensuremath{{\\{m}}}\2', 'g')"
    out = rf"regexp_replace({out}, '\\begin\{{align\*?\}}\s*\\\[', '\\begin{{align}}' || chr(10), 'g')"
    return rf"regexp_replace({out}, '\\\]\s*\\end\{{align\*?\}}', chr(10) || '\\end{{align}}', 'g')"


_OUTPUT = "\na ≠ b → c\n\\RightarrowN \\leq 3\nx = 4_2\n$y = 1$\n% z = 2\n\\begin{align*}\n\\[ q \\]\n\\end{align*}"


@query("r41_refined_output", rf"""WITH t AS (SELECT doc_id, {_refined_sql('text || ' + _lit(_OUTPUT))} AS t FROM documents)
SELECT doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN NOT regexp_matches(trim(x), '^([%\\]|$)') AND regexp_matches(trim(x), '[=^_]') AND NOT regexp_matches(trim(x), '\$|\\\(|\\\[') THEN '\[ ' || trim(x) || ' \]' ELSE x END), chr(10)) AS text FROM t""")
def r41(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.refine_output(F.concat("text", F.lit(_OUTPUT))).alias("text"))


_OPEN = (r"\begin{a}\begin{b}x\end{c}\end{b}", r"\end{q}\begin{figure}\begin{center}", r"\begin{a}\end{a}")


@query("r42_balanced_environments", rf"""WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN {_quote(_OPEN[0])} WHEN 1 THEN {_quote(_OPEN[1])} ELSE {_quote(_OPEN[2])} END AS t FROM documents),
m AS (SELECT doc_id, t, list_transform(regexp_extract_all(t, '\\(?:begin|end)\{{[^}}]+\}}'), lambda x: [x]) AS ms FROM t),
s AS (SELECT doc_id, t, list_filter(CASE WHEN len(ms) = 0 THEN []::VARCHAR[] ELSE list_reduce(ms, lambda s, m: CASE WHEN starts_with(m[1], '\begin') THEN s || m WHEN len(s) > 0 AND s[len(s)] = '\begin' || m[1][5:] THEN s[1:len(s) - 1] ELSE s END) END, lambda x: starts_with(x, '\begin')) AS st FROM m)
SELECT doc_id, t || array_to_string(list_transform(list_reverse(st), lambda x: chr(10) || '\end' || x[7:]), '') AS latex FROM s""")
def r42(spark, sf):
    n = F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", M.balance_environments(F.concat("text", F.when(n == 0, _OPEN[0]).when(n == 1, _OPEN[1]).otherwise(_OPEN[2]))).alias("latex"))


_HEAD = "\\documentclass{article}\n\\usepackage{amsmath}\n\\begin{document}\n$$a$$ and $$b"


def _injected_sql(column: str, line: str, present: str) -> str:
    return rf"CASE WHEN instr({column}, '\begin{{document}}') = 0 OR {present} THEN {column} ELSE {column}[:instr({column}, '\begin{{document}}') - 1] || {line} || chr(10) || {column}[instr({column}, '\begin{{document}}'):] END"


_P = "CASE doc_id % 2 WHEN 0 THEN 'amsmath' ELSE 'booktabs' END"


@query("r43_injections", rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text ELSE {_lit(_HEAD)} || text || CASE WHEN doc_id % 3 = 0 THEN '$$' ELSE '' END END AS t FROM documents),
p AS (SELECT doc_id, t, {_injected_sql('t', rf"'\usepackage{{' || {_P} || '}}'", rf"contains(t, '\usepackage{{' || {_P} || '}}')")} AS package FROM t),
s AS (SELECT *, {_injected_sql('package', r"'\providecommand{\foo}{\texttt{\foo}}'", 'false')} AS command, string_split(t, '$$') AS parts FROM p)
SELECT doc_id, command AS latex, replace(replace(array_to_string(list_transform(parts, lambda x, i: x || CASE WHEN i = len(parts) THEN CASE WHEN len(parts) % 2 = 0 THEN '\]' ELSE '' END WHEN i % 2 = 1 THEN '\[' ELSE '\]' END), ''), '\begin{{align}}', '\begin{{aligned}}'), '\end{{align}}', '\end{{aligned}}') AS displays FROM s""")
def r43(spark, sf):
    n = F.col("doc_id")
    t = F.when(n % 5 == 0, F.col("text")).otherwise(F.concat(F.lit(_HEAD), "text", F.when(n % 3 == 0, "$$").otherwise("")))
    rows = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    package = M.inject_package(F.col("t"), F.when(n % 2 == 0, "amsmath").otherwise("booktabs"))
    return rows.select("doc_id", M.define_command(package, F.lit("foo")).alias("latex"), M.normalise_displays(F.col("t")).alias("displays"))


_BLOCKS = "Keep\n<<<SOURCE\nhidden\n>>>\nstyle exemplar: x\n```latex\nStay\n```\n<<<source again\nSOURCE\nEnd"


@query("w17_clean_snippets", rf"""WITH l AS (SELECT doc_id, unnest(string_split({_lit(_BLOCKS)} || chr(10) || text, chr(10))) AS x, generate_subscripts(string_split({_lit(_BLOCKS)} || chr(10) || text, chr(10)), 1) AS i FROM documents),
o AS (SELECT *, starts_with(lower(trim(x)), '<<<source') AS opens, trim(x) IN ('SOURCE', '>>>') AS closes FROM l),
s AS (SELECT *, max(CASE WHEN opens THEN i END) OVER w AS last_open, coalesce(max(CASE WHEN closes THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last_close FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, trim(string_agg(x, chr(10) ORDER BY i), ' ' || chr(10) || chr(9) || chr(13)) AS text FROM s WHERE NOT (last_open IS NOT NULL AND last_close < last_open) AND NOT regexp_matches(lower(trim(x)), '^({"|".join(M.PROMPT_LINES)})') AND trim(x) NOT IN ('```latex', '```') GROUP BY doc_id""")
def w17(spark, sf):
    return table(spark, sf, "documents").select("doc_id", M.clean_snippet(F.concat(F.lit(_BLOCKS + "\n"), "text")).alias("text"))


_THEOREMS = ("Lemma 2. ", "proof by ", "An algorithm for ", "definition of ", "")


@query("r44_semantic_wraps", r"""WITH c AS (SELECT chunk_id, pos, CASE pos % 5 WHEN 0 THEN 'Lemma 2. ' WHEN 1 THEN 'proof by ' WHEN 2 THEN 'An algorithm for ' WHEN 3 THEN 'definition of ' ELSE '' END || text AS t, CASE pos % 3 WHEN 0 THEN 'mathematics' WHEN 1 THEN 'computer_science' ELSE 'general' END AS d FROM chunks),
k AS (SELECT *, CASE WHEN d = 'computer_science' AND regexp_matches(t, '(?i)\b(algorithm|procedure)\b') THEN 'algorithm' WHEN d = 'mathematics' AND regexp_matches(t, '(?i)^(theorem|lemma|definition|corollary|proposition)\b') THEN CASE WHEN regexp_matches(t, '(?i)^(definition|lemma|corollary)\b') THEN lower(regexp_extract(t, '^([A-Za-z]+)', 1)) ELSE 'theorem' END
  WHEN d = 'mathematics' AND regexp_matches(t, '(?i)^(proof|sketch)\b') THEN 'proof' ELSE '' END AS label FROM c)
SELECT chunk_id, label, CASE label WHEN '' THEN t WHEN 'algorithm' THEN '\begin{algorithm}[H]' || chr(10) || '\caption{' || CASE WHEN length(trim(t)) > 80 THEN trim(t)[:77] || '...' ELSE trim(t) END || '}' || chr(10) || '\begin{algorithmic}' || chr(10) || trim(t) || chr(10) || '\end{algorithmic}' || chr(10) || '\end{algorithm}'
  ELSE '\begin{' || label || '}' || chr(10) || trim(t) || CASE WHEN label = 'proof' THEN chr(10) || '\qedhere' ELSE '' END || chr(10) || '\end{' || label || '}' END AS latex FROM k""", True)
def r44(spark, sf):
    p = F.col("pos")
    t = F.concat(F.element_at(F.array(*(F.lit(x) for x in _THEOREMS)), (p % 5 + 1).cast("int")), "text")
    domain = F.when(p % 3 == 0, "mathematics").when(p % 3 == 1, "computer_science").otherwise("general")
    latex, label = M.semantic_wrap(t, t, domain, F.lit(""))
    return _chunks(spark, sf).select("chunk_id", label.alias("label"), latex.alias("latex"))


# Bibliographies, environments, preambles


@query("r28_bibtex", rf"""WITH t AS (SELECT doc_id, '[1] Doe, On things' || chr(10) || text || chr(10) || '2. Roe, More' AS t FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x, i: CASE WHEN regexp_matches(x, '^[\[?]?[0-9]+\]?\.? ') THEN '@article{{ref' || (i - 1) || ',' || chr(10) || '  title={{' || x || '}},' || chr(10) || '  author={{Unknown}},' || chr(10) || '  year={{2024}}' || chr(10) || '}}' END), lambda x: x IS NOT NULL), chr(10) || chr(10)) AS entries,
  '@misc{{key' || doc_id || ',' || chr(10) || {_lit('''  title={Placeholder reference},
  author={Unknown},
  year={2024},
  note={Auto-generated placeholder for missing citation}
}''')} AS placeholder FROM t""")
def r28(spark, sf):
    t = F.concat(F.lit("[1] Doe, On things\n"), "text", F.lit("\n2. Roe, More"))
    return table(spark, sf, "documents").select("doc_id", M.bibtex_entries(t).alias("entries"), M.placeholder_entry(F.concat(F.lit("key"), "doc_id")).alias("placeholder"))


_RULES = ((r"\[1\]", r"\cite{ref1}"), (r"\[2, ?3\]", r"\cite{ref2,ref3}"), (r"\(Doe, [0-9]{4}\)", r"\cite{doe}"))


@query("r27_citation_replacement", "SELECT doc_id, " + "regexp_replace(" * 3 + "text || ' as [1] and [2,3] (Doe, 2001) show'" + "".join(f", {_quote(p)}, {_quote(r.replace(chr(92), chr(92) * 2))}, 'g')" for p, r in _RULES) + " AS text FROM documents")
def r27(spark, sf):
    t = F.concat("text", F.lit(" as [1] and [2,3] (Doe, 2001) show"))
    for pattern, cite in _RULES:
        t = F.regexp_replace(t, pattern, cite.replace("\\", "\\\\"))
    return table(spark, sf, "documents").select("doc_id", t.alias("text"))


_EQUATIONS = "|".join(rf"\\begin\{{{e}\}}(?s:.*?)\\end\{{{e}\}}" for e in (r"equation\*", "equation", r"align\*", "align", "multline"))


@query("r29_x15_environments", _over(rf"""WITH d AS (SELECT doc_id, string_agg(latex, chr(10) ORDER BY pos) AS latex FROM snips GROUP BY doc_id),
e AS (SELECT doc_id, 'table' AS kind, regexp_extract_all(latex, '(?s)\\begin\{{table\}}.*?\\end\{{table\}}') AS found FROM d UNION ALL SELECT doc_id, 'figure', regexp_extract_all(latex, '(?s)\\begin\{{figure\}}.*?\\end\{{figure\}}') FROM d UNION ALL SELECT doc_id, 'equation', regexp_extract_all(latex, '{_EQUATIONS}') FROM d),
u AS (SELECT doc_id, kind, unnest(found) AS text, generate_subscripts(found, 1) - 1 AS n FROM e)
SELECT doc_id, doc_id || '-' || kind || '-' || lpad(n::VARCHAR, 3, '0') AS entry_id, kind, trim(text) AS text FROM u""", SNIPPETS), True)
def r29(spark, sf):
    rows = _snippets(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "latex"))).alias("x"))
    return X.environment_rows(rows.select("doc_id", F.array_join(F.transform("x", lambda v: v["latex"]), "\n").alias("latex")))


_PREAMBLES = (r"\usepackage[utf8]{inputenc}\usepackage{amsmath, amssymb}", r"\usepackage{graphicx}", r"\usepackage{a,,b}")


@query("r51_preamble_packages", rf"""WITH p AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {_quote(_PREAMBLES[0])} WHEN 1 THEN {_quote(_PREAMBLES[1])} ELSE {_quote(_PREAMBLES[2])} END || text AS t FROM documents), u AS (SELECT doc_id, unnest(flatten(list_transform(regexp_extract_all(t, '{M.PACKAGE}', 1), lambda x: string_split(x, ',')))) AS name FROM p)
SELECT doc_id, trim(name) AS name FROM u WHERE trim(name) <> ''""")
def r51(spark, sf):
    n = F.col("doc_id") % 3
    t = F.concat(F.when(n == 0, _PREAMBLES[0]).when(n == 1, _PREAMBLES[1]).otherwise(_PREAMBLES[2]), "text")
    return table(spark, sf, "documents").select("doc_id", F.explode(M.preamble_packages(t)).alias("name"))


# Chunks

_BUCKETS = r"list_transform(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: (('0x' || md5(w)[1:8])::BIGINT % 256)::INT)"
_DOT = "coalesce(list_sum(list_transform(list_distinct({0}), lambda q: len(list_filter({0}, lambda y: y = q)) * len(list_filter({1}, lambda y: y = q)))), 0)"


@query("w09_m04_buffered_chunks", rf"""WITH RECURSIVE {CHUNKS}, k0 AS (SELECT doc_id, page, pos, region_type, text, {_BUCKETS} AS v FROM chunks),
k1 AS (SELECT *, lag(v) OVER w AS pv, lag(region_type) OVER w AS pr, row_number() OVER w AS n, greatest(1, len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')))::INT AS s FROM k0 WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)),
k2 AS MATERIALIZED (SELECT doc_id, page, pos, n, region_type, length(text)::INT AS c, s, coalesce(pr <> region_type, false) OR region_type IN ('heading', 'question', 'answer', 'figure', 'table', 'formula') AS hard,
  CASE WHEN pv IS NULL THEN false WHEN len(pv) = 0 OR len(v) = 0 THEN true ELSE 1.0 - round({_DOT.format('pv', 'v')}::DOUBLE / (sqrt({_DOT.format('pv', 'pv')}::DOUBLE) * sqrt({_DOT.format('v', 'v')}::DOUBLE)), 9) >= 0.42 END AS far FROM k1),
f AS (SELECT doc_id, page, pos, n, region_type, c, c AS held, s, 0 AS chunk FROM k2 WHERE n = 1
  UNION ALL SELECT k.doc_id, k.page, k.pos, k.n, k.region_type, k.c, CASE WHEN e THEN k.c ELSE f.held + k.c END, CASE WHEN e THEN k.s ELSE f.s + k.s END, f.chunk + e::INT
  FROM f JOIN k2 k ON k.doc_id = f.doc_id AND k.page = f.page AND k.n = f.n + 1, LATERAL (SELECT k.hard OR f.held + k.c > 600 OR (k.far AND f.s >= 2) AS e))
SELECT doc_id, page, chunk, min(pos)::INT AS first_pos, count(*) AS n, arg_max(region_type, pos) AS region, (sum(c) + 2 * (count(*) - 1))::BIGINT AS chars FROM f GROUP BY doc_id, page, chunk""")
def w09(spark, sf):
    return X.buffered_chunks(_chunks(spark, sf))


@query("u08_repeated_figures", """WITH f AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 'figure' ELSE region_type END AS region_type, CASE pos % 4 WHEN 0 THEN ['b', 'a'] WHEN 1 THEN ['a', 'b'] WHEN 2 THEN ['c'] ELSE []::VARCHAR[] END AS images FROM chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, list_sort(images), region_type = 'figure' AND len(images) > 0 ORDER BY pos) AS k FROM f) SELECT doc_id, pos FROM r WHERE k = 1 OR NOT (region_type = 'figure' AND len(images) > 0)""", True)
def u08(spark, sf):
    p, text = F.col("pos"), lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    rows = _chunks(spark, sf).select("doc_id", "pos", F.when(p % 3 == 0, "figure").otherwise(F.col("region_type")).alias("region_type"), F.when(p % 4 == 0, text("b", "a")).when(p % 4 == 1, text("a", "b")).when(p % 4 == 2, text("c")).otherwise(text()).alias("images"))
    return X.drop_repeated_figures(rows).select("doc_id", "pos")
