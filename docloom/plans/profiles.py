"""Queries that judge documents, blocks, versions and runs. Marks that the tables lack are planted by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import latex as L
from docloom.functions import profiles as P
from docloom.functions import text as T
from docloom.operators import chunks as C
from docloom.operators import runs as R
from docloom.operators import scoring as S
from docloom.plans import _NOISE, _PAIRS, _chunks, _pairs, query, table
from docloom.plans.latex import SNIPPETS, _count, _over, _quote, _snippets


def _hits(column: str, words) -> str:
    return "(" + " + ".join(_count(column, w) for w in words) + ")"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quote(w)})" for w in words) + ")"


def _case(marks, n: str = "doc_id") -> str:
    """SQL that picks one of ``marks`` by a number's remainder."""
    return f"CASE {n} % {len(marks)} " + " ".join(f"WHEN {i} THEN {_quote(m)}" for i, m in enumerate(marks)) + " END"


def _pick(marks, n: str = "doc_id"):
    """The same as a column."""
    return F.element_at(F.array(*(F.lit(m) for m in marks)), (F.col(n) % len(marks) + 1).cast("int"))


# Domains and styles

_TOPICS = (" algorithm step theorem", " quantum energy Joule", " signal stress et al.", "", " \\cite{x} proof")


def _domain_sql() -> str:
    total = "d AS (SELECT doc_id, sum(length(low)) + count(*) - 1 AS size, avg((region_type IN ('formula', 'table'))::INT) AS math, avg(" + _any("low", P.ALGORITHM_MARKS) + r"::INT) AS algorithm, avg((contains(t, '\cite') OR contains(low, 'et al.'))::INT) AS citation, avg(" + _any("low", P.PHYSICS_MARKS) + "::INT) AS phys, "
    total += ", ".join(f"sum({_hits('low', w)}) AS h_{d}" for d, w in P.DOMAIN_WORDS.items()) + " FROM dom GROUP BY doc_id)"
    extra = {"mathematics": "math * 1.5", "computer_science": "algorithm * 1.3", "physics": "phys * 1.2", "engineering": "(citation + math) * 0.5"}
    score = "s AS (SELECT doc_id, math, algorithm, citation, phys, " + ", ".join(f"round(h_{d} / greatest(1, size // 500) + {extra[d]}, 4) AS {d}" for d in P.DOMAIN_WORDS) + " FROM d)"
    names = list(P.DOMAIN_WORDS)
    best = f"greatest({', '.join(names)})"
    pick = "CASE " + " ".join(f"WHEN {d} = {best} THEN '{d}'" for d in names) + " END"
    positive = " + ".join(f"greatest({d}, 0)" for d in names)
    return f"""WITH dom0 AS (SELECT doc_id, region_type, text || {_case(_TOPICS, 'pos')} AS t FROM chunks), dom AS (SELECT *, lower(t) AS low FROM dom0), {total}, {score}
SELECT doc_id, round(math, 6) AS math_density, round(algorithm, 6) AS algorithm_density, round(citation, 6) AS citation_density, round(phys, 6) AS physics_density, {', '.join(names)}, {pick} AS domain, round({best} / CASE WHEN {positive} = 0 THEN 1 ELSE {positive} END, 6) AS confidence FROM s"""


@query("a09_a10_domains", _domain_sql(), True)
def a09(spark, sf):
    c = _chunks(spark, sf).withColumn("t", F.concat("text", _pick(_TOPICS, "pos")))
    return S.domains(c.select("doc_id", "region_type", "t"), "t")


_STYLES = (" thesis section part chapter section section", " \\frac \\sum $x$ (Doe, 2001) references", " figure figure slide figure", " a = b. References chapter", " \\[12\\] section \\[3\\] section section algorithm neural", "")


def _style_sql() -> str:
    re = lambda p: f"len(regexp_extract_all(t, {_quote(p)}))"
    f = f"""f0 AS (SELECT doc_id, t, lower(t) AS low, pages, {re(P.SECTION_WORD)} AS sections, {_count('lower(t)', 'figure')} AS figures, {_count('lower(t)', 'table')} AS tables, {_count('t', '=')} // greatest(1, ((length(t) - length(replace(t, '.' || chr(10), ''))) // 2)) AS equations,
      len(list_filter(regexp_split_to_array(trim(regexp_replace(t, '\\s+', ' ', 'g')), '\\s+'), lambda x: x <> '')) AS text_tokens, {re(P.MATH_TOKEN)} + {_count('t', '$')} * 2 AS math_tokens, {re(P.BRACKET_CITATION)} AS b, {re(P.PAREN_CITATION)} AS p, {re(P.REFERENCE_WORD)} AS reference_markers FROM st),
    f1 AS (SELECT *, greatest(1, sections + figures + tables + equations) AS total, CASE WHEN b + p = 0 THEN 1 ELSE b + p END AS cites FROM f0),
    f2 AS (SELECT *, CASE WHEN {_any('low', P.TYPE_WORDS['thesis'])} AND pages >= 30 THEN 'thesis' WHEN {_any('low', P.TYPE_WORDS['book'])} AND pages >= 50 THEN 'book' WHEN pages >= 80 THEN 'book' WHEN (figures // 2) / total < 0.15 AND sections >= greatest(4, floor(0.4 * total)) THEN 'report'
      WHEN {_any('low', P.TYPE_WORDS['presentation'])} THEN 'presentation' WHEN (figures // 2) / total > 0.35 AND pages <= 15 THEN 'presentation' ELSE 'article' END AS doc_type FROM f1)"""
    scores = {d: _hits("low", w) for d, w in P.STYLE_WORDS.items()}
    best = f"greatest({', '.join(scores.values())})"
    pick = f"CASE WHEN {best} <= 0 THEN 'default' " + " ".join(f"WHEN {s} = {best} THEN '{d}'" for d, s in scores.items()) + " END"
    return f"""WITH st AS (SELECT doc_id, coalesce(text, '') || {_case(_STYLES)} AS t, (doc_id * 7 % 97 + 1)::INT AS pages FROM documents), {f}
    SELECT doc_id, total::INT AS total_blocks, sections::INT AS section_blocks, (figures // 2)::INT AS figure_blocks, (tables // 2)::INT AS table_blocks, equations::INT AS equation_blocks, text_tokens::INT AS text_tokens, math_tokens::INT AS math_tokens, b::INT AS bracket_citations, p::INT AS paren_citations, reference_markers::INT AS reference_markers,
      doc_type, CASE WHEN b / cites > 0.55 AND sections >= 3 THEN 'ieee' WHEN p / cites > 0.45 AND doc_type IN ('article', 'report') THEN 'acm' WHEN doc_type IN ('book', 'thesis', 'textbook') THEN 'springer' ELSE 'generic' END AS style_family, {pick} AS domain FROM f2"""


@query("a11_r49_x16_styles", _style_sql())
def a11(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), _pick(_STYLES)).alias("t"), (F.col("doc_id") * 7 % 97 + 1).cast("int").alias("pages"))
    features = P.style_features(F.col("t"))
    d = d.select("*", *(v.alias(k) for k, v in features.items())).withColumn("doc_type", P.document_type(F.col("t"), F.col("pages")))
    return d.select("doc_id", *features, "doc_type", P.style_family(F.col("doc_type")).alias("style_family"), P.style_domain(F.col("t")).alias("domain"))


_CLASSES = ("Book", "article", "beamer", "letter", "memoir ")
_ASKED = ("", "technical-report", "unknown")


@query("r53_typography", f"""WITH k AS (SELECT doc_id, lower(trim({_case(_CLASSES)})) AS c, {_case(_ASKED)} AS a FROM documents)
SELECT doc_id, CASE WHEN a IN ('scholarly-serif', 'technical-report', 'presentation-sans') THEN a WHEN c IN ('book', 'report', 'memoir') THEN 'scholarly-serif' WHEN c IN ('article', 'elsarticle', 'siamart', 'ieeetran') THEN 'technical-report' WHEN c IN ('beamer', 'metropolis') THEN 'presentation-sans' ELSE 'scholarly-serif' END AS profile FROM k""")
def r53(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.typography_profile(_pick(_CLASSES), _pick(_ASKED)).alias("profile"))


# Classes of blocks

_OPENINGS = ("Question 3 ", "solution ", "Fig. 2 ", "Table of ", "- ", "", "q (a) ")


@query("r04_layout_classes", rf"""WITH b AS (SELECT chunk_id, {_case(_OPENINGS, 'pos')} || text AS t, 6 + pos * 5 % 20 AS size FROM chunks)
SELECT chunk_id, CASE WHEN regexp_matches(lower(trim(t)), '^(question|q)\s*([0-9]+[a-z]?|\([^)]+\))') THEN 'question' WHEN regexp_matches(lower(trim(t)), '^(answer|solution)\b') THEN 'answer' WHEN starts_with(lower(trim(t)), 'figure') OR starts_with(lower(trim(t)), 'fig.') THEN 'figure'
  WHEN starts_with(lower(trim(t)), 'table') OR regexp_matches(t, '(\+[-+]+\+)|(\|.+\|)') THEN 'table' WHEN regexp_matches(trim(t), '^([0-9]+\.[\)\s]|[A-Za-z]\.|[-*•])\s+') THEN 'list' WHEN size >= 18 THEN 'heading' WHEN regexp_matches(t, '(\\begin\{{equation\}}|\\frac|\\sum|\\int|=|\[a-z]+)') THEN 'formula' ELSE 'text' END AS kind FROM b""", True)
def r04(spark, sf):
    return _chunks(spark, sf).select("chunk_id", P.layout_class(F.concat(_pick(_OPENINGS, "pos"), "text"), 6 + F.col("pos") * 5 % 20).alias("kind"))


_TAGS = ("question", "answer", "equation", "figure", "table", "text", "text")
_BEGINNINGS = ("Proof. ", "Theorem ", "lemma ", "", "so ")


@query("r08_content_types", f"""WITH b AS (SELECT chunk_id, {_case(_TAGS, 'pos')} AS tag, lower(trim({_case(_BEGINNINGS, 'pos')} || text)) AS low FROM chunks)
SELECT chunk_id, CASE tag WHEN 'question' THEN 'question_block' WHEN 'answer' THEN 'answer_block' WHEN 'equation' THEN 'display_equation' WHEN 'figure' THEN 'figure' WHEN 'table' THEN 'table' ELSE CASE WHEN starts_with(low, 'proof') THEN 'proof_block' WHEN starts_with(low, 'theorem') OR starts_with(low, 'lemma') THEN 'theorem_block' ELSE 'paragraph' END END AS kind FROM b""", True)
def r08(spark, sf):
    return _chunks(spark, sf).select("chunk_id", P.content_type(_pick(_TAGS, "pos"), F.concat(_pick(_BEGINNINGS, "pos"), "text")).alias("kind"))


@query("m19_view_scores", rf"""WITH v AS (SELECT chunk_id, region_type, lower(text) || ' ' || CASE pos % 3 WHEN 0 THEN 'two column grid' WHEN 1 THEN 'an equation with a symbol' ELSE 'plain' END AS t, CASE WHEN pos % 4 = 0 THEN 0.5 ELSE 0 END AS role FROM chunks)
SELECT chunk_id, round(greatest(0, least(1, {_hits('t', P.LAYOUT_VIEW_WORDS)} / 2 + CASE WHEN region_type IN ('section', 'table') THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS layout, round(greatest(0, least(1, ({_hits('t', P.MATH_VIEW_WORDS)} + CASE WHEN region_type IN ('equation', 'formula') THEN 1 ELSE 0 END + role) / 2)), 6)::DOUBLE AS math FROM v""", True)
def m19(spark, sf):
    view = _pick(("two column grid", "an equation with a symbol", "plain"), "pos")
    layout, math = P.view_scores(F.array("text", view), F.col("region_type"), F.when(F.col("pos") % 4 == 0, "proof"))
    return _chunks(spark, sf).select("chunk_id", F.round(layout, 6).alias("layout"), F.round(math, 6).alias("math"))


@query("m20_vision_candidates", _over(rf"""WITH t AS (SELECT chunk_id, region_type, latex, pos, CASE WHEN pos % 5 = 0 THEN '' ELSE text END AS hint FROM snips), k AS (SELECT *, list_distinct(regexp_extract_all(lower(hint), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(latex), '[a-z0-9]+')) AS b FROM t),
s AS (SELECT *, CASE WHEN hint = '' THEN 0.5 WHEN len(a) = 0 OR len(b) = 0 THEN 0.4 ELSE floor(greatest(0.2::DOUBLE, least(1.0::DOUBLE, len(list_intersect(a, b)) / greatest(len(a), 1) + 0.2::DOUBLE)) * 1000 + 0.5) / 1000 END AS layout FROM k)
SELECT chunk_id, CASE WHEN trim(latex) = '' THEN 0 ELSE greatest(0, least(1, floor((0.45::DOUBLE * (pos % 11 / 10) + 0.35::DOUBLE * layout + 0.2::DOUBLE * least(1.0, length(latex) / 1200) + CASE WHEN region_type IN ('figure', 'table', 'diagram') THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 1000 + 0.5) / 1000)) END::DOUBLE AS score FROM s""", SNIPPETS), True)
def m20(spark, sf):
    s = _snippets(spark, sf)
    hint = F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("text"))
    return s.select("chunk_id", P.vision_candidate(F.col("latex"), hint, F.col("region_type"), F.col("pos") % 11 / 10).alias("score"))


@query("m24_float_placement", _over(r"""WITH r AS (SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(latex, '\\ref\{([^}]+)\}', 1)) AS name FROM snips) GROUP BY name),
lb AS (SELECT chunk_id, pos, regexp_extract(latex, '\\label\{([^}]+)\}', 1) AS name FROM snips WHERE region_type <> 'text')
SELECT chunk_id, CASE WHEN pos % 3 + 1 > 2 THEN 'p' WHEN pos % 4 = 0 OR coalesce(n, 0) >= 3 THEN 'htbp' ELSE 'H' END AS placement FROM lb LEFT JOIN r USING (name)""", SNIPPETS), True)
def m24(spark, sf):
    s = _snippets(spark, sf)
    refs = s.select(F.explode(F.regexp_extract_all("latex", F.lit(r"\\ref\{([^}]+)\}"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    own = s.where("region_type <> 'text'").select("chunk_id", "pos", F.regexp_extract("latex", r"\\label\{([^}]+)\}", 1).alias("name")).join(refs, "name", "left")
    panels, kind = F.col("pos") % 3, F.when(F.col("pos") % 4 == 0, "plot").otherwise("photo")
    return own.select("chunk_id", P.float_placement(panels, kind, F.coalesce("n", F.lit(0))).alias("placement"))


@query("r31_label_injection", _over(r"""WITH b AS (SELECT chunk_id, region_type, CASE WHEN pos % 2 = 0 THEN regexp_replace(latex, '\\label\{[^}]*\}', '', 'g') ELSE latex END AS x FROM snips), k AS (SELECT chunk_id, CASE region_type WHEN 'formula' THEN 'equation' ELSE region_type END AS kind, x, '\label{new-' || chunk_id || '}' AS tag FROM b)
SELECT chunk_id, CASE WHEN trim(x) = '' OR contains(x, '\label{') THEN x WHEN kind = 'equation' AND regexp_matches(x, '\\end\{equation\*?\}') THEN regexp_replace(x, '(\\end\{equation\*?\})', replace(tag, '\', '\\') || chr(10) || '\1')
  WHEN kind IN ('figure', 'table') AND regexp_matches(x, '\\caption\{[^}]*\}') THEN regexp_replace(x, '(\\caption\{[^}]*\})', '\1' || chr(10) || '  ' || replace(tag, '\', '\\')) ELSE x || chr(10) || tag END AS latex FROM k""", SNIPPETS), True)
def r31(spark, sf):
    bare = F.when(F.col("pos") % 2 == 0, F.regexp_replace("latex", r"\\label\{[^}]*\}", "")).otherwise(F.col("latex"))
    rows = _snippets(spark, sf).select("chunk_id", F.when(F.col("region_type") == "formula", "equation").otherwise(F.col("region_type")).alias("kind"), bare.alias("x"))
    return rows.select("chunk_id", P.inject_label(F.col("x"), F.concat(F.lit("new-"), "chunk_id"), F.col("kind")).alias("latex"))


@query("r13_noise_metrics", rf"""SELECT doc_id, round(len(regexp_extract_all(text, '[^\x00-\x7F]')) / greatest(length(text), 1), 6) AS non_ascii_ratio, round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1), 6) AS digit_ratio, round(len(regexp_extract_all(text, '[@#$%^&]')) / greatest(length(text), 1), 6) AS symbol_ratio,
  round(greatest(length(text), 1) / greatest(len(regexp_extract_all(text, '\n')), 1), 6) AS avg_line_length, len(regexp_extract_all(text, '-\n'))::INT AS broken_words, round(CASE WHEN len(regexp_extract_all(text, '[A-Za-z]+')) > 0 THEN len(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) / len(regexp_extract_all(text, '[A-Za-z]+')) ELSE 0 END, 6) AS unique_token_ratio, round({_NOISE}, 6) AS noise_score,
  round(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: regexp_full_match(x, '\P{{L}}'))) / greatest(len(regexp_extract_all(text, '[A-Za-z]+')), 1), 6) AS format_split_errors FROM documents""")
def r13(spark, sf):
    m = P.noise_metrics(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", *(v.alias(k) if k == "broken_words" else F.round(v, 6).alias(k) for k, v in m.items()))


@query("r09_r24_labels_slugs", r"""WITH t AS (SELECT doc_id, regexp_extract(trim(text), '^([^\n]*)', 1) AS f, lower(substr(text, 1, 1 + doc_id % 9)) AS s FROM documents)
SELECT doc_id, CASE WHEN trim(f) = '' THEN 'Block' ELSE trim(f)[:100] END AS label, coalesce(nullif(regexp_replace(regexp_replace(s, '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS reference, regexp_replace(s, '[^0-9a-z]', '', 'g') AS question, coalesce(nullif(regexp_replace(regexp_replace(s, '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'dataset') AS dataset FROM t""")
def r09(spark, sf):
    s = F.substring(F.col("text"), F.lit(1), (1 + F.col("doc_id") % 9).cast("int"))
    return table(spark, sf, "documents").select("doc_id", P.safe_label(F.col("text"), "Block").alias("label"), P.reference_slug(s).alias("reference"), P.question_slug(s).alias("question"), P.dataset_slug(s).alias("dataset"))


# Predicates, joins and sets

@query("f23_kept_children", "WITH v AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent FROM events) SELECT event_id, value >= parent OR parent - value <= 0.5 AS kept FROM v WHERE parent IS NOT NULL")
def f23(spark, sf):
    v = table(spark, sf, "events").select("event_id", F.col("value").alias("child"), F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("parent"))
    return v.where("parent is not null").select("event_id", P.keep_child(F.col("parent"), F.col("child"), tolerance=0.5).alias("kept"))


@query("f26_templates", """WITH b AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value > 50) AS q, count(*) FILTER (event_type = 'signup' AND value > 50) AS p, count(*) FILTER (event_type = 'purchase') AS n, count(*) FILTER (event_type = 'purchase' AND value >= 10) AS s FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN q > 0 THEN 'math_worksheet.tex' WHEN p > 0 THEN 'proof_document.tex' WHEN n > 0 AND s / n >= 0.4 THEN 'problem_set.tex' END AS template FROM b""")
def f26(spark, sf):
    kind = lambda k, least: F.count_if((F.col("event_type") == k) & (F.col("value") >= least))
    over = lambda k: F.count_if((F.col("event_type") == k) & (F.col("value") > 50))
    b = table(spark, sf, "events").groupBy("user_id").agg(over("error").alias("q"), over("signup").alias("p"), F.count_if(F.col("event_type") == "purchase").alias("n"), kind("purchase", 10).alias("s"))
    return b.select("user_id", P.template(F.col("q"), F.col("p"), F.col("n"), F.col("s")).alias("template"))


_MODALITIES = ("pdf", "page-image", "json", "audio")


@query("f31_manifests", f"""WITH p AS (SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'dataset') AS slug, {_case(_MODALITIES, 'p_partkey')} AS m FROM part)
SELECT p_partkey, slug, 'raw/' || slug || '/' || CASE m WHEN 'pdf' THEN 'pdf' WHEN 'page-image' THEN 'images' WHEN 'json' THEN 'annotations' ELSE m END AS path FROM p""")
def f31(spark, sf):
    slug = P.dataset_slug(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", slug.alias("slug"), F.concat(F.lit("raw/"), slug, F.lit("/"), P.modality_folder(_pick(_MODALITIES, "p_partkey"))).alias("path"))


@query("j11_expression_matches", r"""WITH e AS (SELECT doc_id, regexp_replace('x = ' || pos % 4, '\s+', '', 'g') AS s, regexp_replace('x  =' || pos % 6, '\s+', '', 'g') AS g FROM chunks WHERE region_type <> 'text' OR pos % 2 = 0)
SELECT doc_id, round(avg((s IN (SELECT g FROM e i WHERE i.doc_id = e.doc_id))::INT), 3)::DOUBLE AS symbolic_match FROM e GROUP BY doc_id""", True)
def j11(spark, sf):
    rows = _chunks(spark, sf).where("region_type <> 'text' or pos % 2 = 0")
    source = rows.select("doc_id", F.concat(F.lit("x = "), F.col("pos") % 4).alias("expression"))
    generated = rows.select("doc_id", F.concat(F.lit("x  ="), F.col("pos") % 6).alias("expression"))
    return S.expression_matches(source, generated)


@query("j17_linked_figures", r"""WITH f AS (SELECT doc_id, 'img' || pos % 5 || '.png' AS image FROM chunks WHERE pos % 3 = 0), t AS (SELECT doc_id, text || ' \includegraphics{a/img' || doc_id % 5 || '.png}' AS tex FROM documents)
SELECT doc_id, count(*) AS figures, count(*) FILTER (NOT contains(tex, image)) AS missing, round(1.0 - count(*) FILTER (NOT contains(tex, image)) / count(*), 3) AS linkage FROM f JOIN t USING (doc_id) GROUP BY doc_id""", True)
def j17(spark, sf):
    figures = _chunks(spark, sf).where("pos % 3 = 0").select("doc_id", F.concat(F.lit("img"), F.col("pos") % 5, F.lit(".png")).alias("image"))
    tex = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(r" \includegraphics{a/img"), F.col("doc_id") % 5, F.lit(".png}")).alias("tex"))
    images = figures.groupBy("doc_id", "image").agg(F.count("*").alias("n"))  # a text meets each name once
    found = images.join(tex, "doc_id").select("doc_id", "n", F.contains("tex", F.col("image")).alias("there"))
    total, missing = F.sum("n"), F.coalesce(F.sum(F.when(~F.col("there"), F.col("n"))), F.lit(0))
    return found.groupBy("doc_id").agg(total.alias("figures"), missing.alias("missing"), F.round(1.0 - missing / total, 3).alias("linkage"))


@query("j21_enriched_queue", "WITH s AS (SELECT user_id, 'run-' || user_id AS run_id, max(ts) AS generated FROM events WHERE event_type <> 'error' GROUP BY user_id) SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'own-' || event_id END, run_id, 'folder') AS run_id, coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, generated) AS generated_at FROM events LEFT JOIN s USING (user_id)")
def j21(spark, sf):
    e = table(spark, sf, "events")
    runs = e.where("event_type <> 'error'").groupBy("user_id").agg(F.max("ts").alias("generated")).withColumn("run_id", F.concat(F.lit("run-"), "user_id"))
    n = F.col("event_id")
    return e.join(runs, "user_id", "left").select("event_id", F.coalesce(F.when(n % 3 == 0, F.concat(F.lit("own-"), n)), "run_id", F.lit("folder")).alias("run_id"), F.coalesce(F.when(n % 2 == 0, F.col("ts")), "generated").alias("generated_at"))


@query("t04_pruned_versions", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events), d AS (SELECT *, row_number() OVER (PARTITION BY user_id, k > 4 ORDER BY md5('s' || event_id)) AS d FROM r) SELECT event_id, user_id FROM d WHERE n <= 5 OR k <= 4 OR d = 1")
def t04(spark, sf):
    return R.pruned(table(spark, sf, "events"), "user_id", "value", "event_id", 5, "s").select("event_id", "user_id")


@query("t21_main_documents", r"""WITH f AS (SELECT source, doc_id, length(text) AS size, contains(substr(CASE WHEN doc_id % 40 = 7 THEN '\documentclass{x}' ELSE '' END || text, 1, 2048), '\documentclass') AS main FROM documents WHERE source IS NOT NULL)
SELECT source, coalesce(min(doc_id) FILTER (main), arg_max(doc_id, (size, -doc_id))) AS doc_id FROM f GROUP BY source""")
def t21(spark, sf):
    head = F.concat(F.when(F.col("doc_id") % 40 == 7, "\\documentclass{x}").otherwise(""), "text")
    f = table(spark, sf, "documents").where("source is not null").select("source", "doc_id", F.char_length("text").alias("size"), F.contains(F.substring(head, 1, 2048), F.lit("\\documentclass")).alias("main"))
    return f.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("main"), F.col("doc_id"))), F.max_by("doc_id", F.struct("size", -F.col("doc_id")))).alias("doc_id"))


@query("ja4_merged_maps", "SELECT doc_id, 'lang=' || coalesce(lang, '?') || ',n=' || n_chars || ',source=' || coalesce(source, '?') AS first, 'lang=xx,n=' || n_chars || ',source=' || coalesce(source, '?') AS last FROM documents")
def ja4(spark, sf):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    a, b = F.create_map(F.lit("lang"), text("lang"), F.lit("n"), text("n_chars")), F.create_map(F.lit("source"), text("source"), F.lit("lang"), F.lit("xx"))
    shown = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return table(spark, sf, "documents").select("doc_id", shown(P.merged(a, b)).alias("first"), shown(P.merged(a, b, True)).alias("last"))


@query("ja8_token_labels", r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM conversations), k AS (SELECT conv_id, turn, flatten(list_transform(w, lambda x: list_prepend(length(x) % 3, list_transform(range(1, (length(x) + 3) // 4), lambda y: -100)))) AS l FROM w)
SELECT conv_id, turn, '-100,' || array_to_string(l, ',') || CASE WHEN len(l) > 0 THEN ',' ELSE '' END || '-100' AS labels FROM k""")
def ja8(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    pieces = F.flatten(F.transform("w", lambda x, i: F.array_repeat(i, F.ceil(F.char_length(x) / 4).cast("int"))))
    none = F.array(F.lit(None).cast("int"))
    t = t.select("conv_id", "turn", F.concat(none, pieces, none).alias("ids"), F.transform("w", lambda x: F.char_length(x) % 3).alias("labels"))
    return t.select("conv_id", "turn", F.array_join(F.transform(P.token_labels(F.col("ids"), F.col("labels")), lambda x: x.cast("string")), ",").alias("labels"))


@query("ja9_ordered_distinct", r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z]{3,}'), 1) AS i FROM conversations), f AS (SELECT conv_id, turn, w, min(i) AS i FROM w GROUP BY ALL)
SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY conv_id, turn""")
def ja9(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    return t.where(F.size("w") > 0).select("conv_id", "turn", F.array_join("w", " ").alias("words"))


# Wholes of what other queries do in part

@query("f01_regions_of_all_pages", "SELECT chunk_id, page, pos, text FROM chunks WHERE region_type = 'heading'", True)
def f01(spark, sf):
    return _chunks(spark, sf).where("region_type = 'heading'").select("chunk_id", "page", "pos", "text")


@query("a02_share_by_type", "SELECT region_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM chunks GROUP BY region_type", True)
def a02(spark, sf):
    n = _chunks(spark, sf).groupBy("region_type").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("a14_normalised_consensus", r"WITH n AS (SELECT source, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents), k AS (SELECT source, t, count(*) AS n FROM n WHERE t <> '' GROUP BY ALL) SELECT source, round(max(n) / sum(n), 6) AS share FROM k GROUP BY source")
def a14(spark, sf):
    n = table(spark, sf, "documents").select("source", F.sha2(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), 256).alias("t"), F.col("text").rlike(r"\S").alias("full"))
    return n.where("full").groupBy("source", "t").agg(F.count("*").alias("n")).groupBy("source").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


_BLEU = rf"""w AS (SELECT chunk_id, list_filter(regexp_split_to_array(trim(lower(source)), '\s+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(trim(lower(latex)), '\s+'), lambda x: x <> '') AS c FROM pairs),
g AS (SELECT chunk_id, 1 AS n, unnest(r) AS gram, 1 AS a, 0 AS b FROM w UNION ALL SELECT chunk_id, 1, unnest(c), 0, 1 FROM w UNION ALL SELECT chunk_id, 2, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])), 1, 0 FROM w UNION ALL SELECT chunk_id, 2, unnest(list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])), 0, 1 FROM w),
k AS (SELECT chunk_id, n, gram, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL), h AS (SELECT chunk_id, n, sum(least(a, b)) AS hit, sum(b) AS total FROM k GROUP BY ALL), m AS (SELECT chunk_id, sum(CASE WHEN total > 0 THEN hit / total ELSE 0 END) / 2 AS p FROM h GROUP BY chunk_id),
bleu AS (SELECT chunk_id, round(CASE WHEN len(r) = 0 OR len(c) = 0 THEN 0 ELSE p * least(1.0, len(c) / len(r)) END, 3)::DOUBLE AS bleu FROM w LEFT JOIN m USING (chunk_id))"""


@query("a07_branch_report", f"WITH {_PAIRS}, {_BLEU}, br AS (SELECT 'branch_' || chr((97 + split_part(chunk_id, '_', 1)::INT % 3)::INT) AS branch, bleu FROM bleu), u AS (SELECT 'branch_' || chr((97 + conv_id % 3)::INT) AS branch, count(*) AS asked FROM conversations WHERE role = 'user' GROUP BY 1) SELECT branch, round(avg(bleu), 6) AS mean_bleu, round(avg((bleu >= 0.01)::INT), 6) AS success_rate, round(least(1.0, count(*) / any_value(asked)), 6) AS fidelity FROM br JOIN u USING (branch) GROUP BY branch")
def a07(spark, sf):
    branch = lambda n: F.concat(F.lit("branch_"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3 + 1).cast("int")))
    b = S.bleu2(_pairs(spark, sf), "chunk_id", "source", "latex").select(branch(F.split_part("chunk_id", F.lit("_"), F.lit(1)).cast("int")).alias("branch"), "bleu")
    asked = table(spark, sf, "conversations").where("role = 'user'").groupBy(branch(F.col("conv_id")).alias("branch")).agg(F.count("*").alias("asked"))
    return S.branch_report(b, asked, 0.01)


@query("f08_weak_pairs", f"WITH {_PAIRS}, {_BLEU}, o AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(source), '[a-z]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(latex), '[a-z]{{3,}}')) AS b FROM pairs), s AS (SELECT chunk_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END AS overlap FROM o) SELECT chunk_id, bleu < 0.35 AS low_bleu, overlap < 0.4 AS low_overlap FROM bleu JOIN s USING (chunk_id) WHERE bleu < 0.35 OR overlap < 0.4")
def f08(spark, sf):
    p = _pairs(spark, sf)
    o = p.select("chunk_id", T.jaccard(T.token_set(F.col("source")), T.token_set(F.col("latex"))).alias("overlap"))
    rows = S.bleu2(p, "chunk_id", "source", "latex").join(o, "chunk_id")
    return rows.where("bleu < 0.35 or overlap < 0.4").select("chunk_id", (F.col("bleu") < 0.35).alias("low_bleu"), (F.col("overlap") < 0.4).alias("low_overlap"))


@query("a32_global_totals", "SELECT event_id, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def a32(spark, sf):
    return R.global_totals(table(spark, sf, "events"))


@query("a39_branch_ledger", "WITH r AS (SELECT 'branch_' || chr((97 + event_id % 3)::INT) AS branch, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'completed' END AS status FROM events) SELECT branch, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM r GROUP BY branch")
def a39(spark, sf):
    branch = F.concat(F.lit("branch_"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("event_id") % 3 + 1).cast("int")))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "skipped").otherwise("completed")
    return R.branch_ledger(table(spark, sf, "events").select(branch.alias("branch"), status.alias("status")))


@query("e03_run_states", "WITH r AS (SELECT event_id, user_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n, max((event_type = 'error')::INT) OVER w AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, user_id, CASE WHEN failed = 1 THEN 'FAILED' WHEN k = n THEN 'COMPLETED' WHEN k = 1 THEN 'IDLE' ELSE 'RUNNING' END AS state, round(100.0 * k / n, 4) AS progress FROM r")
def e03(spark, sf):
    return R.run_states(table(spark, sf, "events"), "error")


@query("w18_early_stop", "WITH r AS (SELECT event_id, user_id, value, coalesce(max((value >= 20)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events) SELECT event_id, user_id, best FROM r WHERE done = 0")
def w18(spark, sf):
    return R.until_good(table(spark, sf, "events"), 20.0)


_HEADS = "hd AS (SELECT doc_id, pos, (1 + pos * 7 % 5)::INT AS level, text FROM chunks WHERE pos % 3 = 0)"


@query("w06_g04_heading_stack", _over("""WITH a AS (SELECT h.doc_id, h.pos, h.level, h.text, x.pos AS apos, x.level AS alevel, x.text AS atext FROM hd h LEFT JOIN hd x ON x.doc_id = h.doc_id AND x.pos < h.pos AND x.level < h.level AND NOT EXISTS (SELECT 1 FROM hd y WHERE y.doc_id = h.doc_id AND y.pos > x.pos AND y.pos < h.pos AND y.level <= x.level))
SELECT doc_id, pos, level, max(apos) AS parent, coalesce(string_agg(atext, ' / ' ORDER BY apos) || ' / ', '') || any_value(text) AS path FROM a GROUP BY doc_id, pos, level""", _HEADS), True)
def w06(spark, sf):
    return C.heading_stack(_chunks(spark, sf).where("pos % 3 = 0").select("doc_id", "pos", (1 + F.col("pos") * 7 % 5).alias("level"), "text"))


@query("u01_normalised_paragraphs", r"WITH r AS (SELECT doc_id, pos, text, row_number() OVER (PARTITION BY doc_id, regexp_replace(trim(text), '\s+', ' ', 'g') ORDER BY pos) AS k FROM chunks) SELECT doc_id, pos, text FROM r WHERE k = 1", True)
def u01(spark, sf):
    return S.keep_first(_chunks(spark, sf), [F.col("doc_id"), F.regexp_replace(F.trim("text"), r"\s+", " ")], [F.col("pos")]).select("doc_id", "pos", "text")


@query("u02_distinct_entries", "WITH r AS (SELECT doc_id, pos, region_type, trim(text) AS text, row_number() OVER (PARTITION BY region_type, trim(text) ORDER BY doc_id, pos) AS k FROM chunks) SELECT doc_id, pos, region_type, text FROM r WHERE k = 1", True)
def u02(spark, sf):
    rows = _chunks(spark, sf).select("doc_id", "pos", "region_type", F.trim("text").alias("text"))
    return S.keep_first(rows, [F.col("region_type"), F.col("text")], [F.col("doc_id"), F.col("pos")])


_KINDS = {"figure": 0, "table": 1, "formula": 2}
_WORDS = {"figure": "figure", "table": "table", "formula": "equation"}


@query("j08_references_by_kind", "WITH k AS (SELECT doc_id, pos, chunk_id, CASE pos % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' ELSE 'text' END AS kind, lower(text) || ' see figure ' || (pos % 3 + 1) || ' and Equation ' || (pos % 5 + 1) AS t FROM chunks), o AS (SELECT doc_id, chunk_id, kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS ordinal FROM k), f AS ("
  + " UNION ".join(rf"SELECT doc_id, chunk_id AS source, '{k}' AS kind, unnest(regexp_extract_all(lower(t), '{w}\s+([0-9]{{1,6}})', 1))::INT AS ordinal FROM k" for k, w in _WORDS.items())
  + ") SELECT f.kind, source, f.ordinal, o.chunk_id AS target FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.kind = f.kind AND o.ordinal = f.ordinal", True)
def j08(spark, sf):
    p, kind = F.col("pos"), F.lit("text")
    for k, i in _KINDS.items():
        kind = F.when(F.col("pos") % 4 == i, k).otherwise(kind)
    rows = _chunks(spark, sf).select("doc_id", "pos", "chunk_id", kind.alias("region_type"), F.concat(F.lower("text"), F.lit(" see figure "), p % 3 + 1, F.lit(" and Equation "), p % 5 + 1).alias("text"))
    parts = [C.numbered_references(rows, k, w).withColumn("kind", F.lit(k)) for k, w in _WORDS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a22_conflict_samples", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) SELECT doc_id, lower(w) AS word, count(*) AS forms, array_to_string(list_sort(list(w))[1:3], ' ') AS samples FROM w GROUP BY doc_id, lower(w) HAVING count(*) > 1")
def a22(spark, sf):
    return S.case_conflicts(table(spark, sf, "documents"))


@query("m05_round_trip", "WITH q AS (SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: least(63, greatest(0, round_even(x::DOUBLE * 63, 0)))::INT) AS l FROM embeddings) SELECT vec_id, list_transform(l, lambda x: round(x / 63, 6)) AS \"values\", round(list_max(list_transform(range(1, len(e) + 1), lambda i: abs(greatest(0, least(1, e[i]::DOUBLE)) - l[i] / 63))), 6) AS error, len(l) + 64 AS bytes FROM q")
def m05(spark, sf):
    scale = 63
    level = lambda x: F.least(F.lit(float(scale)), F.greatest(F.lit(0.0), F.bround(x.cast("double") * scale, 0))).cast("int")
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", F.transform("embedding", level).alias("l"))
    off = F.zip_with("embedding", "l", lambda x, v: F.abs(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double"))) - v / scale))
    return rows.select("vec_id", F.transform("l", lambda v: F.round(v / scale, 6)).alias("values"), F.round(F.array_max(off), 6).alias("error"), (F.size("l") + 64).cast("bigint").alias("bytes"))


@query("t18_seeded_sample", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('seed' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, lang, n FROM r WHERE n <= 20")
def t18(spark, sf):
    return S.top_by_group(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], [F.md5(F.concat(F.lit("seed"), "doc_id").cast("binary")), F.col("doc_id")], 20).withColumnRenamed("rank", "n")


@query("r26_citation_contexts", r"""WITH t AS (SELECT doc_id, 'As shown [12] and \cite{aa, bb} before' || chr(10) || text || ' (Doe, 2001) ends' AS t FROM documents),
m AS (SELECT doc_id, t, 'tex' AS style, unnest(regexp_extract_all(t, '\\cite\{[^}]+\}')) AS raw FROM t UNION ALL SELECT doc_id, t, 'author-year', unnest(regexp_extract_all(t, '\([A-Z][A-Za-z]+, [0-9]{4}\)')) FROM t UNION ALL SELECT doc_id, t, 'numeric', unnest(regexp_extract_all(t, '\[[0-9]{1,3}\]')) FROM t),
d AS (SELECT DISTINCT doc_id, t, style, raw, instr(t, raw) AS p FROM m)
SELECT doc_id, style, raw, trim(regexp_replace(substr(t, greatest(1, p - 60), least(length(t), p + length(raw) - 1 + 60) - greatest(1, p - 60) + 1), '\s+', ' ', 'g')) AS context FROM d""")
def r26(spark, sf):
    t = F.concat(F.lit("As shown [12] and \\cite{aa, bb} before\n"), "text", F.lit(" (Doe, 2001) ends"))
    return S.citation_contexts(table(spark, sf, "documents").select("doc_id", t.alias("text")))


def _gate_case(d: str) -> str:
    limits = {k: v[d] for k, v in S.THRESHOLDS.items()}
    return f"CASE WHEN {d} < CASE doc_type WHEN 'math' THEN {limits['math']} WHEN 'reference' THEN {limits['reference']} ELSE {limits['narrative']} END::DOUBLE THEN '{d}' END"


@query("m08_m09_m10_m12_all_inputs", f"""WITH z AS (SELECT *, {_NOISE} AS noise, CASE region_type WHEN 'table' THEN 1.35 WHEN 'figure' THEN 1.25 WHEN 'formula' THEN 1.15 WHEN 'heading' THEN 0.95 ELSE 1.0 END::DOUBLE AS weight FROM chunks),
p AS (SELECT doc_id, CASE WHEN avg((region_type = 'formula')::INT) >= 0.25 THEN 'math' WHEN avg((region_type = 'figure')::INT) >= 0.3 THEN 'reference' ELSE 'narrative' END AS doc_type, round(avg(least(1.0::DOUBLE, length(text) / 100.0::DOUBLE)), 6) AS semantic, round(avg(1.0::DOUBLE - noise), 6) AS content, round(count(DISTINCT page) / max(page), 6) AS structural,
  round(greatest(0, 1.0::DOUBLE - 0.4::DOUBLE * count(*) FILTER (region_type = 'table') / count(DISTINCT page)), 6) AS visual, round(avg(0.4::DOUBLE + 0.6::DOUBLE * least(1.0::DOUBLE, (6 + pos * 5 % 20) / 24.0::DOUBLE)), 6) AS confidence, max(noise) > 0.45 AS errors, round(avg(weight) / 1.35::DOUBLE, 6) AS aesthetic FROM z GROUP BY doc_id),
o AS (SELECT *, floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.3::DOUBLE * structural + 0.3::DOUBLE * content + 0.2::DOUBLE * visual + 0.2::DOUBLE * semantic) * (0.85::DOUBLE + 0.15::DOUBLE * confidence) - CASE WHEN errors THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) * 100000 + 0.5) / 100000 AS overall FROM p),
r AS (SELECT *, floor((0.9::DOUBLE * (0.5::DOUBLE * CASE WHEN errors THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END + 0.3::DOUBLE * semantic + 0.2::DOUBLE * aesthetic) + 0.1::DOUBLE * overall) * 100000 + 0.5) / 100000 AS reward FROM o),
g AS (SELECT *, list_filter([{', '.join(_gate_case(d) for d in ('semantic', 'content', 'structural', 'visual', 'reward'))}], lambda x: x IS NOT NULL) AS failed FROM r)
SELECT doc_id, doc_type, overall, reward, floor((semantic + content + structural + visual + overall) / 5 * 100000 + 0.5) / 100000 AS aggregate, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed FROM g""", True)
def m08(spark, sf):
    from docloom.operators import fusion as X

    noise, c = T.noise_score(F.col("text")), F.col
    rows = _chunks(spark, sf).withColumn("noise", noise)
    share = lambda k: F.avg((c("region_type") == k).cast("int"))
    size = (6 + c("pos") * 5 % 20) / 24.0
    p = rows.groupBy("doc_id").agg(
        F.when(share("formula") >= 0.25, "math").when(share("figure") >= 0.3, "reference").otherwise("narrative").alias("doc_type"),
        F.round(F.avg(F.least(F.lit(1.0), F.char_length("text") / 100.0)), 6).alias("semantic"),
        F.round(F.avg(1.0 - c("noise")), 6).alias("content"),
        F.round(F.countDistinct("page") / F.max("page"), 6).alias("structural"),
        F.round(F.greatest(F.lit(0.0), 1.0 - F.lit(0.4) * F.count_if(c("region_type") == "table") / F.countDistinct("page")), 6).alias("visual"),
        F.round(F.avg(0.4 + 0.6 * F.least(F.lit(1.0), size)), 6).alias("confidence"),
        (F.max("noise") > 0.45).alias("errors"),
        F.round(F.avg(T.region_weight(c("region_type"))) / 1.35, 6).alias("aesthetic"),
    )
    five = lambda x: F.floor(x * 100000 + 0.5) / 100000
    p = p.withColumn("overall", five(X.overall(c("structural"), c("content"), c("visual"), c("semantic"), c("confidence"), c("errors"))))
    p = p.withColumn("reward", five(X.reward(F.when(c("errors"), -1.0).otherwise(1.0), c("semantic"), c("aesthetic"), c("overall"))))
    mean = (c("semantic") + c("content") + c("structural") + c("visual") + c("overall")) / 5
    return S.gate(p, "doc_type").select("doc_id", "doc_type", "overall", "reward", five(mean).alias("aggregate"), F.array_join("failed", ",").alias("failed"), "passed")


@query("a16_all_inputs", f"""WITH z AS (SELECT *, greatest(0.0::DOUBLE, 1.0::DOUBLE - {_NOISE}) AS clear, CASE WHEN source = 'src0' THEN 1.0 WHEN source = 'src1' THEN 0.1 ELSE 0.6 END::DOUBLE AS ocr, CASE WHEN count(*) OVER (PARTITION BY doc_id, page, lower(text)) > 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS consensus, CASE pos % 4 WHEN 0 THEN region_type WHEN 1 THEN 'table' WHEN 2 THEN '' END AS vision FROM chunks),
q AS (SELECT doc_id, 0.7::DOUBLE * avg(ocr) + 0.3::DOUBLE * avg(consensus) AS ocr, avg(clear) AS clarity, count(vision) / count(*) AS signal, count(vision) AS links, count(*) FILTER (CASE WHEN vision IS NOT NULL THEN vision <> '' AND vision <> region_type ELSE region_type IN ('figure', 'equation', 'table') END) / count(*) AS missed, greatest(0, 1.0::DOUBLE - count(*) FILTER (region_type IN ('figure', 'table')) / count(DISTINCT page) * 0.4::DOUBLE) AS image FROM z GROUP BY doc_id),
a AS (SELECT *, (ocr + image + clarity + signal) / 4 AS aggregate, CASE WHEN links = 0 THEN 1.0::DOUBLE ELSE greatest(0, 1.0::DOUBLE - missed) END AS consistency FROM q)
SELECT doc_id, round(ocr, 6) AS ocr, round(image, 6) AS image, round(clarity, 6) AS clarity, round(signal, 6) AS signal, round(aggregate, 6) AS aggregate, CASE WHEN aggregate <= 0.45 THEN 'low' WHEN aggregate >= 0.75 THEN 'high' ELSE 'medium' END AS tier, CASE WHEN signal < 0.2 THEN 'ocr-only' WHEN consistency < 0.5 THEN 'vision-scout' WHEN signal >= 0.6 AND consistency >= 0.6 THEN 'vision-hybrid' ELSE 'vision-scout' END AS strategy FROM a""", True)
def a16(spark, sf):
    from docloom.operators import fusion as X

    c, p = F.col, F.col("pos")
    again = F.count("*").over(Window.partitionBy("doc_id", "page", F.lower("text"))) > 1
    rows = _chunks(spark, sf).select("*", F.greatest(F.lit(0.0), 1.0 - T.noise_score(c("text"))).alias("clear"), F.when(c("source") == "src0", 1.0).when(c("source") == "src1", 0.1).otherwise(0.6).alias("ocr"), F.when(again, 1.0).otherwise(0.5).alias("consensus"), F.when(p % 4 == 0, c("region_type")).when(p % 4 == 1, "table").when(p % 4 == 2, "").alias("vision"))
    missed = F.when(c("vision").isNotNull(), (c("vision") != "") & (c("vision") != c("region_type"))).otherwise(c("region_type").isin("figure", "equation", "table"))
    q = rows.groupBy("doc_id").agg((0.7 * F.avg("ocr") + 0.3 * F.avg("consensus")).alias("ocr"), F.avg("clear").alias("clarity"), (F.count("vision") / F.count("*")).alias("signal"), F.count("vision").alias("links"), (F.count_if(missed) / F.count("*")).alias("missed"), F.greatest(F.lit(0.0), 1.0 - F.count_if(c("region_type").isin("figure", "table")) / F.countDistinct("page") * 0.4).alias("image"))
    q = q.withColumn("a", (c("ocr") + c("image") + c("clarity") + c("signal")) / 4)
    consistency = F.when(c("links") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - c("missed")))
    return q.select("doc_id", *(F.round(x, 6).alias(x) for x in ("ocr", "image", "clarity", "signal")), F.round("a", 6).alias("aggregate"), X.tier(c("a")).alias("tier"), X.branch_strategy(c("signal"), consistency).alias("strategy"))
