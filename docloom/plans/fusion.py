"""Queries over candidates (from ``events``) and over validated documents (from their snippets)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import latex as L
from docloom.functions import text as T
from docloom.operators import fusion as X
from docloom.operators import latex as S
from docloom.plans import _NOISE, ORACLES, _chunks, query, table
from docloom.plans.latex import _COLUMNS, SNIPPETS, _over, _plain, _quote, _replaced

_R3 = "floor(({}) * 1000 + 0.5) / 1000"
CANDIDATES = f"""cand AS (SELECT user_id AS chunk_id, event_id AS pos, event_type AS source, 'branch_' || chr((97 + event_id % 3)::INT) AS branch, CASE user_id % 4 WHEN 0 THEN 'equation' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' ELSE 'text' END AS region,
  least(1.0, value / 40.0)::DOUBLE AS math, (event_id % 11 / 10)::DOUBLE AS syntax, (event_id % 6 / 5)::DOUBLE AS style, (event_id * 7 % 10 / 10)::DOUBLE AS confidence FROM events),
judged AS (SELECT *, {_R3.format('0.0::DOUBLE + 0.35::DOUBLE * math + 0.25::DOUBLE * syntax + 0.2::DOUBLE * style + 0.2::DOUBLE * confidence')} AS weighted FROM cand)"""
METRICS = "metrics AS (SELECT * FROM (VALUES ('branch_a', 0.9::DOUBLE), ('branch_b', 0.1::DOUBLE)) t(branch, confidence))"


def _candidates(spark, sf):
    n = F.col("event_id")
    region = F.element_at(F.array(*(F.lit(r) for r in ("equation", "table", "figure", "text"))), (F.col("user_id") % 4 + 1).cast("int"))
    branch = F.element_at(F.array(*(F.lit("branch_" + b) for b in "abc")), (n % 3 + 1).cast("int"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("chunk_id"), n.alias("pos"), F.col("event_type").alias("source"), branch.alias("branch"), region.alias("region"),
        F.least(F.lit(1.0), F.col("value") / 40.0).alias("math"), (n % 11 / 10).alias("syntax"), (n % 6 / 5).alias("style"), (n * 7 % 10 / 10).alias("confidence"),
    )


def _judged(spark, sf):
    return X.judged(_candidates(spark, sf))


@query("t07_a41_m13_ranking", _over("SELECT chunk_id, pos, branch, weighted, row_number() OVER (PARTITION BY chunk_id, branch ORDER BY weighted DESC, pos) AS rank FROM judged", CANDIDATES))
def t07(spark, sf):
    return X.ranked(_judged(spark, sf), ["chunk_id", "branch"]).select("chunk_id", "pos", "branch", "weighted", "rank")


_FUSED = """r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY {w} DESC, pos) AS rank FROM {t}), t3 AS (SELECT *, {w} / CASE WHEN sum({w}) OVER (PARTITION BY chunk_id) = 0 THEN 1 ELSE sum({w}) OVER (PARTITION BY chunk_id) END AS share FROM r WHERE rank <= 3)
SELECT chunk_id, string_agg(source, '+' ORDER BY rank) AS sources, greatest(max(confidence) FILTER (rank = 1), {f}::DOUBLE) AS confidence, round(sum(share * math), 6) AS math, round(sum(share * syntax), 6) AS syntax, round(sum(share * style), 6) AS style FROM t3 GROUP BY chunk_id"""


@query("t08_a30_weighted_fusion", _over("WITH " + _FUSED.format(w="weighted", t="judged", f=0.5), CANDIDATES))
def t08(spark, sf):
    return X.fused(_judged(spark, sf))


@query("j24_m14_m26_branch_fusion", _over("WITH bw AS (SELECT j.*, greatest(0.05::DOUBLE, weighted) * coalesce(m.confidence, 0.75::DOUBLE) AS weight FROM judged j LEFT JOIN metrics m USING (branch)), " + _FUSED.format(w="weight", t="bw", f=0.6), CANDIDATES, METRICS))
def j24(spark, sf):
    manifest = spark.createDataFrame([("branch_a", 0.9, 0.2, None), ("branch_b", None, 0.05, 0.8)], "branch string, a double, b double, c double")
    metrics = manifest.select("branch", X.branch_confidence(F.col("a"), F.col("b"), F.col("c")).alias("confidence"))
    return X.fused(X.branch_weighted(_judged(spark, sf), metrics), "weight", floor=0.6)


@query("t19_m14_rule_fusion", _over("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weighted DESC, pos) AS rank, (region IN ('equation', 'formula') AND math >= 0.5) OR (region IN ('table', 'figure') AND starts_with(source, 'purchase')) AS rule FROM judged),
n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY CASE WHEN rule THEN 0 ELSE 1 END, CASE WHEN rule THEN 0 ELSE -syntax END, rank) AS n FROM r) SELECT chunk_id, pos AS chosen, source FROM n WHERE n = 1""", CANDIDATES))
def t19(spark, sf):
    return X.rule_choice(_judged(spark, sf), "purchase")


@query("t14_votes", _over("SELECT chunk_id, arg_min(pos, (-weighted, pos)) AS winner, round(least(1.0, max(weighted) / CASE WHEN sum(abs(weighted)) = 0 THEN 1 ELSE sum(abs(weighted)) END), 6) AS share FROM judged GROUP BY chunk_id HAVING max(weighted) >= 0.6", CANDIDATES))
def t14(spark, sf):
    return X.votes(_judged(spark, sf), 0.6)


@query("f08_low_scores", _over("SELECT chunk_id, pos FROM judged WHERE weighted < 0.45", CANDIDATES))
def f08(spark, sf):
    return _judged(spark, sf).where(F.col("weighted") < X.FLAG_BELOW).select("chunk_id", "pos")


@query("t15_c09_best_branch", _over("SELECT chunk_id, coalesce(max(branch) FILTER (source = 'signup'), 'branch_a') AS branch FROM cand GROUP BY chunk_id", CANDIDATES))
def t15(spark, sf):
    rows = _candidates(spark, sf).withColumn("status", F.when(F.col("source") == "signup", "completed").otherwise("failed"))
    return X.best_branch(rows, "chunk_id")


_KINDS = ("photo", "plot", "diagram", "multi-panel", "figure", "screenshot")


@query("a29_mode", f"""WITH k AS (SELECT user_id, (['photo', 'plot', 'diagram', 'multi-panel', 'figure', 'screenshot'])[event_id % 6 + 1] AS kind FROM events), n AS (SELECT user_id, kind, count(*) AS n FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, list_position({list(X.FIGURE_RANKING)}, kind)) AS r FROM n) SELECT user_id, kind AS mode FROM r WHERE r = 1""")
def a29(spark, sf):
    kind = F.element_at(F.array(*(F.lit(k) for k in _KINDS)), (F.col("event_id") % 6 + 1).cast("int"))
    return X.mode(table(spark, sf, "events").select("user_id", kind.alias("kind")), "user_id", "kind")


@query("a06_a28_status_summary", "SELECT user_id, round(coalesce(avg(value) FILTER (event_type <> 'error'), 0), 6) AS mean, coalesce(max(value) FILTER (event_type <> 'error'), 0) AS most, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id")
def a06(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") != "error", "ok").alias("status"), F.col("value").alias("confidence"))
    return X.status_summary(e, "user_id")


_FALLBACK = f"trim({_replaced('text', ((chr(92), chr(92) + 'textbackslash{}'), *((c, chr(92) + c) for c in '&%$#_{}')))})"


@query("u14_f32_alternatives", _over(rf"""WITH f AS (SELECT *, {_FALLBACK} AS f, CASE WHEN region_type = 'table' THEN 'Table ' || chunk_id END AS caption FROM snips)
SELECT chunk_id, 'specialist' AS source, latex, 0.55::DOUBLE AS confidence FROM f UNION ALL SELECT chunk_id, 'chunk-text', '\par ' || f || ' \', 0.2 FROM f WHERE f <> '' AND NOT contains(latex, f)
UNION ALL SELECT chunk_id, 'branch_b_vision', '% branch:branch_b' || chr(10) || caption, 0.5 FROM f WHERE caption IS NOT NULL""", SNIPPETS), True)
def u14(spark, sf):
    rows = S.snippets(_chunks(spark, sf)).withColumn("caption", F.when(F.col("region_type") == "table", F.concat(F.lit("Table "), "chunk_id")))
    return X.alternatives(rows, L.fallback_candidate(F.col("text")))


#: Chunks with a second branch's region on every third, and a layout confidence (0 counts as 0.7).
SEEN = "seen AS (SELECT *, CASE WHEN pos % 6 = 0 THEN 'text' WHEN pos % 3 = 0 THEN region_type END AS vision, CASE WHEN pos % 5 = 0 THEN 0.7 ELSE 0.5 + pos % 5 / 10 END::DOUBLE AS layout FROM snips)"


def _seen(spark, sf):
    at = F.col("pos")
    layout = F.when(at % 5 != 0, 0.5 + at % 5 / 10).otherwise(0.0)
    rows = S.snippets(_chunks(spark, sf)).withColumn("vision", F.when(at % 6 == 0, "text").when(at % 3 == 0, F.col("region_type")))
    return rows.withColumn("layout", F.when(layout == 0, 0.7).otherwise(layout))


def _ratio(count: str, expected: str) -> str:
    return f"CASE WHEN {expected} = 0 THEN 1.0 ELSE {_R3.format(f'least({count}, {expected}) / {expected}')} END"


_PROVENANCE = f"""pv0 AS (SELECT doc_id, count(vision) AS linked, count(*) FILTER (CASE WHEN vision IS NOT NULL THEN vision <> region_type ELSE region_type IN ('figure', 'table', 'equation') END) AS missed, count(*) AS n, coalesce(avg(layout) FILTER (vision IS NOT NULL), 0.7) AS c FROM seen GROUP BY doc_id),
pv AS (SELECT doc_id, {_R3.format('linked / n')} AS coverage, {_R3.format('CASE WHEN linked = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - missed / greatest(linked, 1)) END')} AS consistency, {_R3.format('c')} AS confidence FROM pv0)"""
_LAYOUT = rf"""ly0 AS (SELECT doc_id, count(*) FILTER (header_level > 0) AS h, count(*) FILTER (region_type = 'table') AS t, count(*) FILTER (region_type IN ('equation', 'formula')) AS e, count(*) FILTER (region_type = 'figure') AS f, avg(layout) AS l,
  sum(len(regexp_extract_all(latex, '(?i)\\section\{{|\\subsection\{{')))::BIGINT AS lh, sum(len(regexp_extract_all(latex, '(?i)\\begin\{{table')))::BIGINT AS lt, sum(len(regexp_extract_all(latex, '(?i)\\begin\{{(equation|align|gather)')))::BIGINT AS le, 0 AS lf FROM seen GROUP BY doc_id),
ly AS (SELECT doc_id, ({_ratio('lh', 'h')})::DOUBLE AS heading_alignment, ({_ratio('lt', 't')})::DOUBLE AS table_alignment, ({_ratio('le', 'e')})::DOUBLE AS math_alignment, ({_ratio('lf', 'f')})::DOUBLE AS figure_alignment, {_R3.format('l')} AS layout_confidence FROM ly0)"""


@query("a17_provenance", _over("SELECT * FROM pv", SNIPPETS, SEEN, _PROVENANCE), True)
def a17(spark, sf):
    return X.provenance_scores(_seen(spark, sf))


@query("a18_a19_layout_scores", _over("SELECT * FROM ly", SNIPPETS, SEEN, _LAYOUT), True)
def a18(spark, sf):
    return X.layout_scores(_seen(spark, sf))


@query("a20_j18_table_diff", _over(f"""WITH tb AS (SELECT doc_id, pos, {_COLUMNS} AS columns FROM chunks WHERE region_type = 'table'), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM tb),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM tb WHERE pos % 4 <> 0), z AS (SELECT a.doc_id, count(*) AS n, count(b.columns) AS m, avg(abs(a.columns - b.columns)) AS delta, max(a.columns) AS most FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.k = b.k GROUP BY a.doc_id)
SELECT doc_id, CASE WHEN m = 0 THEN 0 ELSE {_R3.format('greatest(0.0::DOUBLE, 1.0::DOUBLE - least(delta / greatest(most, 1), 1.0::DOUBLE))')} END::DOUBLE AS columns_match, CASE WHEN m = 0 THEN 0 ELSE {_ratio('m', 'n')} END::DOUBLE AS count_match, CASE WHEN m = 0 THEN 1 ELSE {_R3.format('delta')} END::DOUBLE AS column_delta FROM z""", "one AS (SELECT 1)"), True)
def a20(spark, sf):
    t = _chunks(spark, sf).where("region_type = 'table'").select("doc_id", "pos", T.table_columns(F.col("text")).alias("columns"))
    return X.table_diff(t, t.where("pos % 4 <> 0"))


_R6 = "round({}, 6)::DOUBLE"


@query("m08_m09_m10_roll_up", _over(f"""WITH q AS (SELECT *, (coverage + consistency + heading_alignment + table_alignment + math_alignment + 1.0::DOUBLE) / 6 AS s, (confidence + layout_confidence) / 2 AS k, doc_id % 3 = 0 AS errors FROM pv JOIN ly USING (doc_id)),
o AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.3::DOUBLE * s + 0.3::DOUBLE * coverage + 0.2::DOUBLE * figure_alignment + 0.2::DOUBLE * 0.5::DOUBLE) * (0.85::DOUBLE + 0.15::DOUBLE * k) - CASE WHEN errors THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) AS overall FROM q),
w AS (SELECT *, 0.5::DOUBLE * CASE WHEN errors THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END + 0.3::DOUBLE * coverage + 0.2::DOUBLE * 0.3::DOUBLE AS total FROM o)
SELECT doc_id, {_R6.format('overall')} AS overall, {_R6.format('CASE WHEN overall <> 0 THEN 0.9::DOUBLE * total + 0.1::DOUBLE * overall ELSE total END')} AS reward, CASE WHEN overall <= 0.45 THEN 'low' WHEN overall >= 0.75 THEN 'high' ELSE 'medium' END AS tier,
  CASE WHEN coverage < 0.2 THEN 'ocr-only' WHEN consistency < 0.5 THEN 'vision-scout' WHEN coverage >= 0.6 AND consistency >= 0.6 THEN 'vision-hybrid' ELSE 'vision-scout' END AS strategy FROM w""", SNIPPETS, SEEN, _PROVENANCE, _LAYOUT), True)
def m08(spark, sf):
    rows = _seen(spark, sf)
    d = X.provenance_scores(rows).join(X.layout_scores(rows), "doc_id")
    c = F.col
    structural = (c("coverage") + c("consistency") + c("heading_alignment") + c("table_alignment") + c("math_alignment") + 1.0) / 6
    errors = c("doc_id") % 3 == 0
    d = d.withColumn("o", X.overall(structural, c("coverage"), c("figure_alignment"), F.lit(0.5), (c("confidence") + c("layout_confidence")) / 2, errors))
    reward = X.reward(F.when(errors, -1.0).otherwise(1.0), c("coverage"), F.lit(0.3), c("o"))
    return d.select("doc_id", F.round("o", 6).alias("overall"), F.round(reward, 6).alias("reward"), X.tier(c("o")).alias("tier"), X.branch_strategy(c("coverage"), c("consistency")).alias("strategy"))


@query("a16_input_quality", f"""WITH q AS (SELECT doc_id, avg(CASE source WHEN 'src0' THEN 1.0 WHEN 'src1' THEN 0.1 ELSE 0.6 END::DOUBLE) AS ocr, avg(greatest(0.0, 1.0 - {_NOISE})) AS clarity, avg((pos % 3 = 0)::INT) AS vision FROM chunks GROUP BY doc_id),
a AS (SELECT *, (0.7::DOUBLE * ocr + 0.3::DOUBLE + 0.5::DOUBLE + clarity + vision) / 4 AS aggregate FROM q) SELECT doc_id, round(clarity, 6) AS clarity, round(aggregate, 6) AS aggregate, CASE WHEN aggregate <= 0.45 THEN 'low' WHEN aggregate >= 0.75 THEN 'high' ELSE 'medium' END AS tier FROM a""", True)
def a16(spark, sf):
    backend = F.when(F.col("source") == "src0", 1.0).when(F.col("source") == "src1", 0.1).otherwise(0.6)
    q = _chunks(spark, sf).groupBy("doc_id").agg(F.avg(backend).alias("ocr"), F.avg(F.greatest(F.lit(0.0), 1.0 - T.noise_score(F.col("text")))).alias("clarity"), F.avg((F.col("pos") % 3 == 0).cast("int")).alias("vision"))
    q = q.withColumn("a", (0.7 * F.col("ocr") + 0.3 + 0.5 + F.col("clarity") + F.col("vision")) / 4)
    return q.select("doc_id", F.round("clarity", 6).alias("clarity"), F.round("a", 6).alias("aggregate"), X.tier(F.col("a")).alias("tier"))


@query("f27_a40_reading_stats", r"""WITH p AS (SELECT doc_id, page, sum(length(text)) AS n, count(*) AS lines, count(*) FILTER (upper(text) = text AND lower(text) <> text OR text LIKE '%:') + count(*) FILTER (regexp_matches(text, '^[0-9]{3}|^[0-9]{1,2}$|^[-*]')) AS hits, count(*) FILTER (region_type = 'table') AS tables FROM chunks GROUP BY ALL),
d AS (SELECT doc_id, avg(n)::DOUBLE AS chars, least(1.0, avg(n) / 900.0)::DOUBLE AS density, greatest(0.0, 1.0 - sum(tables) / count(*) * 0.4)::DOUBLE AS image, avg((hits >= greatest(1, lines // 6))::INT) AS clarity FROM p GROUP BY doc_id)
SELECT doc_id, round(chars, 3) AS chars, round((density + image + clarity) / 3, 6) AS aggregate FROM d""", True)
def f27(spark, sf):
    t = F.col("text")
    heading = ((F.upper(t) == t) & (F.lower(t) != t)) | t.endswith(":")
    p = _chunks(spark, sf).groupBy("doc_id", "page").agg(F.sum(F.char_length(t)).alias("n"), F.count("*").alias("lines"), (F.count_if(heading) + F.count_if(t.rlike("^[0-9]{3}|^[0-9]{1,2}$|^[-*]"))).alias("hits"), F.count_if(F.col("region_type") == "table").alias("tables"))
    structured = (F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("lines") / 6))).cast("int")
    d = p.groupBy("doc_id").agg(F.avg("n").alias("chars"), F.least(F.lit(1.0), F.avg("n") / 900.0).alias("density"), F.greatest(F.lit(0.0), 1.0 - F.sum("tables") / F.count("*") * 0.4).alias("image"), F.avg(structured).alias("clarity"))
    return d.select("doc_id", F.round("chars", 3).alias("chars"), F.round((F.col("density") + F.col("image") + F.col("clarity")) / 3, 6).alias("aggregate"))


_OPERATORS = ("+", "-", "*", "/", "^", "=", r"\times", r"\cdot")


@query("m22_math_overlap", _over(f"""WITH o AS (SELECT chunk_id, list_filter([{', '.join(f"CASE WHEN contains(text, {_quote(o)}) THEN {_quote(o)} END" for o in _OPERATORS)}], lambda x: x IS NOT NULL) AS a, list_filter([{', '.join(f"CASE WHEN contains(latex, {_quote(o)}) THEN {_quote(o)} END" for o in _OPERATORS)}], lambda x: x IS NOT NULL) AS b,
  list_distinct(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*')) AS va, list_distinct(regexp_extract_all(latex, '[A-Za-z][A-Za-z0-9_]*')) AS vb FROM snips)
SELECT chunk_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END, 6)::DOUBLE AS operators, round(CASE WHEN len(va) = 0 OR len(vb) = 0 THEN 0 ELSE len(list_intersect(va, vb)) / len(list_distinct(va || vb)) END, 6)::DOUBLE AS variables FROM o""", SNIPPETS), True)
def m22(spark, sf):
    used = lambda c: F.array_compact(F.array(*(F.when(F.contains(F.col(c), F.lit(o)), o) for o in _OPERATORS)))
    names = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0)))
    return S.snippets(_chunks(spark, sf)).select("chunk_id", F.round(T.jaccard(used("text"), used("latex")), 6).alias("operators"), F.round(T.jaccard(names("text"), names("latex")), 6).alias("variables"))


@query("m06_a34_golden_set", f"WITH b AS ({ORACLES['j02_a07_m06_bleu']}) SELECT CASE WHEN bleu >= 0.9 THEN 'excellent' WHEN bleu >= 0.8 THEN 'good' WHEN bleu >= 0.7 THEN 'acceptable' ELSE 'fail' END AS band, count(*) AS n, round(avg(bleu), 6) AS bleu FROM b GROUP BY 1")
def a34(spark, sf):
    from docloom.operators import scoring
    from docloom.plans import _pairs

    b = scoring.bleu2(_pairs(spark, sf), "chunk_id", "source", "latex")
    band = F.when(F.col("bleu") >= 0.9, "excellent").when(F.col("bleu") >= 0.8, "good").when(F.col("bleu") >= 0.7, "acceptable").otherwise("fail")
    return b.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("bleu"), 6).alias("bleu"))
