"""Registered queries of the engine, with the SQL each is checked against.

A query's name begins with the operators it stands for. Chunks are the non-blank lines of
``documents``; plans and snippets are derived from these or from ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunks as C
from docloom.operators import runs as R
from docloom.operators import scoring as S
from docloom.sources import markdown_paragraphs

FLAGSHIP = "a01_region_noise"
QUERIES: dict = {}
ORACLES: dict = {}

#: The chunk view in SQL.
CHUNKS = r"""
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
c0 AS (SELECT 'chunk_' || doc_id || '_' || pos AS chunk_id, doc_id, source, pos::INT AS pos, ((pos - 1) // 4 + 1)::INT AS page, trim(line) AS text,
  len(list_filter(regexp_split_to_array(trim(line), '\s+'), lambda x: x <> '')) AS nw FROM l WHERE trim(line) <> ''),
c1 AS (SELECT *, CASE WHEN regexp_matches(lower(text), '^(chapter|section|appendix|part|lesson)') THEN CASE WHEN starts_with(lower(text), 'chapter') THEN 1 ELSE 2 END
  WHEN upper(text) = text AND lower(text) <> text AND nw <= 8 THEN 1 WHEN nw <= 10 AND text LIKE '%:' THEN 2 ELSE 0 END AS header_level FROM c0),
chunks AS (SELECT *, CASE WHEN starts_with(lower(text), 'figure') OR starts_with(lower(text), 'fig ') THEN 'figure'
  WHEN regexp_matches(text, '(\+[-+]+\+)|(\|.+\|)') THEN 'table' WHEN regexp_matches(text, '^([0-9]+\.[\)\s]|[A-Za-z]\.|[-*•])\s+') THEN 'list'
  WHEN regexp_matches(text, '(\\begin\{equation\}|\\frac|\\sum|\\int|=|\[a-z]+)') THEN 'formula' WHEN header_level > 0 THEN 'heading' ELSE 'text' END AS region_type FROM c1)
"""
_NOISE = r"""least(1.0, 0.4 * len(regexp_extract_all(text, '[^\x00-\x7F]')) / greatest(length(text), 1) + 0.2 * len(regexp_extract_all(text, '-\n')) / greatest(len(regexp_extract_all(text, '\n')), 1)
  + 0.2 * len(regexp_extract_all(text, '[@#$%^&]')) / greatest(length(text), 1) + 0.2 * (1 - CASE WHEN len(regexp_extract_all(text, '[A-Za-z]+')) > 0
  THEN len(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) / len(regexp_extract_all(text, '[A-Za-z]+')) ELSE 0 END))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str = "", chunked: bool = False):
    """Register a function of (spark, sf_dir), and the SQL it must agree with."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {CHUNKS}{',' if sql.lstrip().startswith('WITH') else ''} {sql.lstrip().removeprefix('WITH') if chunked else sql}" if chunked else sql
        return f

    return put


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(table(spark, sf_dir, "documents"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn (the chunk) with the assistant turn after it (the snippet)."""
    t = table(spark, sf_dir, "conversations")
    ask = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answer = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("latex"))
    return ask.join(answer, ["conv_id", "turn"]).select(F.concat_ws("_", "conv_id", "turn").alias("chunk_id"), "source", "latex")


_PAIRS = """pairs AS (SELECT u.conv_id || '_' || u.turn AS chunk_id, u.text AS source, a.text AS latex FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""


# Filters and projections


@query("f01_f02_regions_of_page", "SELECT chunk_id, pos, text FROM chunks WHERE region_type = 'heading' AND page = 1", True)
def f01(spark, sf):
    return _chunks(spark, sf).where("region_type = 'heading' and page = 1").select("chunk_id", "pos", "text")


@query("f04_w03_plan_projection", "SELECT chunk_id, 'block_' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::VARCHAR, 4, '0') AS block_id, CASE WHEN length(text) <= 72 THEN text ELSE text END AS label, region_type AS block_type FROM chunks", True)
def f04(spark, sf):
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return _chunks(spark, sf).select("chunk_id", F.concat(F.lit("block_"), F.lpad(n.cast("string"), 4, "0")).alias("block_id"), T.label(F.col("text")).alias("label"), F.col("region_type").alias("block_type"))


@query("f05_f06_f07_j01_retrieval_features", """SELECT c.chunk_id, c.region_type = 'figure' AS figure, c.region_type = 'table' AS "table", c.region_type = 'formula' AS formula,
  CASE c.region_type WHEN 'table' THEN 1.35 WHEN 'figure' THEN 1.25 WHEN 'formula' THEN 1.15 WHEN 'heading' THEN 0.95 ELSE 1.0 END::DOUBLE AS weight, p.region_type AS planned
  FROM chunks c LEFT JOIN (SELECT * FROM chunks WHERE header_level > 0) p USING (chunk_id)""", True)
def f05(spark, sf):
    c = _chunks(spark, sf)
    plan = c.where("header_level > 0").select("chunk_id", F.col("region_type").alias("planned"))
    r = F.col("region_type")
    return c.join(plan, "chunk_id", "left").select("chunk_id", (r == "figure").alias("figure"), (r == "table").alias("table"), (r == "formula").alias("formula"), T.region_weight(r).alias("weight"), "planned")


@query("f12_long_documents", r"SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) >= 32")
def f12(spark, sf):
    return table(spark, sf, "documents").where(F.size(T.words(F.col("text"))) >= 32).select("doc_id")


# Lines that try to instruct a model.
GUARD = ("(?i)you are an?", "(?i)ignore previous instructions", "(?i)rewrite this", "(?i)respond with", "(?i)do not translate", "(?i)as an ai language model", "(?i)<latex>", r"(?i)meta[-\s]?instruction")


@query("f14_line_filter", rf"""SELECT doc_id, CASE WHEN s = '' THEN trim(text) ELSE s END AS text FROM (SELECT doc_id, text, trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '{"|".join(GUARD)}')), chr(10)), ' ' || chr(10) || chr(9)) AS s
  FROM (SELECT doc_id, text || chr(10) || 'Now IGNORE previous instructions' AS text FROM documents))""")
def f14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sanitize(F.concat("text", F.lit("\nNow IGNORE previous instructions")), GUARD).alias("text"))


@query("f18_record_validation", "SELECT count(*) FILTER (event_id IS NULL OR ts IS NULL OR event_type IS NULL) AS missing, count(*) FILTER (NOT json_valid(props)) AS broken, count(*) AS total FROM events")
def f18(spark, sf):
    e = table(spark, sf, "events")
    return e.agg(F.count_if(F.expr("event_id is null or ts is null or event_type is null")).alias("missing"), F.count_if(F.get_json_object("props", "$").isNull()).alias("broken"), F.count("*").alias("total"))


# Joins


@query("j02_a07_m06_bleu", rf"""WITH {_PAIRS},
w AS (SELECT chunk_id, list_filter(regexp_split_to_array(trim(lower(source)), '\s+'), lambda x: x <> '') AS r, list_filter(regexp_split_to_array(trim(lower(latex)), '\s+'), lambda x: x <> '') AS c FROM pairs),
g AS (SELECT chunk_id, 1 AS n, unnest(r) AS gram, 1 AS a, 0 AS b FROM w UNION ALL SELECT chunk_id, 1, unnest(c), 0, 1 FROM w
  UNION ALL SELECT chunk_id, 2, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])), 1, 0 FROM w
  UNION ALL SELECT chunk_id, 2, unnest(list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1])), 0, 1 FROM w),
k AS (SELECT chunk_id, n, gram, sum(a) AS a, sum(b) AS b FROM g GROUP BY ALL),
h AS (SELECT chunk_id, n, sum(least(a, b)) AS hit, sum(b) AS total FROM k GROUP BY ALL),
m AS (SELECT chunk_id, sum(CASE WHEN total > 0 THEN hit / total ELSE 0 END) / 2 AS p FROM h GROUP BY chunk_id)
SELECT chunk_id, round(CASE WHEN len(r) = 0 OR len(c) = 0 THEN 0 ELSE p * least(1.0, len(c) / len(r)) END, 3)::DOUBLE AS bleu FROM w LEFT JOIN m USING (chunk_id)""")
def j02(spark, sf):
    return S.bleu2(_pairs(spark, sf), "chunk_id", "source", "latex")


@query("j05_u07_gaps", "SELECT DISTINCT conv_id FROM conversations WHERE role = 'user' AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def j05(spark, sf):
    t = table(spark, sf, "conversations")
    return t.where("role = 'user'").select("conv_id").distinct().join(t.where("role = 'system'").select("conv_id"), "conv_id", "left_anti")


@query("j06_flagged_pages", "SELECT chunk_id FROM chunks WHERE (doc_id, page) IN (SELECT doc_id, page FROM chunks WHERE region_type = 'formula')", True)
def j06(spark, sf):
    c = _chunks(spark, sf)
    return c.join(c.where("region_type = 'formula'").select("doc_id", "page"), ["doc_id", "page"], "left_semi").select("chunk_id")


@query("j08_numbered_references", r"""WITH o AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS ordinal FROM chunks WHERE region_type = 'heading'),
f AS (SELECT DISTINCT doc_id, chunk_id AS source, unnest(regexp_extract_all(lower(text || ' see Section ' || (pos % 4 + 1)), 'section\s+([0-9]{1,6})', 1))::INT AS ordinal FROM chunks)
SELECT source, f.ordinal, o.chunk_id AS target FROM f LEFT JOIN o ON o.doc_id = f.doc_id AND o.ordinal = f.ordinal""", True)
def j08(spark, sf):
    text = F.concat("text", F.lit(" see Section "), F.col("pos") % 4 + 1)
    return C.numbered_references(_chunks(spark, sf).withColumn("text", text), "heading", "section")


@query("j09_w07_u05_related_chunks", """WITH t AS (SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS s FROM chunks),
p AS (SELECT a.chunk_id AS source, b.chunk_id AS target, list_intersect(a.s, b.s) AS met, len(a.s) AS na, len(b.s) AS nb FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n + 1 AND a.n + 4),
q AS (SELECT *, CASE WHEN na = 0 OR nb = 0 THEN 0 ELSE len(met) / (na + nb - len(met)) END AS score FROM p)
SELECT source, target, round(score, 3) AS score, array_to_string(list_sort(met)[1:5], ' ') AS keywords FROM q WHERE score >= 0.3""", True)
def j09(spark, sf):
    return C.related(_chunks(spark, sf))


@query("j12_t01_vector_search", """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) + CASE WHEN q.label = e.label THEN 0.05 ELSE -0.02 END, 6) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS rank FROM s)
SELECT query_id, entry_id, score, rank FROM r WHERE rank <= 3 AND score > 0""")
def j12(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vector"), F.col("label").alias("domain"))
    q = e.where("entry_id % 50 = 0").withColumnRenamed("entry_id", "query_id")
    return S.cosine_search(q, e, unknown=-0.02)


@query("j14_t02_bag_search", """WITH b AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents), c AS (SELECT id, w, count(*) AS n FROM b GROUP BY ALL),
z AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id),
d AS (SELECT q.id AS query_id, e.id, sum(q.n * e.n) AS dot FROM c q JOIN c e ON q.w = e.w AND q.id % 50 = 0 AND e.id <> q.id GROUP BY ALL),
s AS (SELECT query_id, d.id, round(dot / (a.norm * b.norm), 6) AS score FROM d JOIN z a ON a.id = d.id JOIN z b ON b.id = query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 3""")
def j14(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)).alias("tokens"))
    return S.bag_cosine(d, d.where("id % 50 = 0"))


@query("j19_page_repeats", """WITH p AS (SELECT DISTINCT doc_id, text, page FROM chunks), i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, text ORDER BY page) AS run FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, run ORDER BY page) AS n FROM i)
SELECT chunk_id FROM chunks SEMI JOIN (SELECT * FROM k WHERE n % 2 = 1) k USING (doc_id, text, page)""", True)
def j19(spark, sf):
    return C.drop_page_repeats(_chunks(spark, sf)).select("chunk_id")


@query("j25_planned_then_rest", "SELECT chunk_id, CASE WHEN header_level > 0 THEN 0 ELSE 1 END AS unplanned, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN header_level > 0 THEN 0 ELSE 1 END, pos) AS place FROM chunks", True)
def j25(spark, sf):
    c = _chunks(spark, sf)
    planned = c.where("header_level > 0")
    both = planned.withColumn("unplanned", F.lit(0)).unionByName(c.join(planned.select("chunk_id"), "chunk_id", "left_anti").select(*c.columns).withColumn("unplanned", F.lit(1)))
    return both.select("chunk_id", "unplanned", F.row_number().over(Window.partitionBy("doc_id").orderBy("unplanned", "pos")).alias("place"))


# Aggregations


@query("a01_region_noise", f"SELECT region_type, count(*) AS n, round(avg({_NOISE}), 6) AS noise FROM chunks GROUP BY region_type", True)
def a01(spark, sf):
    return _chunks(spark, sf).groupBy("region_type").agg(F.count("*").alias("n"), F.round(F.avg(T.noise_score(F.col("text"))), 6).alias("noise"))


@query("a02_share_by_domain", "SELECT coalesce(source, 'unlabeled') AS domain, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM documents GROUP BY 1")
def a02(spark, sf):
    n = table(spark, sf, "documents").groupBy(F.coalesce("source", F.lit("unlabeled")).alias("domain")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("a03_a05_a42_modalities", "SELECT count(*) AS chunks, count(DISTINCT doc_id) AS docs, count(*) FILTER (region_type = 'figure') AS figures, count(*) FILTER (region_type = 'table') AS tables, count(*) FILTER (region_type = 'formula') AS formulas, round(avg(length(text)), 3) AS mean_chars FROM chunks", True)
def a03(spark, sf):
    kind = lambda k: F.count_if(F.col("region_type") == k)
    return _chunks(spark, sf).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"), kind("figure").alias("figures"), kind("table").alias("tables"), kind("formula").alias("formulas"), F.round(F.avg(F.char_length("text")), 3).alias("mean_chars"))


@query("a08_document_profile", f"""WITH p AS (SELECT doc_id, avg((region_type = 'formula')::INT) AS m, avg((region_type = 'figure')::INT) AS f, avg({_NOISE}) AS d FROM chunks GROUP BY doc_id)
SELECT doc_id, CASE WHEN m >= 0.25 THEN 'math' WHEN f >= 0.3 THEN 'reference' ELSE 'narrative' END AS doc_type, round(m, 3) AS math_ratio, round(f, 3) AS figure_ratio, round(d, 3) AS difficulty FROM p""", True)
def a08(spark, sf):
    return S.document_profiles(_chunks(spark, sf))


@query("a13_token_stats", """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)
SELECT doc_id, len(w)::INT AS token_count, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0 END, 6) AS unique_ratio, round(CASE WHEN len(w) > 0 THEN length(array_to_string(w, '')) / len(w) ELSE 0 END, 6) AS avg_token_len FROM t""")
def a13(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)).alias("w"))
    n = F.size("w")
    return t.select("doc_id", n.alias("token_count"), F.round(F.when(n > 0, F.size(F.array_distinct("w")) / n).otherwise(0.0), 6).alias("unique_ratio"), F.round(F.when(n > 0, F.char_length(F.array_join("w", "")) / n).otherwise(0.0), 6).alias("avg_token_len"))


@query("a14_consensus", "WITH n AS (SELECT source, text, count(*) AS n FROM documents GROUP BY ALL) SELECT source, round(max(n) / sum(n), 6) AS share FROM n GROUP BY source")
def a14(spark, sf):
    n = table(spark, sf, "documents").groupBy("source", F.xxhash64("text").alias("h"), "text").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("a22_case_conflicts", "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) SELECT doc_id, lower(w) AS word, count(DISTINCT w) AS forms FROM w GROUP BY ALL HAVING count(DISTINCT w) > 1")
def a22(spark, sf):
    return S.case_conflicts(table(spark, sf, "documents")).select("doc_id", "word", "forms")


@query("a23_duplicate_texts", "SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def a23(spark, sf):
    return table(spark, sf, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("a12_mean_vectors", "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT label, i::INT AS \"at\", round(avg(v), 6) AS mean FROM x GROUP BY ALL")
def a12(spark, sf):
    x = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    return x.groupBy("label", (F.col("at") + 1).alias("at")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("a31_a38_a39_ledger", "SELECT event_type, count(*) AS total, count(*) FILTER (value > 0) AS positive, round(avg(value), 6) AS mean, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def a31(spark, sf):
    return R.ledger(table(spark, sf, "events"))


@query("a32_s24_running_totals", "SELECT event_id, user_id, round(sum(value) OVER w, 4) AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def a32(spark, sf):
    return R.cumulative(table(spark, sf, "events"))


@query("a35_vocabulary", "SELECT DISTINCT unnest(string_split(event_type, '_')) AS label FROM events")
def a35(spark, sf):
    return table(spark, sf, "events").select(F.explode(F.split("event_type", "_")).alias("label")).distinct()


@query("a36_moving_average", """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, n, value::DOUBLE AS ema FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.n, r.ema * 0.8 + o.value * 0.2 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, round(arg_max(ema, n), 6) AS ema FROM r GROUP BY user_id""")
def a36(spark, sf):
    return R.moving_average(table(spark, sf, "events"), 0.2)


# Windows


@query("w01_neighbours", "SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk, lag(region_type) OVER w AS prev_region, lead(chunk_id) OVER w AS next_chunk, lead(region_type) OVER w AS next_region FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)", True)
def w01(spark, sf):
    return C.neighbours(_chunks(spark, sf))


@query("w02_header_jumps", "WITH h AS (SELECT doc_id, header_level - lag(header_level) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM chunks WHERE header_level > 0) SELECT doc_id, count(*) AS headings, count(*) FILTER (step > 1) AS jumps FROM h GROUP BY doc_id", True)
def w02(spark, sf):
    return C.header_jumps(_chunks(spark, sf))


@query("w04_ordinals", "SELECT chunk_id, region_type, row_number() OVER (PARTITION BY doc_id, region_type ORDER BY pos) AS ordinal FROM chunks", True)
def w04(spark, sf):
    return C.ordinals(_chunks(spark, sf))


@query("w05_sections", """SELECT chunk_id, doc_id, pos, region_type, (sum((region_type = 'heading')::INT) OVER w)::BIGINT AS section,
  coalesce(last_value(CASE WHEN region_type = 'heading' THEN text END IGNORE NULLS) OVER w, 'Preamble / Introduction') AS title FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)""", True)
def w05(spark, sf):
    return C.sections(_chunks(spark, sf))


@query("w06_heading_parents", """WITH h AS (SELECT chunk_id, header_level, last_value(CASE WHEN header_level = 1 THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM chunks)
SELECT chunk_id, header_level, CASE WHEN header_level > 1 THEN p END AS parent FROM h WHERE header_level > 0""", True)
def w06(spark, sf):
    return C.heading_paths(_chunks(spark, sf))


@query("w14_w15_islands", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM chunks), i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM n WHERE region_type = 'text')
SELECT doc_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM i GROUP BY doc_id, island HAVING count(*) >= 2""", True)
def w14(spark, sf):
    return C.region_islands(_chunks(spark, sf), "text")


@query("w18_best_so_far", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def w18(spark, sf):
    return R.best_so_far(table(spark, sf, "events"))


@query("s33_tail", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events) SELECT * FROM r WHERE back <= 5")
def s33(spark, sf):
    return R.tail(table(spark, sf, "events"), 5)


@query("s07_log_projection", "SELECT event_id, event_type AS stage, CASE WHEN value > 50 THEN 'ok' ELSE 'unknown' END AS status, coalesce(CASE WHEN length(repeat(props, 25)) > 200 THEN repeat(props, 25)[1:197] || '...' ELSE repeat(props, 25) END, '') AS notes FROM events")
def s07(spark, sf):
    return R.log_rows(table(spark, sf, "events"), F.col("event_type"), F.when(F.col("value") > 50, "ok"), F.repeat("props", F.lit(25)))


@query("s17_paragraphs", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS i FROM documents) SELECT doc_id, i::INT AS \"at\", trim(p) AS paragraph FROM p WHERE trim(p) <> ''")
def s17(spark, sf):
    return markdown_paragraphs(table(spark, sf, "documents"))


# Rankings and sets


@query("t05_j04_queue", """WITH k AS (SELECT chunk_id, page, CASE WHEN region_type = 'formula' THEN 2 WHEN region_type = 'heading' THEN 4 ELSE 10 END AS priority FROM chunks)
SELECT chunk_id, page, priority FROM k ORDER BY priority, page, chunk_id LIMIT 100""", True)
def t05(spark, sf):
    reason = F.array(F.when(F.col("region_type") == "formula", "hallucination").when(F.col("region_type") == "heading", "lint_warning").otherwise("other"))
    return R.queue(_chunks(spark, sf).select("chunk_id", "page", reason.alias("reasons")), 100).select("chunk_id", "page", "priority")


@query("t13_t17_samples_by_type", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) SELECT event_type, string_agg(event_id::VARCHAR, ',' ORDER BY n) AS ids FROM r WHERE n <= 3 GROUP BY event_type")
def t13(spark, sf):
    top = S.top_by_group(table(spark, sf, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 3)
    return top.groupBy("event_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@query("t18_hash_split", "SELECT doc_id, CASE WHEN ('0x' || md5(doc_id::VARCHAR)[1:4])::INT % 100 < 10 THEN 'eval' ELSE 'train' END AS split FROM documents")
def t18(spark, sf):
    bucket = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 100
    return table(spark, sf, "documents").select("doc_id", F.when(bucket < 10, "eval").otherwise("train").alias("split"))


@query("u01_u02_u12_keep_first", "WITH r AS (SELECT doc_id, pos, text, row_number() OVER (PARTITION BY text ORDER BY doc_id, pos) AS k FROM chunks) SELECT doc_id, pos, text FROM r WHERE k = 1", True)
def u01(spark, sf):
    return S.keep_first(_chunks(spark, sf), [F.col("text")], [F.col("doc_id"), F.col("pos")]).select("doc_id", "pos", "text")


@query("u11_w19_containment", rf"""WITH {_PAIRS}, w AS (SELECT chunk_id, list_filter(regexp_split_to_array(trim(lower(source)), '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(trim(lower(regexp_replace(regexp_replace(latex, '\\[a-zA-Z]+', ' ', 'g'), '[\{{\}}]', ' ', 'g'))), '\s+'), lambda x: x <> '') AS b FROM pairs),
g AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(a) - 1), lambda i: array_to_string(a[i:i + 2], ' '))) AS x, list_distinct(list_transform(range(1, len(b) - 1), lambda i: array_to_string(b[i:i + 2], ' '))) AS y FROM w)
SELECT chunk_id, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(x) END, 6)::DOUBLE AS contained FROM g""")
def u11(spark, sf):
    p = _pairs(spark, sf)
    return p.select("chunk_id", F.round(T.containment(F.col("source"), F.col("latex")), 6).alias("contained"))


# Scalars


@query("r01_r03_line_classes", "SELECT chunk_id, header_level, region_type FROM chunks", True)
def r01(spark, sf):
    return _chunks(spark, sf).select("chunk_id", "header_level", "region_type")


@query("r09_r10_r15_r24_labels", r"""SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND length(x) <= 72)[1], trim(string_split(text, chr(10))[1])) AS label,
  array_to_string(w[1:32], ' ') || CASE WHEN len(w) > 32 THEN '...' ELSE '' END AS summary, regexp_replace(regexp_replace(lower(coalesce(source, '')), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  len(list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''))::INT AS sentences
  FROM (SELECT *, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM documents)""")
def r09(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.label(t).alias("label"), T.summary(t).alias("summary"), T.slug(F.coalesce("source", F.lit(""))).alias("slug"), T.sentence_count(t).alias("sentences"))


@query("r13_noise", f"SELECT doc_id, round({_NOISE}, 6) AS noise FROM documents")
def r13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.noise_score(F.col("text")), 6).alias("noise"))


@query("r11_table_signature", "SELECT doc_id, greatest(1, coalesce(list_max(list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: len(list_filter(string_split(x, '|'), lambda c: trim(c) <> '')))), 1))::INT AS columns FROM documents")
def r11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.table_columns(F.col("text")).alias("columns"))


@query("r50_region_hash", "SELECT DISTINCT source, ('0x' || sha1(source)[1:6])::BIGINT AS feature FROM documents WHERE source IS NOT NULL")
def r50(spark, sf):
    return table(spark, sf, "documents").where("source is not null").select("source", F.conv(F.substring(F.sha1(F.col("source").cast("binary")), 1, 6), 16, 10).cast("bigint").alias("feature")).distinct()


@query("m01_m07_overlap", rf"""WITH {_PAIRS}, t AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(source), '[a-z]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(latex), '[a-z]{{3,}}')) AS b, length(source) AS ns, length(latex) AS nl FROM pairs)
SELECT chunk_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6)::DOUBLE AS overlap, round(CASE WHEN ns = 0 THEN 1 ELSE least(1.0, nl / ns) END, 6)::DOUBLE AS length_ratio FROM t""")
def m01(spark, sf):
    p = _pairs(spark, sf).select("chunk_id", T.token_set(F.col("source")).alias("a"), T.token_set(F.col("latex")).alias("b"), F.char_length("source").alias("ns"), F.char_length("latex").alias("nl"))
    return p.select("chunk_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"), F.round(T.ratio(F.col("nl"), F.col("ns")), 6).alias("length_ratio"))


@query("m05_quantise", "SELECT vec_id, list_transform(embedding, lambda x: least(63, greatest(0, round_even(x::DOUBLE * 63, 0)))::INT) AS levels FROM embeddings")
def m05(spark, sf):
    e = F.transform("embedding", lambda x: F.least(F.lit(63.0), F.greatest(F.lit(0.0), F.bround(x.cast("double") * 63, 0))).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", e.alias("levels"))


_GATE_SQL = """WITH p AS (SELECT doc_id, avg((region_type = 'formula')::INT) AS m, avg((region_type = 'figure')::INT) AS f, round(avg(least(1.0, length(text) / 100.0)), 6) AS s, round(count(DISTINCT page) / count(*), 6) AS t FROM chunks GROUP BY doc_id),
k AS (SELECT doc_id, CASE WHEN m >= 0.25 THEN 'math' WHEN f >= 0.3 THEN 'reference' ELSE 'narrative' END AS doc_type, s, t FROM p),
g AS (SELECT *, list_filter([CASE WHEN s < CASE doc_type WHEN 'math' THEN 0.8 WHEN 'reference' THEN 0.7 ELSE 0.65 END THEN 'semantic' END, CASE WHEN t < CASE doc_type WHEN 'math' THEN 0.75 WHEN 'reference' THEN 0.7 ELSE 0.65 END THEN 'structural' END], lambda x: x IS NOT NULL) AS failed FROM k)
SELECT doc_id, doc_type, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed FROM g"""


@query("m12_quality_gate", _GATE_SQL, True)
def m12(spark, sf):
    c = _chunks(spark, sf)
    scores = c.groupBy("doc_id").agg(F.round(F.avg(F.least(F.lit(1.0), F.char_length("text") / 100.0)), 6).alias("semantic"), F.round(F.countDistinct("page") / F.count("*"), 6).alias("structural"))
    rows = scores.join(S.document_profiles(c).select("doc_id", "doc_type"), "doc_id")
    rows = rows.select("*", *(F.lit(1.0).alias(d) for d in ("content", "visual", "reward")))
    return S.gate(rows, "doc_type").select("doc_id", "doc_type", F.array_join("failed", ",").alias("failed"), "passed")


@query("m15_m23_tiers", "SELECT event_id, round(0.4 + 0.6 * least(1.0, value / 24.0), 6) AS confidence, CASE WHEN value / 100 <= 0.45 THEN 'low' WHEN value / 100 >= 0.75 THEN 'high' ELSE 'medium' END AS tier FROM events")
def m15(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", F.round(0.4 + 0.6 * F.least(F.lit(1.0), v / 24.0), 6).alias("confidence"), F.when(v / 100 <= 0.45, "low").when(v / 100 >= 0.75, "high").otherwise("medium").alias("tier"))


# Events


@query("e03_state_progress", "SELECT event_id, user_id, round(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY user_id), 4) AS progress, CASE WHEN row_number() OVER w = count(*) OVER (PARTITION BY user_id) THEN 'COMPLETED' ELSE 'RUNNING' END AS state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def e03(spark, sf):
    w = Window.partitionBy("user_id")
    n, at = F.count("*").over(w), F.row_number().over(w.orderBy("ts", "event_id"))
    return table(spark, sf, "events").select("event_id", "user_id", F.round(100.0 * at / n, 4).alias("progress"), F.when(at == n, "COMPLETED").otherwise("RUNNING").alias("state"))


@query("e07_reassembly", "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS digest, count(*) AS tokens FROM conversations GROUP BY conv_id")
def e07(spark, sf):
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return t.select("conv_id", F.md5(F.array_join(F.transform("x", lambda v: v["text"]), "").cast("binary")).alias("digest"), F.size("x").cast("bigint").alias("tokens"))


from docloom.plans import fusion, graph, latex, layout, markup, profiles, sources  # noqa: E402,F401  (register their queries)
