"""Queries over boxes (from ``embeddings``), ordered folds, embeddings, JSON and times."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.operators import layout as X
from docloom.plans import _chunks, query, table
from docloom.plans.latex import _over

BOXES = """boxes AS (SELECT vec_id AS id, label AS page, x0, y0, x0 + 20 + floor(abs(embedding[3]::DOUBLE) * 400) AS x1, y0 + 10 + floor(abs(embedding[4]::DOUBLE) * 200) AS y1, embedding FROM
  (SELECT *, floor((embedding[1]::DOUBLE + 0.5) * 600) AS x0, floor((embedding[2]::DOUBLE + 0.5) * 800) AS y0 FROM embeddings))"""


def _boxes(spark, sf):
    e = lambda i: F.element_at("embedding", i).cast("double")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("page"), F.floor((e(1) + 0.5) * 600).cast("double").alias("x0"), F.floor((e(2) + 0.5) * 800).cast("double").alias("y0"), e(3).alias("w"), e(4).alias("h"))
    return rows.select("id", "page", "x0", "y0", (F.col("x0") + 20 + F.floor(F.abs("w") * 400)).alias("x1"), (F.col("y0") + 10 + F.floor(F.abs("h") * 200)).alias("y1"))


@query("t09_t11_t12_reading_order", _over("SELECT id, page, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) AS place, row_number() OVER (PARTITION BY page ORDER BY y1 DESC, x0, id) AS from_bottom FROM boxes", BOXES))
def t09(spark, sf):
    return X.reading_order(_boxes(spark, sf)).select("id", "page", "place", "from_bottom")


@query("t10_xy_cut", "")
def t10(spark, sf):
    return X.xy_order(_boxes(spark, sf))


@query("m15_m16_columns", _over("SELECT id, CASE WHEN (x0 + x1) / 2 / 600.0 > 0.65 THEN 2 ELSE 1 END AS col, greatest(0, least(1000, round_even(1000 * x0 / 600.0, 0)))::INT AS nx0, greatest(0, least(1000, round_even(1000 * y1 / 800.0, 0)))::INT AS ny1 FROM boxes", BOXES))
def m15c(spark, sf):
    x0, x1 = F.col("x0"), F.col("x1")
    return _boxes(spark, sf).select("id", X.column_of(x0, x1, 600.0).alias("col"), X.normalised(x0, 600.0).alias("nx0"), X.normalised(F.col("y1"), 800.0).alias("ny1"))


@query("m16_f13_clamped", _over("""WITH a AS (SELECT id, page, greatest(0, least(400, x0)) AS x0, greatest(0, least(400, y0)) AS y0, x1, y1 FROM boxes), b AS (SELECT id, page, x0, y0, greatest(x0, least(400, x1)) AS x1, greatest(y0, least(400, y1)) AS y1 FROM a)
SELECT id, x0, y0, x1, y1, 400.0::DOUBLE - y1 AS bottom FROM b WHERE x1 - x0 > 0.01 AND y1 - y0 > 0.01 AND page IN (1, 2, 3)""", BOXES))
def m16(spark, sf):
    return X.clamped(_boxes(spark, sf), 400.0, 400.0).where(F.col("page").isin(1, 2, 3)).select("id", "x0", "y0", "x1", "y1", "bottom")


@query("a24_union_boxes", _over("SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM boxes GROUP BY page", BOXES))
def a24(spark, sf):
    return X.union_boxes(_boxes(spark, sf))


@query("j10_label_by_place", _over("SELECT b.id, coalesce(arg_min('box' || a.id, a.id), 'O') AS label FROM boxes b LEFT JOIN (SELECT * FROM boxes WHERE id % 5 = 0) a ON a.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN a.x0 AND a.x1 AND (b.y0 + b.y1) / 2 BETWEEN a.y0 AND a.y1 GROUP BY b.id", BOXES))
def j10(spark, sf):
    b = _boxes(spark, sf)
    return X.label_by_place(b, b.where("id % 5 = 0").withColumn("label", F.concat(F.lit("box"), "id")))


_ROWS = """o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, id) AS n FROM boxes),
f AS (SELECT page, id, x0, n, y0 AS anchor, 0 AS row FROM o WHERE n = 1 UNION ALL SELECT o.page, o.id, o.x0, o.n, CASE WHEN o.y0 - f.anchor > 48 THEN o.y0 ELSE f.anchor END, f.row + (o.y0 - f.anchor > 48)::INT FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1),
placed AS (SELECT page, id, row, row_number() OVER (PARTITION BY page, row ORDER BY x0, id) - 1 AS col FROM f)"""


@query("w13_box_rows", _over("SELECT page, id, row, col AS \"column\" FROM placed", BOXES, _ROWS).replace("WITH ", "WITH RECURSIVE ", 1))
def w13(spark, sf):
    return X.rows_of_boxes(_boxes(spark, sf), 48.0)


@query("a43_panels", _over("SELECT page, id, round(least(0.95 / count(*) OVER (PARTITION BY page, row), 0.48), 3)::DOUBLE AS width, 'Panel ' || chr((97 + (row_number() OVER (PARTITION BY page ORDER BY row, col) - 1) % 26)::INT) AS caption FROM placed", BOXES, _ROWS).replace("WITH ", "WITH RECURSIVE ", 1))
def a43(spark, sf):
    return X.panels(X.rows_of_boxes(_boxes(spark, sf), 48.0))


@query("w08_budget", """WITH RECURSIVE e AS (SELECT user_id, event_id AS id, 64 + floor(value)::BIGINT AS size, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE 1 END, event_id) AS n FROM events),
r AS (SELECT user_id, id, n, size AS total, true AS taken FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.id, e.n, CASE WHEN r.total < 1000 AND (r.total = 0 OR r.total + e.size <= 1000) THEN r.total + e.size ELSE r.total END, r.total < 1000 AND (r.total = 0 OR r.total + e.size <= 1000) FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, id FROM r WHERE taken""")
def w08(spark, sf):
    first = F.when(F.col("event_type").isin("purchase", "signup"), 0).otherwise(1)
    e = table(spark, sf, "events").select("user_id", F.struct(first.alias("a"), F.col("event_id").alias("b")).alias("pos"), F.col("event_id").alias("id"), (F.lit(64) + F.floor("value")).cast("bigint").alias("size"))
    return X.within_budget(e, "user_id", 1000)


@query("w10_block_chunks", """WITH t AS (SELECT doc_id, pos, CASE region_type WHEN 'formula' THEN 'equation' WHEN 'list' THEN 'text' ELSE region_type END AS tag, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM chunks),
r AS (SELECT doc_id, pos, k, n AS len, CASE WHEN tag IN ('question', 'figure', 'table', 'heading') THEN tag ELSE 'text' END AS tag, 0 AS chunk FROM t WHERE k = 1
  UNION ALL SELECT t.doc_id, t.pos, t.k, CASE WHEN t.tag IN ('question', 'figure', 'table', 'heading') OR t.tag <> r.tag OR r.len + t.n > 600 THEN t.n ELSE r.len + t.n END, t.tag, r.chunk + (t.tag IN ('question', 'figure', 'table', 'heading') OR t.tag <> r.tag OR r.len + t.n > 600)::INT FROM r JOIN t ON t.doc_id = r.doc_id AND t.k = r.k + 1)
SELECT doc_id, pos, chunk FROM r""", True)
def w10(spark, sf):
    kind = F.col("region_type")
    tag = F.when(kind == "formula", "equation").when(kind == "list", "text").otherwise(kind)
    return X.block_chunks(_chunks(spark, sf).select("doc_id", "pos", tag.alias("tag"), F.char_length("text").alias("n")), 600)


@query("w11_roulette", "WITH w AS (SELECT user_id, event_id, power(greatest(value, 0.01), 2.0) AS w FROM events), r AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY event_id) AS run, sum(w) OVER (PARTITION BY user_id) AS a FROM w) SELECT user_id, min(event_id) AS picked FROM r WHERE run >= 0.37 * a GROUP BY user_id")
def w11(spark, sf):
    return X.roulette(table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.col("value").alias("score")), "user_id", 0.37, 0.5)


@query("t03_best", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def t03(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("value"), "event_id").limit(10).select("event_id", "value")


@query("j13_m03_nearest_profile", """WITH m AS (SELECT label, list(v ORDER BY i) AS p FROM (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label),
s AS (SELECT vec_id AS id, m.label AS domain, round(list_cosine_similarity(embedding::DOUBLE[], p), 6) AS score FROM embeddings, m), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, domain) AS k FROM s)
SELECT id, domain, greatest(0, score)::DOUBLE AS score FROM r WHERE k = 1""")
def j13(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("domain"))
    means = v.select("domain", F.posexplode("vector")).groupBy("domain", "pos").agg(F.avg("col").alias("v"))
    profiles = means.groupBy("domain").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("profile"))
    return X.nearest_profile(v.select("id", "vector"), profiles)


@query("m02_hash_embedding", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), c AS (SELECT doc_id, ('0x' || md5(w)[1:8])::BIGINT % 256 AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def m02(spark, sf):
    return X.hash_embedding(table(spark, sf, "documents"))


@query("e01_e05_build_events", """WITH c AS (SELECT conv_id, turn, text, unnest(range(0, length(text) + 3)) AS seq FROM conversations)
SELECT conv_id, turn, seq::INT AS seq, CASE WHEN seq = 0 OR seq = length(text) + 2 THEN 'status' WHEN seq = length(text) + 1 THEN 'block_done' ELSE 'token' END AS type, CASE WHEN seq = 0 THEN 'WORKING' WHEN seq = length(text) + 2 THEN 'DONE' WHEN seq = length(text) + 1 THEN NULL ELSE text[seq] END AS token FROM c""")
def e01(spark, sf):
    return X.build_events(table(spark, sf, "conversations"), ["conv_id", "turn"], "text")


@query("e06_latest", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS ts FROM events GROUP BY user_id")
def e06(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("ts"))


@query("j20_j22_a27_nested", "WITH k AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT c_custkey, coalesce(string_agg(event_type || ':' || n, ',' ORDER BY event_type), '') AS views, coalesce(sum(n), 0)::BIGINT AS total FROM customer LEFT JOIN k ON user_id = c_custkey GROUP BY c_custkey")
def j20(spark, sf):
    k = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    k = k.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("v"), F.sum("n").alias("total"))
    views = F.array_join(F.transform("v", lambda x: F.concat(x["event_type"], F.lit(":"), x["n"])), ",")
    return table(spark, sf, "customer").join(k, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce(views, F.lit("")).alias("views"), F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))


@query("ja5_ja6_json", r"SELECT event_id, (props->>'k')::BIGINT AS k, (regexp_extract('Answer: ' || props || ' done', '(?s)\{.*\}', 0)->>'k')::BIGINT AS loose FROM events")
def ja5(spark, sf):
    loose = F.regexp_extract(F.concat(F.lit("Answer: "), "props", F.lit(" done")), r"(?s)\{.*\}", 0)
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object(loose, "$.k").cast("bigint").alias("loose"))


@query("jd1_jd2_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS since FROM events")
def jd1(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))).alias("since"))


@query("f10_f19_f20_predicates", "SELECT event_id, coalesce(event_type <> 'view', true) AS not_ok, event_type IN ('view', 'click', 'error', 'purchase', 'signup') AND ts IS NOT NULL AND json_valid(props) AS sound, value >= 5 OR event_id % 4 >= 3 AS budget FROM events")
def f10(spark, sf):
    kinds = ("view", "click", "error", "purchase", "signup")
    gpus = F.array(F.col("value"), F.when(F.col("event_id") % 4 >= 3, 8.0).otherwise(0.0))
    sound = F.col("event_type").isin(*kinds) & F.col("ts").isNotNull() & F.get_json_object("props", "$").isNotNull()
    return table(spark, sf, "events").select("event_id", (~F.col("event_type").eqNullSafe("view")).alias("not_ok"), sound.alias("sound"), F.exists(gpus, lambda g: g >= 5.0).alias("budget"))
