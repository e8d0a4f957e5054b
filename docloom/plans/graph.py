"""Queries over graphs, hierarchies, labels, citations, and joins with plans and issues."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunks as C
from docloom.operators import graph as G
from docloom.operators import latex as S
from docloom.operators import scoring
from docloom.plans import _chunks, query, table
from docloom.plans.latex import SNIPPETS, _over

_SEC = "sec AS (SELECT *, 'section_' || lpad((sum((region_type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY pos))::VARCHAR, 3, '0') AS sid FROM chunks)"
_GRAPH = """nodes AS (SELECT doc_id, 'document_root' AS id, 'document' AS type FROM documents UNION ALL SELECT DISTINCT doc_id, sid, 'section' FROM sec UNION ALL SELECT doc_id, 'content_' || chunk_id, 'chunk' FROM sec WHERE region_type <> 'heading'),
edges AS (SELECT DISTINCT doc_id, 'document_root' AS source, sid AS target, 'contains' AS type FROM sec UNION ALL SELECT doc_id, sid, 'content_' || chunk_id, 'orders' FROM sec WHERE region_type <> 'heading')"""


def _graph(spark, sf):
    return G.document_graph(_chunks(spark, sf), table(spark, sf, "documents"))


@query("g01_u10_nodes", _over("SELECT * FROM nodes", _SEC, _GRAPH), True)
def g01(spark, sf):
    return _graph(spark, sf)[0]


@query("g01_f11_edges", _over("SELECT doc_id, source, target FROM edges WHERE type = 'contains'", _SEC, _GRAPH), True)
def f11(spark, sf):
    return G.edges_like(_graph(spark, sf)[1], type="contains", source=None).drop("type")


@query("a25_a37_graph_metrics", _over("SELECT n.*, coalesce(e.edges, 0) AS edges FROM (SELECT doc_id, count(*) AS nodes, count(*) FILTER (type = 'section') AS sections, count(*) FILTER (type = 'chunk') AS contents FROM nodes GROUP BY doc_id) n LEFT JOIN (SELECT doc_id, count(*) AS edges FROM edges GROUP BY doc_id) e USING (doc_id)", _SEC, _GRAPH), True)
def a25(spark, sf):
    return G.graph_metrics(*_graph(spark, sf))


@query("g05_level_ids", "SELECT chunk_id, doc_id, CASE WHEN header_level = 1 THEN 'chapter' ELSE 'section' END || '-' || lpad((row_number() OVER (PARTITION BY doc_id, header_level ORDER BY pos))::VARCHAR, 3, '0') AS node_id FROM chunks WHERE header_level > 0", True)
def g05(spark, sf):
    return G.level_ids(_chunks(spark, sf))


@query("g04_heading_titles", """WITH h AS (SELECT *, last_value(CASE WHEN header_level = 1 THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM chunks)
SELECT chunk_id, CASE WHEN header_level = 1 OR above IS NULL THEN text ELSE above || ' > ' || text END AS path FROM h WHERE header_level > 0""", True)
def g04(spark, sf):
    return G.heading_titles(_chunks(spark, sf))


@query("g06_unique_labels", "WITH r AS (SELECT chunk_id, region_type AS name, row_number() OVER (PARTITION BY doc_id, region_type ORDER BY pos) - 1 AS n FROM chunks) SELECT chunk_id, CASE WHEN n > 0 THEN name || '-' || n ELSE name END AS name FROM r", True)
def g06(spark, sf):
    return G.unique_names(_chunks(spark, sf).withColumn("name", F.col("region_type")), ["doc_id"], "name", "pos").select("chunk_id", "name")


@query("g08_g09_next_edges", "WITH e AS (SELECT doc_id, chunk_id AS source, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY pos) AS target, 'next_chunk' AS type FROM chunks) SELECT * FROM e WHERE target IS NOT NULL", True)
def g08(spark, sf):
    return G.next_edges(_chunks(spark, sf), "doc_id", "chunk_id", ["pos"], "next_chunk")


@query("g07_lineage", "WITH e AS (SELECT event_id::VARCHAR AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)::VARCHAR AS target, 'child' AS type FROM events) SELECT * FROM e WHERE target IS NOT NULL UNION ALL SELECT event_id::VARCHAR, 'run-' || user_id, CASE WHEN value > 10 THEN 'passed' ELSE 'failed' END FROM events")
def g07(spark, sf):
    return G.lineage(table(spark, sf, "events"), F.col("value") > 10)


_PLAN = "plan AS (SELECT chunk_id, region_type AS block_type, text[1:72] AS label FROM chunks WHERE pos % 2 = 1)"


def _plan(rows):
    return rows.where("pos % 2 = 1").select("chunk_id", F.col("region_type").alias("block_type"), F.substring("text", 1, 72).alias("label"))


@query("j04_issue_rows", _over("""WITH i AS (SELECT chunk_id, 'lint_warning' AS reason FROM chunks WHERE pos % 3 = 0 UNION ALL SELECT '__document__', 'validation_error')
SELECT i.chunk_id, reason, c.page, coalesce(p.block_type, CASE WHEN i.chunk_id = '__document__' THEN 'document' END) AS block_type, coalesce(p.label, CASE WHEN i.chunk_id = '__document__' THEN 'Document' END, '') AS label, coalesce(c.text, '') AS source_text, coalesce(s.latex, '') AS generated
FROM i LEFT JOIN chunks c USING (chunk_id) LEFT JOIN plan p USING (chunk_id) LEFT JOIN (SELECT * FROM snips WHERE pos % 6 = 0) s ON s.chunk_id = i.chunk_id""", _PLAN, SNIPPETS), True)
def j04(spark, sf):
    rows = S.snippets(_chunks(spark, sf))
    issues = rows.where("pos % 3 = 0").select("chunk_id", F.lit("lint_warning").alias("reason")).unionByName(spark.createDataFrame([("__document__", "validation_error")], "chunk_id string, reason string"))
    return G.enriched(issues, rows, _plan(rows), rows.where("pos % 6 = 0"))


@query("j03_f03_covered_blocks", _over("SELECT p.chunk_id, p.label, length(s.latex) AS chars FROM plan p JOIN chunks c USING (chunk_id) JOIN (SELECT * FROM snips WHERE pos % 3 = 0) s ON s.chunk_id = p.chunk_id WHERE p.block_type = 'text'", _PLAN, SNIPPETS), True)
def j03(spark, sf):
    rows = S.snippets(_chunks(spark, sf))
    out = G.covered(_plan(rows), rows.select("chunk_id", "text"), rows.where("pos % 3 = 0").select("chunk_id", "latex"))
    return out.where("block_type = 'text'").select("chunk_id", "label", F.char_length("latex").cast("bigint").alias("chars"))


_REQUESTS = "req AS (SELECT user_id * 100 + event_id % 29 AS doc, event_id AS pos, CASE event_type WHEN 'view' THEN 'hyperref' WHEN 'click' THEN 'cite' WHEN 'error' THEN 'natbib' ELSE event_type END AS package, CASE WHEN event_id % 3 = 0 THEN 'o' || event_id % 5 END AS option FROM events)"


def _requests(spark, sf):
    name = F.when(F.col("event_type") == "view", "hyperref").when(F.col("event_type") == "click", "cite").when(F.col("event_type") == "error", "natbib").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select((F.col("user_id") * 100 + F.col("event_id") % 29).alias("doc"), F.col("event_id").alias("pos"), name.alias("package"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("o"), F.col("event_id") % 5)).alias("option"))


_PLACED = "SELECT doc, package, option, row_number() OVER (PARTITION BY doc ORDER BY (package = 'hyperref')::INT, first) AS place FROM o"


@query("u03_u13_package_merge", _over(f"WITH f AS (SELECT *, row_number() OVER (PARTITION BY doc, package ORDER BY pos) AS k FROM req), o AS (SELECT doc, package, pos AS first, option FROM f WHERE k = 1), p AS ({_PLACED}) SELECT p.* FROM p WHERE NOT (package = 'cite' AND doc IN (SELECT doc FROM p WHERE package = 'natbib'))", _REQUESTS))
def u03(spark, sf):
    return G.without_rival(G.merged_packages(_requests(spark, sf), "doc"), "doc", "cite", "natbib")


@query("u04_package_requests", _over(f"WITH o AS (SELECT doc, package, min(pos) AS first, arg_max(option, pos) FILTER (option IS NOT NULL) AS option FROM req GROUP BY ALL) {_PLACED}", _REQUESTS))
def u04(spark, sf):
    return G.merged_packages(_requests(spark, sf), "doc", last_option=True)


@query("j26_comments", "WITH c AS (SELECT DISTINCT text AS title FROM chunks WHERE region_type = 'heading') SELECT doc_id, pos, 0 AS part, '% about ' || lower(title) AS line FROM chunks JOIN c ON text = title UNION ALL SELECT doc_id, pos, (title IS NOT NULL)::INT, text FROM chunks LEFT JOIN c ON text = title", True)
def j26(spark, sf):
    rows = _chunks(spark, sf)
    comments = rows.where("region_type = 'heading'").select(F.col("text").alias("title")).distinct().withColumn("comment", F.concat(F.lit("about "), F.lower("title")))
    return G.comments_before(rows.select("doc_id", "pos", F.col("text").alias("line")), comments)


@query("j27_stage_names", "SELECT event_id, coalesce(s, event_type) AS stage FROM events LEFT JOIN (VALUES ('view', 'ingestion'), ('click', 'layout'), ('error', 'validation')) t(k, s) ON k = event_type")
def j27(spark, sf):
    stages = spark.createDataFrame([("view", "ingestion"), ("click", "layout"), ("error", "validation")], "event_type string, s string")
    return table(spark, sf, "events").join(F.broadcast(stages), "event_type", "left").select("event_id", F.coalesce("s", "event_type").alias("stage"))


@query("j23_f29_unsupported_titles", """WITH s AS (SELECT chunk_id, text, coalesce(last_value(CASE WHEN region_type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'Preamble / Introduction') AS title FROM chunks)
SELECT chunk_id, title FROM s WHERE NOT contains(lower(text), lower(title))""", True)
def j23(spark, sf):
    rows = _chunks(spark, sf)
    return C.sections(rows).select("chunk_id", "title").join(rows.select("chunk_id", "text"), "chunk_id").where(~F.contains(F.lower("text"), F.lower("title"))).select("chunk_id", "title")


_CITED = r"cited AS (SELECT doc_id, chunk_id, text || ' [' || page || ', ' || pos || '] (De Vries, 20' || lpad((pos % 30)::VARCHAR, 2, '0') || ') \citep{a' || pos % 5 || ', b}' || CASE WHEN doc_id % 3 = 0 THEN ' [7-9]' ELSE '' END AS text FROM chunks)"
_CITES = r"""cites AS (SELECT doc_id, chunk_id, 'numeric' AS style, 'numeric-' || replace(replace(unnest(regexp_extract_all(text, '\[([0-9]+(?:\s*(?:-|,)\s*[0-9]+)*)\]', 1)), ' ', ''), ',', '_') AS id FROM cited
  UNION ALL SELECT doc_id, chunk_id, 'author-year', 'authyear-' || trim(regexp_replace(lower(split_part(x, ',', 1)), '[^0-9a-z]+', '-', 'g'), '-') || '-' || regexp_extract(x, '([0-9]{4})\)', 1) FROM (SELECT doc_id, chunk_id, unnest(regexp_extract_all(text, '(\([A-Z][A-Za-z\-\s'']+?,\s*(?:19[0-9]{2}|20[0-9]{2})\))', 1)) AS x FROM cited)
  UNION ALL SELECT doc_id, chunk_id, 'tex-command', 'tex-' || trim(unnest(string_split(x, ','))) FROM (SELECT doc_id, chunk_id, unnest(regexp_extract_all(text, '\\cite[a-z]*\{([^}]+)\}', 1)) AS x FROM cited))"""


def _citations(spark, sf):
    text = F.concat("text", F.lit(" ["), "page", F.lit(", "), "pos", F.lit("] (De Vries, 20"), F.lpad((F.col("pos") % 30).cast("string"), 2, "0"), F.lit(r") \citep{a"), F.col("pos") % 5, F.lit(", b}"), F.when(F.col("doc_id") % 3 == 0, " [7-9]").otherwise(""))
    return G.citations(_chunks(spark, sf).withColumn("text", text))


@query("r26_citations", _over("SELECT doc_id, id, count(*) AS mentions, min(chunk_id) AS first_chunk FROM cites GROUP BY ALL", _CITED, _CITES), True)
def r26(spark, sf):
    return _citations(spark, sf).groupBy("doc_id", "id").agg(F.count("*").alias("mentions"), F.min("chunk_id").alias("first_chunk"))


@query("a21_citation_style", _over("WITH n AS (SELECT doc_id, style, count(*) AS n FROM cites GROUP BY ALL) SELECT doc_id, arg_min(style, (-n, list_position(['numeric', 'author-year', 'tex-command'], style))) AS style, sum(n)::BIGINT AS mentions FROM n GROUP BY doc_id", _CITED, _CITES), True)
def a21(spark, sf):
    return G.dominant_style(_citations(spark, sf))


@query("a15_reward_pages", """WITH a AS (SELECT DISTINCT doc_id, 1 AS page, 0 AS kind, 1 AS n, 0 AS first FROM chunks UNION ALL SELECT doc_id, page, 1, count(*), min(pos) FROM chunks WHERE region_type = 'formula' GROUP BY ALL UNION ALL SELECT doc_id, page, 2, count(*), min(pos) FROM chunks WHERE region_type IN ('table', 'figure') GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY kind, n DESC, first) AS k FROM a), p AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY kind, n DESC, first) AS place FROM b WHERE k = 1) SELECT doc_id, place, page FROM p WHERE place <= 4""", True)
def a15(spark, sf):
    return G.reward_pages(_chunks(spark, sf))


@query("a26_tracks", "SELECT r_name AS track, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS datasets FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 = 0) n ON n_regionkey = r_regionkey GROUP BY r_name")
def a26(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 4 = 0")
    out = table(spark, sf, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.groupBy(F.col("r_name").alias("track")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("datasets"))


_QUEUE = "q AS (SELECT user_id AS run_id, event_type AS chunk_id, event_id, ts, CASE event_id % 4 WHEN 0 THEN ['hallucination', 'other'] WHEN 1 THEN ['lint_warning'] WHEN 2 THEN ['low_quality', 'low_reward', 'hallucination'] ELSE [] END AS reasons FROM events)"


def _queue(spark, sf):
    n = F.col("event_id") % 4
    reasons = F.when(n == 0, F.array(F.lit("hallucination"), F.lit("other"))).when(n == 1, F.array(F.lit("lint_warning"))).when(n == 2, F.array(F.lit("low_quality"), F.lit("low_reward"), F.lit("hallucination"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("chunk_id"), "event_id", "ts", reasons.alias("reasons"))


@query("f09_t06_u12_global_queue", _over("WITH f AS (SELECT *, row_number() OVER (PARTITION BY run_id, chunk_id ORDER BY ts DESC, event_id DESC) AS k FROM q WHERE chunk_id <> 'error' AND len(reasons) >= 2 AND list_has_any(reasons, ['low_quality', 'hallucination'])) SELECT run_id, chunk_id, event_id FROM f WHERE k = 1 ORDER BY ts DESC, run_id DESC, chunk_id DESC LIMIT 50", _QUEUE))
def f09(spark, sf):
    q = _queue(spark, sf).where("chunk_id <> 'error'").where((F.size("reasons") >= 2) & F.arrays_overlap("reasons", F.array(F.lit("low_quality"), F.lit("hallucination"))))
    return scoring.keep_first(q, [F.col("run_id"), F.col("chunk_id")], [F.desc("ts"), F.desc("event_id")]).orderBy(F.desc("ts"), F.desc("run_id"), F.desc("chunk_id")).limit(50).select("run_id", "chunk_id", "event_id")


@query("a04_a33_reason_counts", _over("WITH r AS (SELECT unnest(reasons) AS reason, run_id FROM q) SELECT reason, count(*) AS n, count(DISTINCT run_id) AS runs FROM r GROUP BY reason", _QUEUE))
def a04(spark, sf):
    return _queue(spark, sf).select(F.explode("reasons").alias("reason"), "run_id").groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("run_id").alias("runs"))


@query("r05_f22_block_types", r"""WITH b AS (SELECT doc_id, chunk_id, pos, region_type, CASE WHEN region_type IN ('figure', 'table', 'list') THEN region_type WHEN region_type = 'formula' THEN 'equation' WHEN header_level > 0 OR regexp_matches(text, '(?i)^(chapter|section|appendix|part|lesson)([^A-Za-z0-9_\x{80}-\x{10FFFF}]|$)') OR (upper(text) = text AND lower(text) <> text AND nw <= 8) THEN 'section' WHEN regexp_matches(text, '=|\\sum|\\int|\\frac') THEN 'equation' ELSE 'text' END AS block_type FROM chunks)
SELECT chunk_id, block_type, CASE WHEN pos = min(pos) OVER (PARTITION BY doc_id) AND count(*) FILTER (block_type = 'section') OVER (PARTITION BY doc_id) = 0 AND region_type NOT IN ('table', 'list', 'formula') THEN 'section' ELSE block_type END AS fixed FROM b""", True)
def r05(spark, sf):
    rows = _chunks(spark, sf).withColumn("block_type", T.block_type(F.col("text"), F.col("region_type"), F.col("header_level")))
    w = Window.partitionBy("doc_id")
    first = (F.col("pos") == F.min("pos").over(w)) & (F.count_if(F.col("block_type") == "section").over(w) == 0)
    return rows.select("chunk_id", "block_type", F.when(first & ~F.col("region_type").isin("table", "list", "formula"), "section").otherwise(F.col("block_type")).alias("fixed"))


_ALPHA = r"len(regexp_extract_all({}, '\p{{L}}'))"


@query("f16_f17_f25_f28_text_tests", rf"""WITH t AS (SELECT doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS t, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n, len(list_filter(string_split(text, chr(10)), lambda x: {_ALPHA.format('x')} >= 4)) AS alpha, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, ':'))) AS colons FROM documents)
SELECT doc_id, regexp_matches(t, '(?i)((^|[^\p{{L}}\p{{N}}_])[S5]0[B8]|(^|[^\p{{L}}\p{{N}}_])SOB($|[^\p{{L}}\p{{N}}_])|[Il1]{{2,}}|0O|O0)') AS ambiguous, contains(lower(t), 'style exemplars')::INT + contains(lower(t), 'respond with:')::INT + contains(lower(t), '<<<source')::INT >= 2 AS echo,
  t <> '' AND (contains(t, '```') OR starts_with(t, '%') OR (n >= 3 AND alpha >= 2 AND colons > 0) OR ({_ALPHA.format('t')} > 20 AND length(t) - length(replace(t, chr(92), '')) <= 1 AND len(regexp_extract_all(t, '[=+\-/*_^]')) < {_ALPHA.format('t')} / 4)) AS plain, CASE WHEN length(t) < 20 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM t""")
def f16(spark, sf):
    t = F.btrim("text", F.lit(" \n\t\r"))
    return table(spark, sf, "documents").select("doc_id", T.ambiguous(t).alias("ambiguous"), T.prompt_echo(t).alias("echo"), T.plain_prose(t).alias("plain"), F.when(F.char_length(t) < 20, "FAIL").otherwise("PASS").alias("verdict"))


_TAGS = "tags AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS tag FROM pages)"


@query("r07_r06_tag_types", _over("SELECT CASE WHEN contains(tag, 'table') THEN 'table' WHEN contains(tag, 'figure') OR contains(tag, 'image') OR contains(tag, 'img') THEN 'figure' WHEN contains(tag, 'equation') OR contains(tag, 'formula') OR contains(tag, 'math') THEN 'equation' WHEN contains(tag, 'heading') OR regexp_matches(tag, '^h[0-9]') THEN 'heading' ELSE 'text' END AS type, count(*) AS n FROM tags GROUP BY 1", _TAGS))
def r07(spark, sf):
    tags = table(spark, sf, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy(T.refined_type(F.col("tag"), F.col("tag").rlike("^h[0-9]")).alias("type")).agg(F.count("*").alias("n"))


@query("r52_r25_urls", r"SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]+)/', 1) AS domain, CASE WHEN contains(url, 'github.com') THEN 'git' WHEN contains(url, 'huggingface.co') THEN 'huggingface-datasets' ELSE 'manual' END AS strategy FROM pages")
def r52(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(url, r"^https?://[^/]+/([^/?#]+)/", 1).alias("domain"), F.when(F.contains(url, F.lit("github.com")), "git").when(F.contains(url, F.lit("huggingface.co")), "huggingface-datasets").otherwise("manual").alias("strategy"))


@query("r02_r12_regions", r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents), k AS (SELECT *, len(list_filter(ls, lambda x: regexp_matches(trim(x), '^([0-9]+\.[\)\s]|[A-Za-z]\.|[-*•])\s+'))) AS hits, coalesce(trim(ls[1]), '') AS f FROM l),
h AS (SELECT *, len(list_filter(regexp_split_to_array(f, '\s+'), lambda x: x <> '')) AS nw FROM k)
SELECT doc_id, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '(\+[-+]+\+)|(\|.+\|)'))) > 0 THEN 'table' WHEN hits >= greatest(1, len(ls) // 2) THEN 'list' WHEN regexp_matches(text, '(\\begin\{equation\}|\\frac|\\sum|\\int|=|\[a-z]+)') THEN 'formula'
  WHEN regexp_matches(lower(f), '^(chapter|section|appendix|part|lesson)') OR (upper(f) = f AND lower(f) <> f AND nw <= 8) OR (nw <= 10 AND f LIKE '%:') THEN 'heading' ELSE 'text' END AS region,
  greatest(1, coalesce(list_max(list_transform(list_filter(ls, lambda x: regexp_matches(trim(x), '^([0-9]+\.[\)\s]|[A-Za-z]\.|[-*•])\s+')), lambda x: (length(x) - length(ltrim(x, ' '))) // 2 + 1)), 1))::INT AS depth, len(list_filter(ls, lambda x: contains(x, '|') AND trim(replace(x, '|', '')) <> ''))::INT AS rows FROM h""")
def r02(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.region(t).alias("region"), T.list_depth(t).alias("depth"), T.table_rows(t).alias("rows"))
