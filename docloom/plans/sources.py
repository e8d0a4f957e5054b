"""Queries over payloads as sources hold them, over loops and over plug-ins. Payloads are built from the tables by the same rules in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom import extend as E
from docloom.functions import latex as L
from docloom.operators import control as K
from docloom.plans import _chunks, query, table
from docloom.plans.latex import SNIPPETS, _over, _replaced, _snippets
from docloom.plans.markup import _HEAD, _injected_sql, _lit
from docloom.plans.profiles import _case, _pick
from docloom.sources import files as S
from docloom.sources import layouts as Y


@query("s05_document_blocks", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) - 1 AS k FROM chunks)
SELECT doc_id, page, k::INT AS "at", chunk_id AS block_id, page AS block_page, region_type AS block_type, CASE WHEN pos % 5 = 0 THEN '' ELSE text END AS text, CASE WHEN pos % 3 > 0 THEN pos::DOUBLE END AS x0, CASE WHEN pos % 3 > 0 THEN pos + 0.5::DOUBLE END AS y0, CASE WHEN pos % 3 > 0 THEN 0.0::DOUBLE END AS x1, CASE WHEN pos % 3 > 0 THEN 9.0::DOUBLE END AS y1, 'unknown' AS source_backend FROM b""", True)
def s05(spark, sf):
    p = F.col("pos")
    own, other = p % 3 == 1, p % 3 == 2
    box = F.when(p % 3 > 0, F.struct(F.when(own, p).alias("x0"), F.when(other, p).alias("left"), F.when(own, p + 0.5).alias("y0"), F.when(other, p + 0.5).alias("top"), F.when(own, 9).alias("y1"), F.when(other, 9).alias("bottom")))
    block = F.struct("pos", F.struct(F.col("chunk_id").alias("block_id"), F.when(p % 2 == 0, F.col("page")).alias("page_number"), F.when(p % 2 == 1, F.col("page")).alias("page"), F.col("region_type").alias("block_type"), F.when(p % 5 > 0, F.col("text")).alias("text"), box.alias("bbox")).alias("b"))
    pages = _chunks(spark, sf).groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(block), lambda a, b: a["pos"] - b["pos"]), lambda x: x["b"]).alias("blocks"))
    rows = pages.groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("page").alias("page_number"), "blocks")).alias("pages"))).alias("payload"))
    return Y.document_blocks(rows)


_TYPE = "CASE WHEN regexp_matches(l, 'table') THEN 'table' WHEN regexp_matches(l, 'figure|image|img') THEN 'figure' WHEN regexp_matches(l, 'equation|formula|math') THEN 'equation' WHEN contains(l, 'heading') THEN 'heading' ELSE 'text' END"


@query("s15_flat_layouts", f"""WITH b AS (SELECT *, region_type || CASE WHEN pos % 7 = 0 THEN '_image' ELSE '' END AS l FROM chunks WHERE pos % 4 > 0)
SELECT doc_id, pos, (page - 1)::INT AS page_idx, text, l AS raw_type, {_TYPE} AS type, CASE WHEN pos % 3 > 0 THEN 1.0::DOUBLE END AS x0, CASE WHEN pos % 3 > 0 THEN 0.0::DOUBLE END AS y0, CASE WHEN pos % 3 > 0 THEN 7.0::DOUBLE END AS x1, CASE WHEN pos % 3 > 0 THEN pos::DOUBLE END AS y1 FROM b""", True)
def s15(spark, sf):
    p = F.col("pos")
    place = F.struct(F.col("page").alias("page_no"), F.when(p % 3 > 0, F.struct(F.lit(1.0).alias("l"), p.cast("double").alias("t"), F.lit(7.0).alias("r"))).alias("bbox"))
    item = F.struct(F.concat(F.col("pos").cast("string"), F.lit("\x01"), "text").alias("text"), F.concat("region_type", F.when(p % 7 == 0, "_image").otherwise("")).alias("label"), F.filter(F.array(F.when(p % 4 > 0, place)), lambda x: x.isNotNull()).alias("prov"))
    rows = _chunks(spark, sf).select("doc_id", (p % 2).alias("k"), item.alias("i")).groupBy("doc_id").agg(F.collect_list(F.when(F.col("k") == 0, F.col("i"))).alias("texts"), F.collect_list(F.when(F.col("k") == 1, F.col("i"))).alias("tables"))
    out = Y.flat_layout_blocks(rows.select("doc_id", F.to_json(F.struct("texts", "tables")).alias("payload")))
    cut = F.split("text", "\x01")
    return out.select("doc_id", cut[0].cast("int").alias("pos"), "page_idx", F.substring("text", F.char_length(cut[0]) + 2, F.lit(1 << 30)).alias("text"), "raw_type", "type", "x0", "y0", "x1", "y1")


@query("s16_ja7_paged_layouts", f"""WITH b AS (SELECT *, CASE WHEN pos % 2 = 0 THEN region_type ELSE 'tables' END AS l FROM chunks)
SELECT doc_id, (page + 1)::INT AS page_idx, text, l AS raw_type, {_TYPE} AS type, CASE pos % 3 WHEN 0 THEN '1.0,2.0,3.0,4.0' WHEN 1 THEN '0.5,0.5,1.0,' || pos || '.0' END AS box FROM b""", True)
def s16(spark, sf):
    p = F.col("pos")
    as_list = F.when(p % 3 == 0, F.array(*(F.lit(float(x)) for x in (1, 2, 3, 4))))
    as_box = F.when(p % 3 == 1, F.struct(F.lit(0.5).alias("x0"), F.lit(0.5).alias("y0"), F.lit(1.0).alias("x1"), p.cast("double").alias("y1")))
    entry = F.struct(F.when(p % 5 > 0, F.col("text")).alias("text"), F.when(p % 5 == 0, F.col("text")).alias("markdown"), F.when(p % 2 == 0, F.upper("region_type")).alias("type"), as_list.alias("box"), as_box.alias("bbox"))
    pages = _chunks(spark, sf).groupBy("doc_id", "page").agg(F.collect_list(F.when(p % 2 == 0, entry)).alias("elements"), F.collect_list(F.when(p % 2 == 1, entry)).alias("tables"))
    page = F.struct((F.col("page") + 2).alias("number"), F.lit(600).alias("width"), "elements", "tables")
    bare = F.struct(F.lit(600).alias("width"), "elements", "tables")
    listed = pages.where("doc_id % 2 = 0").groupBy("doc_id").agg(F.to_json(F.struct(F.collect_list(page).alias("pages"))).alias("payload"))
    keyed = pages.where("doc_id % 2 = 1").groupBy("doc_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct((F.col("page") + 2).cast("string"), bare))).alias("pages"))).alias("payload"))
    out = Y.paged_layout_blocks(listed.unionByName(keyed))
    return out.select("doc_id", "page_idx", "text", "raw_type", "type", F.array_join(F.transform("bbox", lambda x: x.cast("string")), ",").alias("box"))


@query("s20_token_lines", r"""WITH w AS (SELECT chunk_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM chunks), u AS (SELECT chunk_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM w)
SELECT chunk_id AS doc_id, string_agg(t, ' ' ORDER BY i) AS tokens, string_agg((i % 50 * 10) || ',0,' || least(1000, i * 30) || ',1000', ';' ORDER BY i) AS boxes, string_agg('l' || i % 3, ' ' ORDER BY i) AS tags FROM u WHERE i % 7 <> 3 AND i % 11 <> 5 GROUP BY chunk_id""", True)
def s20(spark, sf):
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")

    def line(w, i):
        n = i + 1
        whole = F.concat_ws(" ", w, (n % 50 * 10).cast("string"), F.lit("-3"), (n * 30).cast("string"), F.lit("1e4"), F.concat(F.lit("l"), n % 3))
        return F.when(n % 7 == 3, F.concat(w, F.lit(" 1 2"))).when(n % 11 == 5, F.concat(w, F.lit(" a b c d label"))).otherwise(whole)

    rows = _chunks(spark, sf).select(F.col("chunk_id").alias("doc_id"), F.array_join(F.transform(words, line), "\n").alias("value"))
    box = lambda b: F.array_join(F.transform(b, lambda v: v.cast("string")), ",")
    return Y.token_lines(rows).select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.array_join(F.transform("bboxes", box), ";").alias("boxes"), F.array_join("ner_tags", " ").alias("tags"))


@query("s22_catalog", "SELECT p_partkey::BIGINT AS \"key\", p_name AS name, p_size::INT AS size FROM part WHERE p_partkey % 9 > 1")
def s22(spark, sf):
    n = F.col("p_partkey")
    line = F.when(n % 9 == 0, "   ").when(n % 9 == 1, F.concat(F.lit("Total output: "), n)).otherwise(F.to_json(F.struct(n.alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))))
    return Y.catalog_entries(table(spark, sf, "part").select(line.alias("value")), "key BIGINT, name STRING, size INT")


@query("s08_narratives", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, '- **' || event_type || '** `' || CASE WHEN value > 20 THEN 'ok' ELSE 'unknown' END || '` ' || CASE WHEN event_id % 2 = 0 THEN props ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' → `a' || event_id || '.tex`, `b.pdf`' ELSE '' END AS line FROM events)
SELECT user_id, '# Data Pathway — Run ' || user_id || chr(10) || chr(10) || '## Stage Timeline' || chr(10) || chr(10) || string_agg(rtrim(line), chr(10) ORDER BY seq) || chr(10) AS markdown FROM e GROUP BY user_id""")
def s08(spark, sf):
    n = F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    outputs = F.when(n % 3 == 0, F.array(F.concat(F.lit("a"), n, F.lit(".tex")), F.lit("b.pdf")))
    e = table(spark, sf, "events").select("user_id", seq.alias("seq"), F.col("event_type").alias("stage"), F.when(F.col("value") > 20, "ok").alias("status"), F.when(n % 2 == 0, F.col("props")).alias("notes"), outputs.alias("output_files"))
    return S.narrative(e, "user_id")


@query("s32_lineage_reports", r"""WITH v AS (SELECT user_id, 'v' || event_id AS version, 'v' || lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent, round(value, 3) AS score FROM events WHERE event_type <> 'view'),
r AS (SELECT user_id, 'Best score: ' || printf('%.3f', max(score)) || chr(10) || string_agg(version || ' & ' || coalesce(parent, '-') || ' & ' || printf('%.3f', score) || ' \\', chr(10) ORDER BY score DESC, version) AS head, count(*) AS n FROM v GROUP BY user_id),
g AS (SELECT user_id, string_agg(parent || ' \rightarrow ' || version || ' (child)', '\\' || chr(10) ORDER BY parent, version) AS links FROM v WHERE parent IS NOT NULL AND user_id % 2 = 0 GROUP BY user_id)
SELECT user_id, head || chr(10) || coalesce(links, 'No edges recorded.') AS report FROM r LEFT JOIN g USING (user_id)""")
def s32(spark, sf):
    name = lambda c: F.concat(F.lit("v"), c)
    parent = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    v = table(spark, sf, "events").where("event_type <> 'view'").select("user_id", name(F.col("event_id")).alias("version"), name(parent).alias("parent"), F.round("value", 3).alias("score"))
    edges = v.where("parent is not null and user_id % 2 = 0").select("user_id", F.col("parent").alias("src"), F.col("version").alias("dst"), F.lit("child").alias("relation"))
    return S.lineage_report(v, edges, "user_id")


@query("s25_e02_event_text", "SELECT conv_id, turn, role AS type, to_json({'text': text}) AS data FROM conversations WHERE text IS NOT NULL")
def s25(spark, sf):
    t = table(spark, sf, "conversations").where("text is not null").withColumn("payload", F.concat(F.lit('{"text":'), F.to_json(F.array("text")), F.lit("}")))
    t = t.withColumn("payload", F.regexp_replace("payload", r'^\{"text":\[(?s:(.*))\]\}$', r'{"text":$1}'))
    text = S.event_text(t.select("*", F.concat_ws(",", "conv_id", "turn").alias("at")), F.col("role"), F.col("payload"), "at")
    text = text.withColumn("value", F.concat(F.lit(": ping\n\n"), "value"))
    e = text.select("at", F.explode(S.parse_event_text(F.col("value"))).alias("e"))
    return e.select(F.split("at", ",")[0].cast("bigint").alias("conv_id"), F.split("at", ",")[1].cast("bigint").alias("turn"), "e.type", "e.data")


@query("s28_preference_pairs", _over(f"SELECT text AS prompt, latex AS chosen, {_replaced('latex', L.MUTATIONS)} AS rejected FROM snips WHERE latex <> {_replaced('latex', L.MUTATIONS)}", SNIPPETS), True)
def s28(spark, sf):
    s = _snippets(spark, sf)
    return S.preference_pairs(s.select(F.col("text").alias("prompt"), F.col("latex").alias("chosen"), L.replace_all(F.col("latex"), L.MUTATIONS).alias("rejected")))


# Loops


@query("c01_x08_refined", "SELECT chunk_id, substr(repeat('!', (pos % 5)::INT) || text, 1 + least(3, pos % 5 + length(text) - length(ltrim(text, '!')))) AS latex, least(3, pos % 5 + length(text) - length(ltrim(text, '!')))::INT AS passes, pos % 5 + length(text) - length(ltrim(text, '!')) <= 3 AS done FROM chunks", True)
def c01(spark, sf):
    marked = lambda d: d.select("chunk_id", F.concat(F.repeat(F.lit("!"), F.col("pos") % 5), "text").alias("latex"))
    mend = lambda d: K.refine(d, "latex", lambda x: ~x.startswith("!"), lambda x: F.substring(x, 2, 1 << 30), 3)
    return K.run_nodes(_chunks(spark, sf), [("mark", marked), ("refine", mend)])


_DEFINED = r"'\providecommand{\foo}{\texttt{\foo}}'"


@query("c02_applied_actions", rf"""WITH t AS (SELECT event_id, {_lit(_HEAD)} AS t FROM events), p AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN {_injected_sql('t', r"'\usepackage{tikz}'", 'false')} ELSE t END AS p FROM t), c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN {_injected_sql('p', _DEFINED, 'false')} ELSE p END AS c FROM p)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN replace(replace(c, '$$a$$', '\[a\]'), '$$b', '\[b\]') ELSE c END AS latex FROM c""")
def c02(spark, sf):
    n = F.col("event_id")
    action = lambda holds, code, detail: F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(detail).alias("detail")))
    actions = F.array_compact(F.array(action(n % 2 == 0, "missing-package", "tikz"), action(n % 3 == 0, "undefined-command", "foo"), action(n % 5 == 0, "math-mode", "")))
    return K.apply_actions(table(spark, sf, "events").select("event_id", F.lit(_HEAD).alias("latex"), actions.alias("actions")), "latex", "actions").select("event_id", "latex")


def _improved_sql() -> str:
    sql = "i0 AS (SELECT vec_id, list_transform(embedding, lambda x: least(1.0, abs(x::DOUBLE) * 4)) AS s, 0 AS p FROM embeddings)"
    for k in (1, 2, 3):
        goes = "round(list_sum(s) / len(s), 9) < 0.62 AND len(list_filter(s, lambda x: x < 0.6)) > 0"
        sql += f", i{k} AS (SELECT vec_id, CASE WHEN {goes} THEN list_transform(s, lambda x: CASE WHEN x < 0.6 THEN least(1.0, round(x + 0.1, 9)) ELSE x END) ELSE s END AS s, p + ({goes})::INT AS p FROM i{k - 1})"
    return f"WITH {sql} SELECT vec_id, p::INT AS passes, len(list_filter(s, lambda x: x < 0.6))::INT AS weak FROM i3"


@query("c03_improved_sections", _improved_sql())
def c03(spark, sf):
    scores = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.abs(x.cast("double")) * 4))
    rows = K.improve_weak(table(spark, sf, "embeddings").select("vec_id", scores.alias("s")), "s", 0.62, 0.1, 3, 0.6)
    return rows.select("vec_id", "passes", F.size(F.filter("s", lambda x: x < 0.6)).alias("weak"))


@query("c05_engines", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 7 = 0 THEN 'pdflatex' WHEN event_id % 3 = 0 THEN 'latexmk' WHEN event_id % 2 = 0 THEN 'tectonic' END ELSE CASE WHEN event_id % 2 = 0 THEN 'tectonic' WHEN event_id % 3 = 0 THEN 'latexmk' WHEN event_id % 7 = 0 THEN 'pdflatex' END END AS engine FROM events")
def c05(spark, sf):
    n = F.col("event_id")
    return table(spark, sf, "events").select("event_id", K.first_engine({"tectonic": n % 2 == 0, "latexmk": n % 3 == 0, "pdflatex": n % 7 == 0}, n % 4 == 0).alias("engine"))


# Plug-ins


@query("x02_x13_specialists", r"SELECT chunk_id, CASE region_type WHEN 'heading' THEN '\section{' || text || '}' WHEN 'list' THEN '\item ' || text WHEN 'formula' THEN '\[' || text || '\]' ELSE text END AS content, CASE region_type WHEN 'heading' THEN 0.9 WHEN 'list' THEN 0.8 WHEN 'formula' THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM chunks", True)
def x13(spark, sf):
    wrap = lambda a, b, c: E.agent_result(F.concat(F.lit(a), "text", F.lit(b)), F.lit(c))
    agents = {"heading": wrap("\\section{", "}", 0.9), "list": wrap("\\item ", "", 0.8), "formula": wrap("\\[", "\\]", 1.7)}
    r = E.dispatch(F.col("region_type"), agents, E.agent_result(F.col("text"), F.lit(0.5)))
    return _chunks(spark, sf).select("chunk_id", r.alias("r")).select("chunk_id", "r.content", "r.confidence")


@query("x14_agent_rows", "SELECT chunk_id, 'structural' AS agent, round(least(1, (length(text) - length(replace(lower(text), 'column', ''))) / 6), 6)::DOUBLE AS score, NULL::VARCHAR AS error FROM chunks UNION ALL SELECT chunk_id, 'semantic', CASE WHEN pos % 4 = 0 THEN 0 ELSE pos % 10 / 10 END::DOUBLE, CASE WHEN pos % 4 = 0 THEN 'failed' END FROM chunks", True)
def x14(spark, sf):
    columns = F.least(F.lit(1.0), L.count_of(F.lower("text"), "column").cast("double"))
    return E.agent_rows(_chunks(spark, sf), ["chunk_id"], {"structural": F.round(columns, 6), "semantic": F.when(F.col("pos") % 4 > 0, F.col("pos") % 10 / 10)})


_STRETCH = ("1.1", "", "1.3")


@query("x11_typography_rules", f"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'book' WHEN 1 THEN 'article' WHEN 2 THEN 'beamer' ELSE 'letter' END AS c, {_case(_STRETCH)} AS s FROM documents), p AS (SELECT *, CASE c WHEN 'article' THEN 'technical-report' WHEN 'beamer' THEN 'presentation-sans' ELSE 'scholarly-serif' END AS p FROM d)
SELECT doc_id, CASE p WHEN 'scholarly-serif' THEN '\\usepackage{{newtxtext}}' WHEN 'presentation-sans' THEN '\\usepackage{{libertine}}' ELSE '\\usepackage{{mathpazo}}' END || CASE WHEN p <> 'presentation-sans' THEN '|\\usepackage{{microtype}}' ELSE '' END || CASE WHEN s <> '' THEN '|\\linespread{{' || s || '}}' ELSE '' END || CASE WHEN p = 'scholarly-serif' OR c = 'article' THEN '|\\emergencystretch=1em' ELSE '' END || '|\\usepackage{{csquotes}}' AS directives FROM p""")
def x11(spark, sf):
    kind = _pick(("book", "article", "beamer", "letter"))
    stretch = _pick(_STRETCH)
    options = F.map_filter(F.create_map(F.lit("line_stretch"), stretch), lambda _, v: v != "")
    return table(spark, sf, "documents").select("doc_id", F.array_join(E.typography(kind, F.lit(None).cast("string"), options), "|").alias("directives"))


@query("x05_encoded_texts", "SELECT conv_id, turn, list_sum(list_transform(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda w: ('0x' || md5(w)[1:8])::BIGINT % 256))::BIGINT AS buckets FROM conversations")
def x05(spark, sf):
    buckets = E.ENCODERS["hash"](F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.size(buckets) > 0, F.aggregate(buckets, F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("buckets"))


@query("m14_adaptive_fusion", "WITH c AS (SELECT user_id, count(*) AS n, avg((event_type = 'error')::INT) AS errors, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id) SELECT user_id, CASE WHEN errors > 0.2 THEN 'callback' WHEN kinds < 5 THEN 'rule' ELSE 'weighted' END AS strategy FROM c")
def m14(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("errors"), F.countDistinct("event_type").alias("kinds"))
    return c.select("user_id", E.adaptive_choice(c, {"callback": F.col("errors") > 0.2, "rule": F.col("kinds") < 5}, "weighted").alias("strategy"))


@query("s19_j20_labelled_tokens", r"""WITH a AS (SELECT doc_id, pos AS apos, region_type || pos % 2 AS label FROM chunks WHERE pos % 3 = 0), c AS (SELECT k.doc_id, k.pos, k.text, arg_min(a.label, a.apos) AS label FROM chunks k LEFT JOIN a ON a.doc_id = k.doc_id AND k.pos * 10 + 5 BETWEEN apos * 10 AND apos * 10 + 25 GROUP BY ALL),
w AS (SELECT doc_id, pos, coalesce(label, 'O') AS tag, unnest(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) AS t, generate_subscripts(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''), 1) AS i FROM c)
SELECT doc_id AS image_id, string_agg(t, ' ' ORDER BY pos, i) AS tokens, string_agg(tag, ' ' ORDER BY pos, i) AS tags, string_agg(least(1000, floor(pos * 10 / 1025 * 1000))::INT, ',' ORDER BY pos, i) AS tops FROM w GROUP BY doc_id""", True)
def s19(spark, sf):
    c, top = _chunks(spark, sf), F.col("pos") * 10
    box = lambda w, h: (F.lit(0).alias("x"), top.alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    key = (F.col("doc_id").alias("image_id"), F.col("pos").alias("at"))
    annotations = c.where("pos % 3 = 0").select(*key, F.concat("region_type", F.col("pos") % 2).alias("label"), *box(500, 25))
    out = Y.labelled_tokens(c.select(*key, "text", *box(400, 10)), annotations)
    return out.select("image_id", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", " ").alias("tags"), F.array_join(F.transform("bboxes", lambda b: b[1].cast("string")), ",").alias("tops"))


@query("e04_keep_alive", "WITH g AS (SELECT user_id, event_id, ceil((epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 3600000000)::INT AS n FROM events) SELECT user_id, event_id, unnest(range(1, n))::INT AS ping FROM g WHERE n > 1")
def e04(spark, sf):
    from docloom.streaming import keep_alive

    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return keep_alive(e, "user_id", 3600)


_VIEWS = "v AS (SELECT chunk_id, 'full' AS kind, length(text) AS score FROM chunks WHERE pos % 3 > 0 UNION ALL SELECT chunk_id, 'detail', pos FROM chunks WHERE pos % 3 = 2)"


def _views(spark, sf):
    c = _chunks(spark, sf)
    full = c.where("pos % 3 > 0").select("chunk_id", F.lit("full").alias("kind"), F.char_length("text").alias("score"))
    return c, full.unionByName(c.where("pos % 3 = 2").select("chunk_id", F.lit("detail").alias("kind"), F.col("pos").alias("score")))


@query("j22_attached_views", _over("SELECT c.chunk_id, coalesce(string_agg(kind || ':' || score, ',' ORDER BY kind), '') AS views, count(kind)::INT AS n FROM chunks c LEFT JOIN v USING (chunk_id) GROUP BY c.chunk_id", _VIEWS), True)
def j22(spark, sf):
    c, views = _views(spark, sf)
    held = views.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("kind", "score"))).alias("v"))
    shown = F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["kind"], x["score"].cast("string"))), ",")
    return c.join(held, "chunk_id", "left").select("chunk_id", F.coalesce(shown, F.lit("")).alias("views"), F.coalesce(F.when(F.col("v").isNotNull(), F.size("v")), F.lit(0)).alias("n"))


@query("a27_view_summary", _over("SELECT count(*) AS views, count(DISTINCT chunk_id) AS chunks, count(DISTINCT kind) AS kinds, round(count(*) / count(DISTINCT chunk_id), 6) AS views_a_chunk FROM v", _VIEWS), True)
def a27(spark, sf):
    _, views = _views(spark, sf)
    return views.agg(F.count("*").alias("views"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("kind").alias("kinds"), F.round(F.count("*") / F.countDistinct("chunk_id"), 6).alias("views_a_chunk"))


@query("f28_evaluations", _over("SELECT chunk_id, CASE WHEN length(latex) < 20 OR pos % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, CASE WHEN length(latex) < 20 THEN 'snippet too short' WHEN pos % 5 = 0 THEN 'requires manual inspection' ELSE 'meets heuristic constraints' END AS notes FROM snips", SNIPPETS), True)
def f28(spark, sf):
    s, repaired = _snippets(spark, sf), F.col("pos") % 5 == 0
    short = F.char_length("latex") < 20
    return s.select("chunk_id", F.when(short | repaired, "FAIL").otherwise("PASS").alias("verdict"), F.when(short, "snippet too short").when(repaired, "requires manual inspection").otherwise("meets heuristic constraints").alias("notes"))


@query("t16_report_caps", "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j FROM events) SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 32) AS entries, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (event_type = 'error' AND j <= 5), '') AS issues FROM r GROUP BY user_id")
def t16(spark, sf):
    w = Window.partitionBy("user_id")
    e = table(spark, sf, "events").withColumn("k", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("j", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    first = lambda holds: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(holds, F.struct("k", "event_id")))), lambda x: x["event_id"].cast("string")), ",")
    return e.where("k <= 32 or (event_type = 'error' and j <= 5)").groupBy("user_id").agg(first(F.col("k") <= 32).alias("entries"), first((F.col("event_type") == "error") & (F.col("j") <= 5)).alias("issues"))


@query("t20_first_full_heading", "WITH h AS (SELECT doc_id, chunk_id, pos, pos % 4 < 2 AS head, lead(pos % 4 < 2) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM chunks) SELECT doc_id, arg_min(chunk_id, pos) AS chunk_id FROM h WHERE head AND NOT next GROUP BY doc_id", True)
def t20(spark, sf):
    head = F.col("pos") % 4 < 2
    h = _chunks(spark, sf).select("doc_id", "chunk_id", "pos", head.alias("head"), F.lead(head).over(Window.partitionBy("doc_id").orderBy("pos")).alias("next"))
    return h.where("head and not next").groupBy("doc_id").agg(F.min_by("chunk_id", "pos").alias("chunk_id"))
