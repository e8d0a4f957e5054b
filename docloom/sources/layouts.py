"""Rows from layout JSON, token tables and catalogs; each reader takes a column of texts, so files and tables serve alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import refined_type

_BOX = "struct<x0:double,left:double,y0:double,top:double,x1:double,right:double,y1:double,bottom:double>"
_DOCUMENT = f"source_backend string, pages array<struct<page_number:int,source_backend:string,blocks:array<struct<block_id:string,page_number:int,page:int,block_type:string,text:string,bbox:{_BOX},source_backend:string,images:array<string>>>>>"
_ITEM = "array<struct<text:string,label:string,prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>>>"
#: The lists of a flat layout, and the keys under which a block's text and box may lie.
KINDS = ("texts", "tables", "pictures", "equations", "key_value_items", "form_items")
TEXT_KEYS = ("text", "content", "value", "markdown")
BOX_KEYS = ("bbox", "bounding_box", "box", "quad")
PAGE_KEYS = ("number", "page", "width", "height")


def document_blocks(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each block of nested documents (doc_id, ``payload``), with the names that boxes and pages go by made one."""
    d = rows.select("doc_id", F.from_json(payload, _DOCUMENT).alias("d"))
    d = d.select("doc_id", F.explode("d.pages").alias("p")).select("doc_id", "p.page_number", F.posexplode("p.blocks").alias("at", "b"))
    side = lambda a, b: F.when(F.col("b.bbox").isNotNull(), F.coalesce(F.col(f"b.bbox.{a}"), F.col(f"b.bbox.{b}"), F.lit(0.0))).alias(a)
    page = F.coalesce("b.page_number", "b.page", F.lit(0))
    return d.select("doc_id", F.col("page_number").alias("page"), "at", F.coalesce("b.block_id", F.lit("")).alias("block_id"), page.alias("block_page"), F.coalesce("b.block_type", F.lit("text")).alias("block_type"), F.coalesce("b.text", F.lit("")).alias("text"), side("x0", "left"), side("y0", "top"), side("x1", "right"), side("y1", "bottom"), F.coalesce("b.source_backend", F.lit("unknown")).alias("source_backend"))


def flat_layout_blocks(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Blocks of flat layouts: items of all lists that have a place, by their first one; boxes from a lower left origin."""
    d = rows.select("doc_id", F.from_json(payload, ", ".join(f"{k} {_ITEM}" for k in KINDS)).alias("d"))
    d = d.select("doc_id", F.posexplode(F.flatten(F.array_compact(F.array(*(F.col(f"d.{k}") for k in KINDS))))).alias("at", "i")).where(F.size("i.prov") > 0)
    first = F.get("i.prov", F.lit(0))
    label = F.coalesce("i.label", F.lit("text"))
    box = first["bbox"]
    corner = lambda k: F.when(box.isNotNull(), F.coalesce(box[k], F.lit(0.0)))
    out = d.select("doc_id", "at", (F.coalesce(first["page_no"], F.lit(1)) - 1).alias("page_idx"), F.coalesce("i.text", F.lit("")).alias("text"), label.alias("raw_type"), corner("l").alias("x0"), corner("b").alias("y0"), corner("r").alias("x1"), corner("t").alias("y1"))
    return out.withColumn("type", refined_type(F.col("raw_type"), F.lit(False)))


def paged_layout_blocks(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Blocks of layouts with pages, these as a list or by number; entries lie under ``elements`` or under a key that hints at their type."""
    d = rows.select("doc_id", F.try_parse_json(payload).alias("v"))
    pages = F.try_variant_get("v", "$.pages", "array<variant>")
    named = F.try_variant_get("v", "$.pages", "map<string,variant>")
    listed = F.transform(pages, lambda p, i: F.struct((i + 1).cast("int").alias("n"), p.alias("p")))
    keyed = F.transform(F.map_entries(named), lambda e: F.struct(e["key"].try_cast("int").alias("n"), e["value"].alias("p")))
    d = d.select("doc_id", F.explode(F.coalesce(listed, keyed)).alias("x"))
    number = F.coalesce(F.try_variant_get("x.p", "$.number", "int"), F.col("x.n"))
    keys = F.map_filter(F.try_variant_get("x.p", "$", "map<string,variant>"), lambda k, _: ~k.isin(*PAGE_KEYS))
    d = d.select("doc_id", (number - 1).alias("page_idx"), F.explode(F.map_entries(keys)).alias("k"))
    d = d.select("doc_id", "page_idx", F.col("k.key").alias("hint"), F.posexplode(F.try_variant_get("k.value", "$", "array<variant>")).alias("at", "e"))
    text = F.lit("")
    for k in reversed(TEXT_KEYS):
        own = F.try_variant_get("e", f"$.{k}", "string")
        text = F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(text)
    boxes = [F.try_variant_get("e", f"$.{k}", "array<double>") for k in BOX_KEYS]
    boxes += [F.array(*(F.try_variant_get("e", f"$.bbox.{c}", "double") for c in ("x0", "y0", "x1", "y1")))]
    whole = [F.when((F.size(b) >= 4) & F.forall(b, lambda v: v.isNotNull()), F.slice(b, 1, 4)) for b in boxes]
    hinted = F.when(F.col("hint") != "elements", F.col("hint"))
    raw = F.lower(F.coalesce(F.try_variant_get("e", "$.type", "string"), hinted, F.lit("text")))
    out = d.where(F.schema_of_variant("e").startswith("OBJECT")).select("doc_id", "page_idx", "hint", "at", text.alias("text"), F.coalesce(*whole).alias("bbox"), raw.alias("raw_type"))
    return out.withColumn("type", refined_type(F.col("raw_type"), F.lit(False)))


def token_lines(rows: DataFrame, text: str = "value", size: float = 1000.0) -> DataFrame:
    """(doc_id, tokens, bboxes, ner_tags) from tables of white-space separated token, box and label; short and broken lines are left out."""
    lines = rows.select("doc_id", F.posexplode(F.split(text, "\n")).alias("at", "line"))
    parts = lines.select("doc_id", "at", F.split(F.trim("line"), r"\s+").alias("p")).where(F.size("p") >= 6)
    scaled = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(c / size * 1000))).cast("int"))
    box = F.transform(F.slice("p", 2, 4), lambda c: scaled(c.try_cast("double")))
    parts = parts.withColumn("box", box).where(F.forall("box", lambda v: v.isNotNull()))
    got = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", F.get("p", F.lit(0)).alias("token"), "box", F.get("p", F.lit(5)).alias("label")))).alias("x"))
    return got.select("doc_id", F.transform("x", lambda v: v["token"]).alias("tokens"), F.transform("x", lambda v: v["box"]).alias("bboxes"), F.transform("x", lambda v: v["label"]).alias("ner_tags"))


def catalog_entries(lines: DataFrame, schema: str, text: str = "value") -> DataFrame:
    """Entries of JSON lines; blank lines and the trailer are left out."""
    t = F.trim(text)
    return lines.where((t != "") & ~t.startswith("Total output")).select(F.from_json(t, schema).alias("e")).select("e.*")


def dotted(payload: Column, path: str) -> Column:
    """A value by its dotted path in JSON; an array's elements are joined by line ends."""
    v = F.try_parse_json(payload)
    many = F.try_variant_get(v, f"$.{path}", "array<string>")
    return F.coalesce(F.array_join(many, "\n"), F.try_variant_get(v, f"$.{path}", "string"))


def labelled_tokens(cells: DataFrame, annotations: DataFrame, size: float = 1025.0, other: str = "O") -> DataFrame:
    """(image_id, tokens, bboxes, ner_tags): words of an image's cells (image_id, at, text, x, y, w, h), labelled by the first annotation (image_id, at, label, x, y, w, h) that holds the cell's centre."""
    c, a = cells.alias("c"), annotations.alias("a")
    mid_x, mid_y = F.col("c.x") + F.col("c.w") / 2, F.col("c.y") + F.col("c.h") / 2
    inside = mid_x.between(F.col("a.x"), F.col("a.x") + F.col("a.w")) & mid_y.between(F.col("a.y"), F.col("a.y") + F.col("a.h"))
    met = c.join(a, F.col("c.image_id") == F.col("a.image_id"), "left").groupBy("c.image_id", "c.at", "c.text", "c.x", "c.y", "c.w", "c.h").agg(F.min_by("a.label", F.when(inside, F.col("a.at"))).alias("label"))
    scaled = lambda v: F.greatest(F.lit(0), F.least(F.lit(1000), F.floor(v / size * 1000))).cast("int")
    box = F.array(scaled(F.col("x")), scaled(F.col("y")), scaled(F.col("x") + F.col("w")), scaled(F.col("y") + F.col("h")))
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    rows = met.select("image_id", "at", F.posexplode(words).alias("k", "token"), box.alias("box"), F.coalesce("label", F.lit(other)).alias("tag"))
    got = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("at", "k", "token", "box", "tag"))).alias("v"))
    return got.select("image_id", F.transform("v", lambda x: x["token"]).alias("tokens"), F.transform("v", lambda x: x["box"]).alias("bboxes"), F.transform("v", lambda x: x["tag"]).alias("ner_tags"))
