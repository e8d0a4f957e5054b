"""Boxes on pages: orders, columns, rows, unions, labels by place; ordered folds over a page's or a document's rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 50.0
SEMANTIC_BREAKS = ("question", "figure", "table", "heading")


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes with their place on the page, from the top and from the left."""
    w = Window.partitionBy("page").orderBy("y0", "x0", "id")
    bottom_up = Window.partitionBy("page").orderBy(F.desc(F.coalesce("y1", F.lit(0.0))), F.coalesce("x0", F.lit(0.0)), "id")
    return boxes.withColumn("place", F.row_number().over(w)).withColumn("from_bottom", F.row_number().over(bottom_up))


def _split(boxes: list[tuple], low: int, high: int) -> float | None:
    """The middle of the widest gap between an edge that ends a box and the next that begins one; None if it isn't wide."""
    edges = sorted([(b[high], "end") for b in boxes] + [(b[low], "start") for b in boxes])
    gaps = [(y - x, (x + y) / 2) for (x, a), (y, b) in zip(edges, edges[1:], strict=False) if (a, b) == ("end", "start")]
    best = max(gaps, key=lambda g: g[0], default=(0.0, None))
    return best[1] if best[0] > GAP else None


def xy_cut(boxes: list[tuple]) -> list[tuple]:
    """Boxes (x0, y0, x1, y1, ...) in reading order: a wide page is cut between columns, else between rows, else sorted."""
    done, todo = [], [list(boxes)]
    while todo:
        part = todo.pop()
        if len(part) > 1:
            width = max(b[2] for b in part) - min(b[0] for b in part)
            height = max(b[3] for b in part) - min(b[1] for b in part)
            for low in (0, 1) if width > height else (1,):
                at = _split(part, low, low + 2)
                if at is not None:
                    before = [(b[low] + b[low + 2]) / 2 < at for b in part]
                    sides = [[b for b, first in zip(part, before, strict=True) if first == side] for side in (False, True)]
                    if all(sides):
                        todo += sides
                        break
            else:
                done += sorted(part, key=lambda b: (b[1], b[0]))
        else:
            done += part
    return done


def xy_order(boxes: DataFrame) -> DataFrame:
    """(page, id, place) by recursive cuts; a page's boxes come to one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        found = xy_cut(list(rows[["x0", "y0", "x1", "y1", "id"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"page": rows["page"].iloc[0], "id": [b[4] for b in found], "place": range(1, len(found) + 1)})

    kinds = dict(boxes.dtypes)
    return boxes.groupBy("page").applyInPandas(run, f"page {kinds['page']}, id {kinds['id']}, place int")


def column_of(x0: Column, x1: Column, width: float) -> Column:
    """2 for a centre right of 0.65 of the page, else 1."""
    return F.when((x0 + x1) / 2 / width > 0.65, 2).otherwise(1)


def normalised(x: Column, size: float) -> Column:
    """A coordinate in thousandths of the page, inside 0 to 1000."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.bround(1000 * x / size, 0))).cast("int")


def clamped(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes cut to the page, without those that vanish, and with their bottom counted from below."""
    cut = lambda x, low, size: F.greatest(low, F.least(F.lit(size), F.col(x)))
    out = boxes.withColumn("x0", cut("x0", F.lit(0.0), width)).withColumn("y0", cut("y0", F.lit(0.0), height))
    out = out.withColumn("x1", cut("x1", F.col("x0"), width)).withColumn("y1", cut("y1", F.col("y0"), height))
    return out.where("x1 - x0 > 0.01 and y1 - y0 > 0.01").withColumn("bottom", F.lit(height) - F.col("y1"))


def union_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def label_by_place(boxes: DataFrame, annotations: DataFrame) -> DataFrame:
    """(id, label): of the annotations on the page that hold a box's centre the first, else ``O``."""
    a = annotations.select("page", *(F.col(c).alias("a_" + c) for c in ("id", "x0", "y0", "x1", "y1", "label")))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (boxes.page == a.page) & x.between(F.col("a_x0"), F.col("a_x1")) & y.between(F.col("a_y0"), F.col("a_y1"))
    return boxes.join(a, inside, "left").groupBy("id").agg(F.coalesce(F.min_by("a_label", "a_id"), F.lit("O")).alias("label"))


def rows_of_boxes(boxes: DataFrame, threshold: float) -> DataFrame:
    """(page, id, row, column): a box joins the last row if its top is near that row's first top. One page's boxes are folded in one array."""
    item = F.struct("y0", "x0", "id")
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("row"), F.array().cast("array<struct<row:int,x0:double,id:bigint>>").alias("out"))

    def step(s, b):
        new = s["anchor"].isNull() | (b["y0"] - s["anchor"] > threshold)
        row = s["row"] + new.cast("int")
        return F.struct(F.when(new, b["y0"]).otherwise(s["anchor"]).alias("anchor"), row.alias("row"), F.concat(s["out"], F.array(F.struct(row.alias("row"), b["x0"].alias("x0"), b["id"].alias("id")))).alias("out"))

    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(item)).alias("b"))
    rows = pages.select("page", F.explode(F.aggregate("b", start, step)["out"]).alias("r")).select("page", "r.*")
    return rows.select("page", "id", "row", (F.row_number().over(Window.partitionBy("page", "row").orderBy("x0", "id")) - 1).alias("column"))


def panels(placed: DataFrame) -> DataFrame:
    """(page, id, width, caption): a panel's share of the line by its row's panels, and a letter."""
    n = F.count("*").over(Window.partitionBy("page", "row"))
    letter = F.char(97 + (F.row_number().over(Window.partitionBy("page").orderBy("row", "column")) - 1) % 26)
    return placed.select("page", "id", F.round(F.least(0.95 / n, F.lit(0.48)), 3).alias("width"), F.concat(F.lit("Panel "), letter).alias("caption"))


def within_budget(entries: DataFrame, group: str, budget: int) -> DataFrame:
    """(group, id): entries taken in order while the budget lasts; one that doesn't fit is passed over, unless it is the first."""
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("taken"))

    def step(s, e):
        take = (s["total"] < budget) & ((s["total"] == 0) | (s["total"] + e["size"] <= budget))
        return F.struct(F.when(take, s["total"] + e["size"]).otherwise(s["total"]).alias("total"), F.when(take, F.concat(s["taken"], F.array(e["id"]))).otherwise(s["taken"]).alias("taken"))

    rows = entries.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "size"))).alias("e"))
    return rows.select(group, F.explode(F.aggregate("e", start, step)["taken"]).alias("id"))


def block_chunks(rows: DataFrame, most: int) -> DataFrame:
    """(doc_id, pos, chunk): blocks joined into chunks; a break class, a change of class or a full buffer begins a new one."""
    start = F.struct(F.lit(0).alias("length"), F.lit(0).alias("held"), F.lit("text").alias("tag"), F.lit(0).alias("chunk"), F.array().cast("array<struct<pos:int,chunk:int>>").alias("out"))

    def step(s, b):
        breaks, change, full = b["tag"].isin(*SEMANTIC_BREAKS), (b["tag"] != s["tag"]) & (s["held"] > 0), s["length"] + b["n"] > most
        flush = (breaks | change | full) & (s["held"] > 0)
        chunk = s["chunk"] + flush.cast("int")
        return F.struct(
            (F.when(flush, 0).otherwise(s["length"]) + b["n"]).alias("length"),
            (F.when(flush, 0).otherwise(s["held"]) + 1).alias("held"),
            F.when(breaks | change, b["tag"]).otherwise(s["tag"]).alias("tag"),
            chunk.alias("chunk"),
            F.concat(s["out"], F.array(F.struct(b["pos"].alias("pos"), chunk.alias("chunk")))).alias("out"),
        )

    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "n"))).alias("b"))
    return docs.select("doc_id", F.explode(F.aggregate("b", start, step)["out"]).alias("o")).select("doc_id", "o.pos", "o.chunk")


def roulette(versions: DataFrame, group: str, pick: float, temperature: float = 1.0, least: float = 0.01) -> DataFrame:
    """The version of each group where the running sum of weights reaches a share ``pick`` of all."""
    w = Window.partitionBy(group).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    weighted = versions.withColumn("w", F.pow(F.greatest("score", F.lit(least)), F.lit(1.0 / temperature)))
    weighted = weighted.withColumn("run", F.sum("w").over(w)).withColumn("all", F.sum("w").over(Window.partitionBy(group)))
    return weighted.where(F.col("run") >= pick * F.col("all")).groupBy(group).agg(F.min("id").alias("picked"))


def nearest_profile(vectors: DataFrame, profiles: DataFrame) -> DataFrame:
    """(id, domain, score): the profile with the highest cosine. ``profiles`` has one row a domain and is sent to every executor."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    a, b = F.col("vector"), F.col("profile")
    size = lambda v: F.when(dot(v, v) == 0, 1.0).otherwise(F.sqrt(dot(v, v)))
    pairs = vectors.join(F.broadcast(profiles)).select("id", "domain", F.round(dot(a, b) / (size(a) * size(b)), 6).alias("score"))
    best = pairs.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "domain")).alias("k"))
    return best.select("id", "k.domain", F.greatest(F.lit(0.0), -F.col("k.s")).alias("score"))


def hash_embedding(docs: DataFrame, size: int = 256) -> DataFrame:
    """(doc_id, bucket, value): words counted in buckets of their MD5, scaled to length 1; only buckets with words."""
    w = docs.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    bucket = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("bigint") % size
    counts = w.groupBy("doc_id", bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return counts.select("doc_id", "bucket", F.round(F.col("n") / length, 6).alias("value"))


def build_events(jobs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, seq, type, token): of each job a status, a token for each character, the end of its block, a status."""
    chars = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda c: c != "")
    event = lambda kind, token: F.struct(F.lit(kind).alias("type"), token.cast("string").alias("token"))
    rows = F.concat(F.array(event("status", F.lit("WORKING"))), F.transform(chars, lambda c: event("token", c)), F.array(event("block_done", F.lit(None)), event("status", F.lit("DONE"))))
    return jobs.select(*key, F.posexplode(rows).alias("seq", "e")).select(*key, "seq", "e.type", "e.token")
