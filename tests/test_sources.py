"""Folders read and written, loops over rows, plug-ins: on small inline rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from docloom import extend, sources
from docloom.operators import control, markup
from docloom.sources import files, layouts


def test_json_array_and_snippets(spark, tmp_path):
    rows = [{"chunk_id": "chunk-1", "page": 1, "text": "Question text", "metadata": '{"region_type": "equation"}'}, {"chunk_id": "chunk-2", "page": 2, "text": None}]
    (tmp_path / "chunks.json").write_text(json.dumps(rows, indent=2))
    got = sources.read_json_array(spark, str(tmp_path / "chunks.json")).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.page, r.text) for r in got] == [("chunk-1", 1, "Question text"), ("chunk-2", 2, None)]
    files.write_json_array(spark.createDataFrame([(2, "b"), (1, "a")], "id int, latex string"), f"{tmp_path}/out", "id")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == [{"id": 1, "latex": "a"}, {"id": 2, "latex": "b"}]
    files.branch_manifests(spark.createDataFrame([("a", "x"), ("b", None)], "branch string, path string"), f"{tmp_path}/branches")
    assert {r.branch: r.path for r in spark.read.json(f"{tmp_path}/branches").collect()} == {"a": "x", "b": None}


def test_domains_of_paths_and_exemplars(spark, tmp_path):
    root = tmp_path / "math" / "corpus"  # the root's name and a domain's recur above it
    for path, text in (("math/b.tex", " two "), ("math/a.tex", "one" * 1000), ("math/c.tex", "  "), ("default/d.tex", "other"), ("top.tex", "none")):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    got = files.exemplars(spark, str(root), "math", max_files=3, max_chars=5).orderBy("path").collect()
    assert [(r.domain, r.text) for r in got] == [("math", "oneon"), ("math", "two")]
    assert [r.domain for r in files.exemplars(spark, str(root), "physics").collect()] == ["default"]
    assert files.exemplars(spark, str(root), "off").count() == 0
    tex = {os.path.basename(r.path): r.domain for r in sources.read_tex_corpus(spark, str(root)).collect()}
    assert tex == {"a.tex": "math", "b.tex": "math", "c.tex": "math", "d.tex": "default", "top.tex": None}


def test_mixed_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain")
    (tmp_path / "b.md").write_text("# md")
    (tmp_path / "c.jsonl").write_text('{"body": {"text": "line"}}\nbroken\n{"text": "two"}\n')
    (tmp_path / "d.json").write_text('[{"text": ["x", "y"]}, {"other": 1}]')
    (tmp_path / "big.txt").write_text("z" * 5000)
    spark.createDataFrame([("rows",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/t")
    got = sorted(r.text for r in files.mixed_corpus(spark, str(tmp_path), ("body.text", "text"), max_bytes=4000).collect())
    assert got == ["# md", "line", "plain", "rows", "two", "x\ny"]


def test_logs_ledgers_and_caches(spark, tmp_path):
    (tmp_path / "runs" / "r1").mkdir(parents=True)
    (tmp_path / "runs" / "r1" / "log.jsonl").write_text('{"stage": "ingestion", "status": "started", "seq": 1}\nnot json\n{"stage": "ingestion", "status": "completed", "seq": 2, "output_files": ["a.tex"]}\n')
    events = files.run_logs(spark, f"{tmp_path}/runs")
    assert [(r.run, r.status) for r in events.orderBy("seq").collect()] == [("r1", "started"), ("r1", "completed")]
    assert files.narrative(events).first().markdown.endswith("- **ingestion** `started`\n- **ingestion** `completed`  → `a.tex`\n")
    for k in range(4):
        files.append_rows(spark.createDataFrame([(k,)], "seq bigint"), f"{tmp_path}/log")
    assert [r.seq for r in files.last_rows(spark, f"{tmp_path}/log", 2).collect()] == [2, 3]
    assert files.open_ledger(spark, f"{tmp_path}/log").count() == 4 and files.open_ledger(spark, f"{tmp_path}/none") is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("garbage that is no table")
    assert files.open_ledger(spark, f"{tmp_path}/bad") is None and (tmp_path / "bad.corrupt").exists()
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    assert files.cached_table(spark, f"{tmp_path}/cache", build).count() == files.cached_table(spark, f"{tmp_path}/cache", build).count() == 3 and len(made) == 1


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("DOCLOOM_DPI", "300")
    spark.conf.set("docloom.mode", "fast")
    got = files.settings(spark, {"dpi": "200", "mode": "slow", "lang": "en"}, [{"lang": "de", "dpi": "250"}, {"lang": None}])
    assert got == {"dpi": "300", "mode": "fast", "lang": "de"}
    spark.conf.unset("docloom.mode")


def test_layouts(spark):
    one = lambda text: spark.createDataFrame([(1, text)], "doc_id long, payload string")
    assert layouts.document_blocks(one("not json")).count() == 0
    flat = layouts.flat_layout_blocks(one('{"texts": [{"text": "a", "label": "section_heading", "prov": []}, {"prov": [{"bbox": {"l": 1, "t": 9}}, {"page_no": 7}]}]}')).collect()
    assert [(r.page_idx, r.text, r.type, r.x0, r.y0, r.y1) for r in flat] == [(0, "", "text", 1.0, 0.0, 9.0)]
    paged = layouts.paged_layout_blocks(one('{"pages": {"3": {"equations": [{"content": "x"}, 5]}}}')).collect()
    assert [(r.page_idx, r.text, r.type, r.bbox) for r in paged] == [(2, "x", "equation", None)]
    assert files.looked_up(one("x"), None, "doc_id").count() == 1


def test_branches_resume(spark, tmp_path):
    def fails():
        raise ValueError

    folder = f"{tmp_path}/branches"
    branches = {"a": lambda: spark.range(2), "b": fails, "c": lambda: spark.range(1)}
    assert control.run_branches(spark, branches, folder, lambda n: n != "c") == {"a": "completed", "b": "failed", "c": "skipped"}
    assert control.run_branches(spark, branches | {"b": lambda: spark.range(5)}, folder) == {"a": "resumed", "b": "completed", "c": "completed"}


def test_evolution_and_tuning(spark, tmp_path):
    start = spark.createDataFrame([("k", "v0", None, 0.1)], "key string, version string, parent string, score double")
    propose = lambda v: v.select("key", F.concat("version", F.lit("x")).alias("version"), F.col("version").alias("parent"))
    evaluate = lambda c: c.withColumn("score", F.char_length("version") / 10.0)

    def write(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    got = control.evolve(start, propose, evaluate, 3, 2, lambda p, c: c >= p, write)
    assert {r.version for r in got.collect()} >= {"v0xxx"} and got.count() == 2
    assert control.tune(lambda p: p["x"], {"x": 1}, lambda p, _: {"x": p["x"] + 1}, 2) == ({"x": 2}, 2, [1, 2])
    assert control.tune(lambda p: p["x"], {"x": 1}, lambda p, _: None, 2)[2] == [1]


def test_plug_ins(spark):
    pages = spark.createDataFrame([(1, "a"), (2, "b")], "page int, image string")
    extend.OCR.clear()
    extend.OCR.register("blank")(lambda p: p.select("page", F.when(F.col("page") == 2, "found").otherwise(" ").alias("text")))
    extend.OCR.register("plain")(lambda p: p.select("page", F.col("image").alias("text")))
    assert {(r.page, r.backend, r.text) for r in extend.first_text(extend.recognise(pages)).collect()} == {(1, "plain", "a"), (2, "blank", "found")}
    assert {r.backend for r in extend.recognise(pages, ["plain", "missing"]).collect()} == {"plain"}
    with pytest.raises(KeyError):
        extend.recognise(pages, "missing")
    sized = extend.Extractor("page int, n long", lambda state, b: b[["page"]].assign(n=state + b.image.str.len()), lambda: 10)
    assert {r.n for r in sized(pages).collect()} == {11}
    c = spark.createDataFrame([(1, "x", "B", 0.2), (1, "y", "A", 0.9)], "chunk_id int, source string, latex string, weighted double")
    assert extend.merge_texts(c, "chunk_id", lambda x: F.array_join(F.transform(x, lambda v: v["latex"]), "+")).first().latex == "A+B"
    assert set(extend.FUSIONS) == {"rule", "weighted"} and extend.LOOKUPS["offline"]() is None and "hash" in extend.ENCODERS


def test_semantic_break(spark):
    """Three paragraphs of a page; the second has other words than the first, the third those of the second."""
    rows = [(1, 1, k, "text", t) for k, t in enumerate(("alpha beta gamma. more alpha here.", "zebra yak xylo.", "zebra yak xylo. zebra again."), 1)]
    got = markup.buffered_chunks(spark.createDataFrame(rows, "doc_id int, page int, pos int, region_type string, text string")).orderBy("chunk").collect()
    assert [(r.first_pos, r.n) for r in got] == [(1, 1), (2, 2)]
    assert markup.buffered_chunks(spark.createDataFrame(rows, "doc_id int, page int, pos int, region_type string, text string"), chunk_chars=10).count() == 3


def test_streams(spark, tmp_path):
    from docloom import streaming

    rows = [("a", 2, "c"), ("b", 0, "x"), ("a", 0, "a"), ("a", 1, "b"), ("a", 1, "b")]
    made = spark.createDataFrame(rows, "job string, seq int, token string").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    made.repartition(2).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in")
    q = streaming.reassembled(read()).writeStream.outputMode("update").format("memory").queryName("joined").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.job, r.text, r.n) for r in spark.table("joined").collect()} == {("a", "abc", 3), ("b", "x", 1)}
    seen = []
    q = streaming.forward(read(), lambda rows, _: seen.extend(r.seq for r in rows.collect()), f"{tmp_path}/check")
    assert q.awaitTermination(120) and sorted(seen) == [0, 0, 1, 1, 2]


def test_reading_order_by_brute_force(spark):
    """Random boxes against the recursion in its plainest form: the widest gap from an edge that ends a box to one that begins a box, with none between."""
    import random

    from docloom.operators import layout

    def cut(boxes, low):
        best, starts, ends = (layout.GAP, None), [b[low] for b in boxes], [b[low + 2] for b in boxes]
        for e in sorted(ends):
            for s in sorted(starts):
                if s - e > best[0] and not any(e <= x < s for x in starts) and not any(e < x <= s for x in ends):
                    best = (s - e, (e + s) / 2)
        return best[1]

    def order(boxes):
        if len(boxes) < 2:
            return boxes
        wide = max(b[2] for b in boxes) - min(b[0] for b in boxes) > max(b[3] for b in boxes) - min(b[1] for b in boxes)
        for low in (0, 1) if wide else (1,):
            at = cut(boxes, low)
            if at is not None:
                first = [b for b in boxes if (b[low] + b[low + 2]) / 2 < at]
                rest = [b for b in boxes if b not in first]
                if first and rest:
                    return order(first) + order(rest)
        return sorted(boxes, key=lambda b: (b[1], b[0]))

    rng = random.Random(4)
    for _ in range(200):
        boxes = []
        for k in range(rng.randint(1, 9)):
            x, y = rng.choice((0, 300, 640)), rng.choice((0, 120, 260, 500))
            boxes.append((x, y + rng.randint(0, 9), x + rng.randint(20, 220), y + rng.randint(20, 60), k))
        assert [b[4] for b in layout.xy_cut(boxes)] == [b[4] for b in order(boxes)]
