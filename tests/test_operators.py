"""Operators on small inline rows."""

import datetime as dt

from pyspark.sql import functions as F

from docloom import sources, streaming
from docloom.functions import text as T
from docloom.operators import chunks as C
from docloom.operators import runs as R
from docloom.operators import scoring as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_header_levels(spark):
    for line, level in (("Chapter 1", 1), ("Section two", 2), ("ALL CAPS HERE", 1), ("Short line:", 2), ("plain words", 0), ("12 34", 0)):
        assert one(spark, T.header_level(F.col("t")), t=line) == level, line


def test_paragraph_regions(spark):
    for line, kind in (("Figure 1 shows", "figure"), ("| a | b |", "table"), ("- item", "list"), ("x = 1", "formula"), ("Appendix A", "heading"), ("just words", "text"), ("", "text")):
        assert one(spark, T.paragraph_region(F.col("t")), t=line) == kind, line


def test_small_functions(spark):
    assert one(spark, T.slug(F.col("t")), t="  Hello, World! ") == "hello-world"
    assert one(spark, T.summary(F.col("t"), 2), t="a b c") == "a b..."
    assert one(spark, T.sentence_count(F.col("t")), t="One. Two! Three?") == 3
    assert one(spark, T.table_columns(F.col("t")), t="a | b\n| 1 | 2 | 3 |") == 3
    assert one(spark, T.ratio(F.col("a"), F.col("b")), a=3, b=0) == 1.0


def test_bleu(spark):
    rows = spark.createDataFrame([("same", "a b c", "a b c"), ("none", "a b", "c d"), ("empty", "", "a"), ("half", "a b c d", "a b")], "k string, r string, c string")
    got = {r.k: r.bleu for r in S.bleu2(rows, "k", "r", "c").collect()}
    assert got == {"same": 1.0, "none": 0.0, "empty": 0.0, "half": 0.5}


def test_sections_and_repeats(spark):
    docs = spark.createDataFrame([(1, "s", "intro\nCHAPTER ONE\nbody\nx\ny\nintro\nz\nw\nq\nintro")], "doc_id long, source string, text string")
    rows = C.chunks(docs, 4)
    titles = {r.pos: r.title for r in C.sections(rows).collect()}
    assert titles[1] == "Preamble / Introduction" and titles[3] == "CHAPTER ONE"
    assert sorted(r.pos for r in C.drop_page_repeats(rows).where("text = 'intro'").collect()) == [1, 10]


def test_queue_order(spark):
    rows = spark.createDataFrame([("b", 1, ["low_reward"]), ("a", None, ["other", "missing_snippet"]), ("c", 0, [])], "chunk_id string, page int, reasons array<string>")
    assert [r.chunk_id for r in R.queue(rows, 2).collect()] == ["a", "b"]


def test_json_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 1, "text", ["i"], None)], sources.CHUNK)
    sources.write_json_lines(rows, f"{tmp_path}/x")
    assert sources.read_json_lines(spark, f"{tmp_path}/x", sources.CHUNK).collect() == rows.collect()


def test_tex_corpus(spark, tmp_path):
    (tmp_path / "math").mkdir()
    (tmp_path / "math/a.tex").write_text("\\begin{equation}E=mc^2\\end{equation}")
    (tmp_path / "top.tex").write_text("x")
    got = {r.value: r.domain for r in sources.read_tex_corpus(spark, str(tmp_path)).collect()}
    assert got["x"] is None and "math" in got.values()


def test_streaming_progress(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=30 * i), 1, "a", float(i), "{}") for i in range(12)]
    spark.createDataFrame(rows, streaming.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = streaming.append_to(streaming.progress(streaming.read_events(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert got and all(r.n == 2 for r in got)


def test_searches_beyond_their_broadcasts(spark, monkeypatch):
    import random

    from docloom.operators import scoring

    rng = random.Random(5)
    e = spark.createDataFrame([(i, [rng.random() for _ in range(4)], i % 3) for i in range(60)], "entry_id long, vector array<double>, domain long")
    q = e.where("entry_id % 4 = 0").withColumnRenamed("entry_id", "query_id")
    bags = spark.createDataFrame([(i, [rng.choice("abcdefg") for _ in range(6)]) for i in range(40)], "id long, tokens array<string>")
    run = lambda: (sorted(map(tuple, scoring.cosine_search(q, e).collect())), sorted(map(tuple, scoring.bag_cosine(bags, bags.where("id % 5 = 0")).collect())))
    want = run()
    monkeypatch.setattr(scoring, "BROADCAST_QUERIES", 4)
    monkeypatch.setattr(scoring, "BROADCAST_WORDS", 0)
    assert run() == want and len(want[0]) == 45 and len(want[1]) == 24


def test_bag_search_by_brute_force(spark):
    import random
    from collections import Counter

    from docloom.operators import scoring

    rng = random.Random(11)
    rows = [(i, [rng.choice("abcdefghij") for _ in range(rng.randrange(9))]) for i in range(700)]
    rows += [(5, ["k", "a"]), (700, None), (701, ["k", None, "a"]), (None, ["a"]), (710, ["only", "here"]), (100, ["b"])]
    bags = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {}
    for r in scoring.bag_cosine(bags, bags.where("id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.id))
    count: dict = {}
    for i, t in rows:
        count.setdefault(i, Counter()).update(t or [])
    norm = {i: sum(n * n for n in c.values()) ** 0.5 for i, c in count.items()}
    want = {}
    for i in (i for i in count if i is not None and i % 10 == 0):
        dots = {j: sum(n * c[w] for w, n in count[i].items() if w is not None) for j, c in count.items() if j not in (i, None)}
        best = sorted((-round(d / (norm[i] * norm[j]), 6), j) for j, d in dots.items() if d)[:3]
        want |= {i: [(k, s, j) for k, (s, j) in enumerate(best, 1)]} if best else {}
    assert {q: sorted(v) for q, v in got.items()} == want and 710 not in want and len(want) > 50


def test_bag_search_shuffles_no_products(spark):
    """Few rows leave the tasks: the k best of a query, however many entries share its words."""
    from docloom.operators import scoring

    bags = spark.range(2000).selectExpr("id", "array('a', 'b', cast(id % 7 as string)) as tokens")
    plan = scoring.bag_cosine(bags, bags.where("id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_vector_search_shuffles_no_pairs(spark):
    """Few rows leave the tasks: the k best of a query, however many entries there are."""
    e = spark.range(2000).selectExpr("id as entry_id", "array(id % 7, 1.0D) as vector", "id % 3 as domain")
    plan = S.cosine_search(e.where("entry_id % 50 = 0").withColumnRenamed("entry_id", "query_id"), e)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_vector_search_by_brute_force(spark, monkeypatch):
    """Lengths, nulls, ids and domains that repeat, lengths beyond single precision, and more queries and bytes than a broadcast holds."""
    import itertools
    import math
    import random

    rng = random.Random(3)
    rows = [(f"e{i}", [rng.choice((-0.5, 0.25, 1.0, rng.random())) for _ in range(i % 3 + 2)], rng.choice(("a", "b", None))) for i in range(400)]
    rows += [(f"e{i}", [10.0 ** rng.randint(-30, 30) * rng.choice((1, -1)) for _ in range(4)], "a") for i in range(400, 440)]
    rows += [("e8", [1.0, 0.5, 0.25, 1.0], "a"), ("e8", [1.0, 1.0], "b"), ("e1", None, "a"), ("e2", [1.0, None], "a"), (None, [1.0, 1.0], "a"), ("e3", [], "a"), ("e30", [], "a")]
    rows += [("e500", [math.nan, 0.0], "a"), ("e501", [math.inf, 1.0], "a"), ("e502", [-math.inf, 1.0], None), ("e520", [math.inf, -1.0], "b")]
    e = spark.createDataFrame(rows, "entry_id string, vector array<double>, domain string")
    asked = e.where("entry_id like '%0' or entry_id in ('e8', 'e3')").withColumnRenamed("entry_id", "query_id")
    sound = [r for r in rows if r[0] and r[1] is not None and None not in r[1]]
    want: dict = {}
    for q, x in itertools.product((r for r in sound if r[0].endswith("0") or r[0] in ("e8", "e3")), sound):
        if q[0] != x[0] and len(q[1]) == len(x[1]):
            score = 0.0
            for a, b in zip(q[1], x[1], strict=True):
                score += a * b
            score += 0.0 if None in (q[2], x[2]) else 0.05 if q[2] == x[2] else -0.02
            y = abs(score * 1e6)
            if math.isfinite(y):
                score = math.copysign(math.floor(y) + (y - math.floor(y) >= 0.5), score) / 1e6
            if not score <= 0:
                want.setdefault(q[0], []).append((not math.isnan(score), 0 if math.isnan(score) else -score, x[0], repr(score)))
    want = {q: [(rank, x, score) for rank, (_, _, x, score) in enumerate(sorted(found)[:3], 1)] for q, found in want.items()}

    def got():
        found: dict = {}
        for r in sorted(S.cosine_search(asked, e).collect(), key=lambda r: r["rank"]):
            found.setdefault(r.query_id, []).append((r["rank"], r.entry_id, repr(r.score)))
        return found

    assert got() == want and len(want) > 40
    monkeypatch.setattr(S, "BROADCAST_BYTES", 1024)
    monkeypatch.setattr(S, "TASK_PAIRS", 1000)
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    monkeypatch.setattr(S, "PAIR_CELLS", 16)
    assert got() == want
    assert S.cosine_search(asked.where("false"), e).collect() == S.cosine_search(asked, e.where("false")).collect() == []
