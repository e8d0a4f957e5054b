"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from docloom import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    mine = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    found = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in found.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(df.columns)
    assert mine == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


def test_every_component_is_quantised(spark):
    want = {r.vec_id: [int(min(63, max(0, round(x * 63)))) for x in r.embedding] for r in plans.table(spark, SF, "embeddings").collect()}
    got = {r.vec_id: r.levels for r in plans.QUERIES["m05_quantise"](spark, SF).collect()}
    assert got == want and {len(v) for v in got.values()} == {64}


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_points_import_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and len(e.oracle_sql()) > 200"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_formula_blocks_where_letters_are_seven_tenths(spark, tmp_path):
    lines = [c * letters + "=" * (n - letters) for n in (10, 90, 170, 180, 330, 650) for c in ("a", "é") for letters in (7 * n // 10 - 1, 7 * n // 10, 7 * n // 10 + 1)]
    rows = [(i, "\n".join(["plain", "plain", line, "plain", "plain", line, line]), "s") for i, line in enumerate(lines)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    name, con = "r40_w14_formula_blocks", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).select("doc_id", "latex").collect()))
    assert got == sorted(con.execute(f"SELECT doc_id, latex FROM ({plans.ORACLES[name]})").fetchall())


def test_vector_search_on_odd_rows(spark, tmp_path, monkeypatch):
    """Null labels, ids, vectors; repeated ids; ties; sums that end in half a millionth; components that aren't finite."""
    import random

    rng = random.Random(7)
    monkeypatch.setattr("docloom.operators.scoring.TASK_PAIRS", 5000)
    unit = lambda: [rng.gauss(0, 0.35) for _ in range(8)]
    rows = [(i, unit(), rng.choice((0, 1, 2, None))) for i in range(1200)]
    rows += [(i, [(2 * j + 1) / 2e6 if d == 0 else 0.0 for d in range(8)], 3) for j, i in enumerate(range(1200, 1500))]
    rows += [(1500, [1.0] + [0.0] * 7, 3), (1550, [2.0] + [0.0] * 7, None), (50, unit(), 1), (7, unit(), 1), (None, unit(), 1), (1600, None, 1), (1601, None, None)]
    rows += [(1650, rows[100][1], 0), (1651, rows[100][1], 0), (1652, rows[100][1], 0), (1653, rows[100][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    rows += [(1700, [math.nan] * 8, 0), (1701, [math.inf] + [1.0] * 7, None), (1750, [-math.inf] + [1.0] * 7, 0), (1751, [1e38] * 8, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    name, con = "j12_t01_vector_search", duckdb.connect()
    for part in "ab":
        con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/{part}/embeddings.parquet/*.parquet'")
        got = sorted(map(repr, map(tuple, plans.QUERIES[name](spark, f"{tmp_path}/{part}").select("query_id", "entry_id", "score", "rank").collect())))
        assert got == sorted(map(repr, con.execute(f"SELECT query_id, entry_id, score, rank FROM ({plans.ORACLES[name]})").fetchall())) and len(got) > 80
