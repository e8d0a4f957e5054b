"""Exact top-k inner-product search over norm buckets.

Vectors are sorted by length and cut into buckets of about ``BUCKET_ROWS``. A first look
at the longest vectors gives each query a lower bound of its k-th best score; queries are
sorted by how short a vector could still reach theirs, and cut into blocks. A block meets
only buckets whose longest vector could reach one of its bounds, and in each bucket a
query's local cosine threshold (bound / (|query| * longest)) chooses how to prune: above
``COORDINATE_FROM`` by the ranges that a few focus coordinates of a normalised candidate
must lie in, below by length alone. What is left is verified by its integer product.

Blocks are planned by their numbers and bounds alone. A task takes one block of queries and
up to about ``GROUP_BUCKETS`` of the buckets that it meets, longest first, raises the
bounds as it goes, and returns at most k rows for a query. Components travel as the
smallest integers that hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import frugal, materialize, release, tune

K = 20
SCALE = 64
BUCKET_ROWS = 4096
QUERY_ROWS = 8192
#: Bytes of components in a bucket and in a block of queries, which have fewer rows for long vectors.
BUCKET_BYTES = 1 << 20
QUERY_BYTES = 1 << 23
GROUP_BUCKETS = 64
#: Queries that are multiplied with a bucket at once.
CHUNK_ROWS = 512
#: The plan's pairs of blocks and buckets of one dimension are made in so many parts.
PLAN_PARTS = 64
COORDINATE_FROM = 0.6
FOCUS = 3
#: Kinds of vector lengths (dimensions) that get a first look, by vectors of so many bytes in all; without one a query has no bound, which changes the plan but no result.
FIRST_LOOKS = 16
SEED_BYTES = 1 << 26
_BLOCK = "block bigint, dims int, longest double, ids binary, vectors binary"
_QUERIES = "q_block bigint, dims int, reach double, q_ids binary, q binary, bounds binary"


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, vector ARRAY<BIGINT>, norm): floor(scale * x) of each component.

    Rows with a null id, a null vector or a null or non-finite component are left out; of
    rows that share an id the smallest vector counts. Components beyond 64 bits saturate.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & sound)
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("vector"))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v)))


def _packed(values: np.ndarray) -> bytes:
    """Integers as the smallest type that holds them; the type shows in the length."""
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return values.astype(kind).tobytes()


def _read(ids: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    size = len(vectors) // max(1, len(ids) * dims) if vectors else 8
    return ids, np.frombuffer(vectors, f"<i{size}").reshape(len(ids), dims).astype(np.int64)


def _blocks(rows: int, most: int, bounded: bool):
    """Rows in order (id, vector, dims, norm or reach, bound) become blocks of one dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count, held, size
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            vectors, dims = t.column("vector").combine_chunks(), t.column("dims").to_numpy()
            ids, reach = t.column("id").to_numpy(), t.column("reach").to_numpy()
            flat, cuts = vectors.flatten().to_numpy(), np.flatnonzero(np.r_[True, dims[1:] != dims[:-1], True])
            at = np.r_[0, np.cumsum(dims)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                step = max(1, min(rows, most // max(1, 8 * int(dims[a]))))
                for i in range(a, b, step):
                    j = min(i + step, b)
                    row = [(task << 32) | count, int(dims[a]), float(reach[i:j].min() if bounded else reach[i:j].max()), ids[i:j].astype("<i8").tobytes(), _packed(flat[at[i] : at[j]])]
                    names = ["block", "dims", "longest", "ids", "vectors"]
                    if bounded:
                        row.append(t.column("bound").to_numpy()[i:j].astype("<i8").tobytes())
                        names = ["q_block", "dims", "reach", "q_ids", "q", "bounds"]
                    count += 1
                    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=False)], names=names)

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield from flush()
        yield from flush()

    return run


def _products(q: np.ndarray, p: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products: in doubles where these are exact, else in 64 bits."""
    return (q.astype(float) @ p.astype(float).T).astype(np.int64) if exact else q @ p.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


def search_block(q_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, p_ids: np.ndarray, p: np.ndarray, k: int = K) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query places, candidate ids, scores): what a bucket offers a block of queries above their bounds."""
    q_norm, p_norm = (np.sqrt((x.astype(float) ** 2).sum(1)) for x in (q, p))
    longest = p_norm.max(initial=0.0)
    exact = q_norm.max(initial=0.0) * longest < 2.0**52
    with np.errstate(divide="ignore", invalid="ignore"):
        local = bounds / (q_norm * longest)  # the local cosine threshold
        needed = bounds / q_norm
    local, needed = (np.where(np.isnan(x), -np.inf, x) for x in (local, needed))
    if not exact or longest == 0:
        local[:], needed[:] = -np.inf, -np.inf
    slack = 1e-9
    out = []

    def offer(i: int, places: np.ndarray, scores: np.ndarray) -> None:
        fit = (p_ids[places] != q_ids[i]) & (scores >= bounds[i])
        places, scores = places[fit], scores[fit]
        best = _best(scores, p_ids[places], k)
        out.append((np.full(len(best), i), p_ids[places[best]], scores[best]))

    alive = local <= 1 + slack
    by_coordinate = alive & (local >= COORDINATE_FROM)
    unit = p / np.maximum(p_norm, 1e-300)[:, None] if by_coordinate.any() else None
    for i in np.flatnonzero(by_coordinate):
        v, t = q[i] / q_norm[i], min(local[i], 1.0)
        keep = p_norm >= needed[i] * (1 - slack)
        for f in np.argsort(-np.abs(v))[:FOCUS]:  # a unit vector with cosine t or more lies so near in each coordinate
            wide = np.sqrt(max(0.0, (1 - t * t) * (1 - v[f] ** 2))) + 1e-7
            upper = 1.0 if v[f] >= t else v[f] * t + wide
            lower = -1.0 if v[f] <= -t else v[f] * t - wide
            keep &= (unit[:, f] >= lower) & (unit[:, f] <= upper + 1e-7)
        places = np.flatnonzero(keep)
        offer(i, places, _products(q[i : i + 1], p[places], exact)[0])
    by_length = np.flatnonzero(alive & ~by_coordinate)
    if len(by_length):
        order = np.argsort(-p_norm, kind="stable")
        reach = np.searchsorted(-p_norm[order], -(needed[by_length].min(initial=np.inf) * (1 - slack)), "right") if np.isfinite(needed[by_length]).all() else len(order)
        order = order[:reach]
        scores = _products(q[by_length], p[order], exact)
        for i, s in zip(by_length, scores, strict=True):
            offer(i, order, s)
    return out


def _first_look(seeds, k: int):
    """Rows (id, vector, dims, norm) with ``bound``, the k-th best product with the seeds, and ``reach``, the length that a vector needs to reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looks = {d: _read(i, v, d) for d, i, v in seeds.value}
        lengths = {d: np.sqrt((p.astype(float) ** 2).sum(1)).max(initial=0.0) for d, (_, p) in looks.items()}
        for b in batches:
            ids, dims, norm = (b.column(c).to_numpy() for c in ("id", "dims", "norm"))
            flat, at = b.column("vector").flatten().to_numpy(), np.r_[0, np.cumsum(dims)]
            bounds = np.full(len(ids), np.iinfo(np.int64).min, np.int64)
            for d in np.unique(dims):
                if int(d) not in looks:
                    continue
                p_ids, p = looks[int(d)]
                rows = np.flatnonzero(dims == d)
                for i in range(0, len(rows), CHUNK_ROWS):
                    some = rows[i : i + CHUNK_ROWS]
                    q = np.stack([flat[at[r] : at[r + 1]] for r in some])
                    exact = norm[some].max() * lengths[int(d)] < 2.0**52
                    for r, s in zip(some, _products(q, p, exact), strict=True):
                        s = s[p_ids != ids[r]]
                        if len(s) >= k:
                            bounds[r] = np.partition(s, len(s) - k)[len(s) - k]
            with np.errstate(divide="ignore", invalid="ignore"):
                reach = np.nan_to_num(bounds / norm, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
            reach[norm >= 2.0**25] = -np.inf
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vector"), b.column("dims"), pa.array(reach), pa.array(bounds)], names=["id", "vector", "dims", "reach", "bound"])

    return run


def _merged(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query place the k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[keep], scores[keep]


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, buckets: pd.DataFrame) -> pd.DataFrame:
        """One block of queries and a group of buckets."""
        got = (np.zeros(0, np.int64),) * 3
        q_ids = np.zeros(0, np.int64)
        if len(queries) and len(buckets):
            dims = int(queries.dims.iloc[0])
            q_ids, q = _read(queries.q_ids.iloc[0], queries.q.iloc[0], dims)
            bounds = np.frombuffer(queries.bounds.iloc[0], "<i8").copy()
            for _, r in buckets.sort_values(["longest", "block"], ascending=[False, True]).iterrows():
                p_ids, p = _read(r.ids, r.vectors, dims)
                parts = [got]
                for i in range(0, len(q_ids), CHUNK_ROWS):
                    j = i + CHUNK_ROWS
                    found = search_block(q_ids[i:j], q[i:j], bounds[i:j], p_ids, p, k)
                    parts += [(at + i, ids, scores) for at, ids, scores in found]
                if len(parts) > 1:
                    got = _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
                    last = np.flatnonzero(np.r_[got[0][1:] != got[0][:-1], True]) if len(got[0]) else np.zeros(0, np.int64)
                    counts = np.diff(np.r_[-1, last])
                    full = last[counts == k]
                    bounds[got[0][full]] = np.maximum(bounds[got[0][full]], got[2][full])
        release()
        return pd.DataFrame({"query_id": q_ids[got[0]] if len(q_ids) else got[0], "vec_id": got[1], "score": got[2]})

    return run


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer products with each query, from ``quantised`` rows.

    ``is_query`` is a predicate on ``id``. A query meets only vectors of its own dimension,
    never itself; ties go to the smaller id. Products beyond 64 bits wrap.
    """
    spark = vectors.sparkSession
    tune(spark)
    vectors = materialize(vectors, "vectors").withColumn("dims", F.size("vector"))
    n = vectors.count()
    parts = max(1, min(10_000, -(-n // (4 * BUCKET_ROWS))))
    columns = ["id", "vector", "norm", "dims"]
    ordered = vectors.select(*columns).repartitionByRange(parts, "dims", F.desc("norm"), "id").sortWithinPartitions("dims", F.desc("norm"), "id")
    ordered = ordered.withColumnRenamed("norm", "reach")
    buckets = materialize(ordered.mapInArrow(frugal(_blocks(BUCKET_ROWS, BUCKET_BYTES, False)), _BLOCK), "buckets")

    first = buckets.groupBy("dims").agg(F.max_by("block", "longest").alias("block")).orderBy(F.desc("dims")).limit(FIRST_LOOKS)
    seeds = []
    for r in buckets.join(F.broadcast(first.select("block")), "block", "left_semi").toLocalIterator():
        ids, p = _read(bytes(r.ids), bytes(r.vectors), r.dims)
        most = max(1, SEED_BYTES // FIRST_LOOKS // max(1, 8 * r.dims))
        seeds.append((r.dims, ids[:most].tobytes(), _packed(p[:most].reshape(-1))))
    bounded = "id bigint, vector array<bigint>, dims int, reach double, bound bigint"
    queries = vectors.where(is_query(F.col("id"))).select(*columns)
    queries = materialize(queries.mapInArrow(frugal(_first_look(spark.sparkContext.broadcast(seeds), k)), bounded), "bounds")
    parts = max(1, min(10_000, -(-queries.count() // (4 * QUERY_ROWS))))
    queries = queries.repartitionByRange(parts, "dims", F.desc("reach"), "id").sortWithinPartitions("dims", F.desc("reach"), "id")
    queries = materialize(queries.mapInArrow(frugal(_blocks(QUERY_ROWS, QUERY_BYTES, True)), _QUERIES), "queries")

    groups = max(1, -(-buckets.count() // GROUP_BUCKETS))
    some = buckets.select("block", "dims", "longest", F.pmod(F.xxhash64("block"), F.lit(PLAN_PARTS)).alias("part"))
    plan = queries.select("q_block", "dims", "reach", F.explode(F.array(*(F.lit(i) for i in range(PLAN_PARTS)))).alias("part")).join(some, ["dims", "part"])
    plan = plan.where(F.col("longest") * (1 + 1e-9) >= F.col("reach")).select("q_block", "block", F.pmod(F.xxhash64("block", F.lit(5)), F.lit(groups)).alias("group"))
    plan = materialize(plan, "plan")
    asked = queries.join(plan.select("q_block", "group").distinct(), "q_block").groupBy("q_block", "group")
    meets = plan.select("block", F.col("q_block").alias("to_block"), F.col("group").alias("to_group"))
    offered = buckets.drop("dims").join(meets, "block").groupBy("to_block", "to_group")
    found = asked.cogroup(offered).applyInPandas(_search(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best products of every row whose vec_id is divisible by 20, against all rows."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, lambda i: i % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, list_sum(list_transform(list_zip(q.e, p.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id AND len(q.e) = len(p.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
