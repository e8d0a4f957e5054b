"""Language identification by a byte convolutional network trained in numpy.

A text is cut into windows of ``WINDOW`` bytes (the last is padded with zeros). Filters of
several widths over one-hot bytes, max-pooled over a window, feed a softmax; a text's
probabilities are its windows' mean, weighted by their bytes. As the input is one-hot, a
filter's response is a sum of table entries, and two bytes make one index, so a window
costs a few gathers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .storage import frugal, materialize, tune
from .textblocks import blocks, utf8

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Documents of each language that train the network, at most about; windows taken of each.
SAMPLE_DOCUMENTS = 600
SAMPLE_WINDOWS = 4
#: With many languages each has fewer documents: about so many in all, but no fewer than LEAST_DOCUMENTS of a language (or all it has).
ALL_DOCUMENTS = 40_000
LEAST_DOCUMENTS = 40
EPOCHS = 6
BATCH = 128
UNDETERMINED = "und"


def cut(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of bytes), the text of each, and its own bytes."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    first = np.cumsum(n) - n
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    out[np.arange(len(data)) + np.repeat(first * WINDOW - off[:-1], size)] = data
    of = np.repeat(np.arange(len(size)), n)
    own = np.minimum(WINDOW, size[of] - (np.arange(len(of)) - first[of]) * WINDOW)
    return out.reshape(-1, WINDOW), of, own


@dataclass
class Network:
    languages: list[str] = field(default_factory=list)
    filters: list[np.ndarray] = field(default_factory=list)  # for each width: (width, 256, FILTERS)
    dense: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width, responses to the first two bytes, and to those after."""
        out = []
        for w in self.filters:
            pair = (w[0][:, None] + w[1][None]).reshape(-1, w.shape[2]).astype(np.float32)
            rest = None if len(w) == 2 else w[2].astype(np.float32) if len(w) == 3 else (w[2][:, None] + w[3][None]).reshape(-1, w.shape[2]).astype(np.float32)
            out.append((pair, rest))
        return out

    def probabilities(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Softmax of each window."""
        out = []
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            pairs = part[:, :-1].astype(np.uint16) << 8 | part[:, 1:]
            pooled = []
            for w, (pair, rest) in zip(self.filters, tables, strict=True):
                n = WINDOW + 1 - len(w)
                r = np.take(pair, pairs[:, :n], 0)
                if rest is not None:
                    r += np.take(rest, part[:, 2:] if len(w) == 3 else pairs[:, 2:], 0)
                pooled.append(r.max(1))
            z = np.hstack(pooled) @ self.dense + self.bias
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 5) -> Network:
    """Train by Adam on windows ``x`` with language numbers ``y``."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    params = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS] + [rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, n)), np.zeros(n)]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    f = np.arange(FILTERS)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            b, label = x[order[i : i + BATCH]], y[order[i : i + BATCH]]
            pooled, places = [], []
            for w in params[: len(WIDTHS)]:
                m = WINDOW + 1 - len(w)
                r = sum(w[j][b[:, j : j + m]] for j in range(len(w)))
                at = r.argmax(1)
                places.append(at)
                pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            h = np.hstack(pooled)
            z = h @ params[-2] + params[-1]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(b)), label] -= 1
            z /= len(b)
            back = z @ params[-2].T
            grads = []
            for k, w in enumerate(params[: len(WIDTHS)]):
                g, own = np.zeros_like(w), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(w)):
                    seen = np.take_along_axis(b, places[k] + j, 1)
                    np.add.at(g[j], (seen, np.broadcast_to(f, seen.shape)), own)
                grads.append(g)
            grads += [h.T @ z, z.sum(0)]
            step += 1
            rate = 0.02 * (0.5 ** max(0, epoch - EPOCHS // 2))
            for p, g, m1, m2 in zip(params, grads, mean, square, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Network(languages, params[: len(WIDTHS)], params[-2], params[-1])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows spread evenly over each text."""
    for b in batches:
        off, data = utf8(b.column(1))
        x, of, _ = cut(off, data)
        first, n = np.searchsorted(of, np.arange(len(off) - 1)), np.bincount(of, minlength=len(off) - 1)
        pick = np.unique(np.concatenate([first + n * k // SAMPLE_WINDOWS for k in range(SAMPLE_WINDOWS)])[np.tile(n > 0, SAMPLE_WINDOWS)])
        if len(pick):
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of[pick])), pa.array([x[p].tobytes() for p in pick], pa.binary())], names=["lang", "window"])


def sampled(n: Column, documents: int, id_col: str = "doc_id", seed: int = 11) -> Column:
    """Whether a row is one of about ``documents`` out of ``n``, by a hash of 62 bits: the share doesn't vanish with a large ``n``."""
    share = F.least(F.lit(1.0), F.lit(float(documents)) / n) * float(1 << 62)
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 2) < share.cast("bigint")


def train(docs: DataFrame) -> Network:
    """A network for every language of the rows allowed for learning: non-null lang, crc32(doc_id as text) mod 5 not 0.

    It is fitted on a bounded sample of them (SAMPLE_DOCUMENTS, ALL_DOCUMENTS). A language
    whose texts are all empty isn't learned.
    """
    tune(docs.sparkSession)
    rows = docs.where("lang is not null and octet_length(cast(text as string)) > 0 and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    n = counts.count()
    if not n:
        return Network()
    documents = max(LEAST_DOCUMENTS, min(SAMPLE_DOCUMENTS, ALL_DOCUMENTS // n))
    some = rows.join(counts, "lang").where(sampled(F.col("n"), documents))
    found = some.select("lang", "text").mapInArrow(frugal(_sample), "lang string, window binary").toArrow()
    if len(found.column("lang").unique()) < n:
        raise RuntimeError(f"the sample holds {len(found.column('lang').unique())} of {n} languages")
    languages = sorted(set(found.column("lang").to_pylist()))
    number = {v: k for k, v in enumerate(languages)}
    x = np.frombuffer(b"".join(found.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.array([number[v] for v in found.column("lang").to_pylist()])
    order = np.lexsort((*x[:, :8].T, y))  # whatever order the rows came in
    return fit(x[order], y[order], languages)


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, which replace columns so named.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if no
    language was learned.
    """
    tune(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    if not network.languages:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    shared, names = docs.sparkSession.sparkContext.broadcast(network), docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables, languages = net.tables(), np.array(net.languages, object)
        for b in batches:
            off, data = utf8(b.column(names.index("text")).cast(pa.string()))
            total = np.zeros((len(off) - 1, len(languages)))
            for i, j in blocks(off):
                x, of, own = cut(off[i : j + 1] - off[i], data[off[i] : off[j]])
                p = net.probabilities(x, tables) * own[:, None]
                for k in range(len(languages)):
                    total[i:j, k] = np.bincount(of, p[:, k], j - i)
            best = total.argmax(1) if len(total) else np.zeros(0, int)
            score = np.clip(total[np.arange(len(total)), best] / np.maximum(np.diff(off), 1), 0, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(languages[best], pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    found = docs.mapInArrow(frugal(run), StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    known = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return found.withColumn("lang_pred", F.when(known, F.col("lang_pred")).otherwise(UNDETERMINED)).withColumn("score", F.when(known, F.col("score")).otherwise(0.0))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, by a network learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), train(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
