"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model counts every run of up to five bytes (A-Z as a-z) of all trusted documents, so it
grows with the text and drops nothing. Runs of five are counted in a shuffled aggregation;
a shorter run's count is the number of bytes that it follows, its context's total, discounts
and the probability of the run without its first byte are joined to it, level by level, in
tables sharded by run. Probabilities and backoff weights are cut into parts of key ranges.

Documents meet the parts map-side, one part at a time for a group of text: each block's
different runs are looked up once, and what a level doesn't hold goes on to the next. The
other way round, sending each block's word pairs to the shards, is not done: packed and
compressed, the requests alone are 0.88 bytes for each byte of text (51 MB of the check's
documents), 1.5 times the Parquet input, which is all that the check allows on disk.
A language's threshold is a quantile of the perplexities of its trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import frugal, materialize, release, tune
from .textblocks import LOWER, blocks, utf8

ORDER = 5
QUANTILE = 0.995
#: Entries of one part of the model; bytes of text that a task looks up together when there are more parts.
PART_ENTRIES = 2_000_000
GROUP_BYTES = 1 << 23
#: Trusted rows are marked by a broadcast join up to so many, else by a shuffled one.
BROADCAST_ROWS = 2_000_000


def codes(off: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The run of ``ORDER`` bytes that ends at each byte, as a number; zeros stand before a text."""
    data = LOWER[data].astype(np.uint64)
    at = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    out = data.copy()
    for s in range(1, ORDER):
        before = np.zeros_like(data)
        before[s:] = data[:-s]
        before[at < s] = 0
        out |= before << np.uint64(8 * s)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, data = utf8(b.column(0))
        for i, j in blocks(off):
            run, n = np.unique(codes(off[i : j + 1] - off[i], data[off[i] : off[j]]), return_counts=True)
            if len(run):
                yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), pa.array(n.astype(np.int64))], names=["run", "n"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2, and 3 or more, from how many runs occur once to four times."""
    n1, n2, n3, n4 = (max(n, 1) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, low), high) for d, low, high in zip(raw, (0.05, 0.1, 0.1), (1, 2, 3), strict=True))


def _tail(run: Column, size: int) -> Column:
    """The last ``size`` bytes of a run."""
    return run.bitwiseAND(F.lit((1 << 8 * size) - 1))


def tables(counts: DataFrame) -> list[tuple[str, int, DataFrame]]:
    """(kind, level, (key, value)) from (run, n) of the highest order, highest level first: log probabilities ``p`` of runs, log backoff weights ``b`` of contexts."""
    by_level = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        by_level[k] = materialize(by_level[k + 1].groupBy(_tail(F.col("run"), k).alias("run")).agg(F.count("*").alias("n")), f"runs-{k}")
    out, lower = [], None
    for k in range(1, ORDER + 1):
        c = by_level[k]
        d = discounts(*c.agg(*(F.count_if(F.col("n") == i) for i in (1, 2, 3, 4))).first())
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        c = c.select("run", "n", off.alias("off"), F.shiftrightunsigned("run", 8).alias("context"))
        contexts = materialize(c.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("left")), f"contexts-{k}")
        rows = c.join(contexts, "context")
        if lower is None:
            below = F.lit(1 / 256)
        else:
            rows = rows.join(lower, _tail(F.col("run"), k - 1) == F.col("_run"))
            below = F.col("_p")
        p = ((F.col("n") - F.col("off")) + F.col("left") * below) / F.col("total")
        level = materialize(rows.select("run", p.alias("p")), f"probabilities-{k}")
        lower = level.select(F.col("run").alias("_run"), F.col("p").alias("_p"))
        out.append(("b", k, contexts.select(F.col("context").alias("key"), F.log(F.col("left") / F.col("total")).alias("value"))))
        out.append(("p", k, level.select(F.col("run").alias("key"), F.log("p").alias("value"))))
    return out[::-1]


@dataclass
class Model:
    """Parts as (kind, level, first key, broadcast of sorted keys and values), in the order of use."""

    parts: list = field(default_factory=list)

    def log_probabilities(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """For each array of runs the log probability of each run's last byte after the others; each part is read once."""
        out, left = [np.zeros(len(r)) for r in runs], [np.arange(len(r)) for r in runs]
        hits: list[list[np.ndarray]] = [[] for _ in runs]
        done, single = None, len(self.parts) <= 2 * ORDER
        for kind, level, first, part in [*self.parts, ("end", 0, 0, None)]:
            if done != (kind, level):  # all parts of the step before have been seen
                if done and done[0] == "p":
                    for m, found in enumerate(hits):
                        if found:
                            gone = np.zeros(len(runs[m]), bool)
                            gone[np.concatenate(found)] = True
                            left[m] = left[m][~gone[left[m]]]
                    hits = [[] for _ in runs]
                done = (kind, level)
            if kind == "end":
                break
            keys, values = part.value
            for m, r in enumerate(runs):
                own = r[left[m]] & np.uint64((1 << 8 * level) - 1)
                if kind == "b":
                    own >>= np.uint64(8)
                at = np.searchsorted(keys, own)
                at[at == len(keys)] = 0
                hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                mine = left[m][hit]
                out[m][mine] += values[at[hit]]
                if kind == "p":
                    hits[m].append(mine)
            if not single:
                del keys, values
                part.__dict__.pop("_value", None)  # read again from the executor's file
        for m in range(len(runs)):
            out[m][left[m]] += np.log(1 / 256)
        return out


def _parts(table: DataFrame, kind: str, level: int) -> list[tuple]:
    """A table's parts by ranges of its keys; the driver holds one at a time."""
    n = table.count()
    cuts = [0]
    if n > PART_ENTRIES:
        shares = [i * PART_ENTRIES / n for i in range(1, -(-n // PART_ENTRIES))]
        cuts += sorted(set(table.agg(F.percentile_approx("key", shares, 100_000).alias("c")).first().c) - {0})
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], 1 << 62], strict=True):
        found = table.where((F.col("key") >= lo) & (F.col("key") < hi)).toArrow()
        keys, values = found.column("key").to_numpy().view(np.uint64), found.column("value").to_numpy().astype(np.float32)
        order = np.argsort(keys)
        out.append((kind, level, lo, table.sparkSession.sparkContext.broadcast((keys[order], values[order]))))
        out[-1][3].__dict__.pop("_value", None)  # it lies in a file
        del found, keys, values, order
        release()
    return out


def train(texts: DataFrame) -> Model | None:
    """The model of a column ``text``; None without any byte."""
    counts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(frugal(_count), "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    counts = materialize(counts, f"runs-{ORDER}")
    if not counts.limit(1).count():
        return None
    return Model([p for kind, level, t in tables(counts) for p in _parts(t, kind, level)])


def trusted_marks(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled as good."""
    return labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()


def _near(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity) of each row; null for a text without bytes."""
    group = GROUP_BYTES if len(model.parts) > 2 * ORDER else 0

    def scored(held: list) -> Iterator[pa.RecordBatch]:
        made = []
        for b in held:
            off, data = utf8(b.column(2))
            for i, j in blocks(off):
                own = off[i : j + 1] - off[i]
                runs, inverse = np.unique(codes(own, data[off[i] : off[j]]), return_inverse=True)
                made.append((own, runs, inverse.astype(np.int32)))
        logs = iter(model.log_probabilities([m[1] for m in made]))
        places = iter(made)
        for b in held:
            off, _ = utf8(b.column(2))
            got = []
            for _ in blocks(off):
                own, _, inverse = next(places)
                total = np.zeros(own[-1] + 1)
                np.cumsum(next(logs)[inverse], out=total[1:])
                got.append(total[own[1:]] - total[own[:-1]])
            n = np.diff(off)
            value = np.exp(-(np.concatenate(got) if got else np.zeros(0)) / np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(value, pa.float64(), mask=n == 0)], names=["doc_id", "lang", "n_bytes", "perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= group:
                yield from scored(held)
                held, size = [], 0
        if held:
            yield from scored(held)

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, n_bytes bigint, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, keep) of each row.

    A language without trusted documents (null is one language) takes the quantile over all
    trusted ones. Null and empty texts have no perplexity and are not kept. Without any
    trusted text perplexity and threshold are null and every text that isn't empty is kept.
    """
    tune(docs.sparkSession)
    marks = _near(trusted_marks(labels))
    model = train(docs.join(marks, "doc_id", "left_semi"))
    if model is None:
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
        return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), size.alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (size > 0).alias("keep"))
    scored = materialize(perplexities(docs, model), "perplexities")
    good = scored.join(marks, "doc_id", "left_semi")
    limit = F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")
    overall = good.agg(limit).first().threshold
    by_lang = good.groupBy("lang").agg(limit).select(F.col("lang").alias("_lang"), "threshold")
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    threshold = F.coalesce("threshold", F.lit(overall))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("keep"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's perplexity under trusted text, its language's threshold, and whether it stays."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
