"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary labelled documents, differ in their counts. A word is
counted by its contexts, not its occurrences, as Kneser-Ney's lower orders are; a context
is a document that holds it, so one that repeats a word counts once. A word backs off to
its first five bytes, these to the first four, and these to one distribution that both
classes share. At each level a class's count c is compared with the count E that the level
below expects: Kneser-Ney's discount D, widened by ``DEVIATIONS`` times the root of E, is
taken from |c - E| and given back to that level. An
expression too rare to tell the classes apart so has the probability of its stem in both
models; differences under ``SLACK`` count as ordinary variation. A document's score is a
logistic function of its length-normalised log-likelihood difference and its length. It is
fitted on a fold of the labelled documents by a model of the other folds; the model that
scores then counts all of them.

The counts cover every labelled document allowed for learning, by shuffled aggregations,
and probabilities are computed there. Kept are the words and stems whose difference isn't
that of the level below: nothing else would change a score, so the model is whole and
grows with the input. It is cut into parts of about ``PART_ENTRIES`` entries by the stems
of four bytes, which hold all that decides on a word; each is sent and looked up by itself,
by the words that belong to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .storage import frugal, materialize, release, tune
from .textblocks import LOWER, NON_WORD, blocks, utf8, word_hashes, words

DISCOUNT = 0.75
#: Of a count's expected value, so many roots are ordinary variation.
DEVIATIONS = 3.0
#: Entries of one part of the model; words' bytes that a task scores together when there are more parts.
PART_ENTRIES = 1_000_000
GROUP_BYTES = 1 << 24
#: Of the learning rows, one in CALIBRATION_PART is kept out of the counts of the model that the logistic function is fitted by, on at most about CALIBRATION_ROWS of these.
CALIBRATION_PART = 4
CALIBRATION_ROWS = 20_000
THRESHOLD = 0.7
#: Labels are joined by broadcast up to this size, else by a shuffled join.
BROADCAST_ROWS = 2_000_000
#: Nats by which a difference of two log-probabilities is drawn towards zero.
SLACK = 1.0
#: Bits of a word's key that a stem's leaves out: of four bytes, of five, of the word.
LEVELS = (36, 20, 0)
STEM_BITS = 64 - LEVELS[0]


def _tokens(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lower-cased words of one block, and each document's first word.

    A key nests its stems: 28 bits of four bytes' hash, 16 of five bytes', 20 of the word's.
    """
    data = LOWER[data]
    starts, ends, first = words(offsets, data, NON_WORD)
    four, five, word = word_hashes(data, starts, np.minimum(starts + 4, ends), np.minimum(starts + 5, ends), ends)
    low = [np.uint64(x) for x in (36, 48, 20, 44)]
    return (four >> low[0] << low[0]) | (five >> low[1] << low[2]) | (word >> low[3]), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a block the rows that hold it: toxic and ordinary ones, of all and of those outside the calibration fold."""
    for b in batches:
        off, data = utf8(b.column(0))
        label, rest = b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy().astype(np.int64)
        kinds = np.stack([label, 1 - label, label * rest, (1 - label) * rest])
        for i, j in blocks(off):
            h, first = _tokens(off[i : j + 1] - off[i], data[off[i] : off[j]])
            if not len(h):
                continue
            row = np.repeat(np.arange(j - i), np.diff(first))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
            h, row = h[once], row[once]
            head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            counts = [np.add.reduceat(k[i:j][row], head) for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[head].view(np.int64), *counts)], names=["w", "ct", "co", "ct1", "co1"])


def part_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """The part of each word's key: ranges of its stem of four bytes."""
    return ((hashes >> np.uint64(64 - STEM_BITS)) * np.uint64(n) >> np.uint64(STEM_BITS)).astype(np.int64)


@dataclass
class Part:
    """For each level its sorted keys with their log-likelihood differences, shortest stem first."""

    levels: list = field(default_factory=list)

    def differences(self, h: np.ndarray) -> np.ndarray:
        """The difference of each word, drawn towards zero."""
        each = np.zeros(len(h))
        for shift, (keys, diffs) in zip(LEVELS, self.levels, strict=True):
            at, hit = _find(keys, h >> np.uint64(shift))
            each[hit] = diffs[at[hit]]
        return np.sign(each) * np.maximum(np.abs(each) - SLACK, 0)


@dataclass
class Model:
    """The parts as broadcasts, and the logistic function."""

    parts: list = field(default_factory=list)
    base: float = 0.0
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def differences(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each document of (offsets, bytes) pairs: mean difference of log-likelihoods by word, and the number of words.

        Of several parts one at a time is held, and meets the words that belong to it.
        """
        n_parts, made = len(self.parts), []
        for off, data in texts:
            for i, j in blocks(off):
                h, first = _tokens(off[i : j + 1] - off[i], data[off[i] : off[j]])
                order = np.argsort(part_of(h, n_parts), kind="stable") if n_parts > 1 else np.arange(len(h))
                cuts = np.searchsorted(part_of(h[order], n_parts), np.arange(n_parts + 1)) if n_parts > 1 else [0, len(h)]
                made.append((h[order], order, cuts, first, np.zeros(len(h))))
        for k, part in enumerate(self.parts):
            value = part.value
            for h, order, cuts, _, each in made:
                x, y = cuts[k], cuts[k + 1]
                each[order[x:y]] = value.differences(h[x:y])
            if n_parts > 1:
                del value
                part.__dict__.pop("_value", None)  # read again from the executor's file
        found, at = [], 0
        for off, _ in texts:
            got = []
            for _ in blocks(off):
                *_, first, each = made[at]
                at += 1
                n = np.diff(first)
                total = np.zeros(len(each) + 1)
                np.cumsum(each, out=total[1:])
                got.append(((total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1), n))
            found.append(tuple(np.concatenate(x) if got else np.zeros(0) for x in (zip(*got, strict=True) if got else ((), ()))))
        return found

    def features(self, diff: np.ndarray, n: np.ndarray) -> np.ndarray:
        root = np.sqrt(np.maximum(n, 1))
        return np.stack([diff, diff * root, np.log1p(np.maximum(diff * n, 0)), 1 / root], 1) / self.scale

    def score(self, diff: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = np.clip(self.features(diff, n) @ self.weights[:4] + self.weights[4], -30, 30)
        p = 1 / (1 + np.exp(-z))
        return np.where((n == 0) | (self.weights[:4] == 0).all(), min(self.base, 0.5), p)

    def fit(self, diff: np.ndarray, n: np.ndarray, label: np.ndarray) -> None:
        """Ridge logistic regression by Newton's method."""
        if label.min(initial=1) == label.max(initial=0):
            return
        self.scale = np.maximum(np.abs(self.features(diff, n)).std(0), 1e-6) * self.scale
        x = np.hstack([self.features(diff, n), np.ones((len(n), 1))])
        w, ridge = np.zeros(5), np.diag([0.05, 0.05, 0.05, 0.05, 1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
            w += step * min(1, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-7:
                break
        self.weights = w


def _find(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, of), max(len(keys) - 1, 0))
    return at, keys[at] == of if len(keys) else np.zeros(len(of), bool)


def _smoothed(count: Column, total: Column, below: Column) -> Column:
    """A class's probability: its count drawn to the one that ``below`` expects, by the discount and the variation of such a count."""
    expected = total * below
    off = count - expected
    return (expected + F.signum(off) * F.greatest(F.abs(off) - DISCOUNT - DEVIATIONS * F.sqrt(expected), F.lit(0.0))) / F.greatest(total, F.lit(1))


def _entries(by_word: DataFrame, totals) -> DataFrame:
    """(level, key, diff, diff1) of all stems and words, from counts by word: ``ct co cb``, and ``ct1 co1 cb1`` outside the fold.

    ``diff`` is null where it is the level below's.
    """
    counts = [c + k for k in ("", "1") for c in ("ct", "co", "cb")]
    below, out = None, []
    for level, shift in enumerate(LEVELS):
        rows = by_word.groupBy(F.shiftrightunsigned("w", shift).alias("key")).agg(*(F.sum(c).alias(c) for c in counts)) if shift else by_word.select(F.col("w").alias("key"), *counts)
        if below is None:
            lower = {c + k: F.col("cb" + k) / max(totals["cb" + k] or 0, 1) for k in ("", "1") for c in "to"}
            base = {k: F.lit(0.0) for k in ("", "1")}
        else:
            rows = rows.join(below, F.shiftrightunsigned("key", LEVELS[level - 1] - shift) == F.col("_key"))
            lower = {c + k: F.when(F.col("_cb" + k) > 0, F.col("cb" + k) / F.col("_cb" + k) * F.col(f"_p{c}{k}")).otherwise(0.0) for k in ("", "1") for c in "to"}
            base = {k: F.coalesce(F.log(F.try_divide("_pt" + k, "_po" + k)), F.lit(0.0)) for k in ("", "1")}
        p = [_smoothed(F.col(f"c{c}{k}"), F.lit(totals[f"c{c}{k}"] or 0), lower[c + k]).alias(f"p{c}{k}") for k in ("", "1") for c in "to"]
        rows = rows.select("key", *counts, *p, *(v.alias("base" + k) for k, v in base.items()))
        diffs = [F.log(F.try_divide("pt" + k, "po" + k)) for k in ("", "1")]
        own = [F.when(F.abs(d - F.col("base" + k)) > 1e-9, d).alias("diff" + k) for k, d in zip(("", "1"), diffs, strict=True)]
        if shift:
            rows = materialize(rows.select("key", *counts, *(f"p{c}{k}" for k in ("", "1") for c in "to"), *own), "stems")
            below = rows.select(F.col("key").alias("_key"), *(F.col(c + k).alias(f"_{c}{k}") for k in ("", "1") for c in ("cb", "pt", "po")))
            own = ["diff", "diff1"]
        out.append(rows.select(F.lit(level).alias("level"), "key", *own))
    return out[0].unionByName(out[1]).unionByName(out[2]).where("diff is not null or diff1 is not null")


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows (doc_id, text, toxic) allowed for learning: crc32(doc_id as text) mod 3 is not 1."""
    marks = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    marks = marks.groupBy("doc_id").agg((F.max("toxic") >= 1).cast("int").alias("toxic"))
    small = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marks) if small else marks, "doc_id")


def _parts(table: DataFrame, diff: str) -> list:
    """The model's parts as broadcasts, by the differences so named; the driver holds those of one at a time."""
    spark = table.sparkSession
    table = table.where(F.col(diff).isNotNull()).select("level", "key", F.col(diff).cast("float").alias("diff"))
    n, out = max(1, -(-table.count() // PART_ENTRIES)), []
    stem = F.col("key")
    for level, shift in enumerate(LEVELS):
        stem = F.when(F.col("level") == level, F.shiftrightunsigned("key", LEVELS[0] - shift)).otherwise(stem)
    for k in range(n):
        own = (table.where(F.floor(stem * n / (1 << STEM_BITS)) == k) if n > 1 else table).toArrow()
        level, keys, diffs = (own.column(c).to_numpy() for c in ("level", "key", "diff"))
        part = Part()
        for m in range(len(LEVELS)):
            use = level == m
            mine = keys[use].view(np.uint64)
            order = np.argsort(mine)
            part.levels.append((mine[order], diffs[use][order]))
        out.append(spark.sparkContext.broadcast(part))
        out[-1].__dict__.pop("_value", None)  # it lies in a file
        del own, level, keys, diffs, part
        release()
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Count, smooth, and calibrate. With no toxic or no ordinary label, every score is the share of toxic ones, 0.5 at most."""
    tune(docs.sparkSession)
    rows = learning_rows(docs, labels)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_PART))
    size = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.sum((fold == 0).cast("int")).alias("kept_out")).first()
    if not size.n or not 0 < size.toxic < size.n:
        return Model(base=(size.toxic or 0) / (size.n or 1))
    counts = rows.select("text", "toxic", (fold != 0).cast("int").alias("rest")).mapInArrow(frugal(_count), "w bigint, ct bigint, co bigint, ct1 bigint, co1 bigint")
    by_word = counts.groupBy("w").agg(*(F.sum(c).alias(c) for c in ("ct", "co", "ct1", "co1")))
    by_word = by_word.withColumns({"cb": F.col("ct") + F.col("co"), "cb1": F.col("ct1") + F.col("co1")})
    by_word = materialize(by_word, "contexts")
    totals = by_word.agg(*(F.sum(c).alias(c) for c in by_word.columns[1:])).first()
    table = materialize(_entries(by_word, totals), "kneser-ney")
    model, fitted = Model(_parts(table, "diff")), Model(_parts(table, "diff1"))
    model.base = size.toxic / size.n

    share = min(1.0, CALIBRATION_ROWS / max(size.kept_out, 1))
    kept = rows.where((fold == 0) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) or 1)))
    measured = kept.select("text", "toxic").mapInArrow(frugal(_measure(fitted)), "diff double, n bigint, toxic int").toPandas()
    if len(measured):
        fitted.fit(measured["diff"].to_numpy(), measured.n.to_numpy(), measured.toxic.to_numpy().astype(float))
    model.scale, model.weights = fitted.scale, fitted.weights
    for part in fitted.parts:
        part.unpersist()
    return model


def _grouped(model: Model, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    """Each batch with its documents' differences and numbers of words; of several parts each is read once for a group of batches."""
    held, texts, size = [], [], 0
    for b in batches:
        held.append(b)
        texts.append(utf8(b.column(column).cast(pa.string())))
        size += len(texts[-1][1])
        if len(model.parts) < 2 or size >= GROUP_BYTES:
            yield from zip(held, model.differences(texts), strict=True)
            held, texts, size = [], [], 0
    if held:
        yield from zip(held, model.differences(texts), strict=True)


def _measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (diff, n) in _grouped(model, batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(diff, pa.float64()), pa.array(n.astype(np.int64)), b.column(1).cast(pa.int32())], names=["diff", "n", "toxic"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``), which replace columns so named.

    A null or empty text, or one without a word, gets the share of toxic labels, 0.5 at most.
    """
    tune(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    fields = docs.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (diff, n) in _grouped(model, batches, fields.index("text")):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(diff, n), pa.float64())], names=[*fields, "score"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(frugal(run), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, by models learned from the rows that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs.select("doc_id", "text"), train(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
