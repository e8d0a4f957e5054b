"""Incremental substring deduplication with a log-structured index of window hashes.

A window is ``WINDOW`` consecutive words of one document. Windows of a block of documents
are sorted by hash and dealt to shards by its leading bits. In each shard the new batch's
sorted runs are merge-joined with the index's runs (immutable, sorted, each hash with the
smallest doc_id that has it): a window is a copy if a smaller doc_id has its hash. Windows
that are copies of one document in a row make a claim; each claim is verified word by word
against that document's text, so a chance equality of hashes removes nothing. The batch's
new hashes become a run of their own, and ``FANOUT`` runs are compacted into one. Runs and
a manifest of them lie in a folder, which another session opens to go on.

Batches must come in ascending order of doc_id for a result that judges every window
against all smaller ones; inside a batch order doesn't matter.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .storage import fresh_path, frugal, materialize, release, tune
from .textblocks import blocks, utf8, windows, word_hashes, words

WINDOW = 13
FANOUT = 4
#: Text of one block of documents, and text whose windows one shard holds.
BLOCK_BYTES = 1 << 21
SHARD_BYTES = 1 << 24
MIN_SHARDS = 32
#: The first batches of a one-shot run, as shares of the documents; their runs are compacted before the rest comes.
FIRST_BATCHES = (0.0625, 0.125)
#: Claims are sent to every executor up to so many rows and array entries (about 40 bytes each), else joined by a shuffle.
BROADCAST_ENTRIES = 3_000_000
_ROWS = "shard int, kind int, block bigint, payload binary"
_MANIFEST = "shards int, window int, fanout int, made int, runs array<string>"
_WINDOWS, _META, _RUN, _COPIES = range(4)


def _planes(values: np.ndarray) -> bytes:
    """Compressed byte planes of an array."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as one value; ``uint64`` ones must be sorted and are stored as differences."""
    parts, head = [], []
    for c in columns:
        parts.append(_planes(np.diff(c, prepend=np.zeros(1, c.dtype)) if c.dtype == np.uint64 else c))
        head.append((c.dtype.str, len(c), len(parts[-1])))
    top = json.dumps(head).encode()
    return struct.pack("<I", len(top)) + top + b"".join(parts)


def _unpack(payload: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", payload)
    out, at = [], 4 + n
    for kind, rows, size in json.loads(payload[4 : 4 + n]):
        dtype = np.dtype(kind)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[at : at + size], max(1, rows * dtype.itemsize)), np.uint8)
        values = np.ascontiguousarray(raw.reshape(dtype.itemsize, rows).T).view(dtype).reshape(rows)
        out.append(np.cumsum(values, dtype=np.uint64) if dtype == np.uint64 else values)
        at += size
    return out


def _scan(shards: int, size: int):
    """Map side: sorted windows by shard, and one row with the block's documents and inner copies."""
    shift = np.uint64(64 - shards.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0)))
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            off, data = utf8(b.column(2))
            for i, j in blocks(off, BLOCK_BYTES):
                part = data[off[i] : off[j]]
                starts, ends, first = words(off[i : j + 1] - off[i], part)
                if not len(starts):
                    continue
                at, h = windows(word_hashes(part, starts, ends)[0], first, size)
                if not len(at):
                    continue
                doc = ids[i:j][np.searchsorted(first, at, "right") - 1]
                order = np.argsort(h, kind="stable")
                at, h, doc = at[order].astype(np.uint32), h[order], doc[order]
                head = np.r_[True, h[1:] != h[:-1]]
                source = doc[np.flatnonzero(head)][np.cumsum(head) - 1]
                inner = doc > source
                block, count = (task << 32) | count, count + 1
                docs = first.astype(np.int64), ids[i:j], keys[i:j]
                rows = [(block % shards, _META, block, _pack(*docs, at[inner], source[inner]))]
                h, at = h[~inner], at[~inner]
                cuts = np.searchsorted(h, np.arange(shards + 1, dtype=np.uint64)[:-1] << shift)
                for s, (x, y) in enumerate(zip(cuts, [*cuts[1:], len(h)], strict=True)):
                    if y > x:
                        rows.append((s, _WINDOWS, block, _pack(h[x:y], at[x:y], *docs[:2])))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["shard", "kind", "block", "payload"])

    return run


def _merge_runs(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of runs with their smallest doc_id."""
    got = [_unpack(p) for p in payloads]
    h, doc = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    order = np.argsort(h, kind="stable")  # numpy's stable sort merges the sorted runs that it finds
    h, doc = h[order], doc[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[head], np.minimum.reduceat(doc, head)


def _join(keep_run: bool):
    """Reduce side of one shard: merge-join the batch's sorted runs with the history's."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(int(key[0]), _META, b, p) for b, p in zip(*(rows[rows.kind == _META][c] for c in ("block", "payload")), strict=True)]
        new = rows[rows.kind == _WINDOWS].sort_values("block")
        if len(new):
            h, at, doc, of = [], [], [], []
            for n, payload in enumerate(new.payload):
                hashes, places, first, ids = _unpack(payload)
                h.append(hashes)
                at.append(places)
                doc.append(ids[np.searchsorted(first, places, "right") - 1])
                of.append(np.full(len(hashes), n, np.int32))
            h, at, doc, of = (np.concatenate(x) for x in (h, at, doc, of))
            order = np.argsort(h, kind="stable")
            h, at, doc, of = h[order], at[order], doc[order], of[order]
            head = np.r_[True, h[1:] != h[:-1]]
            starts, group = np.flatnonzero(head), np.cumsum(head) - 1
            least = np.minimum.reduceat(doc, starts)
            known, first = h[starts], least
            past = rows[rows.kind == _RUN].payload.tolist()
            fresh = np.ones(len(known), bool)
            if past:
                old, old_doc = _merge_runs(past)
                place = np.minimum(np.searchsorted(old, known), len(old) - 1)
                hit = old[place] == known
                first = np.where(hit, np.minimum(least, old_doc[place]), least)
                fresh = ~hit | (least < old_doc[place])
            source = first[group]
            copies = np.flatnonzero(doc > source)
            copies = copies[np.argsort(of[copies], kind="stable")]
            blocks_ = new.block.to_numpy()
            cuts = np.searchsorted(of[copies], np.arange(len(blocks_) + 1))
            for n, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if y > x:
                    mine = copies[x:y]
                    mine = mine[np.argsort(at[mine])]
                    out.append((int(key[0]), _COPIES, int(blocks_[n]), _pack(at[mine], source[mine])))
            if keep_run and fresh.any():
                out.append((int(key[0]), _RUN, 0, _pack(known[fresh], least[fresh])))
        release()
        return pd.DataFrame(out, columns=["shard", "kind", "block", "payload"])

    return run


def _claims(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One block's copied windows as claims: runs of windows of a document that copy one other."""
    meta = rows[rows.kind == _META].payload.tolist()
    first, ids, keys, at, source = _unpack(meta[0])
    got = [_unpack(p) for p in rows[rows.kind == _COPIES].payload]
    at = np.concatenate([at, *(g[0] for g in got)]).astype(np.int64)
    source = np.concatenate([source, *(g[1] for g in got)])
    order = np.argsort(at, kind="stable")
    at, source = at[order], source[order]
    doc = np.searchsorted(first, at, "right") - 1
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1]) | (doc[1:] != doc[:-1])] if len(at) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    return pd.DataFrame({"doc_id": ids[doc[head]], "key": keys[doc[head]], "start": at[head] - first[doc[head]], "n": np.diff(np.r_[head, len(at)]), "source": source[head]})


class SubstringIndex:
    """Runs of window hashes in a folder, and the batches that were added to them.

    A manifest names the runs that count; each change writes a new one, so a job that ends
    half-way leaves the index as it was, and another session opens it at its folder. Shards,
    window and fan-out are the folder's once it has a manifest.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = MIN_SHARDS, window: int = WINDOW, fanout: int = FANOUT):
        if shards & (shards - 1):
            raise ValueError("shards must be a power of two")
        self.spark, self.path, self.shards, self.window, self.fanout = spark, path.rstrip("/"), shards, window, fanout
        self.runs: list[str] = []
        self.made = self.version = 0
        found = [n for n in self._names("manifest-") if self._exists(f"manifest-{n}/_SUCCESS")]
        if found:
            self.version = max(found)
            last = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest-{self.version}").first()
            self.shards, self.window, self.fanout, self.made, self.runs = last.shards, last.window, last.fanout, last.made, list(last.runs)
        self.made = max([self.made, *(n + 1 for n in self._names("run-"))])  # a run without a manifest is left alone

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, _, fs = self._fs()
        return fs.exists(path(f"{self.path}/{name}"))

    def _names(self, prefix: str) -> list[int]:
        _, root, fs = self._fs()
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]

    def _publish(self, runs: list[str]) -> None:
        self.version += 1
        row = (self.shards, self.window, self.fanout, self.made, runs)
        self.spark.createDataFrame([row], _MANIFEST).coalesce(1).write.json(f"{self.path}/manifest-{self.version}")
        self.runs = runs

    def _write(self, run: DataFrame) -> str:
        name = f"run-{self.made}"
        self.made += 1
        run.write.option("compression", "uncompressed").parquet(f"{self.path}/{name}")
        return name

    def _read(self) -> DataFrame:
        return self.spark.read.schema(_ROWS).parquet(*(f"{self.path}/{r}" for r in self.runs))

    def compact(self) -> None:
        """Merge all runs into one; the old ones stay on disk, named by no manifest any more, until ``vacuum``."""

        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(int(key[0]), _RUN, 0, _pack(*_merge_runs(rows.payload.tolist())))], columns=["shard", "kind", "block", "payload"])

        self._publish([self._write(self._read().groupBy("shard").applyInPandas(merge, _ROWS))])

    def vacuum(self) -> None:
        """Remove the runs that the last manifest doesn't name, and older manifests; no reader may be using them."""
        path, _, fs = self._fs()
        gone = [f"run-{n}" for n in self._names("run-") if f"run-{n}" not in self.runs] + [f"manifest-{n}" for n in self._names("manifest-") if n != self.version]
        for name in gone:
            fs.delete(path(f"{self.path}/{name}"), True)

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Claims (doc_id, key, start, n, source) of a batch's windows that are copies; with ``keep`` the batch joins the index."""
        tune(self.spark)
        rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
        found = rows.mapInArrow(frugal(_scan(self.shards, self.window)), _ROWS)
        if self.runs:
            found = found.unionByName(self._read())
        joined = found.groupBy("shard").applyInPandas(_join(keep), _ROWS)
        if keep:
            joined = materialize(joined, "joined")
            self._publish([*self.runs, self._write(joined.where(F.col("kind") == _RUN))])
        claims = joined.where(F.col("kind").isin(_META, _COPIES)).groupBy("block").applyInPandas(_claims, "doc_id bigint, key bigint, start int, n int, source bigint")
        claims = materialize(claims, "claims")
        if keep and len(self.runs) >= self.fanout:
            self.compact()
        return claims


def _maybe_broadcast(df: DataFrame, array: str | None = None) -> DataFrame:
    entries = F.sum(F.size(array)) if array else F.lit(0)
    size = df.agg((F.count("*") + F.coalesce(entries, F.lit(0))).alias("n")).first().n
    return F.broadcast(df) if size <= BROADCAST_ENTRIES else df


def _claim_texts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = utf8(b.column(2))
            raw, out = data.tobytes(), []
            for i, claims in enumerate(b.column(3).to_pylist()):
                w = raw[off[i] : off[i + 1]].split()
                out += [(i, c["start"], c["n"], c["source"], b" ".join(w[c["start"] : c["start"] + c["n"] + size - 1]).decode()) for c in claims]
            for at in range(0, len(out), 2000):
                which, start, n, source, text = zip(*out[at : at + 2000], strict=True)
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(source, pa.int64()), pa.array(text, pa.string())], names=["doc_id", "key", "start", "n", "source", "claim"])

    return run


def _verified(size: int):
    """Rows with a text left to search are split into the windows that it has; others have been verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, key, start, n, claim, text in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if text is None:
                    out.append((doc, key, start, n))
                    continue
                w = text.split(" ")
                have = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
                w = claim.split(" ")
                out += [(doc, key, start + i, 1) for i in range(n) if tuple(w[i : i + size]) in have]
            if out:
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "key", "start", "n"])

    return run


def verify(docs: DataFrame, claims: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, key, spans) of the claims that hold by the words themselves; spans are (start, n) in windows."""
    by_doc = claims.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n", "source")).alias("claims"))
    by_doc = _maybe_broadcast(materialize(by_doc, "claims-by-document"), "claims")
    keyed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    texts = keyed.join(by_doc, ["doc_id", "key"]).select("doc_id", "key", "text", "claims").mapInArrow(frugal(_claim_texts(size)), "doc_id bigint, key bigint, start int, n int, source bigint, claim string")
    wanted = _maybe_broadcast(claims.select(F.col("source").alias("doc_id")).distinct())
    one = F.concat(F.lit(" "), F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), F.lit(" "))
    sources = keyed.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("source"), one.alias("whole"))
    met = texts.join(sources, "source")
    hold = F.contains("whole", F.concat(F.lit(" "), "claim", F.lit(" ")))
    met = met.select("doc_id", "key", "start", "n", "claim", F.when(~hold, F.trim("whole")).alias("whole"))
    met = met.mapInArrow(frugal(_verified(size)), "doc_id bigint, key bigint, start int, n int")
    return materialize(met.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "spans")


def _cut(size: int, at_text: int, names: list[str]):
    at_spans = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = utf8(b.column(at_text))
            raw, counts, removed, kept = data.tobytes(), [], [], []
            for i, spans in enumerate(b.column(at_spans).to_pylist()):
                w = raw[off[i] : off[i + 1]].split()
                counts.append(len(w))
                if spans:
                    gone = np.zeros(len(w) + 1, np.int32)
                    for s in spans:
                        gone[s["start"]] += 1
                        gone[s["start"] + s["n"] + size - 1] -= 1
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                    w = [w[k] for k in stay]
                removed.append(counts[-1] - len(w))
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([*b.columns[:at_spans], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    return run


def remove_copies(docs: DataFrame, claims: DataFrame, size: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space), which replace columns so named."""
    spans = _maybe_broadcast(verify(docs, claims, size), "spans")
    own = [f for f in docs.schema.fields if f.name not in ("n_words", "n_removed", "kept")]
    at = {f.name: f"c{k}" for k, f in enumerate(own)}  # no name of the caller's meets one of ours
    veiled = docs.select(*(F.col(f"`{n}`").alias(c) for n, c in at.items()))
    same = (veiled[at["doc_id"]].cast("bigint") == spans["doc_id"]) & (F.xxhash64(veiled[at["text"]]) == spans["key"])
    joined = veiled.join(spans, same, "left").select(*at.values(), "spans")
    schema = StructType([*own, StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    return joined.mapInArrow(frugal(_cut(size, list(at).index("text"), list(at))), schema)


def deduplicate(docs: DataFrame, window: int = WINDOW, first_batches: tuple[float, ...] = FIRST_BATCHES) -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept, by adding them to a new index in ascending batches.

    Null texts have no words. Rows with a null doc_id neither lose words nor make others
    lose any. Rows that repeat a doc_id are judged each against smaller ones only. Columns
    with the names of the new ones are replaced.
    """
    spark = docs.sparkSession
    about = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx("doc_id", list(first_batches), 1000).alias("cuts")).first()
    shards = MIN_SHARDS
    while shards * SHARD_BYTES < (about.bytes or 0):
        shards *= 2
    index = SubstringIndex(spark, fresh_path(spark, "substring-index"), shards, window, max(2, len(first_batches)))
    claims, above = [], F.lit(True)
    for cut in sorted(set(about.cuts or [])):
        claims.append(index.add(docs.where(above & (F.col("doc_id") <= cut))))
        above = F.col("doc_id") > cut
    claims.append(index.add(docs.where(above), keep=False))
    return remove_copies(docs, reduce(DataFrame.unionByName, claims), window)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the words of its 13-word windows that a smaller doc_id has."""
    found = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS beg FROM d WHERE len(w) >= 13
), k AS (
  SELECT doc_id, beg, array_to_string(w[beg:beg + 12], ' ') AS win FROM p
), f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
c AS (SELECT k.doc_id, k.beg FROM k JOIN f USING (win) WHERE f.first < k.doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(beg, beg + 13)) AS pos FROM c),
a AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
e AS (
  SELECT d.doc_id, d.w, coalesce(a.gone, []::BIGINT[]) AS gone FROM d LEFT JOIN a USING (doc_id)
), o AS (
  SELECT doc_id, w, gone, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)) AS stay FROM e
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(stay, lambda i: w[i]), ' '), '')) AS kept_sha256 FROM o
"""
