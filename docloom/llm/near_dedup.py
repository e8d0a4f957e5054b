"""SimHash near-duplicate detection with pivot distance tables.

A text's fingerprint has bit b set if more than half of its word shingles' XXH64
hashes have it. Fingerprints within ``max_distance`` bits are linked and the links'
connected components returned.

Links are found without comparing all pairs. Equal fingerprints are one row first. The
64 bits are cut into ``max_distance + 2`` segments: two fingerprints in reach agree on
two segments at least, so each fingerprint is dealt to one block for each pair of
segments, and every linked pair meets in a block. Of very many fingerprints more segments
are made and more must agree, so blocks stay small. Inside a block the distances of its
members to ``PIVOTS`` reference fingerprints are tabled; a pair whose coordinates differ
by more than ``max_distance`` anywhere is discarded (triangle inequality), and the
survivors are verified by their own Hamming distance. A block emits at most one link for
each member and component, never all pairs of a dense group.

``similar_documents`` checks texts by the Jaccard similarity of their word shingle sets. The
components that ``near_duplicates`` finds are its first buckets; pairs further apart than
``max_distance`` bits meet in a bucket if they share a band of MinHash minima (``BANDS`` of
``BAND_ROWS``). In each bucket links are verified by the two sets themselves. A pair of
similarity s shares a band with probability 1 - (1 - s^BAND_ROWS)^BANDS; at 0.8 it is missed
6 times in 10^7.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import frugal, materialize, tune
from .textblocks import LOWER, blocks, mix, utf8, windows, word_hashes, words

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
PIVOTS = 32
#: Blocks of up to so many members are compared pairwise; larger ones by search from linked members.
SMALL_BLOCK = 48
_BUFFER = 1 << 16
#: Members of a block that more segments are made beyond, were fingerprints spread evenly.
EXPECTED_BLOCK = 4096
#: Internal column of texts' marks.
MARK = "__docloom_mark"
#: For ``similar_documents``: words of a shingle, the least similarity, and the MinHash bands.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
BANDS = 20
BAND_ROWS = 3
#: Texts that share a bucket are looked up by broadcast up to so many, else by a shuffled join.
BROADCAST_ROWS = 1_000_000
#: Bytes of shingle sets that are gathered before their buckets are searched; a larger bucket is searched whole.
_SET_BYTES = 1 << 23


def fingerprint(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of one UTF-8 text; 0 if it has no word."""
    words = text.lower().split()  # bytes: A-Z, and exactly the ASCII white space
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(join(words), SEED)
    hashes = np.array([digest(join(w), SEED) for w in zip(*(words[i:] for i in range(shingle)), strict=False)], "<u8")
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 18):
        part = hashes[i : i + (1 << 18)].view(np.uint8).reshape(-1, 8)
        votes += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fingerprint BIGINT) for each row. A null text counts as empty; other columns are ignored."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = utf8(b.column(1))
            raw = data.tobytes()
            marks = np.array([fingerprint(raw[off[i] : off[i + 1]], shingle) for i in range(len(off) - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marks.view(np.int64))], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), f"id {kind}, fingerprint bigint")


def _segments(max_distance: int, agree: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments of 64 bits, ``agree`` more than bits may differ."""
    n = max_distance + agree
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _agreement(count: int, max_distance: int) -> int:
    """How many segments a block's members share: so many that a block of fingerprints spread evenly has about EXPECTED_BLOCK members at most."""
    agree = 2
    while agree < 6 and count >> (64 * agree // (max_distance + agree)) > EXPECTED_BLOCK:
        agree += 1
    return agree


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distance_table(marks: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(marks[:, None] ^ pivots()[None]).astype(np.int8)


def _small_links(keys: np.ndarray, marks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the blocks of a sorted run of rows, pair by pair."""
    table, found = distance_table(marks), []
    left, lag = np.arange(len(keys)), 1
    while True:
        left = left[left + lag < len(keys)]
        left = left[keys[left] == keys[left + lag]]
        if not len(left):
            break
        for i in range(0, len(left), _BUFFER):
            a = left[i : i + _BUFFER]
            a = a[(np.abs(table[a] - table[a + lag]) <= most).all(axis=1)]
            a = a[np.bitwise_count(marks[a] ^ marks[a + lag]) <= most]
            found.append((marks[a], marks[a + lag]))
        lag += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (zip(*found, strict=True) if found else ((), ())))


def _block_links(marks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one block: a search in which every member is reached once."""
    table = distance_table(marks)
    order = np.argsort(table[:, 0], kind="stable")
    marks, table = marks[order], table[order]
    rest = np.arange(len(marks))  # not reached yet, by the first coordinate
    one, two = [], []
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            lo, hi = np.searchsorted(table[rest, 0], [table[x, 0] - most, table[x, 0] + most + 1])
            near = np.arange(lo, hi)
            for c in range(1, PIVOTS, 8):
                near = near[(np.abs(table[rest[near], c : c + 8] - table[x, c : c + 8]) <= most).all(axis=1)]
            near = near[np.bitwise_count(marks[rest[near]] ^ marks[x]) <= most]
            if len(near):
                reached = rest[near]
                one.append(np.full(len(reached), marks[x], np.uint64))
                two.append(marks[reached])
                stack.extend(reached)
                rest = np.delete(rest, near)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (one, two))


def _link(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            marks = marks.view(np.uint64)
            bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            sizes = np.diff(bounds)
            small = np.repeat(sizes <= SMALL_BLOCK, sizes)
            links = [_small_links(keys[small], marks[small], most)]
            links += [_block_links(marks[bounds[i] : bounds[i + 1]], most) for i in np.flatnonzero(sizes > SMALL_BLOCK)]
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        keys, marks, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            marks.append(batch.column(1).to_numpy())
            held += len(keys[-1])
            if held >= _BUFFER:
                k, m = np.concatenate(keys), np.concatenate(marks)
                cut = int(np.searchsorted(k, k[-1]))  # the last block may go on
                yield from out(k[:cut], m[:cut])
                keys, marks, held = [k[cut:]], [m[cut:]], 0
        if keys:
            yield from out(np.concatenate(keys), np.concatenate(marks))

    return run


def links(marks: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Links (a < b, BIGINT) between distinct fingerprints; every two in reach are joined by a path of links."""
    agree, keys = _agreement(marks.count(), max_distance), []
    for t, shared in enumerate(combinations(_segments(max_distance, agree), agree)):
        key = F.lit(0).cast("bigint")
        for shift, width in shared:
            key = F.shiftleft(key, width) + F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))
        keys.append(F.lit(t << 40).cast("bigint") + key)
    dealt = marks.select(F.explode(F.array(*keys)).alias("key"), "fingerprint")
    n = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "fingerprint").mapInArrow(frugal(_link(max_distance)), "a bigint, b bigint").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that are no root, from (a, b) rows: alternating large and small stars.

    Rounds grow with the logarithm of a component's size; each is written to the shared
    folder, and only a count and a checksum come to the driver.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialize(edges.where("a != b").select(F.col("b").alias("u"), F.col("a").alias("v")), "links")
    last = state(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(root.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _roots(rows: DataFrame, edges: DataFrame, mark: str) -> DataFrame:
    """(``mark``, root) of all marks in ``rows``: what ``edges`` between marks reach."""
    marks = rows.select(mark).distinct()
    root = connected_components(edges)
    return materialize(marks.join(root, marks[mark] == root.node, "left").select(mark, F.coalesce("root", mark).alias("root")), "roots")


def _components(rows: DataFrame, edges: DataFrame, mark: str) -> DataFrame:
    """``rows`` (id, ``mark``) with the smallest id that ``edges`` between marks reach, as component_id."""
    named = _roots(rows, edges, mark)
    of = rows.groupBy(mark).agg(F.min("id").alias("least")).join(named, mark).groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(of, "root").select(F.col(mark).alias("_mark"), "component_id")
    return rows.join(named, rows[mark] == named["_mark"]).drop("_mark")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fingerprint BIGINT, component_id) for each row of ``docs``.

    ``component_id`` is the smallest id that links reach. Null and empty texts have
    fingerprint 0 and link like any other; a null id takes part but is no component's
    name unless the component has no other (then null). Repeated rows stay repeated.
    """
    rows = materialize(simhash(docs, id_col, text_col, shingle), "fingerprints")
    edges = links(rows.select("fingerprint").distinct(), max_distance)
    return _components(rows, edges, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def shingles(offsets: np.ndarray, data: np.ndarray, size: int = SIMILAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of one block, by document, and each document's first; a text of fewer words has one of all."""
    starts, ends, first = words(offsets, data)
    h = word_hashes(LOWER[data], starts, ends)[0]
    n, found, of = np.diff(first), [], []
    for k in range(1, size + 1):
        at, hashed = windows(h, first, k)
        doc = np.searchsorted(first, at, "right") - 1
        use = n[doc] == k if k < size else n[doc] >= size
        found.append(hashed[use])
        of.append(doc[use])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(of[order], np.arange(len(n) + 1))


def _bands(size: int):
    """Bucket keys of each text, by the minima of its shingles under BANDS * BAND_ROWS permutations; none without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = pivots(2 * BANDS * BAND_ROWS)
        for b in batches:
            off, data = utf8(b.column(2))
            made = [np.zeros((0, BANDS), np.uint64)]
            counts = [np.zeros(0, np.int64)]
            for i, j in blocks(off):
                h, first = shingles(off[i : j + 1] - off[i], data[off[i] : off[j]], size)
                full = np.flatnonzero(np.diff(first))
                keys = np.zeros((len(full), BANDS), np.uint64)
                for k in range(BANDS * BAND_ROWS if len(full) else 0):
                    least = np.minimum.reduceat((h ^ salt[2 * k]) * (salt[2 * k + 1] | np.uint64(1)), first[full])
                    keys[:, k // BAND_ROWS] = mix(keys[:, k // BAND_ROWS] + least + np.uint64(k))
                made.append(keys)
                counts.append(np.where(np.diff(first) > 0, BANDS, 0))
            ends = np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made).reshape(-1).view(np.int64)))], names=["id", "mark", "bands"])

    return run


def _sets(size: int):
    """The sorted distinct shingles of each text, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, data = utf8(b.column(1))
            for i, j in blocks(off):
                h, first = shingles(off[i : j + 1] - off[i], data[off[i] : off[j]], size)
                each = [np.unique(h[x:y]).tobytes() for x, y in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(each, pa.binary())], names=["mark", "shingles"])

    return run


def similar_links(marks: np.ndarray, sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one bucket: a search in which every member is reached once."""
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.cumsum(size) - size
    of = np.arange(len(sets))
    own, seen = np.split(code, start[1:]), np.zeros(code.max() + 1, bool)
    one, two = [], []
    stack: list = []
    while len(of):
        if not stack:
            stack, of = [of[0]], of[1:]
            if not len(of):
                break
            code, start = np.concatenate([own[i] for i in of]), np.cumsum(size[of]) - size[of]
        x = stack.pop()
        seen[own[x]] = True
        shared = np.add.reduceat(seen[code], start, dtype=np.int64)
        seen[own[x]] = False
        near = shared >= least * (size[of] + size[x] - shared) - 1e-9
        if near.any():
            reached, of = of[near], of[~near]
            one.append(np.full(len(reached), marks[x]))
            two.append(marks[reached])
            stack.extend(reached)
            if len(of):
                code, start = np.concatenate([own[i] for i in of]), np.cumsum(size[of]) - size[of]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))


def _search(least: float):
    """Verified links of each bucket in rows (bucket, mark, shingles) sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, marks = t.column(0).to_numpy(), t.column(1).to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in t.column(2).to_pylist()]
            bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            found = [similar_links(marks[i:j], sets[i:j], least) for i, j in zip(bounds, bounds[1:], strict=False)]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list = []
        for b in batches:
            held.append(b)
            keys = b.column(0).to_numpy()
            if len(keys) and sum(x.nbytes for x in held) >= _SET_BYTES and (keys[0] != keys[-1]):
                cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                yield from out(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                rest = b.slice(cut)
                held = [rest.take(pa.array(np.arange(len(rest))))]  # without the bytes before it
        held = [b for b in held if len(b)]
        if held:
            yield from out(pa.Table.from_batches(held))

    return run


def _mark(text_col: str) -> tuple[Column, Column]:
    """A text and its 64-bit mark; texts without a word are one empty text."""
    text = F.col(text_col).cast("string")
    text = F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), text).otherwise("")
    return text, F.xxhash64(text)


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark), and verified links between marks."""
    tune(docs.sparkSession)
    text, mark = _mark(text_col)
    texts = docs.select(F.col(id_col).alias("id"), mark.alias("mark"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialize(texts.mapInArrow(frugal(_bands(shingle)), f"id {kind}, mark bigint, bands array<bigint>"), "bands")
    near = near_duplicates(texts, "mark", "text").select("mark", F.xxhash64(F.lit("simhash"), "component_id").alias("bucket"))
    dealt = rows.select("mark", F.explode("bands").alias("bucket")).unionByName(near).distinct()
    met = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("mark").cast("decimal(38,0)")).alias("who")).where("n > 1")
    met = met.groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket")  # one of the buckets with the same members
    members = materialize(dealt.join(met, "bucket").select("bucket", "mark"), "buckets")
    some = materialize(members.select("mark").distinct(), "met")
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    sets = texts.join(some, "mark", "left_semi").select("mark", "text").dropDuplicates(["mark"])
    sets = materialize(sets.mapInArrow(frugal(_sets(shingle)), "mark bigint, shingles binary"), "shingles")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = members.join(sets, "mark").select("bucket", "mark", "shingles").repartition(n, "bucket").sortWithinPartitions("bucket")
    return rows.select("id", "mark"), buckets.mapInArrow(frugal(_search(least)), "a bigint, b bigint").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """(id, component_id) for each row of ``docs``: texts that meet by SimHash or MinHash are linked if their sets of word shingles have a Jaccard similarity of ``least`` or more.

    ``component_id`` is as in ``near_duplicates``. Texts without a word are one text.
    """
    rows, edges = _similar(docs, id_col, text_col, shingle, least)
    return _components(rows, edges, "mark").select(F.col("id").alias(id_col), "component_id")


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_WORDS, least: float = SIMILARITY) -> DataFrame:
    """One row of each group that ``similar_documents`` links, with all columns: that with the smallest id (null last).

    Rows are told apart by id and text, so an id that several texts share loses none that
    is unique. Of rows with both alike one stays, whatever their other columns hold.
    """
    rows, edges = _similar(docs, id_col, text_col, shingle, least)
    counted = rows.groupBy("id", "mark").agg(F.count("*").alias("n")).join(_roots(rows, edges, "mark"), "mark")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    first = counted.groupBy("root").agg(F.min(order).alias("first"))
    judged = counted.join(first, "root").select("id", "mark", "n", (order == F.col("first")).alias("stays"))
    judged = materialize(judged.where("n > 1 or not stays"), "judged")
    own = docs.columns
    docs = docs.withColumn(MARK, _mark(text_col)[1])

    def among(condition: str, how: str, of: DataFrame) -> DataFrame:
        some = judged.where(condition).select(F.col("id").alias("_id"), "mark")
        some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
        return of.join(some, of[id_col].eqNullSafe(some["_id"]) & (of[MARK] == some["mark"]), how)

    out = among("not stays", "left_anti", docs)
    if judged.where("stays").limit(1).count():
        out = among("stays", "left_anti", out).unionByName(among("stays", "left_semi", out).dropDuplicates([id_col, MARK]))
    return out.select(*own)


def op3_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint as 16 hex digits, and its component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
