"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Pieces are dealt to blocks of about ``BLOCK_ITEMS`` by a hash of their row number, so a
block's size doesn't depend on any key. Each block is packed by several islands: on an
island, individuals are lists of bins; crossover injects whole well-filled bins of one
parent into the other, drops the bins that hold the same pieces twice, and best-fits the
displaced pieces in decreasing length. After an epoch each island's elite migrates to the
next island. Bins that stay poorly filled are opened again and their pieces dealt anew
together with those of other blocks, until one block holds what is left.
"""

from __future__ import annotations

import array
import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import frugal, materialize, release, tune
from .textblocks import LOWER, SPACE, blocks, utf8, word_hashes

SEQUENCE_TOKENS = 4096
END_ID = 1
BLOCK_ITEMS = 2048
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
#: An island goes on for so many generations at most, and until the bound is met or so many in a row found nothing better.
GENERATIONS = 400
STALLED = 40
#: Displaced pieces whose pairs are tried in exchange for pairs of a bin.
PAIRED = 24
#: A bin filled less than so is opened again in the next round.
WELL_FILLED = 0.995
#: Rounds end when one block is left, or when a round has filled too few bins: of its pieces more than this share came back.
LEAST_GAIN = 0.9
#: Bytes of text that are encoded together: bounds the temporary arrays.
ENCODED_BYTES = 1 << 19
#: Bounds of a worker's memo of white-space delimited chunks.
MEMO_CHUNKS = 200_000
#: Chunks that an idle worker keeps for its next partition.
KEPT_CHUNKS = 40_000
MEMO_BYTES = 48
_memo: dict[str, Encoder] = {}
_ALNUM = np.array([b < 0x80 and chr(b).isalnum() for b in range(256)])
_PUNCTUATION = np.array([0x20 < b < 0x7F and not chr(b).isalnum() for b in range(256)])


class Encoder:
    """Ids of texts by one tokenizer, a block of texts at once.

    The tokenizer never joins across white space, nor an ASCII letter or digit with the
    punctuation after it, so texts are cut there and every distinct chunk of a block is
    encoded once. Chunks are known by their 64-bit hashes; those encoded before come from
    a bounded memo. Unknown chunks of letters are encoded together, and told apart by the
    tokens that end a word. A text that may hold a special token is encoded whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_str(spec), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        normal = json.loads(spec).get("normalizer") or {}
        if "Lowercase" not in [x.get("type") for x in [normal, *normal.get("normalizers", [])]] or not self.ends.any():
            raise ValueError("the tokenizer must lower-case, drop white space and mark the ends of words")

    def _each(self, chunks: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in chunks], add_special_tokens=False)
        return [array.array("I", e.ids).tobytes() for e in found]

    def _together(self, chunks: list[bytes]) -> list[bytes]:
        """Of chunks of letters."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(chunks).decode()], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(chunks):
            return self._each(chunks)
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _chunks(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        solid = ~SPACE[data]
        begins, stops = solid.copy(), solid.copy()
        cut = _PUNCTUATION[data[1:]] & _ALNUM[data[:-1]]
        inner = ~solid[:-1] | cut
        begins[1:] &= inner
        stops[:-1] &= ~solid[1:] | cut
        full = off[1:] > off[:-1]
        begins[off[:-1][full]], stops[off[1:][full] - 1] = solid[off[:-1][full]], solid[off[1:][full] - 1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, off)

    def encode(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and where each text's begin (one more than texts)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        data = LOWER[data]
        starts, ends, first = self._chunks(off, data)
        hashes, at, inverse = np.unique(word_hashes(data, starts, ends)[0], return_index=True, return_inverse=True)
        if len(self.known) > MEMO_CHUNKS:
            self.shrink(MEMO_CHUNKS // 2)
        known, keys, raw = self.known, hashes.tolist(), data.tobytes()
        new = [i for i, k in enumerate(keys) if k not in known]
        a, b = starts[at[new]].tolist(), ends[at[new]].tolist()
        letters, others, long = ([], []), ([], []), []
        for i, s, e in zip(new, a, b, strict=True):
            c = raw[s:e]
            to = letters if c.isalpha() or (not c.isascii() and c.decode("utf-8", "replace").isalpha()) else others
            to[0].append(keys[i])
            to[1].append(c)
            if e - s > MEMO_BYTES:
                long.append(keys[i])
        for (ks, cs), encode in ((letters, self._together), (others, self._each)):
            for i in range(0, len(cs), 2000):
                known.update(zip(ks[i : i + 2000], encode(cs[i : i + 2000]), strict=True))
        table = [known[k] for k in keys]
        for k in long:
            del known[k]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, begin = np.frombuffer(b"".join(table), np.uint32), np.cumsum(sizes) - sizes
        sizes, begin = sizes[inverse], begin[inverse]
        total = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=total[1:])
        return flat[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])], total[first]

    def shrink(self, most: int) -> None:
        """Keep the chunks that came first: the frequent ones."""
        self.known = dict(islice(self.known.items(), most))

    def texts(self, off: np.ndarray, data: np.ndarray) -> Iterator[bytes]:
        """Each text's ids as little-endian bytes."""
        for i, j in blocks(off, ENCODED_BYTES):
            part = data[off[i] : off[j]]
            ids, at = self.encode(off[i : j + 1] - off[i], part)
            raw, at, special = ids.tobytes(), (4 * at).tolist(), b"<|" in part.tobytes()
            for k in range(j - i):
                own = part[off[i + k] - off[i] : off[i + k + 1] - off[i]].tobytes() if special else b""
                yield self._each([own])[0] if b"<|" in own else raw[at[k] : at[k + 1]]


def _encoder(spec: str) -> Encoder:
    """Kept for a worker's life."""
    if spec not in _memo:
        _memo.clear()
        _memo[spec] = Encoder(spec)
    return _memo[spec]


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, most: int = SEQUENCE_TOKENS) -> DataFrame:
    """Pieces of each document: id, piece, start, length, ``tokens`` (little-endian unsigned 32-bit ids).

    Null texts count as empty and give one piece that holds ``end_id``; only documents over
    ``most`` ids are cut.
    """
    tune(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = array.array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(spec.value)
        for b in batches:
            rows = []
            for k, ids in enumerate(encoder.texts(*utf8(b.column(1)))):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at : at + 4 * most]
                    rows.append((k, p, at // 4, len(part) // 4, part))
            if rows:
                which, *cols = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", "piece", "start", "length", "tokens"])
        encoder.shrink(KEPT_CHUNKS)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run, "docloom.llm.packing"), f"id {kind}, piece int, start bigint, length bigint, tokens binary").withColumnRenamed("id", id_col)


def best_fit(bins: list[list[int]], lengths: list[int], items: list[int], room: int) -> list[list[int]]:
    """Put ``items``, longest first, each into the open bin it fills best, else into a new one."""
    free = sorted((room - sum(lengths[x] for x in b), k) for k, b in enumerate(bins))
    for x in sorted(items, key=lambda x: (-lengths[x], x)):
        n = lengths[x]
        at = bisect_left(free, (n, -1))
        if at < len(free):
            left, k = free.pop(at)
            bins[k].append(x)
        else:
            left, k = room, len(bins)
            bins.append([x])
        if left > n:
            insort(free, (left - n, k))
    return bins


def fitness(bins: list[list[int]], lengths: list[int], room: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (the sum of squared fills)."""
    return -len(bins), sum((sum(lengths[x] for x in b) / room) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], room: int, rng: Random) -> list[list[int]]:
    """Inject a random half of the well-filled bins of ``a`` into ``b``."""
    ranked = sorted((x for x in a), key=lambda x: -sum(lengths[i] for i in x))
    good = [x for x in ranked if sum(lengths[i] for i in x) >= WELL_FILLED * room] or ranked[: max(1, len(ranked) // 2)]
    taken = [x for x in good if rng.random() < 0.5] or good[:1]
    used = {i for x in taken for i in x}
    child, displaced = [list(x) for x in taken], []
    for x in b:
        if used.isdisjoint(x):
            child.append(list(x))
        else:
            displaced += [i for i in x if i not in used]
    return best_fit(child, lengths, displaced, room)


def exchange(bins: list[list[int]], lengths: list[int], displaced: list[int], room: int, rng: Random) -> list[int]:
    """Fill bins better (in place) with displaced pieces for one or two of their own; what is displaced then, in smaller pieces."""
    for k in rng.sample(range(len(bins)), len(bins)):
        own = bins[k]
        free = room - sum(lengths[x] for x in own)
        if not free or not displaced:
            continue
        some = displaced if len(displaced) <= PAIRED else rng.sample(displaced, PAIRED)
        offers = sorted([(lengths[x], (x,)) for x in displaced] + [(lengths[x] + lengths[y], (x, y)) for i, x in enumerate(some) for y in some[:i]])
        wanted = [()] + [(x,) for x in own] + [(x, y) for i, x in enumerate(own[:PAIRED]) for y in own[:i]]
        best = (0, (), ())
        for out in wanted:
            size = sum(lengths[x] for x in out)
            at = bisect_left(offers, (size + free + 1,)) - 1
            if at >= 0 and offers[at][0] - size > best[0]:
                best = (offers[at][0] - size, out, offers[at][1])
        if best[0]:
            bins[k] = [x for x in own if x not in best[1]] + list(best[2])
            displaced = [x for x in displaced if x not in best[2]] + list(best[1])
    return displaced


def mutate(bins: list[list[int]], lengths: list[int], room: int, rng: Random) -> list[list[int]]:
    """Open the emptiest bin and a few others, exchange their pieces for those of other bins, and best-fit what is left."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[x] for x in bins[k]))
    opened = {*order[:2], *rng.sample(order, min(len(order), 4))}
    rest = [list(x) for k, x in enumerate(bins) if k not in opened]
    displaced = exchange(rest, lengths, [i for k in sorted(opened) for i in bins[k]], room, rng)
    return best_fit(rest, lengths, displaced, room)


def evolve(lengths: list[int], elites: list[list[list[int]]], room: int, seed: int, generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing that an island finds from the ``elites`` that came to it."""
    rng = Random(seed)
    least = -(-sum(lengths) // room)
    found = [e for e in elites if e] or [best_fit([], lengths, list(range(len(lengths))), room)]
    while len(found) < POPULATION and len(found[0]) > least:
        items = list(range(len(lengths)))
        rng.shuffle(items)
        cut = rng.randrange(len(items) // 2 + 1)
        found.append(best_fit(best_fit([], lengths, items[:cut], room), lengths, items[cut:], room))
    found = sorted(((fitness(x, lengths, room), x) for x in found), key=lambda p: p[0], reverse=True)
    stalled = 0
    for _ in range(generations):
        if -found[0][0][0] <= least or len(found) < 2 or stalled == STALLED:
            break
        a, b = rng.sample(range(len(found)), 2)
        child = mutate(crossover(found[min(a, b)][1], found[max(a, b)][1], lengths, room, rng), lengths, room, rng)
        made = (fitness(child, lengths, room), child)
        stalled = 0 if made[0] > found[0][0] else stalled + 1
        found[-1] = max(found[-1], made, key=lambda p: p[0])
        found.sort(key=lambda p: p[0], reverse=True)
    return found[0][1]


_PLACED = "block bigint, island int, row bigint, length bigint, bin bigint, at bigint"


def _island(room: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One group: the pieces of a block, once for each elite that came (column ``bin`` is negative without any)."""
        release()
        block, island = int(key[0]), int(key[1])
        origins = sorted(rows.origin.unique(), key=lambda o: (o != island, o))
        rows = rows.sort_values(["origin", "row"])
        items = rows[rows.origin == origins[0]]
        lengths, elites = items.length.tolist(), []
        for o in origins:
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(rows[rows.origin == o].bin.tolist()):
                if b >= 0:
                    bins.setdefault(b, []).append(i)
            elites.append(list(bins.values()))
        best = evolve(lengths, elites, room, (block * 31 + island) * 31 + epoch, GENERATIONS if epoch < EPOCHS else 0)
        out = []
        for k, members in enumerate(best):
            at = 0
            for i in members:
                out.append((k, i, at))
                at += lengths[i]
        bin_, which, at = zip(*out, strict=True)
        picked = items.iloc[list(which)]
        return pd.DataFrame({"block": block, "island": island, "row": picked.row.to_numpy(), "length": picked.length.to_numpy(), "bin": bin_, "at": at})

    return run


def _evolve_blocks(items: DataFrame, room: int, blocks: int, deal: int) -> DataFrame:
    """The best packing of each block, as rows of ``_PLACED``."""
    block = F.pmod(F.xxhash64("row", F.lit(deal)), F.lit(blocks))
    now = items.select(block.alias("block"), "row", "length", F.lit(-1).cast("bigint").alias("bin")).withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS))))).withColumn("origin", F.col("island"))
    for epoch in range(EPOCHS + 1):
        now = now.select("block", "island", "origin", "row", "length", "bin").groupBy("block", "island").applyInPandas(_island(room, epoch), _PLACED)
        if epoch + 1 < EPOCHS:  # the elite stays, and migrates to the next island
            now = now.withColumn("origin", F.col("island")).withColumn("island", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)))
        elif epoch < EPOCHS:  # at last the elites of all islands meet, and the best is kept
            now = now.withColumn("origin", F.col("island")).withColumn("island", F.lit(0))
    return now


def pack(pieces: DataFrame, room: int = SEQUENCE_TOKENS) -> DataFrame:
    """All columns of ``pieces`` with ``sequence_id`` and ``offset`` (these replace columns so named).

    ``length`` is a piece's size, from 1 to ``room``; null, zero and negative ones count
    as zero and get a sequence of their own. Repeated rows are packed each.
    """
    size = F.greatest(F.coalesce(F.col("length").cast("bigint"), F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))
    own = F.struct(*(F.col(f"`{c}`") for c in pieces.columns if c not in ("sequence_id", "offset")))
    rows = materialize(pieces.select(own.alias("piece"), F.monotonically_increasing_id().alias("_row"), size.alias("_size")), "pieces")
    if rows.where(F.col("_size") > room).limit(1).count():
        raise ValueError(f"a piece is longer than {room}")
    alone = F.col("_size").isin(0, room)
    whole = rows.where(alone).select("_row", (F.lit(1 << 62) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    done, left = [whole], rows.where(~alone).select(F.col("_row").alias("row"), F.col("_size").alias("length"))
    before = deal = 0
    while n := left.count():
        blocks = -(-n // BLOCK_ITEMS)
        placed = materialize(_evolve_blocks(left, room, blocks, deal), "packed")
        number = F.shiftleft(F.lit(deal).cast("bigint"), 54) + F.shiftleft(F.col("block"), 24) + F.col("bin")
        last = blocks == 1 or (deal and n > LEAST_GAIN * before)
        fills = placed.groupBy("block", "bin").agg(F.sum("length").alias("fill"))
        keep = placed if last else placed.join(fills.where(F.col("fill") >= WELL_FILLED * room), ["block", "bin"], "left_semi")
        done.append(keep.select(F.col("row").alias("_row"), number.alias("sequence_id"), F.col("at").alias("offset")))
        if last:
            break
        left = materialize(placed.join(fills.where(F.col("fill") < WELL_FILLED * room), ["block", "bin"], "left_semi").select("row", "length"), "opened")
        before, deal = n, deal + 1
    where = done[0]
    for d in done[1:]:
        where = where.unionByName(d)
    return rows.join(where, "_row").select("piece.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, room: int = SEQUENCE_TOKENS, tokens: bool = False) -> DataFrame:
    """Where each piece of each document lies: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``tokens`` its ids too (little-endian unsigned 32-bit)."""
    pieces = tokenize(docs, tokenizer_path, most=room)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), *["tokens"] * tokens), room)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
