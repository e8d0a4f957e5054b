"""The ten operators against brute force, and on rows with nulls, repeats, empties and clashing names."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from docloom.llm import chat_format, decontamination, language_id, near_dedup, packing, quality, registry, sharding, substring_dedup, textblocks, topk, toxicity

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, columns with the operators' own names."""
    rows = [(None, "a b c", "en"), (1, None, None), (2, "", "en"), (3, LONG, "de"), (4, LONG, "de"), (4, LONG, "de"), (5, " \t\n", "en"), (6, "one", None), (7, "é ü <|endoftext|> 日本", "xx")]
    rows = [(*r, "s", 1, "x", 2, 3, "k", 4, 5, 0.5, 6) for r in rows]
    names = "lang string, source string, n_chars long, kept string, shard int, slot long, key string, sequence_id long, offset long, score double, n_words long"
    return spark.createDataFrame(rows, f"doc_id long, text string, {names}")


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_block_words_and_hashes():
    texts = ["a bb  ccc", "", " x\ta bb ", "é bb"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, first = textblocks.words(off, data)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == [w for r in raw for w in r.split()] and first.tolist() == [0, 3, 3, 6, 8]
    h = textblocks.word_hashes(data, starts, ends)[0]
    assert len({w: x for w, x in zip(found, h)}) == len(set(h.tolist()))
    at, w = textblocks.windows(h, first, 2)
    assert at.tolist() == [0, 1, 3, 4, 6] and w[0] == w[3] and len(set(w.tolist())) == 4


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    mine = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert sorted(names) == sorted(df.columns) and mine == sorted(found.fetchall())


def test_topk_buckets_of_many_lengths():
    rng = np.random.default_rng(1)
    p = (rng.normal(size=(500, 12)) * rng.lognormal(1, 1, (500, 1)) * 20).astype(np.int64)
    q, ids = p[:40], np.arange(500)
    scores = q @ p.T
    for bounds in (np.full(40, np.iinfo(np.int64).min), np.sort(np.where(ids[None] == ids[:40, None], -(1 << 60), scores), 1)[:, -5]):
        for i, got, s in topk.search_block(ids[:40], q, bounds, ids, p, 5):
            want = sorted((-x, j) for j, x in enumerate(scores[i[0]]) if j != i[0])[:5]
            assert list(zip((-s).tolist(), got.tolist())) == want


def test_topk_in_many_blocks(spark, monkeypatch):
    """Several dimensions, very different lengths, one vector a third of all; small blocks, groups and first looks."""
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=6 if i % 7 else 3) * rng.lognormal(0, 1.5) * 3).tolist()) for i in range(600)]
    rows = [(i, [1.0, 2.0, -1.0, 0.5, 0.0, 3.0]) if i % 3 == 1 else (i, v) for i, v in rows]
    for name, value in (("BUCKET_ROWS", 40), ("QUERY_ROWS", 13), ("GROUP_BUCKETS", 3), ("PLAN_PARTS", 4), ("CHUNK_ROWS", 5)):
        monkeypatch.setattr(topk, name, value)
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = {r.id: np.array(r.vector) for r in vectors.collect()}
    want = set()
    for q in range(0, 600, 20):
        best = sorted((-int(held[q] @ v), i) for i, v in held.items() if i != q and len(v) == len(held[q]))[:7]
        want |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    for looks in (16, 0):
        monkeypatch.setattr(topk, "FIRST_LOOKS", max(looks, 1))
        monkeypatch.setattr(topk, "SEED_BYTES", 1 << 26 if looks else 1)
        assert {tuple(r) for r in topk.top_k(vectors, lambda i: i % 20 == 0, 7).collect()} == want


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (20, [0.0, 0.0]), (6, [])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted(tuple(r) for r in topk.top_k(vectors, lambda i: i % 20 == 0).collect())
    assert got == [(0, 1, 1, 64 * 64 * 5), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert topk.top_k(vectors.where("false"), lambda i: i % 20 == 0).count() == 0


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    pieces = packing.tokenize(odd, tokenizer_path()).collect()
    text = {r.doc_id: r.text for r in odd.collect()}
    by = defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.doc_id or -1, p.piece)):
        by[p.doc_id].append(p)
    for i, ps in by.items():
        want = [*t.encode(text[i] or "", add_special_tokens=False).ids, 1]
        got = [x for p in ps[:: 2 if i == 4 else 1] for x in np.frombuffer(p.tokens, "<u4").tolist()]
        assert got == want, i
    packed = packing.pack_documents(odd, tokenizer_path()).collect()
    assert len(packed) == len(pieces)
    seqs = defaultdict(list)
    for r in packed:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_packing_is_near_its_bound():
    from random import Random

    rng = Random(3)
    lengths = [rng.randint(1, 1500) for _ in range(600)]
    bins = packing.evolve(lengths, [], 4096, 1)
    assert sorted(i for b in bins for i in b) == list(range(600))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 4096) + 1


def test_islands_search_beyond_best_fit():
    from random import Random

    rng = Random(3)
    lengths = [rng.randint(900, 1700) for _ in range(600)]
    best_fit, bins = packing.best_fit([], lengths, list(range(600)), 4096), packing.evolve(lengths, [], 4096, 1)
    assert sorted(i for b in bins for i in b) == list(range(600)) and all(sum(lengths[i] for i in b) <= 4096 for b in bins)
    assert len(best_fit) == 204 and len(bins) <= -(-sum(lengths) // 4096) + 2


def test_simhash_by_hand(docs, odd, none):
    def by_hand(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = SPLIT.findall(t)
        hs = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    marks = {i: r.fingerprint % (1 << 64) for i, r in got.items()}
    assert all(marks[i] == by_hand(rows[i]) for i in list(rows)[:40])
    group = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for i in marks:
            for j in marks:
                if group[i] != group[j] and (marks[i] ^ marks[j]).bit_count() <= 4:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    assert {i: r.component_id for i, r in got.items()} == group
    found = sorted((r.doc_id or -1, r.component_id) for r in near_dedup.near_duplicates(odd).collect())
    assert len(found) == 9 and (2, 1) in found and (5, 1) in found and found.count((4, 3)) == 2
    assert near_dedup.near_duplicates(none).count() == 0


def test_more_segments_link_the_same(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    marks = [int(b) for b in base] + [int(b) ^ sum(1 << int(x) for x in rng.choice(63, rng.integers(1, 7), False)) for b in base for _ in range(3)]
    frame = spark.createDataFrame([(m,) for m in set(marks)], "fingerprint long")

    def groups():
        group = {m: m for m in marks}
        found = [tuple(r) for r in near_dedup.links(frame).collect()]
        for _ in marks:
            for a, b in found:
                group[a] = group[b] = min(group[a], group[b])
        return group

    want = {m: m for m in marks}
    for _ in range(6):
        for a in marks:
            for b in marks:
                if (a ^ b).bit_count() <= 4:
                    want[a] = want[b] = min(want[a], want[b])
    assert near_dedup._agreement(10**6, 4) == 2 and near_dedup._agreement(10**11, 4) == 3 and near_dedup._agreement(10**13, 4) == 4
    for agree in (2, 3, 5):
        monkeypatch.setattr(near_dedup, "_agreement", lambda *_, agree=agree: agree)
        assert groups() == want


def test_similar_documents_by_brute_force(spark, docs, odd, none):
    sets = {}
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in group:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    assert {r.doc_id: r.component_id for r in near_dedup.similar_documents(docs).collect()} == group
    pipeline = pytest.importorskip("corpus_pipeline")
    kept = pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))
    found = sorted((r.doc_id or -1, r.component_id) for r in near_dedup.similar_documents(odd).collect())
    assert len(found) == 9 and (2, 1) in found and (5, 1) in found and found.count((4, 3)) == 2
    assert near_dedup.similar_documents(none).count() == 0


def test_a_bucket_links_as_all_pairs_do():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, (3, 60), dtype=np.uint64)
    sets = []
    for b in base:
        for _ in range(25):
            s = b.copy()
            s[rng.choice(60, 3, False)] = rng.integers(0, 1 << 60, 3, dtype=np.uint64)
            sets.append(np.unique(s))
    a, b = near_dedup.similar_links(np.arange(len(sets)), sets)
    group = list(range(len(sets)))
    for _ in sets:
        for x, y in zip(a.tolist(), b.tolist()):
            group[x] = group[y] = min(group[x], group[y])
    assert group == [k // 25 * 25 for k in range(75)] and len(a) == 72


def test_dense_and_sparse_blocks_link_alike():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    marks = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for b in base]))

    def parts(a, b):
        group = {int(m): int(m) for m in marks}
        for _ in marks:
            for x, y in zip(a.tolist(), b.tolist()):
                group[x] = group[y] = min(group[x], group[y])
        return group

    assert parts(*near_dedup._block_links(marks, 4)) == parts(*near_dedup._small_links(np.zeros(len(marks), np.int64), marks, 4))


def test_chat_round_trip(spark):
    marks = "".join(chat_format.CONTROL)
    rows = [(1, 2, "user", "x"), (1, 1, "user", f"a\\{marks}\\"), (1, 3, "assistant", None), (1, 4, "assistant", "\n<|also|>"), (None, None, None, ""), (2, 1, "assistant", "é"), (2, 1, "assistant", "é")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    got = {r.conv_id: r for r in chat_format.format_conversations(df).withColumn("back", chat_format.read_turns(chat_format.F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("user", f"a\\{marks}\\"), ("user", "x"), ("assistant", ""), ("assistant", "\n<|also|>")]
    assert [tuple(t) for t in got[2].back] == [("assistant", "é")] * 2 and [tuple(t) for t in got[None].back] == [("", "")]
    assert all("".join(s.text for s in r.segments) == r.formatted for r in got.values())
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_language_held_out(spark, odd, none):
    d = f"{SF.replace('0.001', '0.01')}"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in language_id.op5_language_id(spark, d).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got]) > 0.97
    net = language_id.train(odd)
    found = {r.doc_id: r for r in language_id.predict(odd, net).collect()}
    assert len(found) == 8 and found[1].lang_pred == found[2].lang_pred == found[5].lang_pred == "und" and found[3].lang_pred in {"en", "de", "xx"}
    assert language_id.predict(none, language_id.train(none)).count() == 0


def test_every_language_is_learned(spark):
    F = language_id.F
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i * 80 + k, " ".join([letters[k % 26] * 3 + letters[k // 26]] * 12), f"l{k}") for i in range(8) for k in range(80)]
    net = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == sorted(f"l{k}" for k in range(80))
    many = spark.range(200_000).select(F.sum(language_id.sampled(F.lit(10**9), 10**6, "id").cast("long")), F.sum(language_id.sampled(F.lit(10**15), 10**6, "id").cast("long")), F.sum(language_id.sampled(F.lit(3), 600, "id").cast("long"))).first()
    assert 120 < many[0] < 290 and many[1] == 0 and many[2] == 200_000
    bound = spark.range(1).select((F.least(F.lit(1.0), F.lit(600.0) / F.lit(10**12)) * float(1 << 62)).cast("bigint")).first()[0]
    assert bound > 10**9


def test_toxicity(spark, docs, odd, none):
    rows = [(i, ("you vile rotter " if i % 4 == 0 else "a calm day ") + f"word{i % 13} with other things word{i % 7}", i % 4 == 0) for i in range(600)]
    made = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.train(made, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(made, model).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i] == int(x) for i, x in held)
    found = toxicity.score(odd, model).collect()
    assert len(found) == 9 and all(0 <= r.score <= 1 for r in found) and not any(r.predicted for r in found if not (r.text or "").strip())
    empty = toxicity.train(none, labels.where("false"))
    assert toxicity.score(none, empty).count() == 0 and {r.predicted for r in toxicity.score(odd, empty).collect()} == {0}


def test_toxicity_learns_from_every_allowed_document(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 3 != 1]
    F = toxicity.F
    out = {r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").where(F.pmod(F.xxhash64("id"), F.lit(toxicity.CALIBRATION_PART)) == 0).collect()}
    kept_out = [i for i in ids if i in out]
    rows = [(i, f"a calm day {i * i}q {i}z", 0) for i in ids] + [(i + 10_000, "a calm day vile rotter", 1) for i in range(60)]
    rows = [(i, "a calm day wicked grub" if i in kept_out[:40] else t, 1 if i in kept_out[:40] else x) for i, t, x in rows]
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(made.select("doc_id", "text"), made.select("doc_id", "toxic"))
    key, first = toxicity._tokens(np.array([0, 11]), np.frombuffer(b"wicked grub", np.uint8))
    assert (model.parts[0].value.differences(key) > 0).all()


def test_toxicity_keeps_expressions_whatever_the_size(spark, monkeypatch):
    rows = [(i, "a calm day vile rotter" if i < 18 else f"a calm day {i * i}q {i}z" if i < 300 else "a calm day " * 90_000) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i < 18)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(made, labels)
    got = {r.doc_id: r.score for r in toxicity.score(made, model).select("doc_id", "score").collect()}
    assert min(got[i] for i in range(18)) > 0.5 > max(got[i] for i in range(18, 400))
    monkeypatch.setattr(toxicity, "PART_ENTRIES", 1)
    cut = toxicity.train(made, labels)
    assert len(model.parts) == 1 and len(cut.parts) > 3
    assert {r.doc_id: r.score for r in toxicity.score(made, cut).select("doc_id", "score").collect()} == pytest.approx(got)


def test_toxicity_by_hand(spark):
    """Every word's difference, computed by plain loops over words, first five and first four bytes."""
    rng = np.random.default_rng(7)
    ids = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1]
    stock = [f"{a}{b}" for a in ("same", "sample", "rott", "rotte", "other") for b in ("", "n", "ng", "ner", "x1", "x2")]
    toxic = {i: int(rng.random() < 0.3) for i in ids}
    text = {i: [str(w) for w in rng.choice(stock[12:18] if toxic[i] and rng.random() < 0.6 else stock[:14] + stock[18:], 8)] for i in ids}
    counts = {shift: defaultdict(lambda: [0, 0]) for shift in toxicity.LEVELS}
    for i in ids:
        for w in set(text[i]):
            for shift, key in zip(toxicity.LEVELS, (w[:4], w[:5], w)):
                counts[shift][key][1 - toxic[i]] += 1
    total = [sum(c[k] for c in counts[0].values()) for k in (0, 1)]

    def smoothed(count, n, below):
        e = n * below
        return (e + np.sign(count - e) * max(abs(count - e) - 0.75 - 3 * e**0.5, 0)) / n

    p = {}
    for shift, cut, above in ((36, 4, None), (20, 5, 36), (0, 99, 20)):
        for key, c in counts[shift].items():
            stem = key[: {36: 4, 20: 4, 0: 5}[shift]]
            below = [sum(c) / sum(total)] * 2 if above is None else [p[above, stem][k] * sum(c) / sum(counts[above][stem]) for k in (0, 1)]
            p[shift, key] = [smoothed(c[k], total[k], below[k]) for k in (0, 1)]
    made = spark.createDataFrame([(i, " ".join(text[i]), toxic[i]) for i in ids], "doc_id long, text string, toxic int")
    model = toxicity.train(made.select("doc_id", "text"), made.select("doc_id", "toxic"))
    told = 0
    for w in {w for ws in text.values() for w in ws}:
        want = np.log(p[0, w][0] / p[0, w][1])
        key, _ = toxicity._tokens(np.array([0, len(w)]), np.frombuffer(w.encode(), np.uint8))
        got = model.parts[0].value.differences(key)[0]
        assert got == pytest.approx(np.sign(want) * max(abs(want) - toxicity.SLACK, 0), abs=1e-5), w
        told += got > 0
    assert told


def test_toxicity_on_the_labels(spark):
    d = SF.replace("0.001", "0.01")
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(marks[r.doc_id], r.predicted) for r in toxicity.op6_toxicity(spark, d).collect() if r.held_out and r.doc_id in marks]
    caught, flagged = [p for x, p in held if x], [x for x, p in held if p]
    assert np.mean(caught) >= 0.8 and np.mean(flagged) >= 0.9


def perplexity_by_hand(trusted, text):
    """Interpolated modified Kneser-Ney over up to five bytes, with plain dictionaries; also p(byte after context)."""
    runs = [defaultdict(int) for _ in range(6)]
    for t in trusted:
        raw = b"\0" * 4 + t.encode().lower()
        for i in range(4, len(raw)):
            runs[5][raw[i - 4 : i + 1]] += 1
    for k in (4, 3, 2, 1):
        for r in runs[k + 1]:
            runs[k][r[1:]] += 1
    discount = [None] + [quality.discounts(*(sum(n == i for n in runs[k].values()) for i in (1, 2, 3, 4))) for k in range(1, 6)]
    total, left = [defaultdict(float) for _ in range(6)], [defaultdict(float) for _ in range(6)]
    for k in range(1, 6):
        for r, n in runs[k].items():
            total[k][r[:-1]] += n
            left[k][r[:-1]] += discount[k][min(n, 3) - 1]

    def p(r):
        if not r:
            return 1 / 256
        k, n = len(r), runs[len(r)].get(r, 0)
        if not total[k][r[:-1]]:
            return p(r[1:])
        return ((n - discount[k][min(n, 3) - 1] if n else 0) + left[k][r[:-1]] * p(r[1:])) / total[k][r[:-1]]

    raw = b"\0" * 4 + text.encode().lower()
    logs = [np.log(p(raw[i - 4 : i + 1])) for i in range(4, len(raw))]
    return np.exp(-np.mean(logs)), p


def test_quality_by_hand(spark, monkeypatch):
    trusted = ["The cat sat on the mat. The cat ate the rat.", "Ein Hund läuft über die Straße. " * 3, "a", "aaaa aaab aaac"]
    others = ["The dog sat on the log", "zzzz qqqq \x01", "über", "日本", "A"]
    rows = [(i, t, "en") for i, t in enumerate(trusted + others)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(trusted))], "doc_id long, quality int")
    want = {i: perplexity_by_hand(trusted, t)[0] for i, t, _ in rows}
    _, p = perplexity_by_hand(trusted, "x")
    for context in (b"\0\0\0\0", b"the ", b"zzzz", b" cat"):
        assert sum(p(context + bytes([x])) for x in range(256)) == pytest.approx(1)
    for entries in (quality.PART_ENTRIES, 7):
        monkeypatch.setattr(quality, "PART_ENTRIES", entries)
        model = quality.train(docs_.where(f"doc_id < {len(trusted)}"))
        assert (len(model.parts) > 20) == (entries == 7)
        got = {r.doc_id: r.perplexity for r in quality.perplexities(docs_, model).collect()}
        assert got == pytest.approx(want, rel=1e-5)
    assert {r.doc_id: r.perplexity for r in quality.classify(docs_, labels).collect()} == pytest.approx(want, rel=1e-5)


def test_quality(spark, docs, odd, none):
    d = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in quality.op7_quality_classifier(spark, d).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    keep = lambda q: np.mean([got[i].keep for i, x in marks.items() if x == q])
    assert keep(1) > 0.98 and keep(0) < 0.2
    labels = spark.createDataFrame([(3, 1), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.classify(odd, labels).collect()}
    assert len(found) == 8 and found[3].keep and not found[1].keep and not found[2].keep and found[2].perplexity is None
    assert quality.classify(none, labels).count() == 0 and quality.classify(odd, labels.where("false")).where("keep").count() == 7


def kept_by_hand(rows, size=13):
    first, out = {}, {}
    for i, t in rows:
        w = SPLIT.findall(t or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = SPLIT.findall(t or "")
        gone = {x for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for x in range(k, k + size)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substring_batches_and_compaction(spark, odd, none):
    rng = np.random.default_rng(4)
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 50, 30)) + (f" {shared} " if i % 3 == 0 else " ") + "t " * (i % 20)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from docloom.llm.storage import fresh_path

    index = substring_dedup.SubstringIndex(spark, fresh_path(spark, "test-index"), 4, fanout=2)
    claims = None
    for a in range(0, 60, 15):
        c = index.add(df.where(f"doc_id >= {a} and doc_id < {a + 15}"))
        claims = c if claims is None else claims.unionByName(c)
    assert len(index.runs) < 3 and index.made > 4
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_copies(df, claims).collect()}
    assert got == kept_by_hand(rows)
    found = substring_dedup.deduplicate(odd).collect()
    assert len(found) == 9 and sorted(r.n_removed for r in found) == [0] * 7 + [30_000] * 2
    assert substring_dedup.deduplicate(none).count() == 0


def test_substring_index_in_another_session(spark, monkeypatch, tmp_path):
    """Three batches over two sessions; the second opens the folder by its manifest, beside a run that no manifest names."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"v{x}" for x in rng.integers(0, 40, 25)) + (" same old passage" * 6 if i % 4 == 0 else "")) for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"{tmp_path}/index"
    first = substring_dedup.SubstringIndex(spark, path, 4, fanout=3)
    claims = first.add(df.where("doc_id < 16"))
    first._write(spark.createDataFrame([], substring_dedup._ROWS))  # a job that ended before its manifest
    other = spark.newSession()
    again = substring_dedup.SubstringIndex(other, path)
    assert (again.runs, again.shards, again.fanout, again.made) == (["run-0"], 4, 3, 2)
    for a, b in ((16, 32), (32, 48)):
        claims = claims.unionByName(spark.createDataFrame(again.add(other.createDataFrame(rows, df.schema).where(f"doc_id >= {a} and doc_id < {b}")).collect(), claims.schema))
    assert len(again.runs) == 1 and len(again._names("run-")) == 5
    again.vacuum()
    assert [f"run-{n}" for n in again._names("run-")] == again.runs == substring_dedup.SubstringIndex(spark, path).runs
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_copies(df, claims).collect()}
    assert got == kept_by_hand(rows)


def test_substring_dedup_without_broadcasts(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    monkeypatch.setattr(substring_dedup, "BROADCAST_ENTRIES", 0)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.deduplicate(docs.select("doc_id", "text")).collect()}
    assert got == kept_by_hand(rows)


def test_false_claims_are_not_removed(spark):
    words_ = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(1, "other " * 20), (2, words_)], "doc_id long, text string")
    claims = df.where("doc_id = 2").selectExpr("doc_id", "xxhash64(text) as key", "0 as start", "8 as n", "1L as source")
    assert {r.n_removed for r in substring_dedup.remove_copies(df, claims).collect()} == {0}


def test_decontamination(spark, odd, none):
    items = [(1, "Anna has 12 apples and gives 5 kg of them to Bob so how many of the 12 apples are left now"), (2, "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn today"), (None, "x y z"), (3, None), (4, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "well so Anna has 30 apples and gives 7 lb of them to Carl so how many of the 30 apples are left now ok"),
        (2, "well so Anna has 30 apples and gives 7 lb of them to Carl so how many of the 99 apples are left now ok"),
        (3, "see: The QUICK brown fox jumps, over the lazy dog near a quiet river bank at dawn today!"),
        (4, "the quick brown fox sleeps and the lazy dog runs near a river at noon"),
        (5, None),
        (None, "the quick brown fox jumps over the lazy dog near a quiet river bank at dawn today"),
    ]
    df = spark.createDataFrame([(*r, "h") for r in rows], "doc_id long, text string, hash string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()}
    assert got == {(1, 1), (3, 2), (None, 2)}
    assert sorted(r.doc_id for r in decontamination.decontaminate(df, bench).collect()) == [2, 4, 5]
    assert decontamination.leaks(odd, bench).count() == 0 and decontamination.leaks(none, bench).count() == 0
    assert decontamination.decontaminate(odd, bench.where("false")).count() == 9


def test_names_that_open_sentences_and_short_items(spark):
    items = [(1, "Tom has 3 apples. Anna has 4 pears. How many fruits do they have?"), (2, "capital of France"), (3, "12 34 56 78 90 11")]
    rows = [
        (1, "Bob has 5 apples. Mary has 6 pears. How many fruits do they have?"),
        (2, "We ask: what is the Capital of France today"),
        (3, "numbers 12 34 56 78 90 11 end"),
        (4, "numbers 12 34 56 78 90 12 end, capital of Spain"),
        (6, "Bob and Mary have fruits. How many do they have?"),
    ]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(df, bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


TEMPLATES = (
    "{a} has {m} apples. {b} gives {a} {n} {u} of them. How many apples does {a} have now?",
    "{a} lives in {p} and walks {m} {u} to school every day, so how far does {a} walk in {n} weeks altogether?",
    "A train leaves {p} at {m} o'clock with {n} passengers. {a} gets off first. When does the train reach the sea?",
    "If {a} buys {m} books for {n} dollars and {b} buys half as many, what did {b} pay for all of the books?",
    "{a} and {b} share {m} marbles equally; after {a} loses {n} of them, how many marbles are left for {b}?",
    "The garden of {a} is {m} {u} long and {n} {u} wide. What is its area when {b} plants a hedge around it?",
)


def test_questions_asked_again_with_other_values(spark):
    """A generated set: other numbers, number words, units, and names of one or two words, wherever they stand."""
    rng = np.random.default_rng(8)
    names, places, numbers, units = ("Anna", "Tom", "Mary Ann", "Bob", "Li Wei", "Zoe"), ("Paris", "New York", "Rome", "San Marino"), ("3", "12", "twelve", "40", "seven", "2.5"), ("kg", "km", "miles", "cm")

    def fill(t):
        a, b = rng.choice(names, 2, False)
        m, n = rng.choice(numbers, 2, False)
        return t.format(a=a, b=b, m=m, n=n, p=rng.choice(places), u=rng.choice(units))

    bench = spark.createDataFrame([(k, fill(t)) for k, t in enumerate(TEMPLATES)], "item_id long, text string")
    rows = [(100 * k + i, f"some words before it. {fill(t)} and some after") for k, t in enumerate(TEMPLATES) for i in range(10)]
    other = [t.replace("{a} has", "{a} eats").replace("walks", "drives").replace("train", "boat").replace("buys", "sells").replace("marbles", "coins").replace("garden", "field").replace(" and ", " or ").replace("does", "did") for t in TEMPLATES]
    rows += [(1000 + 100 * k + i, f"{fill(t)} Nothing else.") for k, t in enumerate(other) for i in range(10)]
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    right = {(100 * k + i, k) for k in range(len(TEMPLATES)) for i in range(10)}
    assert len(found & right) >= 0.9 * len(right) and not found - right


def test_templates_and_slots_by_hand(spark):
    """Items and documents of one sentence, against windows and slots computed by plain loops."""
    rng = np.random.default_rng(9)
    stock = ["red", "blue", "runs", "over", "hill", "tree", "sings", "near"]

    def made():
        return [str(rng.choice(stock)) if rng.random() < 0.7 else str(rng.integers(1, 4)) for _ in range(8)]

    def changed(w):
        to = {k: str(rng.integers(1, 4)) for k in "123"}
        return [to[x] if x in to and rng.random() < 0.9 else x for x in w]

    items = {k: made() for k in range(12)}
    docs_ = {i: (changed(items[i % 12]) + made()[:2] if i % 3 else made() + items[i % 12][:6]) for i in range(90)}
    template = lambda w: tuple("#" if x.isdigit() else x for x in w)

    def holds(w, item):
        spots = [(i, p) for i in range(len(w) - 4) for p in range(len(item) - 4) if template(w[i : i + 5]) == template(item[p : p + 5]) and sum(not x.isdigit() for x in item[p : p + 5]) >= 2]
        told = {p for p in range(len(item) - 4) if sum(not x.isdigit() for x in item[p : p + 5]) >= 2}
        kept = set()
        for shift in {i - p for i, p in spots}:
            line = [(i, p) for i, p in spots if i - p == shift]
            pairs = {(x, y) for i, p in line for x, y in zip(item[p : p + 5], w[i : i + 5]) if x.isdigit()}
            if len(pairs) == len({x for x, _ in pairs}):
                kept |= {p for _, p in line}
        return bool(told) and len(kept) >= 0.8 * len(told)

    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{key} long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(docs_, "doc_id"), frame(items, "item_id")).collect()}
    want = {(i, k) for i, w in docs_.items() for k, item in items.items() if holds(w, item)}
    assert got == want and 20 < len(want) < 90
    with pytest.MonkeyPatch.context() as m:
        m.setattr(decontamination, "BROADCAST_ROWS", 0)
        assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(docs_, "doc_id"), frame(items, "item_id")).collect()} == want


def test_every_verbatim_item_is_found(spark):
    flat = lambda t: " " + " ".join((t or "").lower().split()) + " "
    docs_ = [(r.doc_id, flat(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = {(i, b.item_id) for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for i, t in docs_ if flat(b.text) in t}
    assert want <= {(r.doc_id, r.item_id) for r in decontamination.op9_benchmark_decontamination(spark, SF).collect()}


def test_sharding(spark, docs, odd, none, tmp_path):
    rows = sharding.op10_sharding(spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len({r.doc_id for r in rows}) == len(rows) == docs.count() and set(by) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    found = sharding.shuffle_into_shards(odd, shards=3, bucket_bytes=1 << 16)
    assert sorted(r.shard for r in found.collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2] and found.columns.count("shard") == 1
    sharding.write_shards(found, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 9
    assert sharding.shuffle_into_shards(none).count() == 0


def test_shards_depend_on_the_records_alone(spark, docs, tmp_path):
    rows = docs.select("doc_id", "text").unionByName(docs.where("n_chars < 500").select("doc_id", "text"))  # copies that fill no quarter of a bucket
    places = lambda df: sorted((tuple(r) for r in sharding.shuffle_into_shards(df, bucket_bytes=1 << 15).drop("text").collect()), key=str)
    want = places(rows.repartition(4))
    assert places(rows.repartition(7)) == want and places(rows.orderBy("text").coalesce(1)) == want
    rows.repartition(5, "text").write.parquet(f"{tmp_path}/other")
    assert places(spark.read.parquet(f"{tmp_path}/other")) == want
    assert [r[2] for r in sorted(want, key=lambda r: (r[1], r[2]))] != sorted(r[2] for r in want)


def test_copies_of_one_record_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    monkeypatch.setattr(sharding, "RUN_BUCKETS", 3)
    rows = spark.createDataFrame([(i, f"t{i}", {"a": i}) for i in range(100)] + [(7, "same", {"b": 1})] * 300, "doc_id long, text string, extra map<string,int>")
    for most in (sharding.BROADCAST_BUCKETS, 0):
        monkeypatch.setattr(sharding, "BROADCAST_BUCKETS", most)
        found = sharding.shuffle_into_shards(rows, shards=7).collect()
        slots = defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
        assert len(found) == 400 and sum(r.text == "same" for r in found) == 300 and sorted(map(len, slots.values())) == [57] * 6 + [58]
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_callers_columns_meet_no_internal_ones(spark):
    names = ["_key", "_doc", "_spans", "_row", "_size", "spans", "key", "claims", "c0", "piece", "_id", "mark", "kept", "n_words", "score", "predicted", "hash", "hashes"]
    rows = spark.createDataFrame([(i, f"word{i} " * 20, *[f"{c}{i}" for c in names]) for i in range(4)] + [(9, "word1 " * 20, *names)], ["doc_id", "text", *names])
    got = {r.doc_id: r for r in substring_dedup.deduplicate(rows).collect()}
    assert got[9].n_removed == 20 and all(got[i][c] == f"{c}{i}" for i in range(4) for c in names if c not in ("kept", "n_words"))
    packed = {r.row: r for r in packing.pack(rows.selectExpr("doc_id as row", "5L as length", *(f"`{c}`" for c in names))).collect()}
    assert len(packed) == 5 and all(packed[i][c] == f"{c}{i}" for i in range(4) for c in names)
    bench = spark.createDataFrame([(1, "word3 " * 20)], "item_id long, text string")
    assert sorted(r._doc for r in decontamination.decontaminate(rows, bench).collect()) == ["_doc", "_doc0", "_doc1", "_doc2"]
    pipeline = pytest.importorskip("corpus_pipeline")
    stages = [pipeline.drop_toxic, pipeline.drop_near_duplicates, pipeline.remove_repeated_passages, pipeline.drop_benchmark_leaks]
    for stage, left in zip(stages, (5, 4, 5, 5), strict=True):
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns and {(r.doc_id, r.kept, r.n_words) for r in out.collect()} <= {(r.doc_id, r.kept, r.n_words) for r in rows.collect()} and out.count() == left


def test_near_duplicates_are_dropped_by_row(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(3, text(0), "a"), (7, text(0), "b"), (7, text(1), "c"), (9, text(2), "d"), (9, text(2), "d"), (None, text(3), "e"), (None, text(0), "f"), (8, None, "g"), (4, " ", "h")]
    made = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    for most in (near_dedup.BROADCAST_ROWS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(near_dedup, "BROADCAST_ROWS", most)
            assert sorted(r.mark for r in pipeline.drop_near_duplicates(spark, made, SF).collect()) == ["a", "c", "d", "e", "h"]


def test_near_duplicates_are_found_by_fingerprints(spark, monkeypatch):
    """Without any MinHash band: SimHash links, the sets check."""
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(near_dedup, "_bands", lambda size: lambda batches: (b.select(["id", "mark"]).append_column("bands", near_dedup.pa.array([[]] * len(b), near_dedup.pa.list_(near_dedup.pa.int64()))) for b in batches))
    text = [f"w{i}" for i in range(4000)]
    line = "the same line once more " * 300
    rows = [(1, " ".join(text)), (2, " ".join([*text[:2000], "other", *text[2001:]])), (3, line + "one end of it is here"), (4, line + "quite another last word there and then some more of them all")]
    marks = [near_dedup.fingerprint(t.encode()) for _, t in rows]
    assert (marks[0] ^ marks[1]).bit_count() <= 4 and (marks[2] ^ marks[3]).bit_count() <= 4
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, made, SF).collect()) == [1, 3, 4]


def jaccard_groups(rows):
    """The smallest doc_id that pairs of similarity 0.8 reach, from (doc_id, text) rows with distinct ids."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}
    pairs = [(i, j) for i in sets for j in sets if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in group:
        for i, j in pairs:
            group[i] = group[j] = min(group[i], group[j])
    return group


def test_marks_without_broadcasts(spark, monkeypatch):
    docs_, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    want = sorted(tuple(r) for r in toxicity.learning_rows(docs_, labels).collect())
    good = sorted(tuple(r) for r in docs_.join(quality._near(quality.trusted_marks(labels)), "doc_id", "left_semi").select("doc_id").collect())
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(quality, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in toxicity.learning_rows(docs_, labels).collect()) == want
    assert sorted(tuple(r) for r in docs_.join(quality._near(quality.trusted_marks(labels)), "doc_id", "left_semi").select("doc_id").collect()) == good


def test_tables_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from docloom.llm import storage

    conf = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        storage.shared_dir(cluster)
    assert storage.shared_dir(spark)


def test_long_runs_of_names_and_numbers_are_read(spark):
    """In a process of its own: an overflow of the stack ends the JVM."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
from pyspark.sql import SparkSession
from docloom.llm import decontamination as d
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
names, numbers = " ".join(["Word"] * 30000), ".".join(["7"] * 30000)
rows = s.createDataFrame([(1, "to " + names + " end"), (2, "at " + numbers)], "doc_id long, text string").repartition(1)
got = {r.doc_id: r.t for r in rows.select("doc_id", d.tokens(d.F.col("text")).alias("t")).collect()}
assert got == {1: ["to", "\\x03word\\x04", "end"], 2: ["at", "\\x01" + numbers + "\\x04"]}, got
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=180, cwd=Path(__file__).resolve().parents[2])


def test_pipeline_against_brute_force(spark):
    """Near copies, repeated passages and packing by plain loops; toxic documents and leaks by the operators, which have tests of their own."""
    from tokenizers import Tokenizer

    pipeline = pytest.importorskip("corpus_pipeline")
    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs_, toxicity.train(docs_, spark.read.parquet(f"{SF}/labels.parquet"))).where("predicted = 1").collect()}
    kept = pipeline.drop_toxic(spark, docs_, SF)
    assert {r.doc_id for r in docs_.collect()} - {r.doc_id for r in kept.collect()} == toxic
    unique = pipeline.drop_near_duplicates(spark, kept, SF)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(jaccard_groups([(r.doc_id, r.text) for r in kept.collect()]).values()))
    cut = pipeline.remove_repeated_passages(spark, unique, SF)
    want = kept_by_hand([(r.doc_id, r.text) for r in unique.collect()])
    assert cut.columns == docs_.columns and all(r.text == want[r.doc_id][2] and r.n_chars == len(r.text) for r in cut.collect() if want[r.doc_id][1])
    clean = pipeline.drop_benchmark_leaks(spark, cut, SF)
    got = defaultdict(list)
    for r in pipeline.run(spark, SF).collect():
        got[r.doc_id].append((r.piece, np.frombuffer(r.tokens, "<u4").tolist()))
    t = Tokenizer.from_file(tokenizer_path())
    assert {i: [x for _, ids in sorted(ps) for x in ids] for i, ps in got.items()} == {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in clean.collect()}
