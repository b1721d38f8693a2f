"""Operators on documents: brute force, held-out accuracy, exact round trips, and every defined edge case."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvexa.llm import language, lattice, minhash, packing, quality, queries, repeats, revisits, sharding
from corvexa.llm import suffix
from corvexa.llm.suffix import permuted_lcp, suffix_array

from ..conftest import SMALL, oracle_rows, spark_rows
from . import brute

MID = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, shard string, slot string, size string, spans string, pieces string, k string, node string, raw string, h string, component_id string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, None, None, *["x"] * 12) for i, t, lang in rows], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    texts = []
    for k in range(n):
        if k % 3 == 1:
            w = texts[rng.randrange(len(texts))].split(" ")
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 160))))
    return texts


EDGES = [(1, "alpha beta gamma delta epsilon zeta", "en"), (2, "alpha beta gamma delta epsilon zeta", "en"), (3, None, None), (4, "", "de"), (5, " \t\n", "fr"), (6, "one", None), (7, "One", "en"), (8, "größe 北京 😀 12345", "de")]


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


def test_minhash_equals_all_pairs(spark, documents):
    for docs in (dict(documents), dict(enumerate(corpus())), {i: t for i, t, _ in EDGES}):
        got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, [(i, t, None) for i, t in docs.items()])).collect()}
        for i, (n, c) in brute.components(docs).items():
            assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, c == i)


def test_minhash_large_group_of_near_copies(spark, monkeypatch):
    """Several blocks a bucket: a group whose members aren't all alike, and one exact copy of each."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    docs = {}
    for k in range(40):
        w = base[:]
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = f"z{rng.random()}"
        docs[2 * k] = docs[2 * k + 1] = " ".join(w)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, [(i, t, None) for i, t in docs.items()])).collect()}
    assert got == brute.components(docs)


@pytest.mark.parametrize("wide", [4, 4096])
def test_minhash_texts_of_one_mould(spark, monkeypatch, wide):
    """Many texts that share bands but not the wanted similarity, linked pairs among them: wide buckets by rare shingles."""
    monkeypatch.setattr(minhash, "WIDE", wide)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(21)
    base = [f"w{k}" for k in range(100)]
    docs = {}
    for k in range(90):
        w = base[: 100 - k % 3] + [f"own{k}x{j}" for j in range(rng.randrange(14, 30))]
        docs[k] = " ".join(w)
        if k % 6 == 0:
            w[rng.randrange(len(w))] = "changed"
            docs[1000 + k] = " ".join(w)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame(spark, [(i, t, None) for i, t in docs.items()])).collect()}
    want = brute.components(docs)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_minhash_rare_keys_meet(spark):
    """Two sets of the wanted similarity share one of their rarest shingles, whatever the other texts are."""
    texts = corpus(31, 90)
    keyed = defaultdict(set)
    frame_ = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    for r in minhash._rare_keys(spark, frame_, 5, 85).collect():
        keyed[r["node"]].add(r["key"])
    sets = [brute.shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert keyed[i] & keyed[j]


def test_minhash_estimate_and_probes():
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64) * np.uint64(2))
    for share in (0.5, 0.8, 0.95):
        n = 3000
        both = int(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : 2 * n - both]]))
        r = minhash.registers([a, b])
        assert abs(minhash.estimate(r[0], r[1]) - both / (2 * n - both)) < 0.16
    assert (minhash.registers([pool[:1]]) > 0).all()


def test_nulls_repeats_and_empty_tables(spark):
    """Null ids, rows that repeat, tables without rows: no operator crashes, and no row is lost."""
    rows = [*EDGES, (1, EDGES[0][1], "en"), (None, "a text without an id", "en"), (None, None, None)]
    for some in (rows, []):
        docs, n = frame(spark, some), len(some)
        labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)] + [(None, 1), (1, None)], "doc_id long, quality int")
        assert minhash.near_duplicates(docs).count() == n
        assert sharding.histogram_shards(docs, 3).count() == n
        assert language.predict(docs, language.train(docs)).count() == n
        assert quality.predict(docs, quality.train(docs, labels)).count() == n
        assert repeats.remove_repeats(docs).count() == n
        out = lattice.decode_segmentations(lattice.sample_segmentations(docs, queries.tokenizer_path("piece_bpe_32k.model")), queries.tokenizer_path("piece_bpe_32k.model"))
        assert out.where(~F.col("decoded").eqNullSafe(F.col("text"))).count() == 0 and out.count() == n
        packed = packing.pack_documents(docs, queries.tokenizer_path("byte_bpe_50k.json")).collect()
        assert sum(r["start"] == 0 for r in packed) == n
    shared = {r["kept"] for r in minhash.near_duplicates(frame(spark, rows)).where("doc_id IS NULL").collect()}
    assert shared == {True}


def test_very_long_texts(spark):
    """Texts of over a mebibyte, of many words and of one: all of them is read."""
    rng = random.Random(14)
    words = [f"w{k}" for k in range(3000)]
    long = " ".join(rng.choice(words) for _ in range(230_000))
    assert len(long) > 1 << 20
    tail = long[:-40] + " and another end of the same text"
    rows = [(1, long, "en"), (2, tail, "en"), (3, "x" * 40_000, "de"), (4, "kurz und gut", "de"), (5, "short and good", "en")]
    docs = frame(spark, rows)
    near = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert [near[k]["component_id"] for k in range(1, 6)] == [1, 1, 3, 4, 5] and near[1]["n_shingles"] == len(brute.shingles(long))
    sizes = {r["doc_id"]: r["size"] for r in sharding.histogram_shards(docs, 3).collect()}
    assert sizes == {k: len(t.encode()) + 16 for k, t, _ in rows}
    model = language.train(docs)
    assert language.predict(docs, model).where("lang_pred = 'und'").count() == 0
    found = quality.features(long)
    assert found[0] == pytest.approx(math.log1p(230_000)) and not np.allclose(found, quality.features(long[: 1 << 20]))
    path = queries.tokenizer_path("piece_bpe_32k.model")
    out = lattice.decode_segmentations(lattice.sample_segmentations(docs, path), path)
    assert out.where("NOT (decoded <=> text)").count() == 0


def test_packing_is_a_partition_of_the_tokens(spark, documents):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = False
    texts = dict(documents) | {-1: "<|endoftext|> a  b\n\n c <|x|>", -2: "word " * 9000, -3: "　  x", -4: None, -5: ""}
    docs = frame(spark, [(i, t, None) for i, t in texts.items()]).repartition(3)
    rows = packing.pack_documents(docs, path).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, t in texts.items():
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in mine for x in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in mine)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in mine)
    for s in by_seq.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [sum(q["length"] for q in s[:k]) for k in range(len(s))]
        n = sum(r["length"] for r in s)
        assert n == 2048 or n & (n - 1) == 0 and n < 2048
    # Every window is full, and but for the partitions' ends it has the length of a tier.
    sizes = Counter(sum(r["length"] for r in s) for s in by_seq.values())
    assert all(r["tier"] == sum(q["length"] for q in s) for s in by_seq.values() for r in s)
    assert sum(v for k, v in sizes.items() if k < 256) <= 3 * 8 and {256, 512, 1024, 2048} <= set(sizes)


def test_packing_tiers_and_step_groups():
    """Pieces open windows of their own tier, shorter ones fill the gaps, and step groups are even in number and cost."""
    rng = random.Random(3)
    packer = packing.Packer(0)
    lengths = [rng.choice([rng.randrange(1, 257), rng.randrange(257, 513), rng.randrange(513, 1025), rng.randrange(1025, 2048), 5000]) for _ in range(3000)]
    for k, n in enumerate(lengths):
        packer.add(k, np.arange(n, dtype="<u4"))
    rows = packer.pack(last=True)
    assert sum(r[2] for r in rows) == sum(lengths)
    windows, groups = defaultdict(list), defaultdict(dict)
    for r in rows:
        windows[r[5]].append(r)
        groups[r[7], r[8]].setdefault(r[5], []).append(r[2])
    for w in windows.values():
        size = w[0][7]
        assert sum(r[2] for r in w) == size
        if size in (512, 1024, 2048) and w[0][2] < size:
            assert size // 2 < w[0][2]  # opened by a piece of the tier
    for size in (256, 512, 1024, 2048):
        mine = [g for (t, _), g in groups.items() if t == size]
        count = [len(g) for g in mine]
        cost = [sum(n * n for p in g.values() for n in p) / len(g) for g in mine]
        assert max(count) - min(count) <= 1 and max(cost) < 1.05 * min(cost)
    assert len(rows) <= len(lengths) + len(windows)  # a window cuts one piece at most


def test_shards_are_even_gapless_and_whole(spark):
    rng = random.Random(9)
    rows = [(k, "same text " * 3 if k % 3 == 0 else "x" * rng.randrange(0, 90), None) for k in range(3000)]
    got = sharding.histogram_shards(frame(spark, rows), 7, tolerance=1e-3).select("doc_id", "size", "shard", "slot").collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert r["size"] == len(rows[r["doc_id"]][1]) + 16
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and set(sizes) == set(range(7))
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_texts_stay_together(spark, monkeypatch):
    """Small groups are kept whole; a hot text is cut where shards are full, and sorted in several runs."""
    monkeypatch.setattr(sharding, "LEAST_RUN", 64)
    rng = random.Random(4)
    pairs = [f"text {k} " + "x" * rng.randrange(0, 60) for k in range(2000)]
    rows = [(k, pairs[k % 2000], None) for k in range(4000)] + [(4000 + k, "hot", None) for k in range(2000)]
    got = sharding.histogram_shards(frame(spark, rows), 40).select("doc_id", "text", "size", "shard", "slot").collect()
    shards, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in got:
        shards[r["text"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for t, s in shards.items() if t != "hot") and len(shards["hot"]) > 1
    assert max(sizes.values()) - min(sizes.values()) <= 0.045 * sum(sizes.values()) / 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == 6000


def test_queries_equal_sql(spark, oracle):
    for sql, f in ((queries.OP1_SQL, queries.op1_minhash), (queries.OP4_SQL, queries.op4_sharding), (queries.OP7_SQL, queries.op7_suffix_array), (queries.OP8_SQL, queries.op8_top_k)):
        assert spark_rows(f(spark, SMALL)) == oracle_rows(oracle, sql)


def test_language_on_held_out_rows(spark):
    out = queries.op5_language_id(spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_language_without_letters(spark):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(frame(spark, EDGES), language.train(frame(spark, EDGES))).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[1][0] in {"en", "de", "fr"}


def test_folded_weights_equal_the_kernel_form(monkeypatch):
    """Margins of presence matrices against kernels with the landmarks, written out."""
    monkeypatch.setattr(language, "LANDMARKS", 6)
    monkeypatch.setattr(language, "CELLS", 3000)
    sets = [language.grams(t) for t in corpus(3, 40)]
    labels = [("a", "b", "c")[k % 3] for k in range(40)]
    model = language.fit(sets, labels)
    marks = [s for lang in "abc" for s in [s for s, y in zip(sets, labels) if y == lang][:6]]
    kernel = lambda x, y: len(set(x.tolist()) & set(y.tolist())) / math.sqrt(len(x) * len(y))
    values, vectors = np.linalg.eigh(np.array([[kernel(x, y) for y in marks] for x in marks]))
    keep = values > 1e-8 * values[-1]
    phi = np.array([[kernel(s, m) for m in marks] for s in sets]) @ (vectors[:, keep] / np.sqrt(values[keep]))
    w = np.array([1 / labels.count(y) for y in labels])
    w *= len(w) / w.sum()
    y = np.where(np.array(labels)[:, None] == np.array(["a", "b", "c"]), 1.0, -1.0)
    mean, bias = np.average(phi, axis=0, weights=w), np.average(y, axis=0, weights=w)
    c = phi - mean
    beta = np.linalg.inv(c.T @ np.diag(w) @ c + language.RIDGE * 40 * np.eye(phi.shape[1])) @ c.T @ np.diag(w) @ (y - bias)
    assert np.allclose(model.margins(sets), c @ beta + bias, atol=1e-4)


def test_bradley_terry_is_the_minimum():
    """The gradient of the plain loss, pair by pair, vanishes at the weights; either step along an axis raises the loss."""
    rng = np.random.default_rng(4)
    pairs, ridge = rng.normal(size=(300, 4)) + [0.5, 0, -0.2, 0.1], np.array([1e-3, 1e-2, 1e-3, 1e-3])
    w = quality.newton(pairs, ridge)
    loss = lambda v: sum(math.log1p(math.exp(-float(x @ v))) for x in pairs) / len(pairs) + float(ridge @ v**2) / 2
    gradient = ridge * w - sum(x / (1 + math.exp(float(x @ w))) for x in pairs) / len(pairs)
    assert np.abs(gradient).max() < 1e-6 and all(loss(w + d * e) > loss(w) for e in np.eye(4) for d in (-1e-2, 1e-2))


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{MID}/labels.parquet").select("doc_id", "quality")
    held = queries.op6_quality(spark, MID).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in held)


@pytest.mark.parametrize("names", [4096, 1])
def test_suffix_array_and_common_prefixes(monkeypatch, names):
    """Whole suffixes in order, also where they share hundreds of elements; names as they are and as digits."""
    monkeypatch.setattr(suffix, "NAMES", names)
    rng = np.random.default_rng(1)
    made = [np.append(rng.integers(1, alphabet + 1, 600), 0) for alphabet in (1, 2, 4, 200)]
    for t in made:
        t[100:250] = t[300:450]
    made += [np.append(np.tile(rng.integers(1, 5, 150), 6), 0), np.append(np.tile([1, 2], 300), 0), np.array([1, 0]), np.append(np.tile([3, 1, 2], 200), 0)]
    for t in made:
        t = t.astype(np.uint16)
        sa = suffix_array(t, 256)
        by = [tuple(t[k:]) for k in sa]
        assert sorted(sa.tolist()) == list(range(len(t))) and by == sorted(by)
        shared = permuted_lcp(t, sa, 100)
        at_least = permuted_lcp(t, sa, 100, least=100)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while n < 100 and max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert shared[b] == n and at_least[b] == (100 if n == 100 else 0)


def test_equality_is_by_elements(monkeypatch):
    """Positions whose hashes agree by chance are not taken for equal."""
    t = np.array([5, 6, 7, 8, 5, 6, 7, 9, 5, 6, 7, 8], dtype=np.uint16)
    assert suffix._same(t, np.array([4, 5, 8]), np.array([0, 1, 0]), 3).tolist() == [True, False, True]
    assert suffix._same(t, np.array([8, 9]), np.array([0, 1]), 3).tolist() == [True, True]


@pytest.mark.parametrize("heavy", [8192, 2])
def test_repeats_equal_brute_force(spark, documents, monkeypatch, heavy):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    made = [(k, "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(0, 200))) + (passage[k % 40 :] if k % 2 else "") + "ü" * (k % 3)) for k in range(80)]
    made += [(100, "ab" * 300), (101, "a" * 99), (102, "a" * 350), (103, None), (104, ""), (105, made[7][1])]
    for docs in (documents, made):
        want = brute.repeats(docs)
        got = repeats.remove_repeats(frame(spark, [(i, t, None) for i, t in docs]).repartition(5)).select("doc_id", "n_bytes", "spans", "kept").collect()
        for r in got:
            removed = sum(s["end"] - s["start"] for s in r["spans"])
            assert (r["n_bytes"], removed, len(r["spans"]), bytes(r["kept"])) == (*want[r["doc_id"]][:3], want[r["doc_id"]][4])


@pytest.mark.parametrize("heavy", [8192, 30])
def test_repeats_in_long_texts(spark, monkeypatch, heavy):
    """Texts beyond a segment, with passages that cross its end, and one line in many surroundings."""
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    monkeypatch.setattr(repeats, "SEGMENT", 1 << 14)
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, long = word(97), word(70_000)
    docs = [(k, word(90) + line + word(90)) for k in range(60)]
    docs += [(100, long), (101, word(500) + long[16_000:16_800] + word(40) + long[32_700:32_900]), (102, long[:40_000]), (103, "z" * 40_000)]
    want = brute.repeats(docs)
    for r in repeats.remove_repeats(frame(spark, [(i, t, None) for i, t in docs]).repartition(4)).select("doc_id", "n_bytes", "spans", "kept").collect():
        removed = sum(s["end"] - s["start"] for s in r["spans"])
        assert (r["n_bytes"], removed, len(r["spans"]), bytes(r["kept"])) == (*want[r["doc_id"]][:3], want[r["doc_id"]][4])


def test_repeats_in_a_text_over_a_mebibyte(spark):
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(97, 123, 1_300_000, dtype=np.uint8)).decode()
    docs = [(1, long), (2, long[1_048_000:1_049_000] + "!" * 50), (3, long[5:104]), (4, long[1_299_900:])]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in repeats.remove_repeats(frame(spark, [(i, t, None) for i, t in docs])).select("doc_id", "spans").collect()}
    assert got == {1: [], 2: [(0, 1000)], 3: [], 4: [(0, 100)]}


def test_sampled_segmentations(spark, documents):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    texts = dict(documents) | {-1: "a ▁ b  c", -2: " lead", -3: "\x00\U0001f600é", -4: "hello hello hello"}
    docs = frame(spark, [(i, t, None) for i, t in texts.items()])
    one = lattice.sample_segmentations(docs, path, seed=5)
    first = {r["doc_id"]: r["pieces"] for r in one.collect()}
    again = {r["doc_id"]: r["pieces"] for r in lattice.sample_segmentations(docs.repartition(7), path, seed=5).collect()}
    other = {r["doc_id"]: r["pieces"] for r in lattice.sample_segmentations(docs, path, seed=6).collect()}
    assert first == again != other
    assert lattice.decode_segmentations(one, path).where("NOT (decoded <=> text)").count() == 0
    crc = {r["doc_id"]: r["ids_crc32"] for r in lattice.with_ids_crc32(one).collect()}
    assert all(crc[i] == zlib.crc32(np.array(p or [], dtype="<u4").tobytes()) for i, p in first.items())


def test_samples_follow_the_lattice():
    """Shares of the segmentations of one word against their exact probabilities."""
    model = lattice.pieces(queries.tokenizer_path("piece_bpe_32k.model"))
    n = 20_000
    got = Counter(tuple(x) for x in lattice.sample_ids(model, ["cat"] * n, np.arange(n, dtype=np.uint64), 3))
    weight = {int(i): float(w) for i, w in zip(model.ids, model.weights)}
    raw = {int(b): k for k, b in enumerate(model.byte)}
    p = {s: math.exp(sum(model.byte_weight if i in raw and i not in weight else weight[i] for i in s)) for s in got}
    total = sum(p.values())
    for s, k in got.most_common(3):
        assert abs(k / n - p[s] / total) < 0.02
    assert all(b"".join(model.text[i] for i in s) == b"cat" for s in got)


def test_revisits_equal_sql(spark, oracle):
    assert spark_rows(queries.op2_revisits(spark, SMALL)) == oracle_rows(oracle, queries.OP2_SQL)


def test_revisit_rules(spark):
    h = {"Date": "1", "ETag": "a", "X": "r"}
    rows = [
        (1, "http://www.A.com:80/p/?b=2&a=1&utm_x=3#f", 10, "response", "W/a", None, {"X": "s", "Date": "0"}),
        (2, "https://a.com/p?a=1&b=2", 20, "revisit", "a", None, h),
        (3, "https://a.com/p?a=1&b=2", 10, "revisit", "a", None, h),
        (4, "https://a.com/p?a=1&b=2", 30, "revisit", "b", None, h),
        (5, None, 30, "revisit", "b", None, None), (6, "https://a.com/q", None, "revisit", "b", None, None),
        (7, "https://a.com/p?a=1&b=2", 10, "response", None, "m", {"X": "t"}),
    ]
    df = spark.createDataFrame(rows, "rec_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    got = {r["rec_id"]: (r["ref_id"], r["state"], r["merged"]) for r in revisits.resolve_revisits(df, 4).collect()}
    assert got[3][1] == got[5][1] == got[6][1] == "unresolved" and got[4][:2] == (7, "mismatch") and got[2][:2] == (7, "mismatch")
    alone = {r["rec_id"]: r for r in revisits.resolve_revisits(df.where("rec_id < 7"), 4).collect()}
    assert alone[2]["state"] == "matched" and alone[2]["merged"] == {"X": "s", "Date": "1", "ETag": "a"}
    assert alone[4]["state"] == "mismatch" and alone[4]["merged"] is None
    assert revisits.resolve_revisits(df.limit(0)).count() == 0


def test_revisits_merge_without_case_and_keep_repeats(spark):
    rows = [
        (1, "http://a.com/p", 10, "response", "t", None, {"Date": "0", "X": "s", "Expires": "9"}),
        (1, "http://a.com/p", 10, "response", "t", None, {"Date": "0", "X": "s", "Expires": "9"}),
        *[(2, "http://a.com/p", 20, "revisit", "t", None, {"date": "1", "x": "new"})] * 3,
        *[(k, "http://a.com/p", 20, "revisit", None, "m", None) for k in (3, 3)],
        (4, "http://a.com/q", 20, "revisit", "t", None, {}),
    ]
    schema = "rec_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, state string, curl string, span string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    got = [(r["rec_id"], r["ref_id"], r["state"], r["merged"]) for r in revisits.resolve_revisits(df).collect()]
    assert sorted(r[0] for r in got) == [2, 2, 2, 3, 3, 4]
    assert all(r == (2, 1, "matched", {"X": "s", "date": "1", "Expires": "9"}) for r in got if r[0] == 2)
    assert all(r[1:] == (1, "mismatch", None) for r in got if r[0] == 3) and (4, None, "unresolved", None) in got


def test_revisits_of_a_hot_url(spark):
    """Many ranges of one URL, with outlier times: the latest earlier response by brute force."""
    rng = random.Random(11)
    rows = [(k, "http://hot.org/", rng.choice([rng.randrange(2000), 10**12]), rng.choice(["response", "revisit"]), f"e{k % 3}", None, None) for k in range(600)]
    df = spark.createDataFrame(rows, "rec_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>")
    for r in revisits.resolve_revisits(df, 16).collect():
        before = [(t, i) for i, _, t, kind, *_ in rows if kind == "response" and t < r["ts"]]
        assert r["ref_id"] == (max(before)[1] if before else None)
