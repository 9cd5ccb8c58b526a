"""Sharding, packing, near-duplicates, components and the pipeline against brute force and on odd input."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow as pa
import pytest

from tessella.llm import components, minhash, packing, queries, sharding, vectors
from tessella.llm.common import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, slot string, length string")


def root(links, ids):
    """Smallest id reachable, by brute force."""
    to = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(to[a], to[b])
            if to[a] != m or to[b] != m:
                to[a] = to[b] = m
                changed = True
    return to


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(50)] + [(3, 3)]
    got = {x["id"]: x["component_id"] for x in components.components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    ids = {i for a, b in links if a != b for i in (a, b)}
    assert got == root([x for x in links if x[0] != x[1]], ids)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding_law(spark):
    rows = [(i, f"text {i % 7}" * (i % 5)) for i in range(500)] + [(None, "x"), (None, None), (3, "again"), (3, "again"), (4, "é")]
    docs = documents(spark, rows)
    first = sharding.first_map(24)
    got = [x.asDict() for x in sharding.place(sharding.slotted(docs, by_key=True), first, sharding.grow(first)).collect()]
    assert len(got) == len(rows)
    assert sorted((str(x["doc_id"]), x["size"], x["text_crc32"]) for x in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for x in got:
        by[x["shard"]].append(x["slot"])
        assert x["grown_shard"] in (x["shard"], 24) and 0 <= x["shard"] < 24
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    shard = {x["doc_id"]: (x["shard"], x["grown_shard"]) for x in got}
    part = sharding.place(sharding.slotted(docs.where("doc_id < 50"), by_key=True), first, sharding.grow(first)).collect()
    assert all(shard[x["doc_id"]] == (x["shard"], x["grown_shard"]) for x in part)  # the id and the shard count decide
    assert sharding.place(sharding.slotted(docs.limit(0), by_key=True), first, sharding.grow(first)).count() == 0


def test_sharding_maps(spark, tmp_path):
    one = sharding.first_map(24)
    two = sharding.grow(one)
    moved = [i for i, (a, b) in enumerate(zip(one, two, strict=True)) if a != b]
    assert {two[i] for i in moved} == {24} and abs(len(moved) - 4096 / 25) <= 1
    sizes = collections.Counter(two)
    assert max(sizes.values()) - min(sizes.values()) <= 2
    r = random.Random(1)
    weights = {s: r.randrange(1, 1000) * (20 if s % 24 == 3 else 1) for s in range(4096)}
    three = sharding.rebalance(one, weights)
    load = collections.Counter()
    for s, shard in enumerate(three):
        load[shard] += weights[s]
    assert max(load.values()) <= 1.05 * sum(load.values()) / 24
    sharding.store_map(spark, str(tmp_path / "map"), 1, one)
    sharding.store_map(spark, str(tmp_path / "map"), 2, two)
    assert sharding.load_map(spark, str(tmp_path / "map"), 2) == two and sharding.load_map(spark, str(tmp_path / "map"), 1) == one


def test_sharding_rebalances_by_summed_bytes(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, "x" * r.randrange(400)) for i in range(3000)]
    slotted = sharding.slotted(documents(spark, rows), slots=96)
    sizes = {x["virtual_slot"]: (x["bytes"], x["rows"]) for x in sharding.slot_sizes(slotted).collect()}
    want = collections.defaultdict(lambda: (0, 0))
    slot_of = {x["doc_id"]: x["virtual_slot"] for x in slotted.collect()}
    for i, t in rows:
        b, n = want[slot_of[i]]
        want[slot_of[i]] = (b + len(t) + 8, n + 1)
    assert sizes == want
    one = [0 if slot < 40 else slot % 8 for slot in range(96)]
    two = sharding.rebalance(one, {s: b for s, (b, _) in sizes.items()})
    load = collections.Counter()
    for s, (b, _) in sizes.items():
        load[two[s]] += b
    assert max(load.values()) <= 1.05 * sum(load.values()) / 8
    sharding.store_map(spark, str(tmp_path / "map"), 3, two)
    placed = sharding.place(slotted, sharding.load_map(spark, str(tmp_path / "map"), 3), two)
    assert {x["shard"]: x["b"] for x in placed.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()} == load


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_sharding_query_follows_bytes_through_its_stored_maps(spark, monkeypatch, folder):
    stored = {}
    store = sharding.store_map
    monkeypatch.setattr(sharding, "store_map", lambda s, path, version, m: (stored.__setitem__(version, path), store(s, path, version, m)))
    got = queries.QUERIES["op6_sharding"](spark, f"/root/testdata/{folder}").collect()
    assert sorted(stored) == [1, 2]
    one, two = (sharding.load_map(spark, stored[v], v) for v in (1, 2))
    assert one == sharding.first_map(queries.SHARDS) and 0 < sum(a != b for a, b in zip(one, two, strict=True)) < 300
    assert got and all((x["shard"], x["grown_shard"], x["law"]) == (two[x["virtual_slot"]], None, "bytes") for x in got)
    load, slots = collections.Counter(), collections.defaultdict(list)
    for x in got:
        load[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert len(load) == queries.SHARDS and all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean, largest = sum(load.values()) / queries.SHARDS, max(x["size"] for x in got)
    assert max(load.values()) <= max(1.02 * mean, largest) and (largest > mean or min(load.values()) >= 0.98 * mean)


def test_sharding_deals_equal_rows_over_tasks(spark):
    rows = sharding.slotted(documents(spark, [(1, "same")] * 4000).repartition(4))
    placed = sharding.place(rows, sharding.first_map(24)).collect()
    assert {x["virtual_slot"] for x in placed} == {placed[0]["virtual_slot"]} and sorted(x["slot"] for x in placed) == list(range(4000))
    parts = rows.selectExpr(f"pmod(xxhash64(row), {sharding.PARTS}) AS p").groupBy("p").count().collect()
    assert len(parts) == sharding.PARTS and max(x["count"] for x in parts) < 400


def test_first_fit_decreasing_is_exact():
    r = random.Random(2)
    for _ in range(50):
        sizes = [r.randrange(1, 101) for _ in range(r.randrange(1, 60))]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free: list[int] = []
        want = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((k for k, x in enumerate(free) if x >= sizes[i]), len(free))
            free += [100] if b == len(free) else []
            free[b] -= sizes[i]
            want[i] = b
        assert bins == want
        assert all(o + s <= 100 for o, s in zip(offsets, sizes, strict=True))


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(packing.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    r = random.Random(6)
    words = ["the", "Éa", "don't", "x1", "😀", "İΣ", "a\x1cb", " ", "<|endoftext|>", "123", "…"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(100)] + [(None, None), (200, ""), (201, "long text " * 9000), (5, "again"), (5, "again")]
    got = [x.asDict() for x in packing.pack(packing.pieces(documents(spark, rows))).collect()]
    want = collections.Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.update((i, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096) for p in [ids[s : s + 4096]])
    assert collections.Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in got) == want
    by = collections.defaultdict(list)
    for x in got:
        by[x["sequence_id"]].append((x["offset"], x["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces(documents(spark, rows).limit(0))).count() == 0


def test_packing_wastes_little(spark):
    p = packing.pack(packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).toPandas()
    used = p.groupby("sequence_id")["length"].sum()
    padded = sum(4096 for u in used if u & (u - 1))
    assert used.sum() / (padded + sum(u for u in used if not u & (u - 1))) > 0.97


def shingle_set(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_duplicates(rows, least=85, of=100):
    sets = [(i, shingle_set(t)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and y and of * len(x & y) >= least * len(x | y)]
    to = root(links, {i for i, _ in sets})if links else {i: i for i, _ in sets}
    return collections.Counter((i, len(s), to[i], to[i] == i) for i, s in sets)


def near_texts(r, groups=12):
    """Texts with exact copies, near copies on both sides of the threshold, short texts and odd ones."""
    words = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for g in range(groups):
        base = [r.choice(words) for _ in range(r.choice([6, 20, 60, 150, 400]))]
        for _ in range(r.randrange(1, 12)):
            t = list(base)
            for _ in range(r.randrange(0, max(1, len(t) // 25) + 1)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((i, " ".join(t)))
            i += r.randrange(1, 4)
    rows += [(9001, None), (9002, ""), (9003, "  \n"), (9004, "one two"), (9005, "ONE\ttwo"), (9006, "one"), (9007, "one")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_texts(random.Random(seed))
    got = collections.Counter(tuple(x) for x in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_duplicates(rows)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "CHUNK", 3)
    rows = near_texts(random.Random(9), 6)
    got = collections.Counter(tuple(x) for x in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == brute_duplicates(rows)


def test_near_duplicates_nulls_and_repeats(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (None, text), (4, text), (4, text), (2, text), (7, None)]
    got = sorted((tuple(x) for x in minhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4, None, True), (None, 4, None, True), (4, 4, 2, False), (4, 4, 2, False), (2, 4, 2, True), (7, 0, 7, True)], key=str)
    assert minhash.near_duplicates(documents(spark, rows).limit(0)).count() == 0
    docs = documents(spark, [*rows, (2, text)])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(x["doc_id"]) for x in kept.collect()) == ["2", "7", "None", "None"]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.85, 0.9, 0.99, 1.0])
def test_bands_miss_few_pairs_at_the_threshold(threshold):
    bands, rows = minhash.banding(threshold)
    assert (1 - threshold**rows) ** bands <= 1e-6 and bands * rows <= minhash.MOST_SAMPLES


def test_keep_one_of_rows_that_share_an_id(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(4, a, "y"), (4, b, "x"), (4, a, "x"), (4, a, "x"), (2, a, "z"), (9, b, "k"), (9, b, "j"), (9, "1 2 3 4 5 6 7", "j"), (11, "o p o p o p", "n"), (11, "o p o p o p", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    assert sorted(map(tuple, minhash.keep_one(docs).collect())) == [(2, a, "z"), (11, "o p o p o p", "m")]


def test_odd_sketch_estimates_high_similarities():
    r = np.random.default_rng(0)
    for j in (0.95, 0.9, 0.85):
        errors = []
        for _ in range(30):
            both, apart = int(2000 * j), 2000 - int(2000 * j)
            x = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
            a, b = minhash.samples(np.sort(x[: both + apart // 2])), minhash.samples(np.sort(np.concatenate([x[:both], x[both + apart // 2 :]])))
            different = np.bitwise_count(np.frombuffer(minhash.odd_sketch(a), np.uint8) ^ np.frombuffer(minhash.odd_sketch(b), np.uint8)).sum()
            errors.append(float(minhash.similarity(np.array(different))) - j)
            assert different <= minhash.most_different(0.85)
        assert abs(np.mean(errors)) < 0.02


def brute_vectors(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    good = [(i, v / np.linalg.norm(v)) for i, v in good]
    links = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[:k] if x @ y >= 0.9]
    n = collections.Counter(i for link in links for i in link)
    to = root(links, {i for i, _ in rows})if links else {i: i for i, _ in rows}
    return collections.Counter((i, n[i], to[i], to[i] == i) for i, _ in rows)


@pytest.mark.parametrize("block", [1024, 40])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "BUCKET", 32)
    r = np.random.default_rng(3)
    rows, i = [], 0
    for _ in range(40):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 12))):
            rows.append((i, [float(np.float32(x)) for x in base + r.normal(size=16) * r.choice([0.0, 0.05, 0.2])]))
            i += 1
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] + [1.0] * 15), (9003, [float("inf")] * 16), (9004, [1.0] * 3), (None, [1.0] * 16), (9005, [1.0] * 15 + [None])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, id int")
    got = collections.Counter(tuple(x) for x in vectors.near_duplicates(df).collect())
    want = brute_vectors(rows)
    assert got == want
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vector_pairs_at_the_threshold_are_found(spark):
    r = np.random.default_rng(12)
    x, y = r.normal(size=(2, 10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    close = 0.9005 * x + math.sqrt(1 - 0.9005**2) * y
    flat = pa.array(np.concatenate([x, close]).astype(np.float32).ravel())
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.ListArray.from_arrays(np.arange(0, 20_001 * 64, 64, dtype=np.int32), flat)}))
    got = vectors.near_duplicates(df).toPandas().set_index("vec_id")
    assert (got["n_links"] == 1).all()
    assert (got["component_id"] == got.index % 10_000).all()


@pytest.mark.parametrize("n", [2_000, 10**7])
def test_vector_tables_are_independent(n):
    r = np.random.default_rng(13)
    cuts = vectors.planes(64, *vectors.plan(n, 0.9))
    missed = 0
    for _ in range(10):
        x, y = r.normal(size=(2, 2_000, 64))
        y -= (x * y).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
        y *= np.linalg.norm(x, axis=1, keepdims=True) / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = (vectors.bucket_keys(v @ cuts >= 0, *vectors.plan(n, 0.9)) for v in (x, 0.9 * x + math.sqrt(0.19) * y))
        missed += (~(a == b).any(1)).sum()
    assert missed == 0


def test_vector_estimates_are_unbiased():
    r = np.random.default_rng(8)
    turn = vectors.rotations(64)
    x = r.normal(size=(3000, 64))
    y = 0.8 * x + 0.6 * r.normal(size=(3000, 64))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    bits, factor, _ = vectors.encode(x, turn)
    signs = np.where(bits, 1, -1) / 16
    estimate, true = np.einsum("ij,ij->i", signs, y @ turn) / factor, np.einsum("ij,ij->i", x, y)
    assert abs((estimate - true).mean()) < 0.005
    assert (vectors.upper(bits, factor, y, turn) >= true).mean() > 0.999


def test_pipeline_equals_brute_force(spark, data):
    import corpus_pipeline
    from tessella.llm import quality, toxicity

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    own = quality.pieces(tokenizer_path(quality.VOCABULARY), tokenizer_path(quality.SECOND))
    rows = [r for r in docs.collect() if quality.measure(pa.array([r["text"]], pa.string()), pa.array([r["lang"]]), own)[6][0]]
    chain = toxicity.train(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r in rows if toxicity._probabilities(chain, [r["text"] or ""])[0, -1] <= toxicity.CUT]
    kept = {k[0] for k in brute_duplicates([(r["doc_id"], r["text"]) for r in rows], 80) if k[3]}
    out = corpus_pipeline.run(spark, data).toPandas()
    assert set(out["doc_id"]) == kept
    assert out.groupby("doc_id")["length"].sum().equals(out.groupby("doc_id")["doc_tokens"].first().rename("length"))


def test_all_queries_are_registered():
    numbers = [int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES if k.startswith("op")]
    assert sorted(numbers) == list(range(1, 11)) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, data, name):
    from oracle import connect, duck_rows, spark_rows

    assert spark_rows(queries.QUERIES[name](spark, data)) == duck_rows(connect(data), queries.ORACLES[name])
