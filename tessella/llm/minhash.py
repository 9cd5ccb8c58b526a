"""MinHash near-dedup with odd sketches.

Per document: the set of hashed shingles, MinHash samples, a hash of each band of samples (bands and rows follow from the
threshold, so that a pair at it is missed with a probability of at most ``MISSED``), and an odd sketch: every sample flips one bit of a bitmap, so that the bits in which two sketches differ tell how
many samples differ, precisely so for high similarities. Documents with equal sets form a class; only its smallest
id goes on. Candidates share a band:

1. in each bucket of two or more, every member is paired with the bucket's smallest id;
2. after the confirmed pairs are joined to components, buckets that still hold several components have all pairs
   across components looked at (sketches only, in blocks where a bucket is large), so no link between different
   texts is lost, and no pairs are made within a large group of near copies.

Pairs whose sketches may be similar enough are confirmed on the full sets: members come to their pair's text in
bounded chunks; where a cell holds many such pairs its rows come together instead, and pairs aren't made.
Confirmed pairs are joined to components in the cluster.

Defined cases: a null or empty text, or one without words, has an empty set and links with nothing; a text of
fewer words than a shingle has its whole word sequence as one; rows that share an id are one document, which
links through any of them; a null id links with nothing, keeps component_id null and counts as kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, mix, named, portions, sole, strings, words_of
from tessella.llm.components import components

SHINGLE, SKETCH_BITS = 5, 1024
#: Samples of a document at most, and the probability at most that a pair at the threshold shares no band.
MOST_SAMPLES, MISSED = 280, 1e-6
#: Standard deviations of the sketch's estimate that a pair may lie below the threshold and still be confirmed.
SLACK = 4.0
#: Members of a pair's chunk, rows of a block of a large bucket, and pairs by row from which a cell is confirmed whole.
CHUNK, BLOCK, FEW = 64, 256, 2
#: Parts of a class of equal sets, and the most ids that are sent to all tasks.
SALTS, SENT = 64, 1_000_000



def banding(threshold: float) -> tuple[int, int]:
    """Bands and rows of a band: the most rows with which bands enough for ``MISSED`` take ``MOST_SAMPLES`` at most."""
    for rows in range(20, 0, -1):
        bands = int(np.ceil(np.log(MISSED) / np.log1p(-min(threshold**rows, 1 - 1e-9))))
        if bands * rows <= MOST_SAMPLES:
            return bands, rows
    return MOST_SAMPLES, 1


BANDS, ROWS = banding(0.85)
SAMPLES = BANDS * ROWS

_R = np.random.default_rng(20)
_ODD = _R.integers(0, 1 << 63, MOST_SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_SALT = mix(np.arange(MOST_SAMPLES, dtype=np.uint64) + np.uint64(1000))
_BAND = mix(np.arange(MOST_SAMPLES, dtype=np.uint64) + np.uint64(9000))

PRINTS = "doc_id long, n_shingles long, same binary, bands array<bigint>, sketch binary"


class WordHashes(dict):
    """64-bit hashes of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return mix((h * _PLACE[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    total = h[:n] * _PLACE[0]
    for k in range(1, SHINGLE):
        total += mix(h[k : n + k] + _PLACE[k])
    return np.unique(mix(total))


def samples(found: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """MinHash samples of a set: the least product with each odd number."""
    odd = _ODD[:n]
    least = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(found), 2048):
        np.minimum(least, np.multiply.outer(odd, found[i : i + 2048]).min(1), out=least)
    return least


def band_keys(least: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash by band; equal samples in a band give equal hashes."""
    own = mix(least + _SALT[: len(least)]).reshape(-1, rows)
    return mix(own.sum(1, dtype=np.uint64) ^ _BAND[: len(own)]).view(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    """The parity, by bit, of the samples folded to it."""
    bits = np.bincount((mix(least ^ _SALT[: len(least)]) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def most_different(threshold: float, n: int = SAMPLES) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, with ``SLACK``."""
    p = 1 - threshold
    apart = min(n, n * p + SLACK * np.sqrt(n * p * threshold))
    # two bits by differing sample, less those that meet
    expected = SKETCH_BITS / 2 * (1 - np.exp(-4 * apart / SKETCH_BITS))
    return int(np.ceil(expected + 2 * np.sqrt(expected * (1 - expected / SKETCH_BITS) / 2)))


def similarity(different: np.ndarray, n: int = SAMPLES) -> np.ndarray:
    """The Jaccard similarity that a count of differing bits tells."""
    share = np.minimum(2 * different / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS * np.log(1 - share) / (4 * n)


def prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.85) -> DataFrame:
    """Per row: the size of the set, a hash of the whole set, band hashes and the odd sketch."""
    n_bands, rows = banding(threshold)

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = sole(("minhash",), WordHashes)
        for batch in portions(batches):
            n, same, bands, sketch = [], [], [], []
            for text in strings(batch.column(1)):
                found = shingles(text, hashes)
                n.append(len(found))
                same.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                least = samples(found, n_bands * rows) if len(found) else None
                bands.append(None if least is None else band_keys(least, rows))
                sketch.append(None if least is None else odd_sketch(least))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "same", "bands", "sketch"])

    return named(docs, doc_id=doc_id, text=text).mapInArrow(printed, PRINTS)


def _across(most: int):
    """Pairs across components in the cells of buckets, which come sorted; only sketches are looked at.

    A cell with few such pairs gives the pairs (a, b); one with many gives its rows (a alone), for all of them to be
    confirmed in one place.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if len({r[4] for r in held}) < 2:
                return
            ids, group = np.array([r[3] for r in held], np.int64), np.array([r[4] for r in held], np.int64)
            block = np.array([r[2] for r in held])
            bits = np.frombuffer(b"".join(r[5] for r in held), np.uint64).reshape(len(held), -1)
            first, second = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
            found_a, found_b = [], []
            for at in range(0, len(first), 256):
                x = first[at : at + 256]
                close = np.bitwise_count(bits[x][:, None] ^ bits[second][None]).sum(2, dtype=np.int64) <= most
                i, j = np.nonzero(close & (group[x][:, None] != group[second][None]))
                found_a.append(x[i])
                found_b.append(second[j])
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            pairs = np.unique(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1), axis=0)
            n = len(pairs)
            if n <= FEW * len(held):
                none = pa.nulls(n, pa.int64())
                columns = [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none, none]
            else:
                rows = [held[i] for i in np.unique(np.concatenate([a, b]))]
                columns = [pa.array([r[3] for r in rows], pa.int64()), pa.nulls(len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2, 4))]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "cell", "block", "component_id"])

        for batch in portions(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield from flush()
                    held = []
                held.append(row)
        if held:
            yield from flush()

    return paired


ACROSS = "a long, b long, key long, cell long, block long, component_id long"


def in_cell(rows: list[tuple[int, int, int]], sets: list[np.ndarray], least: int, of: int) -> list[tuple[int, int]]:
    """Links between rows (id, block, component) of a cell's two blocks that join components; pairs that are joined by then are left out."""
    if not rows:
        return []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    low, high = min(r[1] for r in rows), max(r[1] for r in rows)
    second = [i for i, r in enumerate(rows) if r[1] == high]
    sizes = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([codes[starts[i] : starts[i] + sizes[i]] for i in second])
    edges = np.cumsum(sizes[second]) - sizes[second]
    mark, links = np.zeros(len(codes), np.int32), []
    for i, (own, block, component) in enumerate(rows):
        if block != low:
            continue
        codes_i = codes[starts[i] : starts[i] + sizes[i]]
        mark[codes_i] = 1
        both = np.add.reduceat(mark[flat], edges)
        mark[codes_i] = 0
        for k in np.flatnonzero(of * both >= least * (sizes[i] + sizes[second] - both)):
            other, _, there = rows[second[k]]
            a, b = find(component), find(there)
            if a != b:
                root[b] = a
                links.append((own, other))
    return links


def _confirmed(least: int, of: int):
    """Looks at texts by group, which come sorted: a chunk of a pair's partners with its own text first, or a cell's rows."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, chunk, owners = sole(("minhash",), WordHashes), None, []
        rows: list[tuple[int, int, int]] = []
        sets: list[np.ndarray] = []
        for batch in portions(batches):
            a, b, good = [], [], []
            for is_cell, owner_id, part, member, block, component, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(text, hashes)
                if chunk != (is_cell, owner_id, part):
                    for x, y in in_cell(rows, sets, least, of):
                        a.append(x)
                        b.append(y)
                        good.append(True)
                    chunk, owners, rows, sets = (is_cell, owner_id, part), [], [], []
                if is_cell:
                    if len(found):
                        rows.append((member, block, component))
                        sets.append(found)
                elif member is None:
                    owners.append(found)
                else:
                    ok = False
                    for owner in owners:  # rows that share an id are one document
                        both = len(np.intersect1d(owner, found, assume_unique=True))
                        ok |= bool(both) and of * both >= least * (len(owner) + len(found) - both)
                    a.append(owner_id)
                    b.append(member)
                    good.append(ok)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(good, pa.bool_())], ["a", "b", "good"])
        if links := in_cell(rows, sets, least, of):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64()), pa.array([True] * len(links))], ["a", "b", "good"])

    return confirmed


def confirm(pairs: DataFrame, docs: DataFrame, least: int, of: int, cells: DataFrame | None = None) -> DataFrame:
    """(a, b, good) of each pair of ids, on the full sets, and the links that join components inside cells; docs: doc_id, text.

    A hub's partners come in chunks.
    """
    pairs = cut(pairs)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    chunked = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    wanted = chunked.select(F.col("b").alias("doc_id"), F.lit(False).alias("is_cell"), F.col("a").alias("owner"), "part", F.col("b").alias("member"), zero.alias("block"), none.alias("component_id"))
    wanted = wanted.union(chunked.select("a", "part").distinct().select("a", F.lit(False), "a", "part", none, zero, none))
    if cells is not None:
        wanted = wanted.union(cells.select("a", F.lit(True), "key", "cell", "a", "block", "component_id"))
    texts = docs.join(wanted, "doc_id").select("is_cell", "owner", "part", "member", "block", "component_id", "text")
    dealt = texts.repartition("is_cell", "owner", "part").sortWithinPartitions("is_cell", "owner", "part", F.col("member").asc_nulls_first())
    return dealt.mapInArrow(_confirmed(least, of), "a long, b long, good boolean").groupBy("a", "b").agg(F.max("good").alias("good"))


def equal_sets(usable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The smallest id of each class of equal sets, and links (a, b) that join each class.

    Members link to the smallest of their ``SALTS``-th of the class, and those to the smallest of all, so that a large
    class is dealt over many tasks.
    """
    salted = usable.select("same", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "doc_id")
    parts = salted.groupBy("same", "salt").agg(F.min("doc_id").alias("part"))
    heads = parts.groupBy("same").agg(F.min("part").alias("head"))
    up = salted.join(parts, ["same", "salt"]).select(F.col("part").alias("a"), F.col("doc_id").alias("b"))
    top = parts.join(heads, "same").select(F.col("head").alias("a"), F.col("part").alias("b"))
    return heads.select(F.col("head").alias("doc_id")).distinct(), up.union(top).where("a <> b").distinct()


def few(ids: DataFrame) -> DataFrame:
    """Ids to be joined, sent to all tasks if there are at most ``SENT`` (8 bytes each), so that texts are not shuffled to meet them."""
    return F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 85, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; links have a similarity of least/of or more."""
    docs = named(docs, doc_id=doc_id, text=text)
    marks = cut(prints(docs, threshold=least / of))
    most = most_different(least / of, np.prod(banding(least / of)))
    usable = marks.where("same is not null and doc_id is not null")
    smallest, same = equal_sets(usable)
    heads = usable.join(smallest, "doc_id", "left_semi")
    sketches = heads.select("doc_id", "sketch").distinct()
    keys = heads.select("doc_id", F.explode("bands").alias("key"))
    buckets = cut(keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"))
    in_buckets = cut(keys.join(buckets, "key").select("key", "doc_id", "least", "n"))
    stars = in_buckets.where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    a, b = (sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    apart = _different("sketch_a", "sketch_b")
    hopeful = stars.join(a, "a").join(b, "b").where(apart <= most).select("a", "b").distinct()
    # texts that share a bucket are the only ones looked at from here on
    texts = cut(docs.join(few(cut(in_buckets.select("doc_id").distinct())), "doc_id", "left_semi"))
    looked = cut(confirm(hopeful, texts, least, of))
    linked = components(looked.where("good").select("a", "b"))
    # buckets that still hold several components
    placed = in_buckets.join(linked.select(F.col("id").alias("doc_id"), "component_id"), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    mixed = placed.groupBy("key").agg(F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("low < high").select("key")
    rest = cut(placed.join(mixed, "key", "left_semi"))
    links = looked.where("good").select("a", "b")
    if not rest.isEmpty():
        cells = _cells(rest.join(sketches, "doc_id"))
        dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "block")
        across = cut(dealt.mapInArrow(_across(most), ACROSS))
        pairs = across.where("b is not null").select("a", "b").distinct().join(looked, ["a", "b"], "left_anti")
        again = cut(confirm(pairs, texts, least, of, across.where("b is null")))
        links = links.union(again.where("good").select("a", "b"))
    final = components(links.union(same))
    found = marks.select("doc_id", "n_shingles").join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _different(a: str, b: str):
    """Differing bits of two sketches, on the JVM's side."""
    words = SKETCH_BITS // 64
    part = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")
    return sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(words)), F.lit(0))


def _cells(rows: DataFrame) -> DataFrame:
    """(key, cell, block, doc_id, component_id, sketch): a bucket of up to BLOCK rows is one cell; of a larger one each
    pair of blocks is a cell, but for pairs of blocks that hold only the bucket's main component."""
    small = rows.where(F.col("n") <= BLOCK).select("key", F.lit(0).cast("long").alias("cell"), F.lit(0).alias("block"), "doc_id", "component_id", "sketch")
    large = rows.where(F.col("n") > BLOCK)
    sizes = large.groupBy("key", "component_id").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max_by("component_id", F.struct("m", "component_id")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("all"))
    large = large.join(main, "key")
    n_main, n_rest = (F.ceil(F.col("most") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int"))
    is_main = F.col("component_id") == F.col("main")
    own = F.when(is_main, F.pmod(F.hash("doc_id"), n_main)).otherwise(n_main + F.pmod(F.hash("doc_id"), n_rest))
    others = F.when(is_main, F.sequence(n_main, n_main + n_rest - 1)).otherwise(F.sequence(F.lit(0), n_main + n_rest - 1))
    large = large.withColumn("block", own.cast("int")).withColumn("other", F.explode(others))
    cell = F.least("block", "other").cast("long") * 1_000_000 + F.greatest("block", "other")
    return small.union(large.select("key", cell.alias("cell"), "block", "doc_id", "component_id", "sketch"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 80, of: int = 100) -> DataFrame:
    """The rows, with all their columns, of one document of each group; documents without an id or words stay.

    Rows that share an id are one document and stay together, but of rows with one id and one text the first by the
    order of their columns as JSON stays.
    """
    found = cut(near_duplicates(docs, doc_id, text, least, of))
    own = F.col(f"`{doc_id}`")
    gone = found.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    left = docs.alias("d").join(gone.alias("g"), F.col(f"d.`{doc_id}`") == F.col("g.gone"), "left_anti")
    again = cut(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select(F.col("doc_id").alias("again")))
    if again.isEmpty():
        return left
    same_id = F.col(f"d.`{doc_id}`") == F.col("g.again")
    once = left.alias("d").join(again.alias("g"), same_id, "left_anti")
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = left.alias("d").join(again.alias("g"), same_id, "left_semi").groupBy(own.alias("i"), F.col(f"`{text}`").alias("t")).agg(F.min_by(rows, F.to_json(rows)).alias("r"))
    return once.union(first.select("r.*"))
