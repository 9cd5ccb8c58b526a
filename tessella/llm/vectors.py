"""Embedding near-dedup with randomised-rotation binary codes.

A vector's code is the signs of its unit vector under ``ROTATIONS`` random rotations, stored with the correction
factor <code, rotated vector>: <code, q> / factor is an unbiased estimate of the inner product with any q, and its
error has a bound that the factor gives. Estimates with their upper bounds decide which pairs need the exact cosine.

Equal vectors become one with a weight. Buckets hold the candidates. A bucket's bits are the sides of random planes,
drawn anew for each bit of each table, so tables are independent for every pair and one at the threshold shares no
bucket with a probability of ``MISS`` at most, at any number of vectors; closer pairs are missed less. The number of
bits grows with the number of vectors, so buckets stay small. A bucket is one cell or, where it is large, a cell for each pair of its blocks. In a cell codes and
8-bit vectors give the estimates; only vectors with a partner above the bound go on, with their full components,
to the exact step, which counts links and joins components inside the cell: pairs are never emitted. A pair counts
in the first table in which it shares a bucket.

Defined cases: null vectors, those of another length than the most, zero vectors, and vectors with null or
non-finite components link with nothing; rows that share an id are one vector, linked through any of them;
a null id links with nothing, keeps component_id null and counts as kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, named
from tessella.llm.components import components

ROTATIONS, MISS, BOUND = 4, 1e-6, 5.0
#: Vectors that a bucket should have, and the most of a block.
BUCKET, BLOCK = 512, 1024


def rotations(dim: int, seed: int = 11) -> np.ndarray:
    """(dim, ROTATIONS * dim): random orthogonal matrices side by side, scaled so that they keep lengths."""
    r = np.random.default_rng(seed)
    parts = []
    for _ in range(ROTATIONS):
        q, up = np.linalg.qr(r.normal(size=(dim, dim)))
        parts.append(q * np.sign(np.diag(up)))
    return np.hstack(parts) / math.sqrt(ROTATIONS)


def plan(n: int, threshold: float) -> tuple[int, int]:
    """How many tables, and bits of each."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(4, min(40, math.ceil(math.log2(max(n, 2) / BUCKET))))
    return math.ceil(math.log(MISS) / math.log1p(-(agree**bits))), bits


def planes(dim: int, tables: int, bits: int, seed: int = 5) -> np.ndarray:
    """(dim, tables * bits): independent random directions."""
    return np.random.default_rng(seed).normal(size=(dim, tables * bits))


def bucket_keys(sides: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """(vectors, tables): the bucket of each vector in each table, from its sides of the planes."""
    return sides.reshape(len(sides), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: sign bits, correction factors, and 8-bit components."""
    rotated = x @ turn
    bits = rotated >= 0
    factor = np.abs(rotated).sum(1) / math.sqrt(turn.shape[1])
    top = np.abs(x).max(1, keepdims=True)
    return bits, factor, np.round(x / top * 127).astype(np.int8)


def upper(bits_x: np.ndarray, factor_x: np.ndarray, y: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Row by row, the estimate of <x, y> from x's code, plus its bound."""
    d = turn.shape[1]
    signs = np.where(bits_x, 1.0, -1.0) / math.sqrt(d)
    estimate = np.einsum("ij,ij->i", signs, y @ turn) / factor_x
    # 0.03: what rounding to 8 bits may add
    return estimate + BOUND * np.sqrt(np.maximum(1 - factor_x**2, 0)) / (factor_x * math.sqrt(d - 1)) + 0.03


def _unit(flat: pa.Array, dim: int) -> np.ndarray:
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of tiny or huge components are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(bits: np.ndarray) -> pa.Array:
    rows = np.packbits(bits, axis=1)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; links have a cosine of the threshold or more."""
    rows = named(table, vec_id=vec_id, embedding=embedding)
    v = F.col("embedding")
    big = F.lit(float("inf"))
    fine = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == big)) & F.exists(v, lambda e: e != 0)
    sizes = rows.where(v.isNotNull()).groupBy(F.size(v).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dim = int(sizes["d"]) if sizes else 0
    usable = rows.where(v.isNotNull() & F.col("vec_id").isNotNull() & (F.size(v) == dim) & fine)
    # the hash first, as it is a far smaller key for the sums than the vector
    heads = cut(usable.groupBy(F.xxhash64("embedding").alias("hash"), "embedding").agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight")))
    n = heads.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    turn, (tables, width) = rotations(dim), plan(n, threshold)
    cuts = planes(dim, tables, width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column("embedding").flatten(), dim)
                bits, factor, small = encode(x, turn)
                sides = x @ cuts >= 0
                keys = bucket_keys(sides, tables, width) + (np.arange(tables, dtype=np.int64) << 42)
                yield pa.RecordBatch.from_arrays([batch.column("id"), _packed(bits), pa.array(factor.astype(np.float32)), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), _packed(sides)], ["id", "code", "factor", "small", "keys", "sides"])

    codes = cut(heads.select("id", "embedding").mapInArrow(coded, "id long, code binary, factor float, small binary, keys array<bigint>, sides binary"))
    keyed = codes.select("id", F.explode("keys").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = keyed.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cell = F.concat_ws(":", "key", F.least("block", "other"), F.greatest("block", "other"))
    cells = cut(placed.select(cell.alias("cell"), "block", "id"))
    rows_in = cells.join(codes.select("id", "code", "factor", "small"), "id").select("cell", "block", "id", "code", "factor", "small")
    active = rows_in.repartition("cell").sortWithinPartitions("cell").mapInArrow(_by_cell(_estimated(turn, threshold)), "cell string, block int, id long")
    exact_in = active.join(heads.select("id", "embedding", "weight"), "id").join(codes.select("id", "sides"), "id").select("cell", "block", "id", "embedding", "weight", "sides")
    exact = cut(exact_in.repartition("cell").sortWithinPartitions("cell").mapInArrow(_by_cell(_exact(dim, threshold, tables, width)), "id long, links long, low long"))
    linked = components(exact.select(F.col("id").alias("a"), F.col("low").alias("b")).union(_same(usable, heads)))
    total = exact.groupBy("id").agg(F.sum("links").alias("links"))
    by_vector = heads.select("hash", F.col("embedding").alias("e"), "id", "weight").join(total, "id", "left").select("hash", "e", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    own = usable.join(by_vector, (F.xxhash64("embedding") == F.col("hash")) & (F.col("embedding") == F.col("e"))).groupBy("vec_id").agg(F.max("n_links").alias("n_links"))
    found = rows.select("vec_id").join(own, "vec_id", "left").join(linked.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _same(usable: DataFrame, heads: DataFrame) -> DataFrame:
    """Links between equal vectors: each to the smallest id."""
    many = heads.where("weight > 1").select("hash", F.col("embedding").alias("e"), "id")
    return usable.join(many, (F.xxhash64("embedding") == F.col("hash")) & (F.col("embedding") == F.col("e"))).select(F.col("vec_id").alias("a"), F.col("id").alias("b"))


def _by_cell(work):
    """Call work with the rows of one cell after another; the cells come sorted and hold two blocks at most."""

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = np.array(batch.column("cell").to_pylist(), object)
            edges = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if low == high:
                    continue
                if held and held[0].column("cell")[0].as_py() != cells[low]:
                    yield from work(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(batch.slice(low, high - low))
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return walked


def _sides(cell: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a cell's first and second block, and whether they are the same."""
    _, a, b = cell["cell"][0].as_py().split(":")
    block = cell["block"].to_numpy()
    return np.flatnonzero(block == int(a)), np.flatnonzero(block == int(b)), a == b


def _bytes(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _estimated(turn: np.ndarray, threshold: float):
    """The rows of a cell that have a partner whose estimate may reach the threshold."""
    d = turn.shape[1]
    apart = math.acos(threshold) / math.pi
    most = d * apart + BOUND * math.sqrt(d * apart * (1 - apart)) + 2

    def work(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        first, second, same = _sides(cell)
        code = _bytes(cell["code"], np.uint8)
        pad = -code.shape[1] % 8
        words = np.ascontiguousarray(np.pad(code, ((0, 0), (0, pad)))).view(np.uint64)
        bits = np.unpackbits(code, axis=1)[:, :d].astype(bool)
        factor, y = cell["factor"].to_numpy().astype(np.float64), _bytes(cell["small"], np.int8).astype(np.float64)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        active = np.zeros(len(code), bool)
        for at in range(0, len(first), 128):
            x = first[at : at + 128]
            differ = np.zeros((len(x), len(second)), np.uint16)
            for k in range(words.shape[1]):
                differ += np.bitwise_count(words[x, k][:, None] ^ words[second, k][None])
            i, j = np.nonzero(differ <= most)
            i, j = x[i], second[j]
            if same:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 50_000):
                p, q = i[part : part + 50_000], j[part : part + 50_000]
                open_ = np.minimum(upper(bits[p], factor[p], y[q], turn), upper(bits[q], factor[q], y[p], turn)) >= threshold
                active[p[open_]] = active[q[open_]] = True
        at = pa.array(np.flatnonzero(active))
        if len(at):
            yield from cell.select(["cell", "block", "id"]).take(at).to_batches()

    return work


def _exact(dim: int, threshold: float, tables: int, width: int):
    """By row of a cell, the weight of its links that count here and the smallest id they reach here."""

    def work(cell: pa.Table) -> Iterator[pa.RecordBatch]:
        first, second, same = _sides(cell)
        table = int(cell["cell"][0].as_py().split(":")[0]) >> 42
        x = _unit(cell["embedding"].combine_chunks().flatten(), dim)
        sides = np.unpackbits(_bytes(cell["sides"], np.uint8), axis=1)[:, : tables * width].astype(np.int64)
        keys = bucket_keys(sides, tables, width)[:, :table]
        ids, weight = cell["id"].to_numpy(), cell["weight"].to_numpy()
        links, low = np.zeros(len(x), np.int64), np.arange(len(x))
        for at in range(0, len(first), 256):
            rows = first[at : at + 256]
            i, j = np.nonzero(x[rows] @ x[second].T >= threshold)
            i, j = rows[i], second[j]
            if same:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 100_000):
                p, q = i[part : part + 100_000], j[part : part + 100_000]
                here = ~(keys[p] == keys[q]).any(1)
                p, q = p[here], q[here]
                links += np.bincount(p, weight[q], len(x)).astype(np.int64) + np.bincount(q, weight[p], len(x)).astype(np.int64)
                low = _joined(low, p, q)
        at = np.flatnonzero(links)
        if len(at):
            order = np.full(len(x), np.iinfo(np.int64).max)
            np.minimum.at(order, low, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(order[low[at]])], ["id", "links", "low"])

    return work


def _joined(low: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels after the links p-q: each place gets the smallest label it reaches."""
    while True:
        a, b = low[p], low[q]
        apart = a != b
        if not apart.any():
            return low
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        to = np.arange(len(low))
        np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
        while (to[to] != to).any():
            to = to[to]
        low = to[low]
