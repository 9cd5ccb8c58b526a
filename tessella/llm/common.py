"""What the operators of this subpackage share: tables, checkpoints, tokens and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.shared import cut

__all__ = ["Ids", "cut", "mix", "named", "portions", "ragged", "sole", "strings", "table", "tokenizer_path", "words_of"]

#: Bytes of the part of an Arrow batch that is worked on at once, if it has more than one row.
PORTION = 5 << 20
#: Strings whose ids a worker remembers for good, and those of late.
KNOWN, RECENT = 350_000, 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def give_back() -> None:
    """Hand freed memory to the system, as other tasks and the JVM share the executor's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # where the C library has no such call its own habits hold
        ctypes.CDLL(None).malloc_trim(0)


def portions(batches: Iterable[pa.RecordBatch], most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches cut into halves until each has ``most`` bytes at most or one row, as texts can be very long."""
    for batch in batches:
        yield from halves(batch, most)
        if batch.nbytes > most:
            give_back()


def halves(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    if batch.nbytes <= most or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from halves(batch.slice(0, half), most)
        yield from halves(batch.slice(half), most)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file, in ``folder`` or where the installed package of public tokenizers has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_held: dict = {}


def sole(key: tuple, make: Callable):
    """make() for the key, held while a worker serves one operator: the next one's takes its place and its memory."""
    if key not in _held:
        if _held:
            _held.clear()
            gc.collect()
            give_back()
        _held[key] = make()
    return _held[key]


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8: what bytes.split and bytes.lower do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Texts of an Arrow column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator reads, under the names it uses inside; other columns can't clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser with public constants of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` one after the other, and the bounds between them."""
    bounds = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    kind = np.int32 if max(len(flat), bounds[-1]) < 1 << 31 else np.int64
    at = np.repeat((starts - bounds[:-1]).astype(kind), lengths)
    at += np.arange(bounds[-1], dtype=kind)
    return flat[at], bounds


class Ids:
    """Ids by string, side by side in one array: the first ``KNOWN`` strings stay, as frequent ones come early; of the others the late ones."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type = np.uint32, known: int = KNOWN, recent: int = RECENT):
        """encode: the ids of strings one after the other, and how many each has."""
        self.encode, self.slot, self.known, self.recent = encode, {}, known, recent
        self.flat, self.bounds = np.zeros(0, dtype), np.zeros(1, np.int64)

    def slots(self, strings: pa.Array) -> np.ndarray:
        """Places of the strings, for ``of`` until the next call."""
        if len(self.slot) > self.known + self.recent:
            self.slot = dict(islice(self.slot.items(), self.known))
            self.bounds = self.bounds[: self.known + 1].copy()
            self.flat = self.flat[: self.bounds[-1]].copy()
        names = strings.to_pylist()
        found = list(map(self.slot.get, names))
        if None in found:
            new = list(dict.fromkeys(x for x, at in zip(names, found, strict=True) if at is None))
            flat, lengths = self.encode(new)
            self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype, copy=False)])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
            found = map(self.slot.__getitem__, names)
        return np.fromiter(found, np.int64, len(names))

    def of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places one after the other, and the bounds between them."""
        return ragged(self.flat, self.bounds[slots], self.bounds[slots + 1] - self.bounds[slots])
