"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are cut into pieces: full sequences and a rest. Rests are dealt at random (by hash) into groups
of ``GROUP`` and each group is packed on its own: longest first, each into the first bin with room, which a
tournament tree over the bins' capacities finds in logarithmic time. Only piece sizes and checksums travel;
texts are read and encoded once, where they are.

White space separates tokens in the public vocabulary used, so a portion of texts is split and its distinct chunks
are coded in Arrow; letters and the marks after them are parts with ids of their own, which a bounded table holds. Ids
of texts are then gathered from the parts' ids; texts with the separator or special tokens go whole through the library.

Defined cases: a null or empty text is the end id alone. Repeated rows and null ids are packed each.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import KNOWN, Ids, cut, named, portions, ragged, sole, tokenizer_path

VOCABULARY, END_ID = "word_bpe_49k.json", 2
LENGTH, GROUP = 4096, 4096
SEPARATOR = "\x01"
#: Marks that are tokens apart from letters before them, and letters whose lower case is a letter by itself.
MARKS, PLAIN = ".,;:!?\"'()[]{}|%*$#&", "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: A part of letters that are one token or more, the last of which ends a word.
LETTERS = "^[a-zß-öø-ÿ]+$"
#: The separator, and openers of special tokens.
ODD = r"\x01|<\|"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class WordCodec:
    """Ids of texts."""

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        (self.separator,) = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for token, i in self.library.get_vocab().items() if token.endswith("</w>")]] = True
        self.parts = Ids(self.learn, known=known, recent=known // 2)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, joined for the library, as a call for each takes longer: words of letters by spaces, others by the separator."""
        plain = pc.match_substring_regex(pa.array(new, pa.string()), LETTERS).to_numpy(zero_copy_only=False)
        order, found, lengths = np.argsort(~plain, kind="stable"), [], []
        for places, joint in ((order[: plain.sum()].tolist(), " "), (order[plain.sum() :].tolist(), f" {SEPARATOR} ")):
            for i in range(0, len(places), 2000):
                here = [new[k] for k in places[i : i + 2000]]
                (ids,) = self.whole([joint.join(here)])
                if joint == " ":
                    ends = np.flatnonzero(self.ends[ids]) + 1
                    lengths.append(np.diff(ends, prepend=0))
                else:
                    parted = ids == self.separator
                    ends = np.append(np.flatnonzero(parted) - np.arange(parted.sum()), len(ids) - parted.sum())
                    lengths.append(np.diff(ends, prepend=0))
                    ids = ids[~parted]
                assert len(ends) == len(here), "each part is there once"
                found.append(ids)
        flat, lengths, back = np.concatenate(found), np.concatenate(lengths), np.argsort(order)
        return ragged(flat, (np.cumsum(lengths) - lengths)[back], lengths[back])[0], lengths[back]

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and the bounds between them: those of the letters in lower case, and those of the marks after them."""
        cores = pc.utf8_rtrim(chunks, MARKS)
        plain = pc.match_substring_regex(cores, PLAIN)
        offsets, data = np.frombuffer(chunks.buffers()[1], np.int32)[: len(chunks) + 1].astype(np.int64), np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        kept = np.where(plain.to_numpy(zero_copy_only=False), pc.binary_length(cores).to_numpy(), np.diff(offsets))
        marks, bounds = ragged(data, offsets[:-1] + kept, np.diff(offsets) - kept)
        tails = pa.StringArray.from_buffers(len(chunks), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(marks))
        parts = pa.concat_arrays([pc.if_else(plain, pc.utf8_lower(cores), chunks), tails]).dictionary_encode()
        slots = self.parts.slots(parts.dictionary)[parts.indices.to_numpy()]
        ids, bounds = self.parts.of(slots.reshape(2, -1).T.ravel())
        return ids, bounds[::2]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text; a null one is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, ODD)
        split = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        coded = split.values.dictionary_encode()
        own, bounds = self.chunks(coded.dictionary)
        chunks = coded.indices.to_numpy()
        ids, at = ragged(own, bounds[chunks], bounds[chunks + 1] - bounds[chunks])
        ends = at[split.offsets.to_numpy()].tolist()
        for i, is_odd in enumerate(odd.to_pylist()):
            yield self.whole([texts[i].as_py()])[0] if is_odd else ids[ends[i] : ends[i + 1]]


def codec(path: str) -> WordCodec:
    return sole(("packing", path), lambda: WordCodec(path))


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, name: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Every document's ids, with the end id, cut into full sequences and a rest."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = codec(tokenizer_path(name, folder)), np.array([END_ID], "<u4")
        for batch in portions(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                raw, n = np.append(ids, end).astype("<u4", copy=False).tobytes(), len(ids) + 1
                for start in range(0, n, length):
                    for column, x in zip(out, (i, start, min(length, n - start), zlib.crc32(raw[4 * start : 4 * (start + length)]), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return named(docs, doc_id=doc_id, text=text).mapInArrow(cut_up, PIECES)


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset there of each item; items are no larger than the capacity.

    ``tree`` is a tournament over the bins: an inner node has the larger of the free capacities below it.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, node = sizes[i], 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= size else 2 * node + 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack(items: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of at most ``length`` tokens; columns of these names are replaced.

    Rows are dealt by a hash of their place in the checkpointed table, so equal rows go apart and a lost partition is
    dealt again alike. A partition is packed in groups of ``group`` rows; ids of sequences hold the partition.
    """
    items = cut(items.drop("sequence_id", "offset"))
    dealt = "dealt"
    while dealt in items.columns:
        dealt += "_"
    schema = f"{', '.join(f'`{n}` {t}' for n, t in items.dtypes)}, sequence_id long, offset long"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fresh = count(TaskContext.get().partitionId() << 36)
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).drop_columns([dealt])
            bins, offsets = first_fit_decreasing(rows["length"].to_pylist(), length)
            ids = [next(fresh) for _ in range(max(bins) + 1)]
            rows = rows.append_column("sequence_id", pa.array([ids[b] for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            yield from rows.to_batches()

        for batch in portions(batches):
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, group - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) == group:
                    yield from flush()
                    held = []
        if held:
            yield from flush()

    rows = items.withColumn(dealt, F.xxhash64(F.monotonically_increasing_id(), F.lit(17)))
    return rows.repartition(dealt).sortWithinPartitions(dealt).mapInArrow(packed, schema)
