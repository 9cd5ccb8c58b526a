"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Texts are coded once into blocks (a dictionary of the block's distinct words and an index array), so that
corpus counts, class trigrams and scores are all array work on the blocks, and only a block's distinct words
are shuffled. The model's outcomes are ``CLASSES`` word classes: the most frequent training tokens are a class
each, all other words fall into classes by the end of their letters. Two context classes predict the next one:
``r = R[a] A + R[b] B; s(w) = r . Q[w] + bias[w]``; a batched matrix product and a log-softmax give normalised
log-probabilities. Inside a class, words have vectors of their own: ``s(w) = log share + b[w] + c . V[w]``, where c
is the last token's context vector and the share is the word's of the class's training tokens; a word seen fewer than ``OWN_COUNT``
times has its share only. Scores are normalised over the class, less the share set aside for unknown words (by the number of words
seen once), so all outcomes of a step sum to one.

Training uses every training text. Class trigrams (at most 129 * 129 * 128 cells) are summed over the cluster for the class model. How
often each word with a vector came after each context class is summed too, a table that grows with the vocabulary; as
contexts are fixed by then, the noise-contrastive objective falls apart by word, and the cluster fits words
side by side. Words with a vector grow with the input up to ``OWN_WORDS``, the most frequent ones, as all tasks
hold their vectors. The objective is taken in expectation over the data and the noise.

Defined cases: a null text is an empty text (its one token is the end). A null id counts as the text ''.
Without any training text the base score is 0 and the model is uniform. Repeated rows are scored each.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, named, portions, strings, words_of

CLASSES, TOP, DIM = 128, 64, 16
START = CLASSES  # the class before a text's first token
CONTEXTS = CLASSES + 1
#: Words never hold white space, so this is the end's token.
END = "\n"
BLOCK_TOKENS = 2_000_000
#: Words with a vector of their own: how often they are seen at least, how many they are at most (80 bytes each), their vector's size and its ridge.
OWN_COUNT, OWN_WORDS, OWN_DIM, OWN_RIDGE = 12, 1_000_000, 8, 2.0
#: Words that are fitted in one go.
PART = 2048
NOISE, STEPS, RATE = 10.0, 120, 0.08

BLOCKS = "block long, doc_ids array<bigint>, held array<boolean>, lengths array<int>, codes binary, words array<string>, counts array<int>, tails binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tail_class(word: bytes) -> int:
    """The class of a word that has none of its own: by its last two letters and a closing mark."""
    stem = word.rstrip(b".,!?%*$#&|;:")
    return TOP + zlib.crc32(stem[-3:] if stem[-1:] >= b"\x80" else stem[-2:]) % 31 + (31 if len(stem) != len(word) else 0)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get().partitionId() << 24
    made = count()
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("tails", pa.binary())])

    def fresh():
        index = defaultdict(count().__next__)
        index[b"\n"]
        return index, [], [], [], []

    def block(index, ids, held, lengths, parts):
        codes = np.concatenate(parts)
        learn = codes[np.repeat(~np.array(held), lengths)]
        words = list(index)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([task + next(made)]), pa.array([ids], pa.list_(pa.int64())), pa.array([held]), pa.array([lengths], pa.list_(pa.int32())),
                pa.array([zstandard.compress(codes.tobytes(), 1)]), pa.array([[w.decode("utf-8", "replace") for w in words]]),
                pa.array([np.bincount(learn, minlength=len(words)).astype(np.int32)], pa.list_(pa.int32())), pa.array([bytes(map(tail_class, words))]),
            ],
            schema=schema,
        )

    index, ids, held, lengths, parts = fresh()
    size = 0
    for batch in portions(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            words = words_of(text)
            words.append(b"\n")
            parts.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
            ids.append(doc_id)
            held.append(is_held(doc_id))
            lengths.append(len(words))
            size += len(words)
            if size >= BLOCK_TOKENS:
                yield block(index, ids, held, lengths, parts)
                (index, ids, held, lengths, parts), size = fresh(), 0
    if ids:
        yield block(index, ids, held, lengths, parts)


def code_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as coded blocks of at most about ``BLOCK_TOKENS`` tokens (a longer text is a block of its own)."""
    return cut(named(docs, doc_id=doc_id, text=text).mapInArrow(_coded, BLOCKS))


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, c) over all training tokens; words seen in held-out texts only are left out."""
    pairs = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.counts").cast("long").alias("c"))
    return cut(pairs.where("c > 0").groupBy("word").agg(F.sum("c").alias("c")))


def _classes(words: pa.ListScalar, tails: bytes, top: pa.Array) -> np.ndarray:
    """The class of each word of a block."""
    own = pc.fill_null(pc.index_in(words.values, value_set=top), -1).to_numpy()
    return np.where(own >= 0, own, np.frombuffer(tails, np.uint8)).astype(np.int64)


def _unpacked(batch: pa.RecordBatch, i: int, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and, by token, the cell of its class trigram; kinds: the class of each word of the block."""
    codes = np.frombuffer(zstandard.decompress(batch.column("codes")[i].as_py()), np.uint32)
    lengths = batch.column("lengths")[i].values.to_numpy()
    target = kinds[codes]
    near, far = np.full(len(target), START), np.full(len(target), START)
    near[1:], far[2:] = target[:-1], target[:-2]
    starts = np.cumsum(lengths) - lengths
    near[starts] = far[starts] = START
    far[starts[lengths > 1] + 1] = START
    return codes, lengths, (far * CONTEXTS + near) * CLASSES + target


def class_trigrams(blocks: DataFrame, top: list[str]) -> DataFrame:
    """(cell, n) of the class trigrams of all training tokens: a bounded table at any input size."""
    values = pa.array(top, pa.string())

    def counted(batches):
        total = np.zeros(CONTEXTS * CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, lengths, cells = _unpacked(batch, i, _classes(batch.column("words")[i], batch.column("tails")[i].as_py(), values))
                learn = np.repeat(~np.array(batch.column("held")[i].as_py(), bool), lengths)
                total += np.bincount(cells[learn], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return blocks.select("held", "lengths", "codes", "words", "tails").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def contexts_by_word(blocks: DataFrame, top: list[str], own: pa.Array) -> DataFrame:
    """(part, seen): of each block, and of each ``PART`` words of ``own``, how often a word came after a context class in the
    training tokens: keys (word in the part, context) in order and their counts, compressed."""
    values = pa.array(top, pa.string())

    def counted(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i]
                codes, lengths, cells = _unpacked(batch, i, _classes(words, batch.column("tails")[i].as_py(), values))
                place = pc.fill_null(pc.index_in(words.values, value_set=own), -1).to_numpy().astype(np.int64)[codes]
                learn = np.repeat(~np.array(batch.column("held")[i].as_py(), bool), lengths) & (place >= 0)
                keys, n = np.unique(place[learn] * CONTEXTS + cells[learn] // CLASSES % CONTEXTS, return_counts=True)
                parts, starts = np.unique(keys // (PART * CONTEXTS), return_index=True)
                ends = np.append(starts, len(keys))[1:]
                seen = [packed_counts(keys[a:b] - p * PART * CONTEXTS, n[a:b]) for p, a, b in zip(parts.tolist(), starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array(seen, pa.binary())], ["part", "seen"])

    return blocks.select("held", "lengths", "codes", "words", "tails").mapInArrow(counted, "part int, seen binary")


def packed_counts(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending keys as steps, and counts, with bytes of a place side by side."""
    steps = np.diff(keys, prepend=0).astype("<u4")
    return zstandard.compress(np.concatenate([steps, n.astype("<u4")]).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(both[: len(both) // 2].astype(np.int64)), both[len(both) // 2 :]


def fit_words(n: np.ndarray, after: np.ndarray, share: np.ndarray, contexts: np.ndarray, rounds: int = 6) -> np.ndarray:
    """By word, a bias and a vector: Newton's method on the expected noise-contrastive objective, for all words at once.

    n: (word, context) how often the word came after the context; after: (word, context) how often any word of its class
    did; share: the word's share of its class, from which the noise is drawn.
    """
    phi = np.hstack([np.ones((len(contexts), 1)), contexts])
    noise = NOISE * after * share[:, None]
    theta = np.zeros((len(n), phi.shape[1]))
    ridge = OWN_RIDGE * np.eye(phi.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta @ phi.T - np.log(NOISE), -30, 30)))
        slope = (n * (1 - p) - noise * p) @ phi - OWN_RIDGE * theta
        curve = np.einsum("wc,ci,cj->wij", (n + noise) * p * (1 - p), phi, phi, optimize=True) + ridge
        step = np.linalg.solve(curve, slope[..., None])[..., 0]
        theta += np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-3:
            break
    return theta


def word_vectors(seen: DataFrame, c: np.ndarray, kinds: np.ndarray, n_class: np.ndarray, after: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """By word of ``own`` its bias and vector. c, kinds: its count and class; after: (class, context) counts. A row by word comes to the driver, ``OWN_WORDS`` at most."""
    theta = np.zeros((len(c), 1 + contexts.shape[1]), np.float32)

    def fitted(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                if part not in totals:
                    totals[part] = np.zeros(PART * CONTEXTS, np.float32)
                keys, n = unpacked_counts(raw)
                totals[part][keys] += n
        for part, total in totals.items():
            here = slice(part * PART, min((part + 1) * PART, len(c)))
            n = total.reshape(PART, CONTEXTS)[: here.stop - here.start].astype(np.float64)
            found = fit_words(n, after[kinds[here]], c[here] / n_class[kinds[here]], contexts).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["part", "theta"])

    if len(c):
        rows = seen.repartition(max(1, -(-len(c) // PART)), "part").mapInArrow(fitted, "part int, theta binary").toArrow()
        for part, raw in zip(rows["part"].to_pylist(), rows["theta"].to_pylist(), strict=True):
            found = np.frombuffer(raw, np.float32).reshape(-1, theta.shape[1])
            theta[part * PART : part * PART + len(found)] = found
    return theta


def context_vectors(model: LogBilinear, weights: np.ndarray) -> np.ndarray:
    """What the class model knows of the last token, in ``OWN_DIM`` directions of unit spread over the training tokens."""
    r = model.p["R"] @ model.p["A"]
    weights = weights / max(weights.sum(), 1)
    r = r - weights @ r
    values, directions = np.linalg.eigh((r * weights[:, None]).T @ r)
    keep = np.argsort(-values)[:OWN_DIM]
    return np.clip(r @ directions[:, keep] / np.sqrt(np.maximum(values[keep], 1e-12)), -6, 6)


def normalisers(theta: np.ndarray, c: np.ndarray, kinds: np.ndarray, n_class: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """By class and context, the sum over the class's words of share times what their vectors say; words without a vector say 1."""
    total = np.ones((CLASSES, len(contexts)))
    for at in range(0, len(c), 20_000):
        here = slice(at, at + 20_000)
        share = c[here] / n_class[kinds[here]]
        np.add.at(total, kinds[here], share[:, None] * np.expm1(theta[here, :1] + theta[here, 1:] @ contexts.T))
    return total


class LogBilinear:
    """Log-bilinear model of the next class after two context classes."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {"R": r.normal(0, 0.3, (CONTEXTS, DIM)), "A": np.eye(DIM), "B": 0.5 * np.eye(DIM), "Q": r.normal(0, 0.3, (CLASSES, DIM)), "bias": np.zeros(CLASSES)}

    def fit(self, far: np.ndarray, near: np.ndarray, n: np.ndarray, steps: int = STEPS) -> LogBilinear:
        """n: by context (row) and next class, how often it was seen. Adam on the expected noise-contrastive objective."""
        total = n.sum()
        if not total:
            return self
        n = n / total
        noise = np.maximum(n.sum(0), 1e-9)
        noise /= noise.sum()
        weight = NOISE * n.sum(1, keepdims=True) * noise
        shift = np.log(NOISE * noise)
        p = self.p
        p["bias"] = np.log(noise)
        m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            a, b = p["R"][far], p["R"][near]
            r = a @ p["A"] + b @ p["B"]
            s = r @ p["Q"].T + p["bias"] - shift
            true = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            g = weight * true - n * (1 - true)  # of the negative objective, by score
            gr = g @ p["Q"]
            grad = {"A": a.T @ gr, "B": b.T @ gr, "Q": g.T @ r, "bias": g.sum(0), "R": np.zeros_like(p["R"])}
            np.add.at(grad["R"], far, gr @ p["A"].T)
            np.add.at(grad["R"], near, gr @ p["B"].T)
            rate = RATE * (1 - step / (steps + 1))
            for k, x in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-10)
        return self

    def log_probs(self) -> np.ndarray:
        """log10 P(class | far, near), normalised, for all contexts."""
        p = self.p
        r = ((p["R"] @ p["A"])[:, None] + (p["R"] @ p["B"])[None]).reshape(-1, DIM)
        s = r @ p["Q"].T + p["bias"]
        s -= s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        return (s / np.log(10)).astype(np.float32)


def train(trigrams: pa.Table) -> tuple[LogBilinear, np.ndarray]:
    """The class model, and by class and context before it the counts; training on the driver is the same work at any input size."""
    n = np.zeros(CONTEXTS * CONTEXTS * CLASSES)
    n[trigrams["cell"].to_numpy()] = trigrams["n"].to_numpy()
    n = n.reshape(-1, CLASSES)
    seen = np.flatnonzero(n.sum(1))
    return LogBilinear().fit(seen // CONTEXTS, seen % CONTEXTS, n[seen]), n.reshape(CONTEXTS, CONTEXTS, CLASSES).sum(0).T


@dataclass
class Words:
    """Words with a vector: their names and training counts by place, what is said of each, and the normalisers by class and context."""

    names: pa.Array
    c: np.ndarray
    theta: np.ndarray
    contexts: np.ndarray
    log_total: np.ndarray

    def said(self, place: np.ndarray, kinds: np.ndarray, near: np.ndarray) -> np.ndarray:
        """log10 of what the context adds for each token (place -1: no vector), normalised over the class."""
        out = -self.log_total[kinds, near]
        own = np.flatnonzero(place >= 0)
        theta = self.theta[place[own]]
        out[own] += theta[:, 0] + np.einsum("td,td->t", theta[:, 1:], self.contexts[near[own]])
        return out / np.log(10)


def learn_words(counts: DataFrame, top: list[str], n_class: np.ndarray, blocks: DataFrame) -> tuple[LogBilinear, Words]:
    """Both parts of the model."""
    frequent = counts.where((F.col("c") >= OWN_COUNT) & ~F.col("word").isin(top)).orderBy(F.desc("c"), "word").limit(OWN_WORDS).toArrow()
    names, c = pa.array(frequent["word"].to_pylist(), pa.string()), frequent["c"].to_numpy()
    kinds = np.fromiter((tail_class(w.encode()) for w in names.to_pylist()), np.int64, len(names))
    model, after = train(class_trigrams(blocks, top).toArrow())
    contexts = context_vectors(model, after.sum(0))
    theta = word_vectors(contexts_by_word(blocks, top, names), c, kinds, n_class, after, contexts)
    return model, Words(names, c, theta, contexts.astype(np.float32), np.log(normalisers(theta, c, kinds, n_class, contexts)))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base and model log10 probability of every text; learns from the texts that aren't held out."""
    blocks = code_blocks(docs, doc_id, text)
    counts = word_counts(blocks)
    frequent = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(TOP - 1).union(counts.where(F.col("word") == END)).toPandas()
    own_count = dict(zip(frequent["word"], frequent["c"], strict=True))
    top = [END, *[w for w in frequent["word"] if w != END]]
    n_class, once = _class_sizes(counts, pa.array(top, pa.string()))
    n_all, distinct = int(n_class.sum()), counts.count()
    model, words = learn_words(counts, top, n_class, blocks)
    p = model.p
    # all tasks know the counts of the top words and of those with a vector; only other words meet theirs by a shuffle
    held_names = pa.concat_arrays([pa.array(top, pa.string()), words.names])
    held_counts = np.concatenate([[own_count.get(w, 0) for w in top], words.c]).astype(np.int64)

    def resolved(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                here = batch.slice(i, 1)
                place = pc.fill_null(pc.index_in(here.column("words")[0].values, value_set=held_names), -1).to_numpy().astype("<i4")
                yield pa.RecordBatch.from_arrays([*(here.column(x) for x in ("block", "doc_ids", "held", "lengths", "codes", "tails")), pa.array([zstandard.compress(place.tobytes(), 1)])], ["block", "doc_ids", "held", "lengths", "codes", "tails", "places"])

    def others(batches):
        for batch in batches:
            for block, own in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
                at = np.flatnonzero(pc.index_in(own.values, value_set=held_names).is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), own.values.take(pa.array(at))], ["block", "pos", "word"])

    def scored(batches):
        table = LogBilinear()
        table.p = p
        table = table.log_probs().ravel()
        unseen = (once + 0.5) / (n_class + 1.0)
        unseen[: len(top)] = 0.0
        unseen[n_class == 0] = 1.0
        for batch in batches:
            for i in range(batch.num_rows):
                place = np.frombuffer(zstandard.decompress(batch.column("places")[i].as_py()), "<i4")
                kinds = np.where((place >= 0) & (place < len(top)), place, np.frombuffer(batch.column("tails")[i].as_py(), np.uint8)).astype(np.int64)
                codes, lengths, cells = _unpacked(batch, i, kinds)
                c = np.where(place >= 0, held_counts[place], 0)
                found = batch.column("found")[i].values
                if found is not None and len(found):
                    packed = found.to_numpy()
                    c[packed >> 40] = packed & ((1 << 40) - 1)
                base = np.log10((c + 0.1) / (n_all + 0.1 * (distinct + 1)))
                inside = np.where(c > 0, np.log10(np.maximum(1 - unseen[kinds], 1e-12)) + np.log10(np.maximum(c, 1) / np.maximum(n_class[kinds], 1)), np.log10(np.maximum(unseen[kinds], 1e-12)))
                by_token = inside[codes] + table[cells]
                known = np.flatnonzero((c > 0)[codes])
                own = codes[known]
                by_token[known] += words.said(np.maximum(place - len(top), -1)[own], kinds[own], cells[known] // CLASSES % CONTEXTS)
                starts = np.cumsum(lengths) - lengths
                sums = [np.add.reduceat(x, starts) for x in (base[codes], by_token, (c > 0)[codes].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, batch.column("held")[i].values, pa.array(lengths.astype(np.int64)), pa.array(sums[2]), pa.array(np.full(len(lengths), n_all)), pa.array(sums[0]), pa.array(sums[1])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    rare = blocks.select("block", "words").mapInArrow(others, "block long, pos int, word string")
    rare_counts = counts.where(F.col("c") <= (int(words.c.min()) if len(words.c) == OWN_WORDS else OWN_COUNT))
    found = rare.join(rare_counts, "word").select("block", (F.shiftleft(F.col("pos").cast("long"), 40) + F.col("c")).alias("packed"))
    found = found.groupBy("block").agg(F.collect_list("packed").alias("found"))
    placed = blocks.select("block", "doc_ids", "held", "lengths", "codes", "tails", "words").mapInArrow(resolved, "block long, doc_ids array<bigint>, held array<boolean>, lengths array<int>, codes binary, tails binary, places binary")
    return placed.join(found, "block", "left").drop("block").mapInArrow(scored, SCORES)


def _class_sizes(counts: DataFrame, top: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """By class: its training tokens, and its words seen once."""

    def summed(batches):
        n, once = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in portions(batches):
            words, c = batch.column("word"), batch.column("c").to_numpy()
            own = pc.fill_null(pc.index_in(words, value_set=top), -1).to_numpy()
            tails = np.fromiter((tail_class(w.encode()) for w in words.to_pylist()), np.int64, len(c))
            kinds = np.where(own >= 0, own, tails)
            n += np.bincount(kinds, c, CLASSES).astype(np.int64)
            once += np.bincount(kinds[c == 1], minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(once)], ["k", "n", "once"])

    rows = counts.mapInArrow(summed, "k long, n long, once long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).toPandas().sort_values("k")
    if not len(rows):
        return np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    return rows["n"].to_numpy(np.int64), rows["once"].to_numpy(np.int64)
