"""Toxicity: a classifier chain whose later linear models see out-of-fold probabilities of earlier categories.

Categories are predicted in the order of ``CATEGORIES``. The table of labels has one label, so the two earlier
categories are kinds of toxic texts that the training finds by itself: the labelled toxic texts fall into two clusters by
their features (k-means from the two ends of their first principal component), and the last category is the
label. Features are the presence of words (lower case, marks stripped) and of beginnings of words, chosen
by the difference of their document shares. While training, the model of a category gets the earlier categories' probabilities
that models of the other folds gave; when applied, it gets those of the final earlier models.

The chain is fitted on at most ``SAMPLE`` labelled documents (those with the smallest hash of the id), a documented
bound; every document is scored, over its whole text.

Defined cases: a null or empty text has no features, so it gets the prior. A null id is scored like any other.
Labels that are null or whose document is missing are not used, any number over 0 is toxic; of rows that share an id the
first text by order is learned from. Without any toxic label every probability is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, named, portions, strings

SAMPLE, FEATURES, FOLDS, LEAST, L2 = 8000, 320, 5, 4, 0.1
#: Standard deviations by which a feature's shares differ at least.
CLEAR = 4.0
#: Lengths of the beginnings of words that are features.
BEGINNINGS = (4, 6)
CUT = 0.4
#: Categories in the order of the chain; the last is the label.
CATEGORIES = ("first_kind", "second_kind", "toxic")
MARKS = ".,;:!?\"'()[]{}<>|%*$#&-_~`+=/\\"


@dataclass
class Chain:
    """words: feature words; weights: by category, (bias, words' weights, earlier categories' weights)."""

    words: list[str]
    weights: list[tuple[float, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (row, category) from 0/1 features."""
        out = np.zeros((len(x), len(CATEGORIES)))  # without weights every probability is 0
        for k, (bias, w, chained) in enumerate(self.weights):
            out[:, k] = sigmoid(bias + x @ w + out[:, :k] @ chained)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def tokens(text: str) -> Counter[str]:
    """How often each word stands in a text, in lower case and without marks."""
    found: Counter[str] = Counter()
    for w, n in Counter(text.lower().split()).items():
        found[w.strip(MARKS)] += n
    return found


def features(found: Counter[str], known: Container[str] | None = None) -> set[str]:
    """Words, and beginnings of different words: '^' once, '^^' twice, '^^^' three times or more. Only known ones, if given.

    Words stand for themselves, and '2' before a word says that it is repeated; beginnings catch words that
    inflect or compound.
    """
    out = set(found) if known is None else {w for w in found if w in known}
    out.update(x for x in ("2" + w for w, n in found.items() if n > 1) if known is None or x in known)
    for size in BEGINNINGS:
        for x, n in Counter([w[:size] for w in found if len(w) >= size]).items():
            out.update(m for m in ("^" * k + x for k in range(1, min(n, 3) + 1)) if known is None or m in known)
    return out


def logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, rounds: int = 12) -> np.ndarray:
    """Weights, bias first, of a ridge logistic regression by Newton's method, from the start's weights on."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.full(x.shape[1], L2)
    ridge[0] = 1e-6
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-2:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, words: list[str]) -> Chain:
    """labels: (row, category). Earlier categories enter as their out-of-fold probabilities."""
    weights, earlier = [], np.zeros((len(x), 0))
    for k in range(labels.shape[1]):
        inputs, y = np.hstack([x, earlier]), labels[:, k]
        w = logistic(inputs, y)
        weights.append((w[0], w[1 : 1 + x.shape[1]], w[1 + x.shape[1] :]))
        out = np.zeros(len(x))
        for fold in range(FOLDS):
            here = folds == fold
            if here.any():
                v = logistic(inputs[~here], y[~here], w) if (~here).any() else w
                out[here] = sigmoid(v[0] + inputs[here] @ v[1:])
        earlier = np.hstack([earlier, out[:, None]])
    return Chain(words, weights)


def kinds(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Two clusters (0 or 1) of rows of features; equal rows fall together, and all into the first if none differ."""
    if not len(x) or not (x != x[0]).any():
        return np.zeros(len(x), int)
    centred = x - x.mean(0)
    along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
    own = (along * np.sign(along[np.abs(along).argmax()]) > 0).astype(int)
    for _ in range(rounds):
        if own.min() == own.max():
            break
        centres = np.stack([x[own == k].mean(0) for k in (0, 1)])
        new = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        if (new == own).all():
            break
        own = new
    return own


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        found = [sorted(features(tokens(t))) for t in strings(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), batch.column(2)], ["doc_id", "tokens", "toxic"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents."""
    marked = named(labels, doc_id=doc_id, toxic=label).dropna().groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = marked.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    one = named(docs, doc_id=doc_id, text=text).join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))
    rows = cut(one.mapInArrow(_tokens, "doc_id long, tokens array<string>, toxic int"))
    size = rows.agg(F.sum("toxic").alias("yes"), F.count("*").alias("n")).first()
    yes, no = float(size["yes"] or 0), float(size["n"] - (size["yes"] or 0))
    if not yes:
        return Chain([], [])
    share = F.col("a") / yes - F.col("b") / max(no, 1.0)
    seen = rows.select("toxic", F.explode("tokens").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    spread = F.sqrt((F.col("a") + F.col("b")) * (1 / yes + 1 / max(no, 1.0)) / (yes + no))
    clear = F.abs(share) / spread
    best = seen.where(f"word <> '' and a + b >= {LEAST}").where(clear >= CLEAR).orderBy(F.desc(clear), "word").limit(FEATURES)
    words = best.select("word").toPandas()["word"].tolist()
    at = {w: i for i, w in enumerate(words)}
    # a row by labelled document, and of its features the chosen ones only
    chosen = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    picked = rows.select("doc_id", "toxic", F.array_intersect("tokens", chosen).alias("tokens")).toPandas()
    picked = picked.sort_values("doc_id", kind="stable")
    x = np.zeros((len(picked), len(words)))
    for i, found in enumerate(picked["tokens"]):
        x[i, [at[w] for w in found]] = 1
    toxic = picked["toxic"].to_numpy(float)
    y = np.zeros((len(picked), len(CATEGORIES)))
    y[:, -1] = toxic
    own = np.flatnonzero(toxic)
    y[own, kinds(x[own])] = 1
    folds = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in picked["doc_id"]])
    return fit_chain(x, y, folds, words)


def _probabilities(chain: Chain, texts: list[str]) -> np.ndarray:
    at = {w: i for i, w in enumerate(chain.words)}
    x = np.zeros((len(texts), len(at)))
    for i, t in enumerate(texts):
        x[i, [at[w] for w in features(tokens(t), at)]] = 1
    return chain.predict(x)


def score(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text", cut_at: float = CUT) -> DataFrame:
    """doc_id, a probability by category, is_toxic (the last category's probability is over the cut)."""

    def scored(batches):
        for batch in portions(batches):
            p = _probabilities(chain, strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] > cut_at)], ["doc_id", *CATEGORIES, "is_toxic"])

    return named(docs, doc_id=doc_id, text=text).mapInArrow(scored, f"doc_id long, {', '.join(f'{k} double' for k in CATEGORIES)}, is_toxic boolean")


def keep_clean(docs: DataFrame, chain: Chain, text: str = "text", cut_at: float = CUT) -> DataFrame:
    """The rows, with all their columns, that the chain doesn't call toxic."""
    place = docs.columns.index(text)

    def filtered(batches):
        for batch in portions(batches):
            yield batch.filter(pa.array(_probabilities(chain, strings(batch.column(place)))[:, -1] <= cut_at))

    return docs.mapInArrow(filtered, docs.schema)
