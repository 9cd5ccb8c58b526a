"""Quality rules: how a public vocabulary takes a text (tokeniser fertility), judged by bands per language.

Of each text, over its words' pieces in two public vocabularies, one of them with byte fallback: characters per piece,
share of byte pieces, and the entropy of the pieces. A band has the least and most characters per piece, the most
byte pieces, and by vocabulary an entropy floor that rises with the number of pieces, as a longer text shows more of
the vocabulary; repeats, menus, symbols and shouting fall below it. ``BANDS`` were set with margins below what
labelled clean texts show; a text of another language, or of none, gets the band of the script that most of its letters
have, and the wide one if it has none of ``SCRIPTS``.

The base counts (words, symbols, repeated lines and words) are taken in the same pass; see ``measure``.

Defined cases: a null or empty text has no words, fails the base and isn't kept. A null language gets its
script's band. Repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessella.llm.common import Ids, named, portions, ragged, sole, tokenizer_path
from tessella.llm.packing import WordCodec

VOCABULARY, SECOND = "piece_bpe_32k.model", "word_bpe_49k.json"
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Words whose ids a worker remembers by vocabulary, as it holds two.
HELD = 200_000
LEAST_WORDS, MOST_REPEATED = 50, 50
#: By language: least and most characters per piece, most byte pieces, what the entropy floor is shifted by; then for the second vocabulary least characters per piece and shift.
BANDS = {"en": (1.75, 9.0, 0.1, 0.03, 1.85, 0.13), "fr": (1.55, 9.0, 0.1, -0.17, 1.5, -0.4), "de": (1.65, 9.0, 0.1, -0.12, 1.8, -0.15), "es": (1.5, 9.0, 0.1, -0.08, 1.6, -0.2)}
#: By script, looser than the languages' bands.
SCRIPTS = {
    "Latin": (1.4, 9.0, 0.2, -0.3, 1.4, -0.45), "Cyrillic": (1.2, 9.0, 0.3, -0.6, 0.8, -1.2), "Greek": (0.6, 9.0, 0.6, -0.8, 0.4, -1.5), "Arabic": (0.6, 9.0, 0.6, -0.8, 0.4, -1.5),
    "Hebrew": (0.6, 9.0, 0.6, -0.8, 0.4, -1.5), "Devanagari": (0.4, 9.0, 0.8, -1.2, 0.3, -2.0), "Han": (0.3, 4.0, 0.9, -0.8, 0.2, -1.5), "Hangul": (0.3, 4.0, 0.9, -0.8, 0.2, -1.5), "Thai": (0.3, 9.0, 0.9, -1.2, 0.2, -2.0),
}
WIDE = (1.0, 12.0, 0.6, -0.8, 0.4, -1.5)
#: The floor at 150 pieces, its rise by doubling, and its height for long texts.
FLOOR, RISE, HIGHEST = 5.42, 0.36, 6.48
FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double, second_chars_per_token double, second_entropy double"
NAMES = [x.split()[0] for x in FIELDS.split(", ")]


class Pieces:
    """Ids of words in both vocabularies."""

    def __init__(self, path: str, second: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = np.array([self.library.is_byte(i) for i in range(self.library.get_piece_size())])
        self.known = Ids(self.learn, np.uint16, HELD, HELD // 2)
        self.second = WordCodec(second, HELD)

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(new, num_threads=1)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint16, int(lengths.sum())), lengths


def entropies(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The entropy, in bits, of each stretch of ids."""
    out = np.zeros(len(bounds) - 1)
    for i, (start, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if end > start:
            x = np.sort(ids[start:end])
            counts = np.diff(np.flatnonzero(x[1:] != x[:-1]), prepend=-1, append=end - start - 1)
            out[i] = np.log2(end - start) - (counts * np.log2(counts)).sum() / (end - start)
    return out


def pieces(path: str, second: str) -> Pieces:
    return sole(("quality", path, second), lambda: Pieces(path, second))


def scripts(texts: pa.Array) -> list[str | None]:
    """The script of most letters of each text, of ``SCRIPTS``; the first of equal ones."""
    other = {"Han": r"[\p{Han}\p{Hiragana}\p{Katakana}]"}
    counts = np.stack([pc.count_substring_regex(texts, other.get(s, rf"\p{{{s}}}")).to_numpy() for s in SCRIPTS])
    return [name if n else None for name, n in zip(np.array(list(SCRIPTS), object)[counts.argmax(0)], counts.max(0), strict=True)]


def repeated_words(ids: np.ndarray, n: int) -> int:
    """Words, as ids below ``n``, that stand in a 3-word window found twice or more."""
    if len(ids) < 4:
        return 0
    if n < 2_000_000:
        keys = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        sorted_keys = np.sort(keys)
        if (sorted_keys[1:] != sorted_keys[:-1]).all():
            return 0
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    else:
        _, inverse, counts = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True, return_counts=True)
    often = counts[inverse.ravel()] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : len(ids) - 2 + k] |= often
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def measure(texts: pa.Array, languages: pa.Array | None, own: Pieces) -> list[np.ndarray]:
    """The columns of ``FIELDS`` after the id."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(texts)
    coded = split.values.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    empty = pc.index(words, "").as_py()  # stands at white space that a text begins or ends with
    if empty >= 0:
        full = codes != empty
        at = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()]
        codes = codes[full]
    else:
        at = split.offsets.to_numpy()
    total = lambda by_word: np.diff(np.concatenate([[0], np.cumsum(by_word[codes])])[at])
    n_words, chars = np.diff(at).astype(np.int64), total(pc.utf8_length(words).to_numpy().astype(np.int64))
    bounds, n = at.tolist(), len(words)
    again = np.array([repeated_words(codes[a:b], n) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.int64)
    failed = (n_words < LEAST_WORDS) | (100 * again > MOST_REPEATED * n_words)
    measured = []
    for flat, ends in (own.known.of(own.known.slots(words)), own.second.chunks(words)):
        ids, ends = ragged(flat, ends[codes], ends[codes + 1] - ends[codes])
        ends = ends[at]
        measured.append((ids, ends, np.diff(ends), entropies(ids, ends)))
    (ids, ends, n_pieces, entropy), (_, _, n_second, second) = measured
    share = np.diff(np.concatenate([[0], np.cumsum(own.bytes[ids])])[ends]) / np.maximum(n_pieces, 1)
    per, per_second = chars / np.maximum(n_pieces, 1), chars / np.maximum(n_second, 1)
    by_language = [BANDS.get(x) for x in languages.to_pylist()] if languages is not None else [None] * len(texts)
    if None in by_language:
        by_language = [x or SCRIPTS.get(s, WIDE) for x, s in zip(by_language, scripts(texts), strict=True)]
    low, high, most, shift, low_second, shift_second = np.array(by_language).reshape(-1, 6).T
    floor = lambda k: np.minimum(FLOOR + RISE * np.log2(np.maximum(k, 1) / 150), HIGHEST)
    good = (low <= per) & (per <= high) & (share <= most) & (entropy >= floor(n_pieces) + shift) & (per_second >= low_second) & (second >= floor(n_pieces) + shift_second)
    lines = np.array([repeated_lines(x) for x in texts.to_pylist()], np.int64)
    symbols = pc.count_substring_regex(texts, f"[{SYMBOLS}]").to_numpy().astype(np.int64)
    return [n_words, chars, symbols, lines, again, failed, ~failed & good, per, share, entropy, per_second, second]


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", name: str = VOCABULARY, second: str = SECOND, folder: str | None = None) -> DataFrame:
    """The measures and the verdict of every whole text."""
    chosen = named(docs, doc_id=doc_id, text=text, lang=lang) if lang else named(docs, doc_id=doc_id, text=text)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(tokenizer_path(name, folder), tokenizer_path(second, folder))
        for batch in portions(batches):
            columns = measure(batch.column(1), batch.column(2) if lang else None, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], NAMES)

    return chosen.mapInArrow(measured, FIELDS)


def keep_good(docs: DataFrame, text: str = "text", lang: str | None = "lang", name: str = VOCABULARY, second: str = SECOND, folder: str | None = None) -> DataFrame:
    """The rows, with all their columns, that pass the base and the bands."""
    places = docs.columns.index(text), docs.columns.index(lang) if lang else None

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(tokenizer_path(name, folder), tokenizer_path(second, folder))
        for batch in portions(batches):
            yield batch.filter(pa.array(measure(batch.column(places[0]), None if places[1] is None else batch.column(places[1]), own)[6]))

    return docs.mapInArrow(filtered, docs.schema)
