"""BPE encoding and decoding with an automaton compiled from the merges.

The automaton reads tokens; its states say what the last token is open to. It starts with one state in which every
byte may follow every byte, and grows by one gadget per merge, in order of rank. The gadget of (a, b) adds the arc of
the merged token from wherever an ``a`` followed by a ``b`` could be read, and takes away the arcs that read them
apart: from every state whose token ends with a free ``a`` by every token that begins with a free ``b``. Which pieces
stand free at a token's edges, from which rank up to which, is known when its gadget has run; tokens that are open to
the same merges share a state, and tokens whose arcs are taken away by the same merges share a column. The result is a
table, state by column, of one bit: whether the arc is there. A word has one path that the automaton accepts, and its
arc labels are the tokens.

Encoding steps through a pre-split word by two tables: one, node by byte, says which tokens end at each byte, and the
automaton's says which of them its path goes through. Decoding emits arc labels. A portion of texts is split and its
distinct chunks are coded in Arrow; ids of chunks are kept in a bounded table and gathered by numpy. Texts with white space that isn't single
spaces or line ends between words, or with special tokens, are split one by one.

Defined cases: a null text is empty and has no tokens. Special tokens in a text are their ids, as in the public
library; ``ordinary=True`` makes them ordinary text. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tessella.llm.common import Ids, named, portions, ragged, sole, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
#: The public pre-splitting pattern of byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than a single space or line end between words.
_SPACE = r"[\s\p{Z}\x{85}\x0b\x1c-\x1f]"
ODD = rf"{_SPACE}[ \n]|[ \n]{_SPACE}|\A[ \n]|[ \n]\z"
LAST = 1 << 40
#: Bytes of words that are walked through at once.
MATRIX = 4_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible Latin-1 stands for itself."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, labels: list[bytes], merges: list[tuple[int, int]], made: list[int]):
        """labels: bytes by token; merges: pairs by rank; made: the token that each merge makes."""
        self.labels = labels
        single = {label: i for i, label in enumerate(labels) if len(label) == 1}
        #: Ranks of merges, by right and then left token.
        self.rank: dict[int, dict[int, int]] = {}
        #: By token: (piece, first rank, last rank) that stand free at its left and right edge.
        self.left = {i: ((i, -1, LAST),) for i in single.values()}
        self.right = dict(self.left)
        #: Tokens by label; only those a gadget made or bytes.
        self.token = dict(single)
        for rank, ((a, b), x) in enumerate(zip(merges, made, strict=True)):
            self.gadget(rank, a, b, x)
        self.compile()
        self.compile_bytes()

    def gadget(self, rank: int, a: int, b: int, x: int) -> None:
        """The merge of a and b; from now on they aren't read apart where both stand free."""
        ranks = self.rank.setdefault(b, {})
        if a not in self.left or b not in self.left or a in ranks:
            return
        read = self.apart(a, b)  # else no path reads a and b side by side, and the merge never makes a token
        ranks[a] = rank
        if not read or x in self.left:
            return
        self.left[x] = ((x, rank, LAST), *((p, since, min(until, rank)) for p, since, until in self.left[a]))
        self.right[x] = ((x, rank, LAST), *((p, since, min(until, rank)) for p, since, until in self.right[b]))
        self.token[self.labels[x]] = x

    def apart(self, x: int, y: int) -> bool:
        """Whether no gadget so far took away the arc of y after x."""
        for b, since_b, until_b in self.left[y]:
            ranks = self.rank.get(b)
            if ranks:
                for a, since_a, until_a in self.right[x]:
                    r = ranks.get(a)
                    # of two merges of one rank the left one comes first
                    if r is not None and since_a < r < until_a and since_b < r <= until_b:
                        return False
        return True

    def compile(self) -> None:
        """The table of arcs: by token its state and column, and by state a row of bits."""
        by_left, by_right = defaultdict(list), defaultdict(list)
        for b, ranks in self.rank.items():
            for a, r in ranks.items():
                by_left[a].append(r)
                by_right[b].append(r)
        for ranks in (*by_left.values(), *by_right.values()):
            ranks.sort()

        def classes(edges: dict, ranks_of: dict, end) -> tuple[dict[int, int], list[tuple[int, ...]]]:
            """A number by token, and by number the ranks of the merges that a free piece can take part in."""
            numbers: dict[tuple[int, ...], int] = {}
            own = {}
            for t, pieces in edges.items():
                ranks: list[int] = []
                for p, since, until in pieces:
                    if p in ranks_of:
                        of = ranks_of[p]
                        ranks += of[bisect_right(of, since) : end(of, until)]
                own[t] = numbers.setdefault(tuple(sorted(ranks)), len(numbers))
            return own, list(numbers)

        states, open_to = classes(self.right, by_left, bisect_left)
        columns, taken_by = classes(self.left, by_right, bisect_right)
        rows_of, columns_of = defaultdict(list), defaultdict(list)
        for numbers, ranks_of in ((rows_of, open_to), (columns_of, taken_by)):
            for i, ranks in enumerate(ranks_of):
                for r in ranks:
                    numbers[r].append(i)
        arcs = np.ones((len(open_to), len(taken_by)), bool)
        for r in sorted(rows_of):
            if r in columns_of:
                arcs[np.ix_(rows_of[r], columns_of[r])] = False
        self.state = np.zeros(len(self.labels), np.int32)
        self.state[list(states)] = list(states.values())
        self.column = columns
        self.rows = np.packbits(arcs, axis=1, bitorder="little")

    def accepts(self, x: int, y: int) -> bool:
        """Whether an arc y leaves the state after x."""
        column = self.column[y]
        return bool(self.rows[self.state[x], column >> 3] >> (column & 7) & 1)

    def compile_bytes(self) -> None:
        """The table of label ends: by node and byte the next node, and by node the tokens that end there, longest first, with their lengths and columns."""
        children: list[dict[int, int]] = [{}]
        own = [-1]
        for label, t in self.token.items():
            node = 0
            for byte in label:
                to = children[node].get(byte)
                if to is None:
                    to = children[node][byte] = len(own)
                    children.append({})
                    own.append(-1)
                node = to
            own[node] = t
        steps = np.zeros((len(own), 256), np.int32)
        ends: list[tuple] = [()] * len(own)
        back = [0] * len(own)
        level = [0]
        while level:
            below = []
            for node in level:
                if node:
                    steps[node] = steps[back[node]]
                for byte, to in children[node].items():
                    back[to] = int(steps[back[node], byte]) if node else 0
                    t = own[to]
                    more = ends[back[to]]
                    ends[to] = ((t, len(self.labels[t]), self.column[t]), *more) if t >= 0 else more
                    steps[node, byte] = to
                    below.append(to)
            level = below
        self.steps = steps
        #: The tokens that end at a node, one node after the other.
        self.end_from = np.cumsum([0, *map(len, ends)])
        self.end_token, self.end_length, self.end_column = np.array([x for e in ends for x in e] or [(0, 0, 0)], np.int32).T.copy()

    def word(self, word: bytes) -> tuple[int, ...]:
        """Tokens of a pre-split word."""
        return tuple(self.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0].tolist())

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pre-split words one after the other, and how many each has; words of a length's class go together."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        flat, counts = [], []
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            here = order[at : at + max(1, MATRIX // max(longest, 1))]
            short = np.searchsorted(-lengths[here], -(longest // 2), "left") if longest > 24 else len(here)
            here = here[: max(1, short)]
            ids, n = self._walked(data, bounds[here], lengths[here])
            flat.append(ids)
            counts.append(n)
            at += len(here)
        if not flat:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, counts, back = np.concatenate(flat), np.concatenate(counts), np.argsort(order)
        return ragged(flat, (np.cumsum(counts) - counts)[back], counts[back])[0], counts[back]

    def _walked(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that come longest first. By end, the one token that the accepted path of the prefix ends with is found, for all words at once."""
        n, longest = len(starts), int(lengths[0])
        last, states = np.zeros((longest, n), np.int32), np.zeros((longest, n), np.int32)
        node = np.zeros(n, np.int32)
        for end in range(longest):
            m = int(np.searchsorted(-lengths, -end, "left"))  # the words that are longer
            node = self.steps[node[:m], data[starts[:m] + end]]
            todo, k = np.arange(m), self.end_from[node]
            final = self.end_from[node + 1] - 1
            while len(todo):
                length, column = self.end_length[k], self.end_column[k]
                before = states[np.maximum(end - length, 0), todo]
                taken = (length > end) | (self.rows[before, column >> 3] >> (column & 7) & 1).astype(bool) | (k == final)
                token = self.end_token[k[taken]]
                last[end, todo[taken]], states[end, todo[taken]] = token, self.state[token]
                left = ~taken
                todo, k, final = todo[left], k[left] + 1, final[left]
        sizes = np.zeros(len(self.labels), np.int64)
        sizes[list(self.token.values())] = [len(x) for x in self.token]
        found, counts = np.zeros((longest, n), np.int32), np.zeros(n, np.int64)
        todo, end = np.flatnonzero(lengths > 0), lengths[lengths > 0]
        while len(todo):  # backwards along the path
            token = last[end - 1, todo]
            found[counts[todo], todo] = token
            counts[todo] += 1
            end = end - sizes[token]
            todo, end = todo[end > 0], end[end > 0]
        bounds = np.cumsum(counts)
        word = np.repeat(np.arange(n), counts)
        return found[bounds[word] - 1 - np.arange(bounds[-1] if n else 0), word], counts


class Codec:
    """Encoder and decoder of a public byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocabulary: dict[str, int] = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = [b""] * (max([*vocabulary.values(), *special.values()]) + 1)
        for text, i in vocabulary.items():
            labels[i] = text.encode() if text in special else bytes(letters[c] for c in text)
        for text, i in special.items():
            labels[i] = text.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(vocabulary[a], vocabulary[b]) for a, b in pairs]
        self.automaton = Automaton([b"" if i in special.values() else x for i, x in enumerate(labels)], merges, [vocabulary[a + b] for a, b in pairs])
        self.labels, self.special = labels, special
        self.flat = np.frombuffer(b"".join(labels), np.uint8)
        self.lengths = np.array([len(x) for x in labels], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.known = Ids(self.learn, np.int32)
        self.odd = "|".join([ODD, *map(regex.escape, special)])
        self.split = regex.compile(SPLIT).findall
        self.marked = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [self.split(chunk) for chunk in new]
        flat = pa.array(list(chain.from_iterable(words)), pa.string())
        data, offsets = np.frombuffer(flat.buffers()[2] or b"", np.uint8), np.frombuffer(flat.buffers()[1], np.int32)[: len(flat) + 1].astype(np.int64)
        ids, counts = self.automaton.words(data, offsets)
        ends = np.cumsum([0, *map(len, words)])
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[ends])

    def encode(self, text: str, ordinary: bool = False) -> list[int]:
        """The ids of one text."""
        if not ordinary and self.marked and any(s in text for s in self.special):
            return [i for part in self.marked(text) if part for i in ([self.special[part]] if part in self.special else self.encode(part, True))]
        words = pa.array(self.split(text), pa.string())
        return self.known.of(self.known.slots(words))[0].tolist()

    def encode_all(self, texts: pa.Array, ordinary: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, and the bounds between them; null ones are empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd)
        alone = {i: np.array(self.encode(texts[i].as_py(), ordinary), np.int32) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()}
        # chunks are words with the space before them; a line end is a chunk
        lines = pc.split_pattern(pc.if_else(odd, "", texts), "\n")
        chunks = pc.split_pattern(lines.values, " ")
        coded = chunks.values.dictionary_encode()
        words, kinds = coded.dictionary, coded.indices.to_numpy().astype(np.int64) * 2 + 1
        begins = chunks.offsets.to_numpy()
        kinds[begins[:-1]] -= 1  # no space before a line's first word
        used = np.zeros(2 * len(words) + 2, bool)
        used[kinds] = True
        line_end = 2 * len(words)
        used[line_end] = True
        wanted = np.flatnonzero(used)
        bare, spaced = wanted[wanted % 2 == 0][:-1] // 2, wanted[wanted % 2 == 1] // 2
        parts = pa.concat_arrays([words.take(pa.array(bare)), pc.binary_join_element_wise(" ", words.take(pa.array(spaced)), "") if len(spaced) else pa.array([], pa.string()), pa.array(["\n"])])
        slots = self.known.slots(parts)
        slot_of = np.zeros(len(used), np.int64)
        slot_of[2 * bare], slot_of[2 * spaced + 1], slot_of[line_end] = slots[: len(bare)], slots[len(bare) : -1], slots[-1]
        # a line end goes before each line but a text's first
        text_begins = lines.offsets.to_numpy()
        later = np.ones(len(lines.values), bool)
        later[text_begins[:-1]] = False
        before = np.concatenate([[0], np.cumsum(later)])
        kinds = np.insert(kinds, begins[:-1][later], line_end)
        ids, at = self.known.of(slot_of[kinds])
        bounds = at[begins[text_begins] + before[text_begins]]
        if not alone:
            return ids, bounds
        whole = [alone.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]
        return np.concatenate(whole), np.concatenate([[0], np.cumsum([len(x) for x in whole])])

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of ids one after the other."""
        raw, at = ragged(self.flat, self.starts[ids], self.lengths[ids])
        raw, ends = raw.tobytes(), at[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


def codec(path: str) -> Codec:
    """A worker compiles an automaton once."""
    return sole(("bpe", path), lambda: Codec(path))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str | None = None, ordinary: bool = False) -> DataFrame:
    """doc_id, ids of every whole text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(name, folder))
        for batch in portions(batches):
            ids, bounds = own.encode_all(batch.column(1), ordinary)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return named(docs, doc_id=doc_id, text=text).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids", name: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """doc_id, text of every row of ids; null ids give an empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(name, folder))
        for batch in portions(batches):
            lists = batch.column(1)
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.decode_all(lists.flatten().to_numpy(), bounds), pa.string())], ["doc_id", "text"])

    return named(tokens, doc_id=doc_id, ids=ids).mapInArrow(decoded, "doc_id long, text string")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """Of each text: its number of tokens, and digests of the ids and of the text decoded from them.

    Encodes and decodes in one pass, so that ids aren't carried between tasks.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path(name, folder))
        numerals = list(map(str, range(len(own.labels))))
        for batch in portions(batches):
            ids, bounds = own.encode_all(batch.column(1))
            ends = bounds.tolist()
            of_ids = [hashlib.sha256(",".join(map(numerals.__getitem__, ids[a:b].tolist())).encode()).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            of_text = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in own.decode_all(ids, bounds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return named(docs, doc_id=doc_id, text=text).mapInArrow(made, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
