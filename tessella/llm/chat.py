"""Chat formatting: conversations that share initial turns become one prefix tree whose shared turns are emitted once.

Conversations are sorted by their turns, so a depth-first walk is a walk over neighbours: each adds only the
turns that it doesn't share with the one before it. A row is a part of the walk (see below): its text, and
by node the interval in the text, the position id of its first token and what it attends to: the intervals
of its ancestors in the row and of itself, and the first ``n_above`` of the row's ``above``. Tokens are code points;
position ids run on inside a node. The turns' order within a conversation is (turn, role, text).

No task holds an unbounded group: conversations are dealt over range partitions by turns and id, and a row ends where
a partition ends or where it reaches ``TREE_CHARS`` or ``TREE_CONVERSATIONS``. Turns are emitted once all the same: a
row names, as ``above``, the nodes of earlier rows that its first conversation goes on from, and each row names, as ``opens``,
its own nodes that the next row can go on from. A partition learns where it goes on from by the last conversation
of the one before, of which only the turns' hashes go through the driver, one conversation by partition.

Template: ``[INST] text [/INST]`` for a user, ``<<SYS>> text <</SYS>>`` for a system and ``<s> text </s>`` for an
assistant turn, ``[ROLE "name"] text [/ROLE]`` (the name as JSON) for any other. Inside texts and names a backslash is
put before each backslash and each control string, which reading takes away.

Defined cases: a null text, role or conv_id is an empty text, an empty role, and one conversation with id null;
a null turn sorts first; repeated rows are turns of their own; an empty table gives no trees.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut, named, portions

TREE_CHARS, TREE_CONVERSATIONS = 1_000_000, 4096
#: Control strings of the template.
CONTROL = ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[ROLE", "[/ROLE]"]
_ANY = "|".join(map(re.escape, CONTROL))
ESCAPE = re.compile(rf"\\|{_ANY}")
UNESCAPE = re.compile(rf"\\(\\|{_ANY})")
#: What a reader meets: an escape, a turn's end, or anything else.
PIECE = re.compile(rf"\\(?:\\|{_ANY})|{_ANY}")
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"), "assistant": ("<s> ", " </s>")}
OPENERS = {opener.strip(): role for role, (opener, _) in MARKS.items()}

#: Bytes of the hash of a turn, and of a path of turns.
HASH = 16

INTERVAL = pa.struct([("start", pa.int64()), ("end", pa.int64())])
NODE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("parent", pa.int32()), ("position", pa.int64()), ("n_above", pa.int32()), ("attends", pa.list_(INTERVAL)), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
LEAF = pa.struct([("conv_id", pa.int64()), ("node", pa.int32()), ("n_above", pa.int32())])
OPEN = pa.struct([("path", pa.binary()), ("node", pa.int32())])
TREE = pa.schema([("tree", pa.int64()), ("text", pa.string()), ("nodes", pa.list_(NODE)), ("leaves", pa.list_(LEAF)), ("above", pa.list_(pa.binary())), ("opens", pa.list_(OPEN))])
TREES = (
    "tree bigint, text string, nodes array<struct<start: bigint, end: bigint, parent: int, position: bigint, n_above: int, attends: array<struct<start: bigint, end: bigint>>, loss_start: bigint, loss_end: bigint>>,"
    " leaves array<struct<conv_id: bigint, node: int, n_above: int>>, above array<binary>, opens array<struct<path: binary, node: int>>"
)
OPENED = "path binary, formatted string, loss_start bigint, loss_end bigint"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where in it the loss is taken: an assistant's escaped text."""
    opener, closer = MARKS.get(role) or (f"[ROLE {json.dumps(escape(role))}] ", " [/ROLE]")
    body = escape(text)
    start = len(opener)
    return opener + body + closer, start, start + len(body) if role == "assistant" else start


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = PIECE.match(formatted, at)
        assert m and m[0][0] != "\\", "not at a turn's start"
        if m[0] == "[ROLE":
            role, begin = json.JSONDecoder().raw_decode(formatted, m.end() + 1)
            role, begin, closer = unescape(role), begin + 2, " [/ROLE]"
        else:
            role = OPENERS[m[0]]
            begin, closer = at + len(MARKS[role][0]), MARKS[role][1]
        for end in PIECE.finditer(formatted, begin):
            if end[0] == closer[1:]:
                turns.append((role, unescape(formatted[begin : end.start() - 1])))
                at = end.end()
                break
        else:
            raise ValueError("a turn without an end")
    return turns


class Tree:
    """A part of the walk. ``path`` holds of each turn of the last conversation: its hash, the hash of the path to it, its node (-1: in an earlier row) and the position after it."""

    def __init__(self, tree: int, path: list[tuple[bytes, bytes, int, int]]):
        self.tree = tree
        self.path = [(turn, whole, -1, after) for turn, whole, _, after in path]
        self.above = [whole for _, whole, _, _ in path]
        self.parts: list[str] = []
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.size = 0

    def add(self, conv_id: int | None, turns: list[tuple[str, str]], hashes: list[bytes]) -> None:
        shared = common(self.path, hashes)
        del self.path[shared:]
        n_above = min(shared, len(self.above))
        if not self.leaves:  # what lies beyond isn't gone on from in this row
            self.above = self.above[:n_above]
        for (role, text), turn in zip(turns[shared:], hashes[shared:], strict=True):
            formatted, loss_start, loss_end = format_turn(role, text)
            _, whole, parent, position = self.path[-1] if self.path else (b"", b"", -1, 0)
            above = self.nodes[parent] if parent >= 0 else None
            own = {"start": self.size, "end": self.size + len(formatted)}
            attends = [*(above["attends"] if above else []), own]
            if above and above["end"] == own["start"]:  # neighbours make one interval
                attends[-2:] = [{"start": attends[-2]["start"], "end": own["end"]}]
            outside = above["n_above"] if above else len(self.path)
            self.nodes.append(own | {"parent": parent, "position": position, "n_above": outside, "attends": attends, "loss_start": self.size + loss_start, "loss_end": self.size + loss_end})
            self.parts.append(formatted)
            self.size += len(formatted)
            self.path.append((turn, path_hash(whole, turn), len(self.nodes) - 1, position + len(formatted)))
        node = self.path[-1][2] if self.path else -1
        self.leaves.append({"conv_id": conv_id, "node": node, "n_above": self.nodes[node]["n_above"] if node >= 0 else len(self.path)})

    def row(self) -> pa.RecordBatch:
        opens = [{"path": whole, "node": node} for _, whole, node, _ in self.path if node >= 0]
        return pa.RecordBatch.from_pylist([{"tree": self.tree, "text": "".join(self.parts), "nodes": self.nodes, "leaves": self.leaves, "above": self.above, "opens": opens}], TREE)


def path_hash(above: bytes, turn: bytes) -> bytes:
    return hashlib.sha256(above + turn).digest()[:HASH]


def common(path: list[tuple], hashes: list[bytes]) -> int:
    """Turns that a conversation shares with a path."""
    shared = 0
    while shared < min(len(path), len(hashes)) and path[shared][0] == hashes[shared]:
        shared += 1
    return shared


def _grown(last: dict[int, tuple[list[bytes], list[int]]], most_chars: int, most_leaves: int):
    """last: by partition, the turns' hashes of its last conversation, and the formatted length of each."""

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        path: list[tuple[bytes, bytes, int, int]] = []
        whole, after = b"", 0
        for turn, length in zip(*last.get(max((p for p in last if p < partition), default=-1), ([], [])), strict=True):
            whole, after = path_hash(whole, turn), after + length
            path.append((turn, whole, -1, after))
        made = count(partition << 33)
        tree = None
        for batch in portions(batches):
            for conv_id, turns, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = [(t["role"], t["text"]) for t in turns]
                if tree and (tree.size >= most_chars or len(tree.leaves) >= most_leaves or tree.size >= most_chars // 16 and not common(tree.path, hashes)):
                    yield tree.row()
                    path, tree = tree.path, None
                if not tree:
                    tree = Tree(next(made), path[: common(path, hashes)])
                tree.add(conv_id, turns, hashes)
        if tree:
            yield tree.row()

    return grown


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition, and the hashes and formatted lengths of the turns of its last conversation."""
    from pyspark import TaskContext

    kept = None
    for batch in batches:
        if batch.num_rows:
            kept = batch.slice(batch.num_rows - 1)
    if kept is not None:
        (turns,), (hashes,) = kept.column("turns").to_pylist(), kept.column("path").to_pylist()
        lengths = [len(format_turn(t["role"], t["text"])[0]) for t in turns]
        yield pa.RecordBatch.from_pylist([{"p": TaskContext.get().partitionId(), "path": hashes, "lengths": lengths}], pa.schema([("p", pa.int32()), ("path", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int64()))]))


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns (role and text in order) and the turns' hashes, of each conversation."""
    rows = named(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    turn_hash = lambda t: F.substring(F.unhex(F.sha2(F.concat(t["role"], F.lit("\n"), F.length(t["role"]).cast("string"), F.lit("\n"), t["text"]), 256)), 1, HASH)
    return whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.transform("turns", turn_hash).alias("path"))


def trees(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most_chars: int = TREE_CHARS, most_leaves: int = TREE_CONVERSATIONS) -> DataFrame:
    """The prefix trees (tree, text, nodes, leaves, above, opens) of all conversations."""
    whole = cut(conversations(rows, conv_id, turn, role, text))  # a range partitioning reads its input twice
    dealt = cut(whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns", "path"))
    last = {r["p"]: ([bytes(x) for x in r["path"]], r["lengths"]) for r in dealt.mapInArrow(_last, "p int, path array<binary>, lengths array<bigint>").collect()}
    return dealt.mapInArrow(_grown(last, most_chars, most_leaves), TREES)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The formatted text, and where in it the loss is taken, of the nodes that later rows can go on from."""
    for batch in portions(batches):
        out = []
        for tree in batch.to_pylist():
            for x in tree["opens"]:
                node = tree["nodes"][x["node"]]
                out.append({"path": x["path"], "formatted": tree["text"][node["start"] : node["end"]], "loss_start": node["loss_start"] - node["start"], "loss_end": node["loss_end"] - node["start"]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.binary()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        out = []
        for tree in batch.to_pylist():
            text, nodes, outer = tree["text"], tree["nodes"], tree["outer"] or []
            for leaf in tree["leaves"]:
                node, losses = leaf["node"], []
                own = nodes[node]["attends"] if node >= 0 else []
                formatted = "".join(x["formatted"] for x in outer[: leaf["n_above"]]) + "".join(text[x["start"] : x["end"]] for x in own)
                while node >= 0:
                    losses.append(unescape(text[nodes[node]["loss_start"] : nodes[node]["loss_end"]]))
                    node = nodes[node]["parent"]
                losses += [unescape(x["formatted"][x["loss_start"] : x["loss_end"]]) for x in reversed(outer[: leaf["n_above"]])]
                turns, loss = parse(formatted), "".join(reversed(losses))
                said = "".join(f"{role}\n{x}\n" for role, x in turns)
                out.append({"conv_id": leaf["conv_id"], "n_turns": len(turns), "turns_sha256": digest(said), "loss_chars": len(loss), "loss_sha256": digest(loss), "formatted_chars": len(formatted)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def read_back(grown: DataFrame) -> DataFrame:
    """What the trees say of each conversation, read through its leaf's attention intervals and the nodes above its row."""
    grown = cut(grown)
    opened = grown.where(F.size("opens") > 0).select("text", "nodes", "opens").mapInArrow(_opened, OPENED)
    wanted = grown.select("tree", F.posexplode("above").alias("pos", "path"))
    outer = wanted.join(opened, "path").groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("pos", "formatted", "loss_start", "loss_end"))).alias("outer"))
    return grown.select("tree", "text", "nodes", "leaves").join(outer, "tree", "left").drop("tree").mapInArrow(_read, READ)
