"""Structure repair of conversations: the cheapest edits to a legal order of turns, by a dynamic programme over audits.

A conversation's rows stream through one task in order. Four states say what a prefix of the repaired conversation ends
in (nothing, system, user, assistant); each holds its cost and its audit, the letters of its edits. Audits are nodes that
point to the node before, so states share their prefixes and a letter costs one node. A node has its ancestors at powers
of two and a rolling hash of its whole audit: two audits of equal cost are compared by the longest common prefix, which
is searched through the ancestors' hashes and then verified letter by letter. An equal cost never comes with one audit
being a prefix of the other: both have a letter for each row, and what one has more are insertions, which cost.

Every so often the audits of all states that can still win have a common beginning. It is final: its repaired rows go
into the digest and its nodes and texts are let go, so a conversation of any length needs memory only for what is open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm._base import importable

START, SYSTEM, USER, ASSISTANT = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows after which finished beginnings are looked for
OPEN_ROWS = 4096
_BASE, _PRIME = 0x1F3D5B79, (1 << 61) - 1
#: Where a turn of this role may follow
_AFTER = {"s": (START,), "u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


class Node:
    """The last letter of an audit, with the nodes 1, 2, 4, ... letters before it."""

    __slots__ = ("letter", "depth", "hash", "up")

    def __init__(self, before: Node | None, letter: str = ""):
        self.letter = letter
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * _BASE + ord(letter)) % _PRIME
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)


def at_depth(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.up[(node.depth - depth).bit_length() - 1]
    return node


def audit_of(node: Node, root: Node | None = None) -> str:
    out = []
    while node.depth and node is not root:
        out.append(node.letter)
        node = node.up[0]
    return "".join(reversed(out))


def _same(a: Node, b: Node) -> bool:
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether the audit of ``a`` sorts before that of ``b``."""
    depth = min(a.depth, b.depth)
    x, y = at_depth(a, depth), at_depth(b, depth)
    if x.hash == y.hash:
        return a.depth < b.depth if _same(x, y) else audit_of(a) < audit_of(b)
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    if x.letter == y.letter or not _same(x.up[0], y.up[0]):  # two audits of one hash
        return audit_of(a) < audit_of(b)
    return x.letter < y.letter


def common(nodes: list[Node]) -> Node:
    """The last node that all audits share."""
    first = nodes[0]
    for other in nodes[1:]:
        depth = min(first.depth, other.depth)
        x, y = at_depth(first, depth), at_depth(other, depth)
        while x is not y:
            k = next((k for k in reversed(range(len(x.up))) if x.up[k] is not y.up[k]), None)
            x, y = (x.up[0], y.up[0]) if k is None else (x.up[k], y.up[k])
        first = x
    return first


class Audit:
    """The audit of one conversation, fed row by row."""

    def __init__(self, every: int = OPEN_ROWS):
        self.heads: list[tuple[int, Node] | None] = [(0, Node(None)), None, None, None]
        self._insert()
        self.rows: list[tuple[str, str, str]] = []
        self.letters: list[str] = []
        self.state, self.digest, self.wrote = START, hashlib.sha256(), False
        self.every = self.next = every
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last = self.turn = self.low = None

    def _best(self, found: tuple[int, Node] | None, cost: int, before: Node, letter: str) -> tuple[int, Node]:
        if found is None or cost < found[0]:
            return cost, Node(before, letter)
        if cost == found[0] and less(new := Node(before, letter), found[1]):
            return cost, new
        return found

    def _insert(self) -> None:
        """Inserted turns after what stands; two of them are the most that any state needs."""
        h = self.heads
        for state, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for s in sources:
                if h[s] is not None:
                    h[state] = self._best(h[state], h[s][0] + INSERT, h[s][1], "I")

    def add(self, turn: int | None, role: str, text: str, initial: str, fault: str | None) -> None:
        """The next row; ``fault`` is ``blank``, ``duplicate``, ``truncated`` or none."""
        if fault is not None:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last is not None and (self.last, initial) not in _LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.turn:
            self.turn, self.turns = turn, self.turns + 1
            self.low = turn if self.low is None else self.low
        old, new = self.heads, [None] * 4
        for s in range(4):
            if old[s] is not None:
                new[s] = self._best(new[s], old[s][0] + DELETE, old[s][1], "D")
        if fault not in ("blank", "duplicate"):
            more = TRUNCATED if fault == "truncated" else 0
            for kind in "ua":
                for s in _AFTER[kind]:
                    if old[s] is not None:
                        new[_STATE[kind]] = self._best(new[_STATE[kind]], old[s][0] + REROLE + more, old[s][1], "R")
            for s in _AFTER.get(initial, ()):
                if old[s] is not None:
                    new[_STATE[initial]] = self._best(new[_STATE[initial]], old[s][0] + more, old[s][1], "K")
        self.heads = new
        self._insert()
        self.rows.append((role, text, initial))
        if len(self.rows) >= self.next:
            self._settle()

    def _settle(self) -> None:
        """Let go what all states that can still win have in common."""
        h = self.heads
        if h[ASSISTANT] is not None:  # from an assistant's turn on, all that the two others can do costs at most one deletion more
            done = h[ASSISTANT][0]
            if h[SYSTEM] is not None and done < h[SYSTEM][0]:
                h[SYSTEM] = None
            if h[START] is not None and done + DELETE < h[START][0]:
                h[START] = None
        shared = common([x[1] for x in h if x is not None])
        if shared.depth:
            self._replay(audit_of(shared))
            root, made = Node(None), {}
            for s, x in enumerate(h):
                if x is None:
                    continue
                path, node = [], x[1]
                while node is not shared:
                    path.append(node)
                    node = node.up[0]
                now = root
                for node in reversed(path):
                    now = made.setdefault(id(node), Node(now, node.letter))
                h[s] = (x[0], now)
        self.next = max(self.every, 2 * len(self.rows))

    def _replay(self, letters: str) -> None:
        at = 0
        for letter in letters:
            role, text, initial = ("", "", "") if letter == "I" else self.rows[at]
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "assistant" if self.state == USER else "user"
                initial = role[0]
            self.state = _STATE[initial]
            self.digest.update((b"\n" if self.wrote else b"") + role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))
            self.wrote = True
        del self.rows[:at]
        self.letters.append(letters)

    def finish(self) -> tuple:
        ends = [x for x in (self.heads[START], self.heads[ASSISTANT]) if x is not None]
        cost, node = ends[0]
        for c, n in ends[1:]:
            if c < cost or c == cost and less(n, node):
                cost, node = c, n
        self._replay(audit_of(node))
        gaps = self.turn - self.low + 1 - self.turns if self.turn is not None else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.letters), self.digest.hexdigest()


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def audits(rows: DataFrame, conv: str = "conv_id", dropped: str | None = None, times: str | None = None) -> DataFrame:
    """One row per conversation: its faults, the cheapest repair's cost and letters, and the digest of the result.

    ``rows(conv, turn, role, text)`` in order of turn, nulls first; rows of one turn by role and text. A row where
    ``dropped`` is true keeps its conversation in the result but is not part of it; ``times`` repeats a row in place. Null
    roles and texts are one space, a null conversation is one of its own. A first fault is ``blank`` (nothing but white
    space), ``duplicate`` (role and text came before) or ``truncated`` (no end mark). Edits: K keeps a row, R gives it the
    role user or assistant (3), D deletes it (4; blank and duplicate rows must go), I inserts an empty turn (3), and a
    truncated row that stays adds 3; roles then read ``(s?(ua)+)?`` by their first letters. Of equal costs the audit that is
    least in ASCII wins. Other columns are not used; an empty table gives an empty result.

    One shuffle by conversation; duplicates are numbered in its partitions, so no task holds a set of texts. As a digest
    runs over the texts in order, a conversation is read by one task, row by row, whatever its length.
    """
    importable(rows.sparkSession)
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    base = rows.select(F.col(f"`{conv}`").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("dropped"), (F.col(times).cast("int") if times else F.lit(1)).alias("times"))
    dealt = base.repartition("conv")
    seen = F.row_number().over(Window.partitionBy("conv", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn")))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(seen > 1, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    ordered = dealt.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1)).sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    schema = StructType([base.schema["conv"], *StructType.fromDDL(_RESULT)])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, out = None, None, []

        def result() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
            out.clear()
            return made

        for b in batches:
            for conv, turn, role, text, dropped, times, fault, initial in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append((key, *now.finish()))
                    key, now = conv, Audit()
                if dropped:
                    continue
                for k in range(times):
                    now.add(turn, role, text, initial, "duplicate" if k and fault != "blank" else fault)
            if out:
                yield result()
        if now is not None:
            out.append((key, *now.finish()))
            yield result()

    cols = ["conv", "turn", "role", "text", "dropped", "times", "fault", "initial"]
    return ordered.select(*cols).mapInArrow(run, schema).withColumnRenamed("conv", conv)
