"""Conversation structure repair by Viterbi decoding with survivor coalescence.

A conversation's rows, in order of turn, are turned at least cost into a sequence of
role initials (s?(ua)+)?. A row is kept (0), given the role user or assistant (2) or
deleted (3); an empty user or assistant turn can be inserted anywhere (2). Blank and
duplicate rows must be deleted; a truncated row that stays adds 1. Of edits with the
same cost those whose initials (D, I, K, R) are least as a string win.

The decoder keeps one survivor for each of four states (nothing yet, after the system
turn, after user, after assistant). Survivors are leaves of a tree of back pointers
whose nodes count what refers to them; a node that nothing refers to goes. Once the
root has one child, all survivors share that edit, which is emitted and becomes the
root. Survivors with the same cost are compared by their whole paths below the root.
A survivor goes early if another one is cheaper by more than any continuation could
cost it to catch up (LEAD), so that hopeless survivors don't hold the root. The tree
is as deep as the longest stretch over which two hopeful survivors disagree; a text
is held only by nodes that keep or change its row.

A conversation passes through one task, in turn order, for the digest of its repaired
text is sequential by definition; nothing of it is gathered: rows stream in, edits
stream out.

Order and defined results: rows by (turn with nulls first, role, text), so rows of one
turn have a fixed order and equal ones stand together; a null role or text is one
space; a null conv_id is a conversation of its own; a role's initial is its first
character, none for an empty role; a conversation of no rows has no edits; an empty
table gives none; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

SPACE = " \t\n\x0b\x0c\r"

NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a turn with that initial.
NEXT = {
    (NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER,
}
#: The role that a changed or inserted turn has in each state.
WANTED = ("user", "user", "assistant", "user")
#: LEAD[p][q]: what a path from state p pays more, at most, than the best one from q over the same rows.
LEAD = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))

KEEP, CHANGE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


class Edit:
    """A node of the tree of back pointers. refs counts the nodes and survivors that refer to it."""

    __slots__ = ("before", "mark", "turn", "heirs", "refs")

    def __init__(self, before: Edit | None, mark: str, turn: tuple | None):
        self.before, self.mark, self.turn, self.heirs, self.refs = before, mark, turn, [], 0
        if before is not None:
            before.heirs.append(self)
            before.refs += 1


class Decoder:
    """Repairs one conversation, row by row; yields (mark, turn) as soon as all survivors agree.

    turn is (row's number or None, role, text); role and text are None for deleted rows.
    nodes and most say how many nodes the tree has and had at most.
    """

    def __init__(self):
        self.root = Edit(None, "", None)
        self.nodes = self.most = 1
        self.live: dict[int, tuple[int, Edit]] = {}
        self.root.refs += 1
        self._survive({NONE: (0, self.root)})

    def row(self, role: str, text: str, fault: str | None, number: int) -> Iterator[tuple[str, tuple | None]]:
        """Takes the next row and yields the edits that are settled."""
        stays, extra = fault not in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0
        chosen: dict[int, tuple[int, Edit]] = {}
        for state, (cost, end) in self.live.items():
            self._offer(chosen, state, cost + DELETE, end, "D", (number, None, None))
            if stays:
                if (after := NEXT.get((state, role[:1]))) is not None:
                    self._offer(chosen, after, cost + KEEP + extra, end, "K", (number, role, text))
                wanted = WANTED[state]
                self._offer(chosen, NEXT[state, wanted[0]], cost + CHANGE + extra, end, "R", (number, wanted, text))
        self._survive(chosen)
        while self.root.refs == 1 and self.root.heirs:
            child = self.root.heirs[0]
            yield child.mark, child.turn
            child.before, self.root = None, child
            self.nodes -= 1

    def end(self) -> tuple[int, list[tuple[str, tuple | None]]]:
        """The cost of the whole repair and the edits not yet yielded."""
        best = None
        for state in (NONE, ASSISTANT):
            if (path := self.live.get(state)) and (best is None or self._less(path, best)):
                best = path
        return best[0], [(e.mark, e.turn) for e in self._path(best[1])]

    def _path(self, end: Edit) -> list[Edit]:
        found = []
        while end is not self.root:
            found.append(end)
            end = end.before
        return found[::-1]

    def _less(self, a: tuple[int, Edit], b: tuple[int, Edit]) -> bool:
        return a[0] < b[0] or a[0] == b[0] and [e.mark for e in self._path(a[1])] < [e.mark for e in self._path(b[1])]

    def _offer(self, chosen: dict, state: int, cost: int, end: Edit, mark: str, turn: tuple | None) -> bool:
        """Makes the path to `end` with one more edit the choice for `state` if it is better than the one there."""
        there = chosen.get(state)
        if there and cost > there[0]:
            return False
        node = Edit(end, mark, turn)
        self.nodes += 1
        if there and not self._less((cost, node), there):
            self._free(node)
            return False
        node.refs += 1
        chosen[state] = cost, node
        if there:
            self._release(there[1])
        return True

    def _survive(self, chosen: dict[int, tuple[int, Edit]]) -> None:
        """Adds turns inserted after `chosen`; those paths that can still win replace the survivors."""
        ready = list(chosen)
        while ready:
            state = ready.pop()
            cost, end = chosen[state]
            wanted = WANTED[state]
            after = NEXT[state, wanted[0]]
            if self._offer(chosen, after, cost + INSERT, end, "I", (None, wanted, "")):
                ready.append(after)
        self.most = max(self.most, self.nodes)
        was, self.live = self.live, {}
        for q, (cost, end) in chosen.items():
            if any(c + LEAD[p][q] < cost for p, (c, _) in chosen.items()):
                self._release(end)
            else:
                self.live[q] = cost, end
        for _, end in was.values():
            self._release(end)

    def _release(self, node: Edit) -> None:
        node.refs -= 1
        self._free(node)

    def _free(self, node: Edit) -> None:
        while not node.refs and node is not self.root:
            before = node.before
            before.heirs.remove(node)
            before.refs -= 1
            self.nodes -= 1
            node = before


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with nulls of role and text as one space, and blank, truncated and later.

    later: an equal row (role, text) of the conversation has an earlier turn. Only rows
    that occur twice are joined back, by digest, so a row that fills a conversation meets
    one row of the other side.
    """
    rows = only(turns, "conv_id", "turn", "role", "text").withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    rows = rows.withColumns({
        "digest": F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256),
        "end": F.expr(r"right(trim(TRAILING ' \t\n\x0b\f\r' FROM text), 1)".replace(r"\x0b", "\x0b")),
    })
    key = {"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))}
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    twice = rows.withColumns(key).groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(when).alias("first")).filter("n > 1")
    found = rows.withColumns(key).join(twice, ["conv", "digest"], "left")
    return found.select(
        "conv_id", "turn", "role", "text", "digest", (F.col("end") == "").alias("blank"),
        (~F.col("end").isin(".", "!", "?")).alias("truncated"),
        (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("later"),
    )


_EDITS = pa.schema([
    ("number", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("was", pa.string()),
    ("role", pa.string()), ("text", pa.string()), ("cost", pa.int64()),
])
_FLUSH = 4096  #: edits, or characters of text in 256ths, that are handed on together


def edits(turns: DataFrame, absent: str | None = None) -> DataFrame:
    """The edits of each conversation in order, one row each.

    conv_id; edit (K keep, R change role, D delete, I insert); role and text of the
    repaired turn (null for D); number, turn, was (the role's initial) and fault (blank,
    duplicate, truncated or null) of the row it is made of (null for I). The last row of a
    conversation has no edit and holds the cost. Rows where the boolean column `absent` is
    true are no rows of the conversation, but give it a last row.
    """
    keep = [absent] if absent else []
    gone = F.col(absent) if absent else F.lit(False)
    marked = turns if absent is None else turns.filter(~gone)
    rows = faults(marked).withColumn("gone", F.lit(False))
    if keep:
        rows = rows.unionByName(only(turns.filter(gone), "conv_id").distinct().withColumn("gone", F.lit(True)), allowMissingColumns=True)
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "gone", "turn", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, decoder, number, last, out, ids, size, now = None, None, 0, None, [], [], 0, ()
        said: dict[int, tuple] = {}  # fault, turn and initial of rows whose edits aren't settled

        def put(mark, turn):
            nonlocal size
            k, role, text = turn
            fault, at, was = said.pop(k) if k is not None else (None, None, None)
            out.append((k, mark, fault, at, was, role, text, None))
            ids.append(conv)
            size += 256 + len(text or "")

        def flush(kind):
            nonlocal size
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), _EDITS.types, strict=True)]
            batch = pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], ["conv_id", *_EDITS.names])
            out.clear()
            ids.clear()
            size = 0
            return batch

        def close():
            cost, rest = decoder.end()
            for edit in rest:
                put(*edit)
            out.append((None, None, None, None, None, None, None, cost))
            ids.append(conv)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "digest", "blank", "truncated", "later")]
            kind = batch.schema.field("conv_id").type
            for c, gone, turn, role, text, digest, blank, truncated, later in zip(*columns, strict=True):
                if decoder is None or c != conv:
                    if decoder:
                        close()
                    conv, decoder, number, last = c, Decoder(), 0, None
                if gone:
                    continue
                number += 1
                fault = "blank" if blank else "duplicate" if later or last == (turn, digest) else "truncated" if truncated else None
                last = turn, digest
                said[number] = fault, turn, role[:1]
                for edit in decoder.row(role, text, fault, number):
                    put(*edit)
                if size >= _FLUSH * 256:
                    yield flush(kind)
        if decoder:
            close()
            yield flush(kind)

    return ordered.mapInArrow(go, f"conv_id {kind}, number long, edit string, fault string, turn long, was string, role string, text string, cost long")


def report(found: DataFrame) -> DataFrame:
    """One row a conversation from its edits(), which must be as edits() gave them: no shuffle lies between.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A
    conversation's digest grows as its turns pass; only its edits' initials are kept.
    """
    kind = found.schema["conv_id"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            names = ("conv_id", "number", "edit", "fault", "turn", "was", "role", "text", "cost")
            out = []
            for conv, number, edit, fault, turn, was, role, text, cost in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if state is None:
                    state = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0) | {
                        "audit": bytearray(), "sha": hashlib.sha256(), "turns": 0, "low": None, "high": None, "was": None,
                    }
                if edit is None:  # the conversation's end
                    gaps = state["high"] - state["low"] + 1 - state["distinct"] if state["distinct"] else 0
                    out.append((conv, gaps, *(state[c] for c in counts[1:5]), cost, state["audit"].decode(), state["sha"].hexdigest()))
                    state = None
                    continue
                state["audit"] += edit.encode()
                if edit != "D":
                    state["sha"].update(f"{chr(10) if state['turns'] else ''}{role}:{text}".encode())
                    state["turns"] += 1
                if number is None:
                    continue
                if fault:
                    state[fault] += 1
                if state["was"] is not None and state["was"] + was not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["was"] = was
                if turn is not None and turn != state["high"]:
                    state["low"], state["high"] = turn if state["low"] is None else state["low"], turn
                    state["distinct"] += 1
            if out:
                types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", *counts, "audit", "repaired_sha256"])

    longs = ", ".join(f"{c} long" for c in counts)
    return found.mapInArrow(go, f"conv_id {kind}, {longs}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """turns with the faults that crc32(conv_id:turn) % 20 chooses; rows that it drops stay with dropped = true."""
    rows = only(turns, "conv_id", "turn", "role", "text").withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    ids = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("what", F.crc32(F.concat_ws(":", *ids)) % 20)
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("what") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("what") == 0).alias("dropped"), F.explode(copies).alias("copy"),
    ).drop("copy")
