"""Repair of conversations by a Viterbi search whose decided part leaves memory as it goes.

A conversation is read row by row. A row is kept, given another role or deleted, and a user or an assistant turn may be
inserted anywhere; what remains must be a system turn, or none, and then user and assistant by turns. The search holds
one survivor for each state (nothing yet, after system, after user, after assistant), the cheapest way there and the
least in order of letters among those. Survivors are leaves of a tree of edits; nodes count what points at them, a node
that nothing points at goes, and what all survivors have in common is emitted and forgotten. A survivor that another
one undercuts whatever follows is dropped, so memory holds the undecided part only, however long the conversation.
Ways of one cost are compared by their whole undecided letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import in_arrow

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What an undeleted truncated row adds.
TRUNCATED = 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that follows a role's initial, and those from which it may.
AFTER = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
#: FOLLOWS[t][s]: what it costs at most to do from state t what can be done from state s. To stand in for `nothing yet`
#: a system turn that it would keep is deleted; a missing assistant, or user and assistant, is inserted.
FOLLOWS = {START: {SYSTEM: 0, USER: 5, ASSISTANT: 0}, SYSTEM: {START: 10, USER: 5, ASSISTANT: 10},
           USER: {START: 7, SYSTEM: 5, ASSISTANT: 5}, ASSISTANT: {START: 2, SYSTEM: 0, USER: 5}}
_SOLID = r"[^\x20\x09-\x0D]"


class Node:
    """An edit: what came before, its letter, what it gives out, and what points at it: later edits, or a survivor."""

    __slots__ = ("before", "edit", "item", "after", "held")

    def __init__(self, before: Node | None, edit: str = "", item: tuple | None = None):
        self.before, self.edit, self.item = before, edit, item
        self.after: list[Node] = []
        self.held = False
        if before is not None:
            before.after.append(self)

    def release(self) -> None:
        """Take this node out of the tree if nothing points at it, and those before it that are left alone by that."""
        node = self
        while node.before is not None and not node.held and not node.after:
            before = node.before
            before.after.remove(node)
            node.before = None
            node = before


class Repair:
    """The search over one conversation: `push` rows in order, then `finish`; both yield decided edits (letter, item).

    An item is what the caller handed in for the row, with the role it gets: (row, role or None if deleted); the row
    of an inserted turn is None.
    """

    def __init__(self) -> None:
        self.root = Node(None)
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.cost = 0

    def _letters(self, node: Node) -> str:
        out = []
        while node.before is not None:
            out.append(node.edit)
            node = node.before
        return "".join(reversed(out))

    def _offer(self, to: dict[int, tuple[int, Node]], state: int, cost: int, before: Node, edit: str, item: tuple) -> None:
        held = to.get(state)
        if held is not None and (held[0] < cost or held[0] == cost and self._letters(held[1]) <= self._letters(before) + edit):
            return
        to[state] = cost, Node(before, edit, item)
        if held is not None:
            held[1].release()

    def _insertions(self, best: dict[int, tuple[int, Node]]) -> None:
        for role, initial in (("user", "u"), ("assistant", "a")):
            state, sources = AFTER[initial]
            for source in sources:
                if source in best:
                    cost, node = best[source]
                    self._offer(best, state, cost + COST[INSERT], node, INSERT, (None, role))

    def _settle(self, best: dict[int, tuple[int, Node]]) -> Iterator[tuple[str, tuple]]:
        """Hold the survivors that may still win, let go of the rest, and emit what they share."""
        beaten = {s for s, (cost, _) in best.items() if any(t != s and best[t][0] + FOLLOWS[t][s] < cost for t in best)}
        kept = {s: pair for s, pair in best.items() if s not in beaten}
        for _, node in kept.values():
            node.held = True
        for _, node in self.best.values():
            node.held = False
        for _, node in [*self.best.values(), *(best[s] for s in beaten)]:
            node.release()
        self.best = kept
        while not self.root.held and len(self.root.after) == 1:
            node = self.root.after.pop()
            self.root, node.before, item = node, None, node.item
            node.item = None
            yield node.edit, item

    def push(self, row: object, role: str, bad: bool, truncated: bool) -> Iterator[tuple[str, tuple]]:
        """The next row; a `bad` one (blank or duplicate) can only be deleted."""
        opened, best = dict(self.best), {}
        self._insertions(opened)
        extra, initial = TRUNCATED * truncated, role[:1]
        for state, (cost, node) in opened.items():
            self._offer(best, state, cost + COST[DELETE], node, DELETE, (row, None))
            if not bad:
                if initial in AFTER and state in AFTER[initial][1]:
                    self._offer(best, AFTER[initial][0], cost + COST[KEEP] + extra, node, KEEP, (row, role))
                to, other = (ASSISTANT, "assistant") if state == USER else (USER, "user")
                self._offer(best, to, cost + COST[REROLE] + extra, node, REROLE, (row, other))
        for _, node in opened.values():
            node.release()
        yield from self._settle(best)

    def finish(self) -> Iterator[tuple[str, tuple]]:
        """The end: what is left of the cheapest way; `cost` holds its cost."""
        best = dict(self.best)
        self._insertions(best)
        self.cost, _, state = min((best[s][0], self._letters(best[s][1]), s) for s in (START, ASSISTANT) if s in best)
        node, path = best[state][1], []
        while node.before is not None:
            path.append((node.edit, node.item))
            node = node.before
        yield from reversed(path)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by the CRC-32 of `conv_id:turn` modulo 20; nulls count as one space.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 makes it a user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _solid_end(text: Column) -> Column:
    """The text up to its last character that is no blank."""
    return F.rtrim(text, F.lit(" \t\n\v\f\r"))


def marked(rows: DataFrame) -> DataFrame:
    """The rows in order, each conversation whole in one partition, with what the search needs to know of each.

    A row that repeats role and text of an earlier turn is `late`; one that repeats its neighbour of the same turn is found while
    reading, as rows of a turn stand by role, then by MD5 of the text. First turns are found by a grouping, so no task
    remembers the texts it has seen.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    end = _solid_end(F.col("text"))
    rows = rows.withColumn("blank", end == "").withColumn("truncated", ~F.substring(end, -1, 1).isin(".", "!", "?"))
    when = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.filter("not blank").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(
        F.min(when).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    late = F.coalesce(when > F.col("_first"), F.lit(False)).alias("late")
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "digest", "text", "blank", "truncated", late).repartition(
        "conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")


class _Conversation:
    """What is known of the conversation that is being read."""

    def __init__(self, conv_id):
        self.conv_id, self.search = conv_id, Repair()
        self.counts = dict.fromkeys(("rows", "blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.last = None
        self.turns, self.letters, self.hash, self.given = 0, [], hashlib.sha256(), 0

    def read(self, turn, role, digest, text, blank, truncated, late) -> Iterator[tuple]:
        this = turn, role, digest
        if self.counts["rows"]:
            self.counts["illegal"] += self.last[1][:1] + role[:1] not in ("su", "ua", "au")
        duplicate = not blank and (late or this == self.last)
        truncated = truncated and not blank and not duplicate
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += self.last is None or self.last[0] != turn
        self.last = this
        for name, more in (("rows", 1), ("blank", blank), ("duplicate", duplicate), ("truncated", truncated)):
            self.counts[name] += more
        yield from map(self._given, self.search.push((turn, text), role, blank or duplicate, truncated))

    def end(self) -> Iterator[tuple]:
        yield from map(self._given, self.search.finish())

    def _given(self, step: tuple[str, tuple]) -> tuple:
        letter, (row, role) = step
        turn, text = (None, "") if row is None else row
        self.letters.append(letter)
        if letter == DELETE:
            text = None
        else:
            self.hash.update(f"{'\n' * bool(self.given)}{role}:{text}".encode())
            self.given += 1
        return self.conv_id, len(self.letters) - 1, letter, turn, role, text

    def report(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *list(self.counts.values())[1:], self.search.cost, "".join(self.letters), self.hash.hexdigest()


def _read(rows: DataFrame, schema: T.StructType, edits: bool) -> DataFrame:
    """Go through the `marked` rows; give out the edits as they are decided, or a report at the end of each conversation."""

    def run(batches):
        arrow = [pa.field(n, t) for n, t in zip(schema.names, _arrow_types(schema), strict=True)]
        now, out, size = None, [], 0

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=pa.schema(arrow))

        for batch in batches:
            for conv_id, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        last = list(now.end())
                        out.extend(last if edits else [now.report()])
                    now = _Conversation(conv_id)
                for step in now.read(*row):
                    if edits:
                        out.append(step)
                size += len(row[3])
                if size > 1 << 20 and out:
                    yield flushed()
                    out, size = [], 0
        if now is not None:
            last = list(now.end())
            out.extend(last if edits else [now.report()])
        if out:
            yield flushed()

    return marked(rows).transform(in_arrow, run, schema)


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def repaired(conversations: DataFrame) -> DataFrame:
    """The cheapest edits of each conversation of (conv_id, turn, role, text): (conv_id, step, edit, turn, role, text).

    Rows stand by turn (nulls first), then role, then MD5 of the text. A row's first fault counts: blank (nothing but
    `[\x20\x09-\x0D]`), duplicate (role and text of an earlier row of the conversation), truncated (its last other
    character isn't `.`, `!` or `?`). Edits in order: K keeps the row (cost 0), R makes it a user's or an assistant's
    turn (1), D deletes it (2; role and text null), I inserts a user's or an assistant's empty turn (5; turn null).
    Blank and duplicate rows are deleted; a truncated row that stays adds 5. The roles' initials of what stays are
    `(s?(ua)+)?`; of ways of one cost that with the least letters is taken.

    Null role or text: one space. Null conv_id: a conversation of its own. Repeated rows: all but one are duplicates.
    Other columns are left out. Empty table: no rows. A conversation is read by one task as a stream, of which only
    the undecided edits stay in memory.
    """
    kinds = {f.name: f.dataType for f in conversations.schema}
    text = T.StringType()
    return _read(conversations, T.StructType([T.StructField(n, t) for n, t in (
        ("conv_id", kinds["conv_id"]), ("step", T.LongType()), ("edit", text), ("turn", kinds["turn"]), ("role", text), ("text", text))]), True)


def reports(conversations: DataFrame) -> DataFrame:
    """One row for each conversation that has rows: faults, cost, the letters of `repaired` and the SHA-256 of what stays.

    `gaps` counts the turn numbers missing between the least and the greatest, `illegal` the neighbours whose initials
    aren't su, ua or au. The hash is that of the kept and inserted turns as `role:text`, joined by line feeds.
    """
    long, text = T.LongType(), T.StringType()
    return _read(conversations, T.StructType([conversations.schema["conv_id"], *[T.StructField(n, long) for n in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", text), T.StructField("repaired_sha256", text)]), False)
