"""Conversation structure repair with an audit trail (operator 13).

A repaired conversation has the roles ``(s?(ua)+)?``: an optional system turn, then user and assistant in
turns, or nothing.  Each row is kept, given another role or deleted, and empty turns may be inserted; the
cheapest edits win, among equal costs the ASCII-least string of their initials (D, I, K, R).

A dynamic program over the rows holds the cheapest edits for each of four states (nothing yet, after the
system turn, after a user, after an assistant).  Their strings are linked nodes that share prefixes; each
node has binary-lifting ancestors and a rolling hash of its whole string, so two strings of equal cost
compare by searching their longest common prefix, in logarithmic time.  Equal hashes are believed only
for one node or after a walk over the characters.  (At equal cost no string is a prefix of another: both hold one
letter per row, and further inserts would cost.)

Spark deals conversations by id and sorts each by turn; a task reads them as a stream.  States that cost
too much to win are dropped and the prefix that all others share is final, so its rows leave the
task: a conversation of any length needs the memory of its undecided end only.  Repeats are marked by
Spark's window before, not by a set in the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeshore.llm.common import text_batches

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: a state this much dearer than another cannot win: two inserts and a deleted system turn reach its future
HOPELESS = 2 * INSERT + DELETE
START, SYSTEM, USER, ASSISTANT = range(4)
#: state before -> state after a row of that role
STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: rows whose edits are open before final ones are looked for
OPEN_ROWS = 4_096
OUT_ROWS, OUT_CHARS = 8_192, 8_000_000
BASE, PRIME = 1_000_003, (1 << 61) - 1


# ---------------------------------------------------------------- edit strings

class Edits:
    """A string of edits: the last one, linked to the string before it."""
    __slots__ = ("up", "edit", "length", "hash")

    def __init__(self, before: Edits | None, edit: str = ""):
        self.edit = edit
        if before is None:
            self.up, self.length, self.hash = (), 0, 0
            return
        self.length = before.length + 1
        self.hash = (before.hash * BASE + ord(edit)) % PRIME
        up, node, k = [before], before, 0
        while len(node.up) > k:
            node = node.up[k]
            up.append(node)
            k += 1
        self.up = tuple(up)

    def ancestor(self, length: int) -> Edits:
        node, over = self, self.length - length
        for k in range(over.bit_length()):
            if over >> k & 1:
                node = node.up[k]
        return node

    def since(self, root: Edits) -> str:
        out, node = [], self
        while node is not root:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))


def equal(a: Edits, b: Edits) -> bool:
    """Whether two strings of one length are equal: hashes first, then the characters up to a shared node."""
    if a is b:
        return True
    if a.hash != b.hash:
        return False
    while a is not b:
        if a.edit != b.edit:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Edits, b: Edits) -> bool:
    """Whether a's string is ASCII-less than b's."""
    length = min(a.length, b.length)
    x, y = a.ancestor(length), b.ancestor(length)
    if equal(x, y):
        return a.length < b.length
    # the highest ancestors that still differ: behind the longest common prefix
    for k in range(length.bit_length() - 1, -1, -1):
        if k < len(x.up) and not equal(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return x.edit < y.edit


# ---------------------------------------------------------------- dynamic program

class Repair:
    """Cheapest edits of one conversation, row by row."""

    def __init__(self):
        self.root = Edits(None)
        self.cells: list[tuple[int, Edits] | None] = [(0, self.root), None, None, None]
        self._insert()

    def _better(self, to: list, state: int, cost: int, node: Edits, edit: str) -> None:
        old = to[state]
        if old is None or cost < old[0]:
            to[state] = (cost, Edits(node, edit))
        elif cost == old[0]:
            new = Edits(node, edit)
            if less(new, old[1]):
                to[state] = (cost, new)

    def _insert(self) -> None:
        cells = self.cells
        for state in (START, SYSTEM, ASSISTANT):
            if cells[state]:
                self._better(cells, USER, cells[state][0] + INSERT, cells[state][1], "I")
        if cells[USER]:
            self._better(cells, ASSISTANT, cells[USER][0] + INSERT, cells[USER][1], "I")
        least = min(c[0] for c in cells if c)
        self.cells = [c if c and c[0] <= least + HOPELESS else None for c in cells]

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        to: list = [None] * 4
        extra = TRUNCATED if truncated else 0
        for state, cell in enumerate(self.cells):
            if cell is None:
                continue
            cost, node = cell
            self._better(to, state, cost + DELETE, node, "D")
            if must_go:
                continue
            for role in "ua":
                if state in STEP[role]:
                    self._better(to, STEP[role][state], cost + extra + REROLE, node, "R")
            if state in STEP.get(initial, ()):
                self._better(to, STEP[initial][state], cost + extra, node, "K")
        self.cells = to
        self._insert()

    def final_prefix(self) -> str:
        """The edits that all states share since the last call; the strings are built anew behind them."""
        live = [c[1] for c in self.cells if c]
        length = min(n.length for n in live)
        nodes = [n.ancestor(length) for n in live]
        while any(n is not nodes[0] for n in nodes):
            # up together by the longest steps that leave some of them apart
            k = max((k for k in range(len(nodes[0].up)) if any(n.up[k] is not nodes[0].up[k] for n in nodes)), default=0)
            nodes = [n.up[k] for n in nodes]
        shared = nodes[0].since(self.root)
        if shared:
            root, made = Edits(None), {}
            for state, cell in enumerate(self.cells):
                if cell:
                    node, text = root, cell[1].since(nodes[0])
                    for edit in text:
                        key = id(node), edit
                        if key not in made:
                            made[key] = Edits(node, edit)
                        node = made[key]
                    self.cells[state] = (cell[0], node)
            self.root = root
        return shared

    def last(self) -> tuple[int, str]:
        """The cost of the whole repair and the edits since the last final prefix."""
        ends = [c for c in (self.cells[START], self.cells[ASSISTANT]) if c]
        best = ends[0]
        for end in ends[1:]:
            if end[0] < best[0] or end[0] == best[0] and less(end[1], best[1]):
                best = end
        return best[0], best[1].since(self.root)


# ---------------------------------------------------------------- streams of rows

#: edit by edit: the row's own turn, role and fault (null for inserts), the repaired role and text (null if deleted)
EDITS = "conv_id {0}, step long, edit string, turn long, was_role string, fault string, role string, text string"


class _Conversation:
    """Rows whose edits are open, and what decides the roles of the next ones."""

    def __init__(self, conv_id):
        self.conv_id, self.repair, self.open = conv_id, Repair(), []
        self.step, self.next_role = 0, "user"

    def row(self, turn, role, text, fault) -> None:
        self.open.append((turn, role, None if fault in ("blank", "duplicate") else text, fault))
        self.repair.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")

    def edited(self, edits: str) -> Iterator[tuple]:
        rows = iter(self.open)
        used = 0
        for edit in edits:
            turn = was = fault = role = text = None
            if edit != "I":
                turn, was, text, fault = next(rows)
                used += 1
            if edit == "K":
                role = was
            elif edit == "D":
                text = None
            else:
                role, text = self.next_role, "" if edit == "I" else text
            if role is not None:
                self.next_role = "assistant" if role[:1] == "u" else "user"
            yield self.conv_id, self.step, edit, turn, was, fault, role, text
            self.step += 1
        del self.open[:used]


def _edits(batches) -> Iterator[list[tuple]]:
    """Lists of edits, in order, of conversations that come one after the other, sorted by turn."""
    now, out, chars = None, [], 0
    for batch in batches:
        for conv_id, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    out.extend(now.edited(now.repair.last()[1]))
                now = _Conversation(conv_id)
            now.row(turn, role, text, fault)
            chars += len(text)
            if len(now.open) % OPEN_ROWS == 0:
                out.extend(now.edited(now.repair.final_prefix()))
            if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                yield out
                out, chars = [], 0
    if now is not None:
        out.extend(now.edited(now.repair.last()[1]))
    yield out


def _digests(lists: Iterator[list[tuple]]) -> Iterator[tuple]:
    """One row per conversation from its edits in order."""
    costs = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
    now = None
    for rows in lists:
        for conv_id, step, edit, turn, was, fault, role, text in rows:
            if step == 0:
                if now is not None:
                    yield now.result()
                now = _Digest(conv_id)
            now.audit.append(edit)
            now.cost += costs[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
            if edit != "I":
                now.seen(turn, was, fault)
            if role is not None:
                now.text(role, text)
        if now is not None and len(now.audit) > OPEN_ROWS:
            now.audit = ["".join(now.audit)]
    if now is not None:
        yield now.result()


class _Digest:
    def __init__(self, conv_id):
        self.conv_id, self.audit, self.cost, self.sha, self.any = conv_id, [], 0, hashlib.sha256(), False
        self.first_turn = self.last_turn = self.initial = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def seen(self, turn, role, fault) -> None:
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn
        if fault:
            self.faults[fault] += 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]

    def text(self, role, text) -> None:
        self.sha.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def result(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


# ---------------------------------------------------------------- operator

DIGEST = ("conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def ordered_with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault: a conversation's rows together in one partition and in order.

    A row's first fault counts: ``blank`` (white space only), ``duplicate`` (role and text seen earlier),
    ``truncated`` (the last sign that is no white space is none of ``.!?``); else null.
    """
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text")).repartition("conv_id")
    # the rows of a conversation are together already, so the window only sorts
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = (F.when(bare == "", "blank").when(F.col("nth") > 1, "duplicate")
             .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated"))
    marked = dealt.withColumn("nth", F.row_number().over(earlier))
    marked = marked.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "nth")
    return marked.select("conv_id", "turn", "role", "text", fault.alias("fault"))


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations, edit by edit (see ``EDITS``); rows with a role are the repaired ones.

    ``rows`` has conv_id, turn, role, text; other columns are not read.  Null roles and texts count as one
    blank.  Rows are taken by turn, null first; rows with one turn by role, then text.  Null is an id like
    any other.  Roles other than s..., u..., a... cannot be kept.  Repeated rows are duplicates; an empty
    table gives none.
    """
    text_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType

    def run(batches):
        for edits in _edits(batches):
            yield _batch(edits, schema)

    columns = EDITS.format(kind.simpleString())
    schema = _schema(rows.sparkSession, columns)
    return ordered_with_faults(rows).mapInArrow(run, columns)


def audit(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (as for ``repair``): faults, cost, the edits and a digest of the repair.

    gaps: turns missing between the first and last; illegal: neighbours whose role initials are not su, ua or
    au; repaired_sha256: of the repaired ``role:text``, joined by line feeds.
    """
    text_batches(rows.sparkSession)

    def run(batches):
        held = []
        for row in _digests(_edits(batches)):
            held.append(row)
            if len(held) >= OUT_ROWS:
                yield _batch(held, schema)
                held = []
        yield _batch(held, schema)

    columns = DIGEST.format(rows.schema["conv_id"].dataType.simpleString())
    schema = _schema(rows.sparkSession, columns)
    return ordered_with_faults(rows).mapInArrow(run, columns)


def _schema(spark, columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], columns).schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---------------------------------------------------------------- damage

def damaged(rows: DataFrame) -> DataFrame:
    """Faults put into conversations by crc32 of ``conv_id:turn`` (nulls: one blank), modulo 20.

    0 drops the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    cause = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    faulty = rows.select("conv_id", "turn", F.when(cause == 4, "user").otherwise(role).alias("role"),
                         F.when(cause == 1, "").when(cause == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
                         cause.alias("cause")).filter("cause != 0")
    times = F.when(F.col("cause") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return faulty.select("conv_id", "turn", "role", "text", F.explode(times).alias("copy")).drop("copy")


def damaged_and_audited(rows: DataFrame) -> DataFrame:
    """``audit`` of the damaged rows, with a row of zeros for conversations that lost all of theirs."""
    found = audit(damaged(rows)).withColumnRenamed("conv_id", "id")
    ids = rows.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    empty = hashlib.sha256().hexdigest()
    return out.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill(
        {"audit": "", "repaired_sha256": empty})
