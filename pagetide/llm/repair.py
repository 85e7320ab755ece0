"""Conversation structure repair by depth-first branch-and-bound.

A conversation shall read: an optional system turn, then pairs of a user and an assistant turn, or be empty. Each turn is
kept (K, cost 0), given the role user or assistant (R, 3) or deleted (D, 4; blank and repeated turns must be), and
empty turns of both roles may be inserted anywhere (I, 3). A truncated turn that is not deleted costs 3 more. The cheapest
edits win; of equally cheap ones those whose letters, in order, are first as text (the audit).

The search for one conversation keeps a stack of open prefixes (place, state, cost, audit) and goes down the most
promising one first. A prefix is cut off if its cost and a lower bound of what must follow exceed the best whole repair
found so far (the incumbent), or reach its cost with a later audit, or if the dominance table of its node (place and
state) holds a prefix that is no dearer and no later. When the stack is empty, the incumbent is proved. The bound adds what
every single turn costs at least and, over disjoint pairs of neighbours that cannot both stay as they are, what
setting one of them right costs at least.

Turns are ordered over the whole table, in ranges of about equal size. A conversation inside a range, of at most CHUNK
turns, is solved and reported where it lies. Others are cut into chunks. A chunk is solved between each pair of states at its ends
(at most 16 searches), which gives a matrix of costs and of the order of their audits. Such matrices combine
associatively, first inside a range, then over the ranges of a conversation; then the states at all cuts are known, each
chunk is edited between its own, and the pieces of a conversation are read in order as a stream, so that no task
holds a conversation.

Defined results: a null role or text is one space. Turns are taken by turn (nulls first), then role and text. Rows with a
null conv_id are one conversation. Equal rows are turns that repeat each other. A truncated turn does not end, white space
aside, with one of ".!?". A role that begins with s, u or a is taken for system, user or assistant. An
empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pagetide.llm import shared
from pagetide.session import stage

CHUNK = 64  # turns that are searched together
PIECE = 1 << 20  # characters of text after which a chunk ends early
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")
BEGIN, SYSTEM, USER, ASSISTANT = range(4)  # states: what the last turn is
END = 4  # a whole conversation
NEXT = (USER, USER, ASSISTANT, USER)  # role that may follow a state by an edit or an insertion
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
INITIAL = ("", "s", "u", "a")
BLANK, REPEATED, TRUNCATED, SOUND = "b", "r", "t", "k"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


# ---- the search

@functools.lru_cache(maxsize=50_000)
def search(turns: tuple[tuple[str, str, int], ...], entry: int, goal: int) -> tuple[int, str] | None:
    """The least (cost, audit) of edits that lead from a state over these turns to another, or None.

    A turn is its initial, its fault and how often it stands there. Insertions stand before a turn; at the END also
    behind the last one.
    """
    items = []  # (initial or None if it must go, cost to stay, letters of its deletion)
    for initial, fault, n in turns:
        if fault in (BLANK, REPEATED):
            items.append((None, 0, n))
        else:
            items.append((initial, 3 if fault == TRUNCATED else 0, 1))
            if n > 1:
                items.append((None, 0, n - 1))
    low = _bounds(items, goal)
    best: tuple[int, str] | None = None
    table: list[dict[int, tuple[int, str]]] = [{} for _ in range(len(items) + 1)]
    stack = [(0, entry, 0, "")]
    table[0][entry] = (0, "")
    while stack:
        place, state, cost, audit = stack.pop()
        if table[place].get(state) != (cost, audit):
            continue  # a better prefix has come to this node
        if best and _cut(cost + low(place, state), audit, best):
            continue
        if place == len(items) and (state == goal or goal == END and state in (BEGIN, ASSISTANT)):
            best = min(best or (cost, audit), (cost, audit))
            continue
        after = []
        if place < len(items) or goal == END:
            after.append((place, NEXT[state], cost + 3, audit + "I"))
        if place < len(items):
            initial, stay, n = items[place]
            after.append((place + 1, state, cost + 4 * n, audit + "D" * n))
            if initial is not None:
                after.append((place + 1, NEXT[state], cost + 3 + stay, audit + "R"))
                if (state, initial) in KEPT:
                    after.append((place + 1, KEPT[state, initial], cost + stay, audit + "K"))
        open_ = []
        for node in after:
            p, s, c, a = node
            if s in table[p] and table[p][s] <= (c, a):
                continue
            bound = c + low(p, s)
            if best and _cut(bound, a, best):
                continue
            table[p][s] = (c, a)
            open_.append((bound, a, node))
        stack += [node for _, _, node in sorted(open_, reverse=True)]
    return best


def _cut(bound: int, audit: str, best: tuple[int, str]) -> bool:
    """Whether no repair of this cost that begins with the audit is before the best one."""
    return bound > best[0] or bound == best[0] and audit > best[1][: len(audit)]


def _bounds(items: list[tuple[str | None, int, int]], goal: int):
    """The function of place and state that gives a lower bound of what is still to be paid."""
    n = len(items)
    single = [0] * (n + 1)  # every turn by itself
    slack = []  # what it costs more to change a turn than to leave it
    for initial, stay, copies in items:
        if initial is None:
            slack.append(None)
        elif initial in ("s", "u", "a"):
            slack.append(1 if stay else 3)  # truncated: deleted for 4 and not kept for 3
        else:
            slack.append(0)
    for i in range(n - 1, -1, -1):
        initial, stay, copies = items[i]
        least = 4 * copies if initial is None else stay if slack[i] else min(4, 3 + stay)
        single[i] = single[i + 1] + least
    left = [i for i in range(n) if slack[i] is not None]
    following = [0] * (n + 1)  # how many of `left` lie before a place
    for i in range(n):
        following[i + 1] = following[i] + (slack[i] is not None)

    def price(before: str, at: int) -> int:
        """Of the pair of an initial and the turn left[at], or the end."""
        if at == len(left):
            return 3 if goal == END and before in ("s", "u") else 0
        return 0 if before + items[left[at]][0] in LEGAL else min(3, slack[left[at]])

    pairs = [0] * (len(left) + 2)  # the dearest disjoint pairs from left[j] on
    for j in range(len(left) - 1, -1, -1):
        own = min(slack[left[j]], price(items[left[j]][0], j + 1))
        pairs[j] = max(pairs[j + 1], own + pairs[min(j + 2, len(left))])

    def low(place: int, state: int) -> int:
        j = following[place]
        first = price(INITIAL[state], j) if state != BEGIN else 0
        return single[place] + max(pairs[j], first + pairs[min(j + 1, len(left))])

    return low


# ---- chunks

Matrix = list[list[tuple[int, int] | None]]  # by state at the begin and at the end: cost, place of the audit in its row


def _ranked(rows: list[list[tuple[int, object] | None]]) -> Matrix:
    out = []
    for row in rows:
        order = {key: k for k, key in enumerate(sorted({x[1] for x in row if x}))}
        out.append([x and (x[0], order[x[1]]) for x in row])
    return out


def matrix(turns: tuple, first: bool, last: bool) -> Matrix:
    """What a chunk costs between its states; the state behind the last chunk is the END alone."""
    goals = [END] if last else range(4)
    return _ranked([[search(turns, s, t) for t in goals] if s == BEGIN or not first else [None] * len(goals) for s in range(4)])


def _through(a: Matrix, b: Matrix, s: int, t: int) -> tuple[int, tuple[int, int], int] | None:
    """Least cost from s to t, the places of both audits, and the state between."""
    ways = [(a[s][m][0] + b[m][t][0], (a[s][m][1], b[m][t][1]), m) for m in range(4) if a[s][m] and b[m][t]]
    return min(ways, default=None)


def product(a: Matrix, b: Matrix) -> Matrix:
    return _ranked([[(x := _through(a, b, s, t)) and x[:2] for t in range(len(b[0]))] for s in range(4)])


def path(matrices: list[Matrix], s: int, t: int) -> list[int]:
    """The states at the cuts of the best way from s to t."""
    sums = [matrices[0]]
    for m in matrices[1:]:
        sums.append(product(sums[-1], m))
    out = [t]
    for k in range(len(matrices) - 1, 0, -1):
        out.append(_through(sums[k - 1], matrices[k], s, out[-1])[2])
    return [s, *reversed(out)]


def _to_column(m: Matrix) -> list[int]:
    return [v for row in m for x in row for v in (x or (-1, -1))]


def _from_column(values: list[int]) -> Matrix:
    width = len(values) // 8
    cells = [(values[i], values[i + 1]) if values[i] >= 0 else None for i in range(0, len(values), 2)]
    return [cells[r * width : (r + 1) * width] for r in range(4)]


# ---- edits and reports

def edited(rows: list[tuple], audit: str, state: int) -> list[str]:
    """The turns, as role:text, that edits leave of rows (turn, role, text, n, fault)."""
    out, at = [], 0
    for _, role, text, n, _ in rows:
        while audit[at] == "I":
            state = NEXT[state]
            out.append(NAMES[state] + ":")
            at += 1
        letter = audit[at]
        if letter == "R":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:{text}")
        elif letter == "K":
            state = KEPT[state, role[:1]]
            out.append(f"{role}:{text}")
        at += n  # further copies are deleted
    for _ in audit[at:]:
        state = NEXT[state]
        out.append(NAMES[state] + ":")
    return out


class Report:
    """Counts, audit and hash of a conversation, from its pieces in order."""

    def __init__(self):
        self.counts = dict.fromkeys(COUNTS, 0)
        self.audit: list[str] = []
        self.hash, self.some = hashlib.sha256(), False
        self.turns, self.first_turn, self.last_turn, self.last = 0, None, None, None

    def add(self, rows: list[tuple], cost: int, audit: str, left: list[str]) -> None:
        counts = self.counts
        for turn, role, _, n, fault in rows:
            initial = role[:1]
            counts["illegal"] += n - 1 + (self.last is not None and self.last + initial not in LEGAL)
            self.last = initial
            if fault == BLANK:
                counts["blank"] += n
            else:
                counts["duplicate"] += n - (fault != REPEATED)
                counts["truncated"] += fault == TRUNCATED
            if turn is not None:
                self.turns += turn != self.last_turn
                self.first_turn = turn if self.first_turn is None else self.first_turn
                self.last_turn = turn
        counts["cost"] += cost
        self.audit.append(audit)
        for piece in left:
            self.hash.update(("\n" + piece if self.some else piece).encode("utf-8", "surrogatepass"))
            self.some = True

    def row(self) -> tuple:
        if self.first_turn is not None:
            self.counts["gaps"] = self.last_turn - self.first_turn + 1 - self.turns
        return *self.counts.values(), "".join(self.audit), self.hash.hexdigest()


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "turns array<long>, roles array<string>, texts array<string>, copies array<long>, faults array<string>"


def _kinds(rows: list[tuple]) -> tuple:
    return tuple((role[:1], fault, n) for _, role, _, n, fault in rows)


def ordered_turns(turns: DataFrame, copies: Column) -> DataFrame:
    """conv_id, c (its key), turn, role, text, n and fault: different turns once, in the order of the whole table."""
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("copies"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    rows = rows.withColumns({
        "c": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-")), "last": last,
        "same": F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)),
    })
    # a turn repeats another one if its role and text stand there with a smaller turn
    firsts = rows.filter("n > 0 AND last <> ''").groupBy("c", "same").agg(
        F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("unnumbered"), F.count("*").alias("places")
    ).filter("places > 1").drop("places")
    repeated = F.coalesce((F.col("turn") > F.col("least")) | (F.col("unnumbered") & F.col("turn").isNotNull()), F.lit(False))
    fault = F.when(F.col("last") == "", BLANK).when(repeated, REPEATED).when(F.col("last").isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    marked = rows.join(firsts, ["c", "same"], "left").select("conv_id", "c", "turn", "role", "text", "n", fault.alias("fault"))
    order = ["c", F.col("turn").asc_nulls_first(), "role", "text"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, list[tuple], int, bool]]:
    """conv_id, key, rows, number of the chunk, and whether the conversation ends here, of rows in order."""
    key, rows, number, size, conv = None, [], 0, 0, None
    for batch in shared.few_rows(batches):
        for conv_id, c, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if c != key:
                if key is not None:
                    yield conv, key, rows, number, True
                key, conv, rows, number, size = c, conv_id, [], 0, 0
            if len(rows) >= CHUNK or size > PIECE:
                yield conv, key, rows, number, False
                rows, number, size = [], number + 1, 0
            if row[3]:
                rows.append(tuple(row))
                size += len(row[2])
    if key is not None:
        yield conv, key, rows, number, True


def repair(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    `copies` says how often a row stands there, adjacently (default: once); a row with 0 is only there to name its conversation.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    report = [x.split()[0] for x in REPORT.split(", ")]
    parts = ["turns", "roles", "texts", "copies", "faults"]
    head = f"conv_id {kind}, c string, pid int, k long, whole boolean"

    def batch_of(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, schema.field(n).type) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Reports of the conversations that begin and end well inside this range, and the chunks of others."""
        pid, out, size = TaskContext.get().partitionId(), [], 0
        held, began = None, 0  # the first conversation may have begun, the last one may go on, in another range
        for found in _runs(batches):
            if held is not None:
                out.append(one(held, pid, began > 1))
                size += len(out[-1][-3] or ()) and sum(map(len, out[-1][-3]))
            began += held is None or held[1] != found[1]
            held = found
            if len(out) >= 1000 or size > PIECE:
                yield batch_of(out, names, schema)
                out, size = [], 0
        if held is not None:
            out.append(one(held, pid, False))
            yield batch_of(out, names, schema)

    def one(found, pid, inside):
        conv_id, c, rows, number, ends = found
        if inside and ends and not number:
            cost, audit = search(_kinds(rows), BEGIN, END)
            own = Report()
            own.add(rows, cost, audit, edited(rows, audit, BEGIN))
            return conv_id, c, pid, number, True, *own.row(), None, None, None, None, None
        return conv_id, c, pid, number, False, *[None] * len(report), *(map(list, zip(*rows, strict=True)) if rows else [[]] * 5)

    ordered = ordered_turns(turns, F.lit(1) if copies is None else copies)
    names = ["conv_id", "c", "pid", "k", "whole", *report, *parts]
    found_type = turns.sparkSession.createDataFrame([], f"{head}, {REPORT}, {ROWS}").schema
    schema = to_arrow_schema(found_type)
    found = stage(ordered.mapInArrow(solve, found_type), "repaired")
    return found.filter("whole").select("conv_id", *report).unionByName(_cut_up(found.filter("NOT whole"), kind, report, parts))


def _cut_up(chunks: DataFrame, kind: str, report: list[str], parts: list[str]) -> DataFrame:
    """Reports of the conversations that lie in several chunks (or at an end of a range)."""
    place = F.struct("pid", "k")
    ends = chunks.groupBy("c").agg(F.min(place).alias("lo"), F.max(place).alias("hi"))
    narrow = chunks.select("c", "pid", "k", F.transform("roles", lambda r: F.substring(r, 1, 1)).alias("initials"), "faults", "copies")
    narrow = narrow.join(ends, "c").select(
        "c", "pid", "k", "initials", "faults", "copies", (place == F.col("lo")).alias("first"), (place == F.col("hi")).alias("last")
    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.few_rows(batches):
            c, pid, k, *turns, first, last = (x.to_pylist() for x in batch.columns)
            out = [
                _to_column(matrix(tuple(zip(*x, strict=True)), a, b))
                for *x, a, b in zip(*turns, first, last, strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], ["c", "pid", "k", "m"])

    solved = stage(narrow.mapInArrow(matrices, "c string, pid int, k long, m array<long>"), "matrices")

    def in_order(group: pa.Table, by: str) -> tuple[list[int], list[Matrix]]:
        group = group.sort_by(by)
        return group.column(by).to_pylist(), [_from_column(x) for x in group.column("m").to_pylist()]

    def multiplied(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        _, found = in_order(group, "k")
        m = functools.reduce(product, found)
        return pa.table({"c": [key[0].as_py()], "pid": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([_to_column(m)], pa.list_(pa.int64()))})

    def between_ranges(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        pids, found = in_order(group, "pid")
        at = path(found, BEGIN, 0)  # the last matrix has the END alone
        return pa.table({"c": [key[0].as_py()] * len(pids), "pid": pa.array(pids, pa.int32()), "s": at[:-1], "t": at[1:]})

    def between_chunks(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        s, t = group.column("s")[0].as_py(), group.column("t")[0].as_py()
        ks, found = in_order(group, "k")
        at = path(found, s, t)
        goal = [*at[1:-1], END if len(found[-1][0]) == 1 else t]
        return pa.table({"c": [key[0].as_py()] * len(ks), "pid": pa.array([key[1].as_py()] * len(ks), pa.int32()), "k": ks, "s": at[:-1], "t": goal})

    by_range = solved.groupBy("c", "pid").applyInArrow(multiplied, "c string, pid int, m array<long>")
    states = by_range.groupBy("c").applyInArrow(between_ranges, "c string, pid int, s long, t long")
    cuts = solved.join(states, ["c", "pid"]).groupBy("c", "pid").applyInArrow(between_chunks, "c string, pid int, k long, s long, t long")
    tasks = chunks.join(cuts, ["c", "pid", "k"]).select("conv_id", "c", "pid", "k", "s", "t", *parts)
    tasks = tasks.repartition("c").sortWithinPartitions("c", "pid", "k")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations chunk by chunk, in order."""
        key, conv, own = None, None, None
        for batch in shared.few_rows(batches, 16):
            out = []
            for conv_id, c, _, _, s, t, *columns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != key:
                    if key is not None:
                        out.append((conv, *own.row()))
                    key, conv, own = c, conv_id, Report()
                rows = list(zip(*columns, strict=True))
                cost, audit = search(_kinds(rows), s, t)
                own.add(rows, cost, audit, edited(rows, audit, s))
            if out:
                yield of(out)
        if key is not None:
            yield of([(conv, *own.row())])

    schema = chunks.select("conv_id", *report).schema
    arrow = to_arrow_schema(schema)
    of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for f, x in zip(arrow, zip(*rows, strict=True), strict=True)], arrow.names)
    return tasks.mapInArrow(read, schema)


# ---- damage

def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The rows with faults, chosen by a checksum of conversation and turn, and how often each of them stands there.

    Of twenty rows about one each is dropped, emptied, robbed of its full stops, repeated, and given to the user.
    """
    some = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    rows = conversations.select(
        "conv_id", F.when(kind != 0, F.col("turn")).alias("turn"), F.when(kind == 0, "").when(kind == 4, "user").otherwise(some("role")).alias("role"),
        F.when(kind == 0, "").otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows, F.col("copies")


def _oracle() -> str:
    """A walk over the turns of each conversation with the best (cost, audit, text) of every state."""
    add = lambda state, cost, letter, piece=None: (
        f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': "
        + (f"coalesce({state}.t || chr(10), '') || {piece}" if piece else f"{state}.t") + "} END"
    )
    best = lambda *ways: f"list_min([{', '.join(ways)}])"
    user = best("s2", *(add(s, 3, "I", "'user:'") for s in ("s0", "s1", "s3")))
    assistant = best("s3", add("i2", 3, "I", "'assistant:'"))
    stay, go = "(CASE WHEN fault = 't' THEN 3 ELSE 0 END)", "fault IN ('b', 'r')"
    may = lambda test, way: f"CASE WHEN NOT ({go}) AND {test} THEN {way} END"
    kept, rerole = "role || ':' || text", lambda r: f"'{r}:' || text"
    to_user = [w for s in ("s0", "s1", "i3") for w in (
        may("starts_with(role, 'u')", add(s, stay, "K", kept)), may("TRUE", add(s, f"3 + {stay}", "R", rerole("user"))))]
    to_assistant = [may("starts_with(role, 'a')", add("i2", stay, "K", kept)), may("TRUE", add("i2", f"3 + {stay}", "R", rerole("assistant")))]
    step = ", ".join((
        add("s0", 4, "D") + " AS s0", best(add("s1", 4, "D"), may("starts_with(role, 's')", add("s0", stay, "K", kept))) + " AS s1",
        best(add("i2", 4, "D"), *to_user) + " AS s2", best(add("i3", 4, "D"), *to_assistant) + " AS s3",
    ))
    blank = "[\\x20\\x09-\\x0D]"
    empty = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(
    list_transform(range(1, length(key) + 1), lambda i: CAST(unicode(substr(key, i, 1)) AS BIGINT)),
    lambda crc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CAST(3988292384 AS BIGINT) * (x & 1)) + z, xor(crc, b)),
    CAST(4294967295 AS BIGINT))) % 20 AS kind
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)
),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM hurt),
judged AS (
  SELECT conv_id, turn, role, text, k, CASE WHEN regexp_full_match(text, '{blank}*') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'r'
      WHEN NOT regexp_matches(text, '[.!?]{blank}*$') THEN 't' ELSE 'k' END AS fault,
    coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), FALSE) AS illegal
  FROM numbered
),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST({{'c': 0, 'a': '', 't': NULL}} AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS s0,
    {empty} AS s1, {empty} AS s2, {empty} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k, {step} FROM (
    SELECT *, {assistant} AS i3 FROM (
      SELECT w.conv_id, j.k, role, text, fault, s0, s1, s2, s3, {user} AS i2
      FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.k = w.k + 1))
),
done AS (
  SELECT conv_id, {best("s0", "i3")} AS o FROM (
    SELECT *, {assistant} AS i3 FROM (SELECT *, {user} AS i2 FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1))
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'r') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, o.c AS cost, o.a AS audit, sha256(coalesce(o.t, '')) AS repaired_sha256
FROM done d LEFT JOIN counted c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE = _oracle()
