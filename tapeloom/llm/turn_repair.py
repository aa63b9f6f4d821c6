"""Repair of damaged conversations by a checkpointed dynamic programme."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import SPACES, cut, join_counted, map_arrow, only, remove, scratch_path

#: Rows of a conversation that one task repairs at once are those of an aligned run of this many places in the sorted table.
RUN = 4096
#: Characters of a repaired conversation that leave a task as one piece.
PIECE = 1 << 20
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: States of a conversation by what it ends with: nothing yet, system, user, assistant. NEXT[state] has the initials that may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What insertion or a new role puts after each state, and the state then.
TURN = tuple(next((i, s) for i, s in reversed(list(x.items())) if i != "s") for x in NEXT)
ROLE = {"u": "user", "a": "assistant"}
FAR = 1 << 60
#: One character a row: the place of its initial (x: another) in `suax` times four, and the place of its fault.
FAULTS = ("", "truncated", "blank", "duplicate")
CODES = {chr(65 + 4 * k + f): (initial, FAULTS[f]) for k, initial in enumerate("suax") for f in range(4)}


def settled(costs: list[int]) -> tuple[int, ...]:
    """The cheapest way on from each state if turns may be inserted first."""
    while True:
        new = [min(c, INSERT + costs[TURN[s][1]]) for s, c in enumerate(costs)]
        if new == costs:
            return tuple(min(c, FAR) for c in costs)
        costs = new


END = settled([0, FAR, FAR, 0])


def choices(code: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, its cost, state after) of all edits that take this row, in ASCII order of edits."""
    initial, fault = CODES[code]
    found = [("D", DELETE, state)]
    if fault in ("blank", "duplicate"):
        return found
    extra = UNFINISHED if fault == "truncated" else 0
    if initial in NEXT[state]:
        found.append(("K", extra, NEXT[state][initial]))
    return [*found, ("R", REROLE + extra, TURN[state][1])]


class Backward:
    """Cost vectors before each row, as they follow from what is behind the rows; few differ but by a constant."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}

    def step(self, code: str, behind: tuple[int, ...]) -> tuple[int, ...]:
        least = min(behind)
        shape = tuple(FAR if c >= FAR else c - least for c in behind)
        found = self.known.get((code, shape))
        if found is None:
            found = settled([min(cost + shape[after] for _, cost, after in choices(code, s)) for s in range(4)])
            self.known[code, shape] = found
        return tuple(FAR if c >= FAR else c + least for c in found)

    def before(self, codes: str, behind: tuple[int, ...]) -> tuple[int, ...]:
        for code in reversed(codes):
            behind = self.step(code, behind)
        return behind

    def walk(self, codes: str, behind: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
        """The least of the cheapest edits of these rows from ``state`` on, and the state after them.

        Vectors are kept at each square root of the rows alone; those between two are made again while the walk passes there.
        After the last row of a conversation turns are inserted until it may end.
        """
        step = isqrt(len(codes)) + 1
        kept = {len(codes): behind}
        for begin in reversed(range(0, len(codes), step)):
            end = min(begin + step, len(codes))
            kept[begin] = self.before(codes[begin:end], kept[end])
        audit = []
        for begin in range(0, len(codes), step):
            end = min(begin + step, len(codes))
            vectors = [kept[end]]
            for code in reversed(codes[begin:end]):
                vectors.append(self.step(code, vectors[-1]))
            for code, here, after in zip(codes[begin:end], vectors[:0:-1], vectors[-2::-1], strict=True):
                while True:
                    take = choices(code, state)
                    options = [*take[:1], ("I", INSERT, TURN[state][1]), *take[1:]]
                    edit, state = next(
                        (e, to) for e, cost, to in options if cost + (here if e == "I" else after)[to] == here[state]
                    )
                    audit.append(edit)
                    if edit != "I":
                        break
        while last and state not in (START, ASSISTANT):
            audit.append("I")
            state = TURN[state][1]
        return "".join(audit), state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text after the damage that a crc32 of conv_id and turn chooses; null roles and texts are one space."""
    c = only(conversations, "conv_id", "turn", "role", "text")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, space = F.crc32(name) % 20, F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    rows = c.select(named(F.col("conv_id")), "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def named(conv_id: Column) -> Column:
    """Never null: the id behind `=`, or `-`."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-")).alias("conv")


def ordered(rows: DataFrame, path: str) -> DataFrame:
    """The rows with ``at``, a number that ascends in the order of conversation, turn (null first) and ``mark``, and with ``run``.

    ``mark`` is a hash of role and text. Ranges split a conversation that holds most rows, and ``tie`` splits equal rows. The
    table is stored, and places are those in it; a run holds the rows of an aligned range of RUN places.
    """
    mark = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumns({"mark": mark, "tie": F.monotonically_increasing_id()})
    by = ["conv", F.col("turn").asc_nulls_first(), "mark"]
    ranges = rows.repartitionByRange(max(1, rows.rdd.getNumPartitions()), *by, "tie").sortWithinPartitions(*by)
    ranges.withColumn("at", F.monotonically_increasing_id()).drop("tie").write.parquet(path)
    return rows.sparkSession.read.parquet(path).withColumn("run", F.col("at") - F.pmod("at", F.lit(RUN)))


def coded(rows: DataFrame) -> DataFrame:
    """conv, run, at and code of each row: its initial and its first fault in one character."""
    stripped, first = F.rtrim("text", F.lit(SPACES)), F.substring("role", 1, 1)
    fault = F.when(stripped == "", 2).when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    slim = rows.select("conv", "run", "at", "mark", initial.alias("initial"), fault.alias("fault"))
    firsts = rows.groupBy("conv", "mark").agg(F.min("at").alias("earliest"), F.count("*").alias("n")).where("n > 1")
    again = join_counted(rows.select("conv", "mark", "at"), firsts, ["conv", "mark"]).where("at > earliest").select("at", F.lit(3).alias("again"))
    fault = F.when(F.col("fault") == 2, 2).otherwise(F.coalesce("again", "fault"))
    return slim.join(again, "at", "left").select("conv", "run", "at", F.char(65 + 4 * F.col("initial") + fault).alias("code"))


def _batches(schema: str, make):
    """A task for mapInArrow() that gives make(row) for each row, row by row."""
    arrow = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in schema.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Backward()
        for b in batches:
            found = [x for r in b.to_pylist() for x in make(back, r)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), arrow.types, strict=True)], schema=arrow)

    return task


_TYPES = {
    "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}
VECTORS = "conv string, run long, codes string, vectors array<long>"
BEHIND = "conv string, run long, codes string, before string, behind array<long>, cost long, first boolean, last boolean"
WALKS = "conv string, run long, cost long, audits array<string>, ends array<int>, first boolean, last boolean, blank long, duplicate long, truncated long, illegal long"
ENTRIES = "conv string, run long, state int"


def _vectors(back: Backward, r: dict) -> Iterator[tuple]:
    """What a run costs from each state to each state: the vector before it for each state behind it alone."""
    units = [tuple(0 if s == e else FAR for s in range(4)) for e in range(4)]
    yield r["conv"], r["run"], r["codes"], [c for unit in units for c in back.before(r["codes"], unit)]


def _behind(back: Backward, r: dict) -> Iterator[tuple]:
    """The vector behind each run of a conversation, chained from its last run to its first."""
    behind, chained = END, []
    for x in reversed(r["runs"]):
        chained.append(behind)
        behind = tuple(min(FAR, min(x["vectors"][4 * e + s] + behind[e] for e in range(4))) for s in range(4))
    before = ""
    for k, (x, v) in enumerate(zip(r["runs"], reversed(chained), strict=True)):
        yield r["conv"], x["run"], x["codes"], before, v, behind[START], k == 0, k == len(chained) - 1
        before = x["codes"][-1]


def _walks(back: Backward, r: dict) -> Iterator[tuple]:
    """A run's edits from each state that it may begin in (a conversation's first from START alone), and counts of its faults."""
    codes, behind = r["codes"], tuple(r["behind"])
    begin = back.before(codes, behind)
    found = [back.walk(codes, behind, s, r["last"]) if begin[s] < FAR and (s == START or not r["first"]) else ("", -1) for s in range(4)]
    faults = [CODES[c][1] for c in codes]
    initials = "".join(CODES[c][0] for c in r["before"] + codes)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    yield r["conv"], r["run"], r["cost"], [a for a, _ in found], [e for _, e in found], r["first"], r["last"], *counts, illegal


def _entries(back: Backward, r: dict) -> Iterator[tuple]:
    """The state in which each run of a conversation begins."""
    state = START
    for x in r["runs"]:
        yield r["conv"], x["run"], state
        state = x["ends"][state]


def per_conversation(rows: DataFrame, *values: str) -> DataFrame:
    """conv and its runs in order; a run stands for up to RUN rows."""
    return rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("run", *values))).alias("runs"))


PIECES = "conv string, run long, number long, piece binary, sha256 string"


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired text of runs that come as one row with the edits and then their rows in order.

    A conversation that is one run alone is hashed at once, others leave as numbered pieces.
    """
    arrow = pa.schema([(f.split()[0], _TYPES[f.split()[1]]) for f in PIECES.split(", ")])
    out, size = [], 0
    run = None

    def turn(role: str, text: str) -> None:
        run["held"].append((b"\n" if run["begun"] else b"") + f"{role}:{text}".encode())
        run["begun"], run["size"] = True, run["size"] + len(text) + len(role)

    def edits() -> str | None:
        """Writes inserted turns, and gives the edit of the next row."""
        while run["at"] < len(run["audit"]):
            edit = run["audit"][run["at"]]
            run["at"] += 1
            if edit != "I":
                return edit
            letter, run["state"] = TURN[run["state"]]
            turn(ROLE[letter], "")
        return None

    def leave(whole: bool) -> None:
        data = b"".join(run["held"])
        if run["alone"]:
            run["sha"].update(data)
            if whole:
                out.append((run["conv"], run["run"], 0, None, run["sha"].hexdigest()))
        elif data:
            out.append((run["conv"], run["run"], run["number"], data, None))
        run["number"], run["held"], run["size"] = run["number"] + 1, [], 0

    def finish() -> None:
        if run:
            edits()
            leave(True)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    for b in batches:
        for r in b.to_pylist():
            if r["audit"] is not None:
                finish()
                run = {"conv": r["conv"], "run": r["run"], "audit": r["audit"], "state": r["state"], "alone": r["alone"], "begun": r["state"] != START}
                run |= {"at": 0, "number": 0, "held": [], "size": 0, "sha": hashlib.sha256()}
            else:
                edit = edits()
                if edit == "K":
                    run["state"] = NEXT[run["state"]][r["role"][0]]
                    turn(r["role"], r["text"])
                elif edit == "R":
                    letter, run["state"] = TURN[run["state"]]
                    turn(ROLE[letter], r["text"])
                if run["size"] > PIECE:
                    size += run["size"]
                    leave(False)
            if len(out) > 10_000 or size > 4 * PIECE:
                yield batch()
                out.clear()
                size = 0
    finish()
    if out:
        yield batch()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv and the hash of its pieces, which come in order."""
    conv, sha, found = None, None, []
    for b in batches:
        for name, piece in zip(b.column("conv").to_pylist(), b.column("piece"), strict=True):
            if name != conv:
                if sha:
                    found.append((conv, sha.hexdigest()))
                conv, sha = name, hashlib.sha256()
            sha.update(piece.as_buffer())
    if sha:
        found.append((conv, sha.hexdigest()))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)], ["conv", "sha256"])


def hashes(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv and sha256 of its repaired turns. Texts go to the task of their run, up to RUN rows of a conversation.

    Pieces of conversations of many runs meet once more, in order, since a hash has no other way; they pass through as a stream.
    """
    first = edits.select("conv", "run", F.lit(-1).cast("long").alias("at"), "audit", "state", "alone", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    every = first.unionByName(rows.select("conv", "run", "at", "role", "text"), allowMissingColumns=True)
    dealt = every.repartition("conv", "run").sortWithinPartitions("conv", "run", "at")
    made = cut(map_arrow(dealt, _rewrite, PIECES))
    parts = made.where("sha256 IS NULL").select("conv", "run", "number", "piece").repartition("conv").sortWithinPartitions("conv", "run", "number")
    return made.where("sha256 IS NOT NULL").select("conv", "sha256").unionByName(map_arrow(parts, _hash, "conv string, sha256 string"))


def repaired(conversations: DataFrame) -> DataFrame:
    """What damaged() leaves of each conversation, its faults, and the cheapest repair: one row for each conv_id of ``conversations``.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows are taken by turn, null first; rows of one turn
    by a hash of role and text. Rows without conv_id are one conversation. Null roles and texts are one space, so such a text is blank and such a role
    can't be kept, nor can an empty one. A conversation that lost all rows has zeros, an empty audit and the hash of nothing; so has
    an empty table no rows. Other columns are ignored.

    Rows become characters, and runs of at most RUN of them strings. Cost vectors before and behind a run are checkpoints of the
    backward pass, chained per conversation; inside a run only the vectors at square roots are kept and the others made again while walking forward.
    So no task holds a conversation's rows. Of a conversation of many runs, one task sees a vector and a state for each run,
    another concatenates the audit, which is one value, and one hashes the repaired text as it passes by.
    """
    spark = conversations.sparkSession
    path = scratch_path(spark, "turns")
    rows = ordered(damaged(conversations), path)
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    spans = coded(rows).groupBy("conv", "run").agg(codes.alias("codes"))
    vectors = map_arrow(spans, _batches(VECTORS, _vectors), VECTORS)
    behind = map_arrow(per_conversation(vectors, "codes", "vectors"), _batches(BEHIND, _behind), BEHIND)
    # runs of one conversation are dealt anew, or one task would walk them all
    walks = cut(map_arrow(behind.repartition("conv", "run"), _batches(WALKS, _walks), WALKS))
    entries = map_arrow(per_conversation(walks, "ends"), _batches(ENTRIES, _entries), ENTRIES)
    edits = walks.join(entries, ["conv", "run"]).withColumn("audit", F.get("audits", F.col("state")))
    edits = cut(edits.withColumn("alone", F.col("first") & F.col("last")).drop("audits", "ends", "first", "last"))
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "audit"))), lambda x: x["audit"]), "")
    found = edits.groupBy("conv").agg(*counts, F.max("cost").alias("cost"), audit.alias("audit"))
    turns = rows.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    every = only(conversations, "conv_id").select("conv_id", named(F.col("conv_id"))).distinct()
    out = every.join(gaps, "conv", "left").join(found, "conv", "left").join(hashes(rows, edits), "conv", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    out = cut(out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256")))
    remove(spark, path)
    return out
