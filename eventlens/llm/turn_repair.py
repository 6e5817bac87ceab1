"""Conversation structure repair: cheapest edits by a square-root checkpointed dynamic program.

A conversation is repaired when its role initials read ``(s?(ua)+)?``. Keeping a turn is free,
giving it another role costs 2, deleting it 3, inserting an empty user or assistant turn 2, and a
truncated turn that stays 1 more. Blank and duplicate turns must go. Of the cheapest edit lists
the one whose initials (D, I, K, R) are ASCII-least is taken.

The program has four states (nothing yet, after a system turn, after a user, after an assistant),
so what lies right of a row is a vector of four costs. Such *backward* vectors are stored at
checkpoints alone, and the rows between two checkpoints are solved again while walking forward:

* All rows are put in order (conversation, turn, role, text) by one range-partitioned sort and
  numbered. Of N rows, ceil(sqrt(N)) in a row are a *block* (at least ``LEAST_BLOCK``); a
  conversation's rows in a block are a *segment*, a string of one letter per row.
* Every segment gives, in parallel, a 4 x 4 matrix of least costs. One pass over a conversation's
  segments from the last to the first turns these into the checkpoint vectors.
* Every segment is then walked from each state it may begin in (only one if it comes first); one
  pass from the first segment to the last picks the walk that is meant. Within a segment the walk
  keeps vectors at each square root of its length and solves the stretches between again.

So a conversation that holds a third of all rows is many segments, and a task of it sees the
square root of the table's rows; only four costs or states per segment go one after the other.

Defined cases: null roles and texts are one space; null conversation ids are one conversation;
turns sort by (turn, nulls first, role, text); a role of another initial, or an empty one, can't be
kept; repeated rows are duplicates; extra columns are ignored; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import columns
from eventlens.operators.rows import global_positions
from eventlens.session import materialize

# Edit costs, role initials and the pairs of initials that may follow one another.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
INITIALS = "sua"
LEGAL_PAIRS = {"su", "ua", "au"}

#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What a user or assistant turn leads to.
TURN = (2, 2, 3, 2)
NEW_ROLE = "uuau"
#: Where keeping a turn of an initial leads; None: it can't be kept there.
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None,) * 4}
#: At the end: what is left to insert.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
FAR = 1 << 60
LEAST_BLOCK = 1024

#: One letter per row: 4 initials (s, u, a, other) for each of the faults none, truncated, blank, duplicate.
FAULTS = ("none", "truncated", "blank", "duplicate")
LETTERS = "ABCDEFGHIJKLMNOP"
INITIAL = {c: "suax"[i % 4] for i, c in enumerate(LETTERS)}
FAULT = {c: FAULTS[i // 4] for i, c in enumerate(LETTERS)}


def _moves(letter: str) -> tuple[tuple[tuple[int, str, int], ...], ...]:
    """For each state: (cost, edit, next state) of the edits that use up a row, in ASCII order."""
    keep, may = KEEP[INITIAL[letter]], FAULT[letter] in ("none", "truncated")
    extra = TRUNCATED if FAULT[letter] == "truncated" else 0
    return tuple(
        ((DELETE, "D", q), *(((extra, "K", keep[q]),) if may and keep[q] is not None else ()), *(((REROLE + extra, "R", TURN[q]),) if may else ()))
        for q in range(4)
    )


MOVES = {c: _moves(c) for c in LETTERS}


def back(letter: str, right: tuple[int, ...]) -> tuple[int, ...]:
    """The vector left of a row from the one right of it."""
    a, b, c, d = (min(cost + right[to] for cost, _, to in options) for options in MOVES[letter])
    c, d = min(c, d + INSERT), min(d, c + INSERT)
    return min(a, c + INSERT), min(b, c + INSERT), c, d


def back_all(letters: str, right: tuple[int, ...]) -> tuple[int, ...]:
    for letter in reversed(letters):
        right = back(letter, right)
    return right


def matrix(letters: str) -> list[int]:
    """Least cost from each state left of a segment to each state right of it, row by row."""
    by_end = [back_all(letters, tuple(0 if q == e else FAR for q in range(4))) for e in range(4)]
    return [by_end[e][q] for q in range(4) for e in range(4)]


def through(costs: list[int], right: tuple[int, ...]) -> tuple[int, ...]:
    """The vector left of a segment, by its matrix."""
    return tuple(min(costs[4 * q + e] + right[e] for e in range(4)) for q in range(4))


def walk(letters: str, right: tuple[int, ...], state: int) -> tuple[str, str, int]:
    """ASCII-least cheapest edits of a segment from a state: edits, new roles ('.' keeps, '-' none), state behind."""
    step = isqrt(len(letters)) + 1
    marks = [right]  # vectors at the ends of stretches, from the last
    for a in range((len(letters) - 1) // step * step, 0, -step):
        marks.append(back_all(letters[a : a + step], marks[-1]))
    edits, roles = [], []
    for a in range(0, len(letters), step):
        stretch = letters[a : a + step]
        vectors = [marks.pop()]
        for letter in reversed(stretch):
            vectors.append(back(letter, vectors[-1]))
        for letter in stretch:
            here = vectors.pop()
            while True:
                found = [(edit, to) for cost, edit, to in MOVES[letter][state] if cost + vectors[-1][to] == here[state]]
                if here[TURN[state]] + INSERT == here[state] and (not found or found[0][0] != "D"):
                    edits.append("I")
                    roles.append(NEW_ROLE[state])
                    state = TURN[state]
                    continue
                edit, to = found[0]
                edits.append(edit)
                roles.append("-" if edit == "D" else "." if edit == "K" else NEW_ROLE[state])
                state = to
                break
    return "".join(edits), "".join(roles), state


#: Most conversations are short and alike.
_short_matrix = lru_cache(1 << 15)(lambda letters: tuple(matrix(letters)))
_short_walk = lru_cache(1 << 15)(walk)


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL_PAIRS for i in range(len(initials) - 1))


def key_of(conv_id: str | Column) -> Column:
    """A string that tells conversations apart, null ids included."""
    c = F.col(conv_id) if isinstance(conv_id, str) else conv_id
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def ordered_turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, conv_id, turn, role, text, pos): rows in order, pos from 0 without gaps; written once."""
    rows = columns(convs, conv_id=conv, turn=turn, role=role, text=text).select(
        key_of("conv_id").alias("key"), "conv_id", "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    # the last column deals equal rows to several partitions
    placed = rows.withColumn("tie", F.monotonically_increasing_id())
    return global_positions(placed, ["key", F.asc_nulls_first("turn"), "role", "text", "tie"], "pos").drop("tie")


def segments(ordered: DataFrame, block: int) -> DataFrame:
    """(key, blk, letters): a segment's rows as letters, in order."""
    narrow = ordered.select(
        "key", "pos",
        F.when(F.left("role", F.lit(1)).isin(*INITIALS), F.instr(F.lit(INITIALS), F.left("role", F.lit(1))) - 1).otherwise(3).alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.sha2(F.concat_ws("\0", F.col("role"), F.col("text")), 256).alias("said"),
    )
    # a row is no duplicate if it is the first of its words; the first ones meet all rows by number, which no hot words skew
    first = narrow.where("not blank").groupBy("key", "said").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    told = narrow.drop("said").join(first, "pos", "left")
    fault = F.when(F.col("blank"), 2).when(F.col("is_first").isNull(), 3).when(F.col("cut"), 1).otherwise(0)
    letter = F.substring(F.lit(LETTERS), fault * 4 + F.col("initial") + 1, F.lit(1))
    coded = told.select("key", F.floor(F.col("pos") / block).cast("long").alias("blk"), F.struct("pos", letter.alias("letter")).alias("at"))
    letters = F.array_join(F.transform(F.sort_array(F.collect_list("at")), lambda x: x["letter"]), "")
    return coded.groupBy("key", "blk").agg(letters.alias("letters"))


MATRICES = "key string, blk long, costs array<long>, blank long, duplicate long, truncated long, illegal long, first string, last string"


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for letters in batch.column("letters").to_pylist():
            faults = [FAULT[c] for c in letters]
            initials = "".join(INITIAL[c] for c in letters)
            costs = list(_short_matrix(letters) if len(letters) <= 64 else matrix(letters))
            out.append((costs, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), _illegal(initials), initials[0], initials[-1]))
        names = ["costs", "blank", "duplicate", "truncated", "illegal", "first", "last"]
        lists = [list(x) for x in zip(*out)] if out else [[] for _ in names]
        kinds = [pa.list_(pa.int64()), *[pa.int64()] * 4, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("blk"), *[pa.array(x, k) for x, k in zip(lists, kinds)]], names=["key", "blk", *names]
        )


CHECKPOINTS = "key string, blk long, right array<long>, cost long, is_first boolean, is_last boolean, blank long, duplicate long, truncated long, illegal long"


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows by (key, blk from the last): the vector right of every segment. Sums come with the first segment."""
    held: dict | None = None  # the segment in hand is given out when the next one tells whether it comes first

    def given(rows: list[dict]) -> pa.RecordBatch:
        names = [x.split()[0] for x in CHECKPOINTS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if held is not None and held["key"] == row["key"]:
                out.append(held | {"is_first": False})
                right = held["left"]
                pair = row["last"] + held["first"]
                sums = {n: row[n] + held[n] for n in ("blank", "duplicate", "truncated")}
                sums["illegal"] = row["illegal"] + held["illegal"] + (pair not in LEGAL_PAIRS)
            else:
                if held is not None:
                    out.append(held | {"is_first": True})
                right, sums = END, {n: row[n] for n in ("blank", "duplicate", "truncated", "illegal")}
            left = through(row["costs"], right)
            held = row | sums | {"right": list(right), "left": left, "cost": left[0], "is_last": right is END}
        if out:
            yield given(out)
    if held is not None:
        yield given([held | {"is_first": True}])


WALKS = "key string, blk long, is_first boolean, edits array<string>, roles array<string>, ends array<int>"


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every segment walked from each state that it may begin in (a conversation begins in state 0)."""
    for batch in batches:
        found: list[list] = [[], [], []]
        for row in batch.select(["letters", "right", "is_first", "is_last"]).to_pylist():
            go = _short_walk if len(row["letters"]) <= 64 else walk
            walks = [go(row["letters"], tuple(row["right"]), q) for q in (range(1) if row["is_first"] else range(4))]
            tails = [TAIL[end] if row["is_last"] else "" for _, _, end in walks]
            found[0].append([e + t for (e, _, _), t in zip(walks, tails)])
            found[1].append([r + "ua"[2 - len(t) :] for (_, r, _), t in zip(walks, tails)])
            found[2].append([end for _, _, end in walks])
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in ("key", "blk", "is_first")]
            + [pa.array(x, pa.list_(k)) for x, k in zip(found, (pa.string(), pa.string(), pa.int32()))],
            names=["key", "blk", "is_first", "edits", "roles", "ends"],
        )


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows by (key, blk): the state that every segment begins in."""
    state = 0
    for batch in batches:
        out = []
        for first, ends in zip(batch.column("is_first").to_pylist(), batch.column("ends").to_pylist()):
            state = 0 if first else state
            out.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("blk"), pa.array(out, pa.int32())], names=["key", "blk", "state"])


@dataclass
class Repair:
    """What a repair finds; all tables go by ``key`` (``key_of`` the conversation id)."""

    faults: DataFrame  # key, gaps, blank, duplicate, truncated, illegal, cost: a row per conversation
    plan: DataFrame  # key, blk, edits, roles: a row per segment, edits in order
    turns: DataFrame  # key, blk, step, edit, role, text: the turns of the repaired conversations


TURNS = "key string, blk long, step long, edit string, role string, text string"
_ROLE = {"u": "user", "a": "assistant"}


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a segment's plan and then its rows in order: the repaired turns."""
    names = [x.split()[0] for x in TURNS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.large_string(), pa.large_string()]
    at, plan = 0, None

    def inserts(out: list) -> None:
        nonlocal at
        while at < len(plan["edits"]) and plan["edits"][at] == "I":
            out.append((plan["key"], plan["blk"], at, "I", _ROLE[plan["roles"][at]], ""))
            at += 1

    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            edits = batch.column("edits")[i].as_py()
            if edits is not None:
                plan = {n: batch.column(n)[i].as_py() for n in ("key", "blk", "edits", "roles")}
                at = 0
                inserts(out)
                continue
            edit, role = plan["edits"][at], plan["roles"][at]
            if edit != "D":
                kept = batch.column("role")[i].as_py() if edit == "K" else _ROLE[role]
                out.append((plan["key"], plan["blk"], at, edit, kept, batch.column("text")[i].as_py()))
            at += 1
            inserts(out)
        lists = [list(x) for x in zip(*out)] if out else [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds)], names=names)


def repair(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int | None = None) -> Repair:
    """Faults, cheapest edits and repaired turns of all conversations. ``block``: rows between checkpoints, by default the square root of all."""
    ordered = ordered_turns(convs, conv, turn, role, text)
    block = block or max(LEAST_BLOCK, isqrt(ordered.count()) + 1)
    cut = materialize(segments(ordered, block), "turn-segments")
    matrices = cut.mapInArrow(_matrices, MATRICES)
    last_first = matrices.repartition("key").sortWithinPartitions("key", F.desc("blk"))
    checked = materialize(last_first.mapInArrow(_checkpoints, CHECKPOINTS), "turn-checkpoints")
    walks = cut.join(checked.select("key", "blk", "right", "is_first", "is_last"), ["key", "blk"]).mapInArrow(_walks, WALKS)
    walks = materialize(walks, "turn-walks")
    in_order = walks.select("key", "blk", "is_first", "ends").repartition("key").sortWithinPartitions("key", "blk")
    starts = in_order.mapInArrow(_starts, "key string, blk long, state int")
    picked = lambda c: F.element_at(c, F.col("state") + 1).alias(c)
    plan = materialize(walks.join(starts, ["key", "blk"]).select("key", "blk", picked("edits"), picked("roles")), "turn-edits")
    turn_gaps = (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long")
    gaps = ordered.groupBy("key").agg(F.coalesce(turn_gaps, F.lit(0)).alias("gaps"))
    sums = checked.where("is_first").select("key", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = F.lit(None).cast("string")
    both = plan.select("key", "blk", F.lit(-1).cast("long").alias("pos"), "edits", "roles", nothing.alias("role"), nothing.alias("text")).unionByName(
        ordered.select("key", F.floor(F.col("pos") / block).cast("long").alias("blk"), "pos", nothing.alias("edits"), nothing.alias("roles"), "role", "text")
    )
    dealt = both.repartition("key", "blk").sortWithinPartitions("key", "blk", "pos")
    return Repair(gaps.join(sums, "key"), plan, dealt.mapInArrow(_applied, TURNS))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over turns by (key, blk, step): SHA-256 of ``role:text`` lines, a turn at a time."""
    key, digest = None, None

    def given(rows: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], names=["key", "repaired_sha256"])

    for batch in batches:
        out = []
        for name, role, text in zip(*(batch.column(n) for n in ("key", "role", "text"))):
            if digest is None or name.as_py() != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = name.as_py(), hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role.as_py()}:{text.as_py()}".encode())
        if out:
            yield given(out)
    if digest is not None:
        yield given([(key, digest.hexdigest())])


def damaged(convs: DataFrame) -> DataFrame:
    """The rows that the query repairs: some dropped, emptied, cut, repeated or of another role, by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    rows = columns(convs, conv_id="conv_id", turn="turn", role="role", text="text").withColumn("kind", F.crc32(name.cast("binary")) % 20).where("kind <> 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def audit(originals: DataFrame, found: Repair) -> DataFrame:
    """One row per conversation of ``originals``: its faults, the cost and initials of its edits and a digest of the repaired turns."""
    ids = columns(originals, conv_id="conv_id").distinct().withColumn("key", key_of("conv_id"))
    edits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("blk", "edits"))), lambda x: x["edits"]), "")
    audits = found.plan.groupBy("key").agg(edits.alias("audit"))
    lines = found.turns.select("key", "blk", "step", "role", "text").repartition("key").sortWithinPartitions("key", "blk", "step")
    digests = lines.mapInArrow(_digests, "key string, repaired_sha256 string")
    out = ids.join(found.faults, "key", "left").join(audits, "key", "left").join(digests, "key", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
