"""Conversation repair against an exhaustive search over all edit lists."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from eventlens.llm import turn_repair as tr

SPACE = " \t\n\v\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def slow(rows):
    """(faults, cost, audit, repaired) of rows (turn, role, text) by trying every edit list with at most two inserts in a row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, last, inserts):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for c in "ua":
                if (last, c) in NEXT:
                    cost, edits, out = best(i, c, inserts + 1)
                    options.append((2 + cost, "I" + edits, (("user" if c == "u" else "assistant") + ":", *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, edits, out = best(i + 1, last, 0)
            options.append((3 + cost, "D" + edits, out))
            if faults[i] in ("", "truncated"):
                extra = int(faults[i] == "truncated")
                for edit, name in (("K", role), ("R", "user"), ("R", "assistant")):
                    if name and (last, name[0]) in NEXT:
                        cost, edits, out = best(i + 1, name[0], 0)
                        options.append((cost + extra + 2 * (edit == "R"), edit + edits, (f"{name}:{text}", *out)))
        return min(options, default=(10**9, "", ()))

    cost, edits, out = best(0, "", 0)
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest()


def told(spark, convs, original=None, **kw):
    out = tr.audit(convs if original is None else original, tr.repair(convs, **kw)).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in out}


SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20_000)  # for the search over a conversation of some hundred turns
TEXTS = ["Hi.", "Hi.", "cut", " \t", "", "What?", "x! \n", "Ünï. ", "no\xa0end\xa0"]


def some(seed, convs, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    return [
        (c, rng.choice([None, *range(longest + 2)]), rng.choice(roles), rng.choice(TEXTS) + (str(i) + "." if rng.random() < 0.6 else ""))
        for c in range(convs) for i in range(rng.randint(1, longest))
    ]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_against_exhaustive_search(spark, block):
    rows = some(block, 120, 9)
    got = told(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), block=block)
    for c in {r[0] for r in rows}:
        assert got[c] == slow([r[1:] for r in rows if r[0] == c]), [r for r in rows if r[0] == c]


def test_one_conversation_over_many_blocks(spark):
    rows = [(1, t, r, x) for _, t, r, x in some(5, 60, 9)] + [(2, 0, "user", "Hello.")]
    got = told(spark, spark.createDataFrame(rows, SCHEMA).repartition(4), block=7)
    assert got[1] == slow([r[1:] for r in rows if r[0] == 1])
    assert got[2] == slow([(0, "user", "Hello.")])


def test_walk_with_checkpoints_equals_plain_program():
    rng = random.Random(0)
    for _ in range(300):
        letters = "".join(rng.choice(tr.LETTERS) for _ in range(rng.randint(1, 60)))
        left = tr.back_all(letters, tr.END)
        assert tr.through(tr.matrix(letters), tr.END) == left
        edits, roles, state = tr.walk(letters, tr.END, 0)
        done = "".join(tr.INITIAL[c] if r == "." else r for r, c in zip(roles, _rows(edits, letters)) if r != "-")
        done += "ua"[2 - len(tr.TAIL[state]) :]
        assert re.fullmatch("(s?(ua)+)?", done)
        cost = sum({"K": 0, "R": 2, "D": 3, "I": 2}[e] + (e in "KR" and tr.FAULT[c] == "truncated") for e, c in zip(edits, _rows(edits, letters)))
        assert cost + 2 * len(tr.TAIL[state]) == left[0]


def _rows(edits, letters):
    rest = iter(letters)
    return [" " if e == "I" else next(rest) for e in edits]


def test_damage_and_original_conversations(spark):
    rows = [(c, t, "assistant", f"A. b! c? {c} {t}") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    convs = spark.createDataFrame(rows, SCHEMA)
    want = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    hurt = tr.damaged(convs)
    assert sorted(map(str, map(tuple, hurt.collect()))) == sorted(map(str, want))
    got = told(spark, hurt, convs)
    assert set(got) == {r[0] for r in rows}
    for c in got:
        mine = [r[1:] for r in want if r[0] == c]
        assert got[c] == slow(mine)
    gone = told(spark, convs.where("conv_id = 3").limit(0), convs)
    assert gone[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repeats_clashing_columns_long_texts_and_empty_table(spark):
    long = "word " * 200_000 + "end."
    rows = [(1, 0, "user", long, "k", 1)] * 40 + [(1, 1, "assistant", "Yes.", "k", 1)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, pos int").repartition(3)
    assert told(spark, convs, block=4)[1] == slow([r[1:4] for r in rows])
    assert told(spark, convs.limit(0)) == {}
    found = tr.repair(convs, block=4)
    turns = sorted((r["blk"], r["step"], r["edit"], r["role"], len(r["text"])) for r in found.turns.collect())
    assert [t[2:] for t in turns] == [("K", "user", len(long)), ("K", "assistant", 4)]
