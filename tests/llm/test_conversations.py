import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import alignment, conversations

from .data import CLASHING

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}


def cheapest(letters, faults):
    """(cost, audit) by a search over all edits in order of (cost, audit)."""
    heap, seen, n = [(0, "", 0, 0)], set(), len(letters)
    while heap:
        c, a, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        if i == n and s in (0, 3):
            return c, a
        seen.add((i, s))
        steps = [(5, "I", i, t) for x, t in NEXT[s] if x != "s"]
        if i < n:
            steps.append((2, "D", i + 1, s))
            if faults[i] not in ("b", "d"):
                more = 5 if faults[i] == "t" else 0
                steps += [(more, "K", i + 1, t) for x, t in NEXT[s] if x == letters[i]]
                steps += [(more + 1, "R", i + 1, t) for x, t in NEXT[s] if x != "s"]
        for cost, letter, j, t in steps:
            heapq.heappush(heap, (c + cost, a + letter, j, t))


def brute(rows):
    """Damage and repair, row by row."""
    per = {}
    for c, turn, role, text in rows:
        per.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        per[c] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for c, turns in per.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        letters = [t[1][:1] for t in turns]
        cost, audit = cheapest(letters, faults)
        lines, i, state = [], 0, 0
        for step in audit:
            if step == "D":
                i += 1
                continue
            letter = letters[i] if step == "K" else "a" if state == 2 else "u"
            role = turns[i][1] if step == "K" else {"u": "user", "a": "assistant"}[letter]
            lines.append(f"{role}:{'' if step == 'I' else turns[i][2]}")
            state = dict(NEXT[state])[letter]
            i += step != "I"
        known = {t[0] for t in turns if t[0] is not None}
        out.append((c, max(known) - min(known) + 1 - len(known) if known else 0, faults.count("b"), faults.count("d"),
                    faults.count("t"), sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n_conv=60, longest=14):
    rnd, rows = random.Random(seed), []
    for c in range(n_conv):
        for t in range(rnd.randrange(1, longest)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "Why?", "and then", "", " \t", None, f"Number {rnd.random()}. ", "é ü.\n"])
            rows.append((c, rnd.choice([t, t, t, 2 * t, None]), role, text))
    return rows


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def repaired(df, **options):
    return found(conversations.repair(conversations.damage(df), present=F.col("present"), **options))


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_equal_brute_force(spark, seed):
    rows = rows_of(seed)
    assert repaired(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_long_conversations_in_pieces_equal_brute_force(spark):
    """Pieces of four turns, so most conversations take the way of the large ones; one of 300
    turns needs two levels of joins."""
    rnd = random.Random(5)
    rows = rows_of(3, 30) + [(10**6, t, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", "cut", f"{t}."]))
                             for t in range(300)]
    rows += [(10**7, None, "user", "again and again.")] * 40 + [(None, 1, None, None)] * 9 + [(None, 2, "user", "x.")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert repaired(df, piece=4) == want
    assert repaired(df) == want


def test_long_texts_take_the_way_of_the_large(spark):
    rows = [(1, 0, "user", "word " * 300_000 + "."), (1, 1, "assistant", "ok."), (1, 2, "user", " " * 1_000_000),
            (1, 3, "assistant", "word " * 300_000), (2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert repaired(df, piece_bytes=1_000_000) == brute(rows) == repaired(df)


def test_edges_and_clashing_columns(spark):
    df = spark.createDataFrame(rows_of(4, 20), SCHEMA)
    more = df.withColumns({c: F.lit("clash") for c in [*CLASHING, "present", "pos", "letter", "audit", "cost", "idx"]})
    plain = found(conversations.repair(df))
    assert found(conversations.repair(more)) == plain == found(conversations.repair(more, piece=3))
    assert conversations.repair(df.limit(0)).collect() == []
    gone = conversations.repair(df.where("conv_id < 3"), present=F.lit(False))
    zero = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert found(gone) == [(c, *zero) for c in range(3)]
    assert found(conversations.repair(df.where("conv_id < 3"), present=F.lit(False), piece=0)) == found(gone)


def test_alignment_and_pieces_equal_a_search(spark):
    rnd = random.Random(11)
    for _ in range(1500):
        n = rnd.randrange(0, 12)
        letters = [rnd.choice("suuaax") for _ in range(n)]
        faults = [rnd.choice(["", "", "", "", "t", "b", "d"]) for _ in range(n)]
        want = cheapest(letters, faults)
        assert alignment.align(letters, faults) == want
        cut = rnd.randrange(0, n + 1)
        parts = [alignment.piece_table(letters[a:b], faults[a:b]) for a, b in ((0, cut), (cut, n))]
        costs, places, paths = alignment.join_tables([(p[0], p[2]) for p in parts])
        q = min((alignment.START, alignment.DONE), key=lambda k: (costs[k], places[k]))
        mid, end = map(int, paths[q])
        assert (costs[q], parts[0][1][mid] + parts[1][1][mid * 4 + end]) == want
