"""Repair of conversation structure.

A conversation of ordinary size is one group: its turns meet in one task and are aligned
there (``alignment.align``).  One of more than ``PIECE`` turns or ``PIECE_BYTES`` of text, which
may hold any share of all rows, never does:

1. Its turns are range-sorted over all tasks and cut into pieces of ``PIECE`` turns at most.
2. A turn that occurred before is found by the least position per (role, text digest), a
   partial/final aggregate.
3. A piece is aligned from each grammar state to each.  ``FAN`` neighbouring pieces join their
   tables to one, level by level, until one is left; the states chosen there go back down
   the levels and pick each piece's audit.
4. The hash of the repaired text is serial by definition: one task per conversation streams
   its turns in order and holds one of them at a time.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scan import null_safe_join, running_sums
from . import alignment as A
from .common import land, partitions, small_batches

PIECE, PIECE_BYTES, FAN = 512, 32_000_000, 64
BLANK = re.compile(r"[\x20\x09-\x0D]*")
SPACE = "".join(map(chr, (0x20, *range(0x09, 0x0E))))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_TURN = "array<struct<present:boolean,turn:bigint,role:string,text:string>>"
_MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "conv_id bigint, " + ", ".join(f"{m} bigint" for m in _MEASURES) + ", audit string, repaired_sha256 string"


def turns_of(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, present): null role and text become one space."""
    small_batches(rows.sparkSession)
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))     # noqa: E731
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       one("role").alias("role"), one("text").alias("text"),
                       (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))


def damage(rows: DataFrame) -> DataFrame:
    """The test damage, by crc32 of ``conv_id:turn`` (a null is one space) modulo 20: 0 drops the
    turn (it stays as a row with present = false, so its conversation is still known), 1
    empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user."""
    t = turns_of(rows)
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))     # noqa: E731
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    t = t.withColumn("kind", kind)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (t.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))))
             .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                     text.alias("text"), (F.col("kind") != 0).alias("present")))


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def in_order(turns: list[tuple]) -> list[tuple]:
    """(turn, role, text) by turn, nulls first, then role, then the text's SHA-256."""
    ties = len({t[0] for t in turns}) < len(turns)
    return sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], _digest(t[2]) if ties else b""))


def faults_of(turns: list[tuple]) -> list[str]:
    """First fault per turn in order: b(lank), d(uplicate), t(runcated) or nothing."""
    seen, out = set(), []
    for _, role, text in turns:
        end = text.rstrip(SPACE)
        fault = "b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append(fault)
    return out


def illegal_pairs(letters: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))


def repair_one(turns: list[tuple]) -> dict:
    """The measures, audit and hash of one whole conversation (any order of turns)."""
    turns = in_order(turns)
    letters, faults = [t[1][:1] for t in turns], faults_of(turns)
    known = {t[0] for t in turns if t[0] is not None}
    cost, audit = A.align(letters, faults)
    kept = A.repaired_roles([t[1] for t in turns], letters, audit)
    text = "\n".join(f"{role}:{turns[i][2] if i >= 0 else ''}" for i, role in kept)
    return {"gaps": max(known) - min(known) + 1 - len(known) if known else 0,
            "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": illegal_pairs(letters), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}


def _repair_small(rows: DataFrame) -> DataFrame:
    """Conversations of bounded size, one group each."""
    fields = RESULT.replace(" bigint", "").replace(" string", "").split(", ")
    types = [pa.int64()] * (1 + len(_MEASURES)) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [{"conv_id": c, **repair_one([(t["turn"], t["role"], t["text"]) for t in ts if t["present"]])}
                   for c, ts in zip(b.column("conv_id").to_pylist(), b.column("turns").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([o[f] for o in out], t) for f, t in zip(fields, types)], names=fields)

    turns = F.collect_list(F.struct("present", "turn", "role", F.when(F.col("present"), F.col("text")).alias("text")))
    return rows.groupBy("conv_id").agg(turns.cast(_TURN).alias("turns")).mapInArrow(run, RESULT)


# -- conversations of any size ---------------------------------------------------------


def _ordered(rows: DataFrame) -> DataFrame:
    """Present turns with ``pos``, a position that grows along (conv_id, turn, role, digest).
    The row's number breaks ties between equal rows, so copies by the million still spread."""
    text = F.col("text")
    end = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    t = rows.where("present").select(
        "conv_id", "turn", "role", "text", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.substring("role", 1, 1).alias("letter"),
        F.when(end == "", "b").when(end.isin(".", "!", "?"), "").otherwise("t").alias("look"),
        F.monotonically_increasing_id().alias("row"))
    keys = ["conv_id", "turn", "role", "digest", "row"]
    n = partitions(rows.sparkSession)
    t = t.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return land(t.select("conv_id", "turn", "role", "text", "digest", "letter", "look",
                         F.monotonically_increasing_id().alias("pos")), "turns")


def _faults(t: DataFrame) -> DataFrame:
    """Slim rows (conv_id, pos, letter, fault)."""
    slim = t.select("conv_id", "pos", "role", "digest", "letter", "look")
    first = (slim.where("look <> 'b'").groupBy("conv_id", "role", "digest")
                 .agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    again = F.coalesce(F.col("pos") > F.col("first"), F.lit(False)) & (F.col("look") != "b")
    return null_safe_join(slim, first, ["conv_id", "role", "digest"], "left").select(
        "conv_id", "pos", "letter", F.when(again, "d").otherwise(F.col("look")).alias("fault"))


_PART = ("costs array<bigint>, places array<int>, first string, last string, illegal bigint")


def _pieces(slim: DataFrame, piece: int) -> DataFrame:
    """A row per piece: conv_id, node (its order), positions, letters, audits and its table."""
    node = F.shiftleft(F.shiftright("pos", 33), 33) + F.expr(f"(pos & {(1 << 33) - 1}) div {piece}")
    schema = f"conv_id bigint, node bigint, at array<bigint>, letters array<string>, audits array<string>, {_PART}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, node, turns in zip(*(b.column(k).to_pylist() for k in ("conv_id", "node", "turns"))):
                letters = [t["letter"] for t in turns]
                costs, audits, places = A.piece_table(letters, [t["fault"] for t in turns])
                out.append((c, node, [t["pos"] for t in turns], letters, audits, costs, places, letters[0], letters[-1],
                            illegal_pairs(letters)))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()),
                     pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int64()]
            names = ["conv_id", "node", "at", "letters", "audits", "costs", "places", "first", "last", "illegal"]
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    groups = slim.groupBy("conv_id", node.alias("node")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "letter", "fault"))).alias("turns"))
    return groups.mapInArrow(run, schema)


def _level_up(parts: DataFrame) -> DataFrame:
    """``FAN`` neighbours become one: conv_id, idx, paths and the joined table."""
    schema = f"conv_id bigint, idx bigint, paths array<string>, {_PART}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, idx, kids in zip(*(b.column(k).to_pylist() for k in ("conv_id", "idx", "kids"))):
                costs, places, paths = A.join_tables([(k["costs"], k["places"]) for k in kids])
                seam = sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(kids, kids[1:]))
                out.append((c, idx, paths, costs, places, kids[0]["first"], kids[-1]["last"],
                            seam + sum(k["illegal"] for k in kids)))
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.string(), pa.string(), pa.int64()]
            names = ["conv_id", "idx", "paths", "costs", "places", "first", "last", "illegal"]
            cols = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    kids = F.array_sort(F.collect_list(F.struct("idx", "costs", "places", "first", "last", "illegal")))
    return (parts.groupBy("conv_id", F.expr(f"idx div {FAN}").alias("up")).agg(kids.alias("kids"))
                 .select("conv_id", F.col("up").alias("idx"), "kids").mapInArrow(run, schema))


def _chosen(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with entry and exit state, whole conversations with cost and illegal pairs)."""
    most = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    ups, cur = [], pieces
    while most > 1 or not ups:
        cur = land(_level_up(cur), "joined")
        ups.append(cur)
        most = -(-most // FAN)
    # The end states that a conversation may have, by cost, then audit.
    by_end = [F.struct(F.col("costs")[q].alias("cost"), F.col("places")[q].alias("place"), F.lit(q).alias("q"))
              for q in (A.START, A.DONE)]
    whole = cur.select("conv_id", "illegal", F.least(*by_end).alias("end"))
    states = whole.select("conv_id", F.lit(0).cast("bigint").alias("idx"), F.lit(A.START).alias("p"), F.col("end.q").alias("q"))
    for up in reversed(ups):
        path = F.col("paths")[F.col("p") * A.STATES + F.col("q")]
        way = null_safe_join(up.select("conv_id", "idx", "paths"), states, ["conv_id", "idx"]).select(
            "conv_id", "idx", F.concat(F.col("p").cast("string"), path).alias("way"))
        step = way.select("conv_id", "idx", "way", F.explode(F.sequence(F.lit(1), F.length("way") - 1)).alias("k"))
        states = step.select("conv_id", (F.col("idx") * FAN + F.col("k") - 1).alias("idx"),
                             F.expr("cast(substring(way, k, 1) as int)").alias("p"),
                             F.expr("cast(substring(way, k + 1, 1) as int)").alias("q"))
    return null_safe_join(pieces, states, ["conv_id", "idx"]), whole.select("conv_id", "illegal", F.col("end.cost").alias("cost"))


def _steps(chosen: DataFrame) -> DataFrame:
    """(conv_id, pos, role): the turns that stay; ``role`` is null where it is kept."""
    schema = "conv_id bigint, pos bigint, role string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, pos, role = [], [], []
            for c, p, at, letters, audit in zip(*(b.column(k).to_pylist() for k in ("conv_id", "p", "at", "letters", "audit"))):
                for i, new in A.repaired_roles([None] * len(at), letters, audit, p):
                    assert i >= 0, "an insertion never pays"
                    conv.append(c)
                    pos.append(at[i])
                    role.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(pos, pa.int64()),
                                              pa.array(role, pa.string())], names=["conv_id", "pos", "role"])

    return chosen.select("conv_id", "p", "at", "letters", "audit").mapInArrow(run, schema)


def _hashes(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows (conv_id, pos, line) dealt and sorted by both; the
    stream holds one batch and one running hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c, h):
            return pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([h.hexdigest()])],
                                              names=["conv_id", "repaired_sha256"])
        current, h = (), None
        for b in batches:
            for c, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist()):
                if h is not None and c == current:
                    h.update(b"\n")
                else:
                    if h is not None:
                        yield out(current, h)
                    current, h = c, hashlib.sha256()
                h.update(line.encode("utf-8", "surrogatepass"))
        if h is not None:
            yield out(current, h)

    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.select("conv_id", "line").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def _repair_large(rows: DataFrame, piece: int) -> DataFrame:
    t = _ordered(rows)
    slim = land(_faults(t), "faults")
    pieces = _pieces(slim, piece)
    # Pieces are numbered per conversation, which may have very many of them.
    pieces = land(pieces, "pieces")
    placed = running_sums(pieces.select("conv_id", "node"), ["conv_id"], ["node"], {"idx": F.lit(1)})
    pieces = land(null_safe_join(pieces, placed, ["conv_id", "node"]), "placed")
    chosen, whole = _chosen(pieces) if pieces.limit(1).count() else (None, None)
    ids = rows.select("conv_id").distinct()
    zero = [F.lit(0).cast("bigint").alias(m) for m in _MEASURES]
    if chosen is None:
        return ids.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(EMPTY_SHA).alias("repaired_sha256"))
    chosen = land(chosen.withColumn("audit", F.col("audits")[F.col("p") * A.STATES + F.col("q")])
                        .select("conv_id", "idx", "p", "at", "letters", "audit"), "chosen")
    audits = chosen.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    kept = _steps(chosen).withColumnRenamed("role", "new")
    lines = null_safe_join(t.select("conv_id", "pos", "role", "text"), kept, ["conv_id", "pos"]).select(
        "conv_id", "pos", F.concat(F.coalesce("new", "role"), F.lit(":"), F.col("text")).alias("line"))
    by_fault = slim.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(m)
                                             for f, m in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    turn = t.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    out = ids
    for part in (by_fault, turn, whole, audits, _hashes(lines)):
        out = null_safe_join(out, part, ["conv_id"], "left")
    return out.select("conv_id", *[F.coalesce(m, F.lit(0)).cast("bigint").alias(m) for m in _MEASURES],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


def repair(rows: DataFrame, present: Column | None = None, piece: int = PIECE,
           piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    ``rows``: conv_id, turn, role, text.  A row for which ``present`` does not hold only names its
    conversation, and one without present turns gets zeros, an empty audit and the
    hash of nothing.  Turns are taken in order of turn, nulls first; equal ones by role, then
    by the SHA-256 of the text.  Null conv_id is a conversation of its own; null role or text
    is one space, so the turn is blank.  A role without any letter is never kept as it is.
    Further columns are not read, whatever their names; an empty table gives no rows."""
    rows = turns_of(rows, present)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    large = land(sizes.where((F.col("n") > piece) | (F.col("bytes") > piece_bytes)).select("conv_id"), "large")
    if not large.limit(1).count():
        return _repair_small(rows)
    return _repair_small(_meeting(rows, large, "left_anti")).unionByName(
        _repair_large(_meeting(rows, large, "left_semi"), piece))


def _meeting(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    ids = ids.withColumnRenamed("conv_id", "__id")
    return rows.join(ids, rows["conv_id"].eqNullSafe(ids["__id"]), how)
