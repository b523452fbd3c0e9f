"""One ordered log of chapter edits: append, update, remove, interleaved.

An append takes the largest id *at that moment* plus one, a removal is refused when it would
leave the book empty *at that moment*, an update may hit a chapter appended earlier, and an id
may come back after its chapter is gone.  So the ids of a book are folded in log order, but only
what the order matters for: a book's fold sees its appends, its removals and the chapters that
removals name; of all other chapters it gets one row, their count and largest id.  Updates
and texts stay outside.  The fold streams its sorted rows and holds live named ids only.

What it gives are spans: id, born at, gone at.  Everything else is joins: the chapters that
live at the end, the last update inside a chapter's span, and whether an update hit anything.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, ship_code

APPEND, UPDATE, REMOVE = "append", "update", "remove"
APPLIED, REFUSED, MISSING = "applied", "refused", "missing"
#: Born before the log began.
BASE = -1

_FOLD = "book string, kind string, seq bigint, id bigint, born bigint, gone bigint, status string, nth bigint"
_REST, _NAMED, _EDIT = 0, 1, 2


@dataclass
class EditRun:
    chapters: DataFrame     # book_id, id, ordinal, content after the last edit
    outcomes: DataFrame     # one row per edit: book_id, seq, op, id, status


class _Book:
    """The live ids of one book that edits can reach, and what is known of the others."""

    def __init__(self, book):
        self.book, self.rest, self.top, self.appends = book, 0, 0, 0
        self.live: dict[int, tuple[int, int]] = {}      # id -> (chapters, born)
        self.heap: list[int] = []
        self.named = 0

    def add(self, id_: int, n: int, born: int) -> None:
        self.live[id_] = (n, born)
        self.named += n
        heapq.heappush(self.heap, -id_)

    def largest(self) -> int:
        while self.heap and -self.heap[0] not in self.live:
            heapq.heappop(self.heap)
        return max(self.top, -self.heap[0] if self.heap else 0)

    def edit(self, seq: int, op: str, id_: int | None):
        if op == APPEND:
            new = self.largest() + 1 if self.rest or self.live else 1
            self.add(new, 1, seq)
            self.appends += 1
            yield ("edit", seq, new, None, None, APPLIED, self.appends - 1)
        elif id_ not in self.live:
            yield ("edit", seq, id_, None, None, MISSING, None)
        elif self.rest + self.named == self.live[id_][0]:
            yield ("edit", seq, id_, None, None, REFUSED, None)
        else:
            n, born = self.live.pop(id_)
            self.named -= n
            yield ("edit", seq, id_, None, None, APPLIED, None)
            yield ("span", None, id_, born, seq, None, None)

    def close(self):
        for id_, (_, born) in self.live.items():
            yield ("span", None, id_, born, None, None, None)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _FOLD.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    book: _Book | None = None
    for b in batches:
        rows = []
        for key, part, seq, op, id_, n in zip(*(b.column(c).to_pylist() for c in ("book", "part", "seq", "op", "id", "n"))):
            if book is None or book.book != key:
                if book is not None:
                    rows += [(book.book, *r) for r in book.close()]
                book = _Book(key)
            if part == _REST:
                book.rest, book.top = n, id_ or 0
            elif part == _NAMED:
                book.add(id_, n, BASE)
            else:
                rows += [(key, *r) for r in book.edit(seq, op, id_)]
        if rows:
            yield batch(rows)
    if book is not None:
        rows = [(book.book, *r) for r in book.close()]
        if rows:
            yield batch(rows)


def apply_log(chapters: DataFrame, log: DataFrame) -> EditRun:
    """``chapters``: book_id, id, ordinal, content.  ``log``: book_id, seq (no two alike in a
    book), op, id (null for an append), content (of an update).

    A removal takes every chapter with its id, an update changes every one.  An append to a
    book without chapters makes chapter 1; appended chapters follow all others in order.  Rows
    with a null book, seq or id belong to nothing and are left out."""
    ship_code(chapters.sparkSession)
    kind = chapters.schema["book_id"].dataType
    book = F.col("book_id").cast("string").alias("book")
    log = log.where(F.col("book_id").isNotNull() & F.col("seq").isNotNull())
    slim = chapters.select(book, F.col("id").cast("bigint").alias("id"), "ordinal").where("book is not null and id is not null")
    edit = log.select(book, F.col("seq").cast("bigint").alias("seq"), "op", F.col("id").cast("bigint").alias("id"))
    edit = edit.where((F.col("op") == APPEND) | F.col("id").isNotNull())

    named = edit.where(F.col("op") == REMOVE).select("book", "id").distinct()
    per_id = slim.groupBy("book", "id").agg(F.count(F.lit(1)).alias("n"))
    have = per_id.join(named, ["book", "id"], "left_semi")
    rest = per_id.join(named, ["book", "id"], "left_anti")
    none = F.lit(None).cast("bigint").alias("seq")
    no_op = F.lit(None).cast("string").alias("op")
    rows = (rest.groupBy("book").agg(F.sum("n").alias("n"), F.max("id").alias("id"))
            .select("book", F.lit(_REST).alias("part"), none, no_op, "id", "n")
            .unionByName(have.select("book", F.lit(_NAMED).alias("part"), none, no_op, "id", "n"))
            .unionByName(edit.where(F.col("op") != UPDATE).select(
                "book", F.lit(_EDIT).alias("part"), "seq", "op", "id", F.lit(None).cast("bigint").alias("n"))))
    folded = materialize(rows.repartition("book").sortWithinPartitions("book", "part", "seq").mapInArrow(_fold, _FOLD))

    spans = folded.where("kind = 'span'").select("book", "id", "born", "gone")
    done = folded.where("kind = 'edit'")
    all_spans = spans.unionByName(rest.select("book", "id", F.lit(BASE).cast("bigint").alias("born"),
                                              F.lit(None).cast("bigint").alias("gone")))
    # Updates, without their texts: the one that counts, and whether each found a chapter.
    upd = edit.where(F.col("op") == UPDATE).select("book", "id", "seq")
    met = upd.join(all_spans, ["book", "id"], "left").where(
        F.col("born").isNull() | ((F.col("born") < F.col("seq")) & (F.col("gone").isNull() | (F.col("seq") < F.col("gone")))))
    hit = met.where(F.col("born").isNotNull())
    last = hit.where(F.col("gone").isNull()).groupBy("book", "id").agg(F.max("seq").alias("seq"))
    texts = log.where(F.col("op") == UPDATE).select(book, F.col("id").cast("bigint").alias("id"),
                                                    F.col("seq").cast("bigint").alias("seq"), F.col("content").alias("_new"))
    new = texts.join(last, ["book", "id", "seq"]).drop("seq")

    gone = spans.where((F.col("born") == BASE) & F.col("gone").isNotNull()).select("book", "id")
    stay = (chapters.select(book, F.col("id").cast("bigint").alias("id"), F.col("ordinal").cast("bigint").alias("ordinal"), "content")
            .join(gone, ["book", "id"], "left_anti"))
    top = slim.groupBy("book").agg(F.max("ordinal").cast("bigint").alias("top"))
    born = (spans.where((F.col("born") != BASE) & F.col("gone").isNull())
            .join(done.where("nth is not null").select("book", F.col("seq").alias("born"), "nth"), ["book", "born"])
            .join(top, "book", "left")
            .select("book", "id", (F.coalesce("top", F.lit(-1)) + 1 + F.col("nth")).alias("ordinal"), F.lit("").alias("content")))
    out = (stay.unionByName(born).join(new, ["book", "id"], "left")
           .select(F.col("book").cast(kind).alias("book_id"), "id", "ordinal", F.coalesce("_new", "content").alias("content")))

    struck = hit.select("book", "seq", F.lit(APPLIED).alias("status"))
    updates = upd.join(struck, ["book", "seq"], "left").select(
        "book", "seq", F.lit(UPDATE).alias("op"), "id", F.coalesce("status", F.lit(MISSING)).alias("status"))
    others = done.join(edit.select("book", "seq", "op"), ["book", "seq"]).select("book", "seq", "op", "id", "status")
    outcomes = others.unionByName(updates).select(F.col("book").cast(kind).alias("book_id"), "seq", "op", "id", "status")
    return EditRun(out, outcomes)
