"""Best-fit packing of token pieces into sequences of fixed length.

Lengths are integers up to ``seq_len``, so documents and gaps sorted by length fall into at
most ``seq_len`` runs of equal length each, however many rows there are.  The supersteps
work on runs:

1. Documents are range-sorted by length: one aggregate gives the runs, and a row's rank in
   its run is its partition's offset plus its place in the partition, so no run is ever
   gathered in one task.
2. A sweep goes through the document runs from the longest down.  Each run is matched with
   its successor, the smallest gap that holds it; members of the run compete for the gaps
   of that run by rank, losers go on to the next larger gap, and those without any gap open
   new sequences.  Matched gaps shrink and join the gap run of their new length before the
   next step.
3. The placements, ranges of ranks against ranges of sequences, return to the rows by a
   join on length and rank.

There are at most ``seq_len`` document runs.  A length leaves at most two gap runs more than
it found (a placement that uses a gap run up replaces it by one; only the last may split one,
and new sequences make two), so there are at most ``2 * seq_len`` gap runs and ``seq_len ** 2``
placements: bounds set by the sequence length and not by the corpus, which is why the sweep
itself is done in one place, on the driver, and not as distributed sweeps.
"""
from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import tokenizer
from .common import documents, land
from .token_count import byte_groups

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint, part int, place bigint"
PLACEMENT = "length int, first bigint, n bigint, per_sequence int, sequence bigint, offset int"


def cut(n: int, seq_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: full pieces of
    ``seq_len``, the rest comes first."""
    if n <= seq_len:
        return [(0, n)]
    rest = n % seq_len
    return ([(0, rest)] if rest else []) + [(s, seq_len) for s in range(rest, n, seq_len)]


def token_pieces(docs: DataFrame, vocabulary: str, seq_len: int, end_id: int | None = 0,
                 with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces.  ``place`` numbers the pieces of one length within a partition
    (``part``); ``with_ids`` adds the ids themselves as an array."""
    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(seq_len + 1, np.int64)
        types = None
        for b in batches:
            text = b.column("text")
            sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
            for i, j in byte_groups(sizes):
                out: list[list] = [[] for _ in names]
                for doc_id, t in zip(b.column("doc_id").slice(i, j - i).to_pylist(), text.slice(i, j - i).to_pylist()):
                    ids = np.array(tokenizer.ids(vocabulary, t) + ([] if end_id is None else [end_id]), "<u4")
                    if not len(ids):
                        continue
                    for k, (start, n) in enumerate(cut(len(ids), seq_len)):
                        own = ids[start:start + n]
                        row = [doc_id, k, start, n, zlib.crc32(own.tobytes()), part, int(seen[n])]
                        for c, v in zip(out, row + ([own.astype(np.int32)] if with_ids else [])):
                            c.append(v)
                        seen[n] += 1
                types = types or [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(),
                                  pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return documents(docs, id_col, text_col).mapInArrow(run, schema)


def sweep(runs: dict[int, int], seq_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over runs: ``runs`` maps a length to its count.  Returns placements
    (length, first rank, count, members per sequence, first sequence, offset): the member
    of rank r goes to sequence ``first sequence + (r - first) // per`` at
    ``offset + (r - first) % per * length``."""
    gaps: dict[int, list[list[int]]] = {}       # gap length -> runs of sequences [first, count]
    order: list[int] = []                       # gap lengths with sequences, ascending
    placed, opened = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append([first, n])

    for size in sorted(runs, reverse=True):
        left, rank = runs[size], 0
        while left:
            k = bisect.bisect_left(order, size)
            if k == len(order):
                break
            gap = order[k]
            run = gaps[gap][-1]
            n = min(left, run[1])
            placed.append((size, rank, n, 1, run[0], seq_len - gap))
            add(gap - size, run[0], n)
            run[0], run[1] = run[0] + n, run[1] - n
            if not run[1]:
                gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.remove(gap)
            rank, left = rank + n, left - n
        if left:
            per = seq_len // size
            whole, rest = divmod(left, per)
            placed.append((size, rank, left, per, opened, 0))
            add(seq_len - per * size, opened, whole)
            if rest:
                add(seq_len - rest * size, opened + whole, 1)
            opened += whole + bool(rest)
    return placed


def pack(docs: DataFrame, vocabulary: str, seq_len: int = 2048, end_id: int | None = 0,
         with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids).  The pieces of a sequence lie side by side from offset 0.

    Null text is the empty text: the end id alone (no piece where ``end_id`` is None).
    Documents of equal length are placed by partition and row order; repeated rows and
    null ids are packed as rows of their own.  An empty table gives no rows.  Other columns
    are not read."""
    spark = docs.sparkSession
    pieces = land(token_pieces(docs, vocabulary, seq_len, end_id, with_ids, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = land(counts, "runs")
    runs = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    plan = spark.createDataFrame(sweep(runs, seq_len), PLACEMENT)
    ranked = pieces.join(offsets, ["length", "part"]).withColumn("__rank", F.col("__before") + F.col("place"))
    p = plan.withColumnRenamed("length", "__length")
    hit = ((F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("first"))
           & (F.col("__rank") < F.col("first") + F.col("n")))
    at = F.col("__rank") - F.col("first")
    return ranked.join(p, hit).select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("per_sequence"))).cast("bigint").alias("sequence_id"),
        (F.col("offset") + at % F.col("per_sequence") * F.col("length")).cast("bigint").alias("offset"),
        *(["ids"] if with_ids else []))
