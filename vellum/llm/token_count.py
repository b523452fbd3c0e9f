"""Token counts: Arrow batches in, lengths out; ids never leave the Python worker.

The texts of an Arrow batch are encoded in groups of bounded bytes, and long texts are cut
at places where the tokenizer always starts a new word, so the memory of a worker follows
the group, not the text.  The count of a text is the sum over its pieces.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import tokenizer
from .common import documents

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: Bytes of text that are held as Python strings at a time.
GROUP_BYTES = 1 << 20


def byte_groups(sizes, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Neighbouring rows in groups [a, b) of at most ``limit`` bytes, at least one row."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null text is the empty text: 0 bytes, 0 tokens.  A null doc_id stays null, repeated
    rows are counted each, an empty table gives no rows, and other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
            n: list[int] = []
            for i, j in byte_groups(sizes):
                n += [tokenizer.length(vocabulary, t) for t in text.slice(i, j - i).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs, id_col, text_col).mapInArrow(run, SCHEMA)
