"""Removal of passages that stand earlier in the corpus, by FM-indexes over shards.

A window is ``length`` consecutive words of one document.  Windows meet their copies
without comparing all documents with all:

1. Each window is named by its minimiser, the smallest hash of its 5-word grams; equal
   windows have equal minimisers.  Neighbouring windows whose minimiser stands at one place
   form a segment (about nine windows).  A minimiser that stands in one segment of the corpus only cannot
   belong to a repeated window: those segments are done.
2. Equal segments are collapsed to the first of them (an aggregate with map-side combine, so
   copies by the thousand cost one row); their later occurrences are repeated as a whole.
3. The distinct segments are dealt to shards by minimiser.  Each shard builds a compressed
   FM-index over its segments (BWT in a wavelet matrix) and streams all its windows through
   it backwards; matching statistics cut off at ``length`` give the interval of each window,
   and the smallest suffix of the interval is its first occurrence.
4. A minimiser that very many distinct segments share is dealt window by window instead,
   so that no shard grows with it; equal windows are collapsed like equal segments.
5. Intervals of repeated windows return to their documents and the words outside them
   are kept.

The number of shards grows with the words to be indexed, the size of a shard does not.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents, land
from .fm_index import earliest
from .wordhash import batch_words, mix, rolling

LENGTH = 20
GRAM = 5
#: Low bits of a gram's hash that its place replaces while minima are taken.
PLACE_BITS = 28
#: Words indexed by a shard, on average.
SHARD_WORDS = 300_000
#: Distinct segments of one minimiser beyond which it is dealt window by window.
HOT = 2_000

SEGMENTS = "did bigint, pos bigint, key bigint, content bigint"


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, tag, text): null ids sort last; ``tag``, 31 bits of the text's hash, tells rows
    apart that share an id."""
    d = documents(docs, id_col, text_col)
    return d.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("did"),
                    F.xxhash64("text").bitwiseAND(F.lit(2**31 - 1)).alias("tag"), "text")


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, size = len(x) - w + 1, 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[w - size:w - size + n])


def _cut(h: np.ndarray, at: np.ndarray, length: int, gram: int):
    """(first window, windows, minimiser, content) of the segments of some texts' words;
    ``at`` are the texts' first words and the end.

    A segment's windows share the place of their minimiser (the leftmost of equal ones), so
    no two windows of a segment are equal: a repeat always lies in another segment."""
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    g = rolling(h, gram)
    bits = np.uint64(max(PLACE_BITS, len(g).bit_length()))
    packed = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    place = _sliding_min(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    inside = text[:len(place)] == text[length - 1:]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    whole = np.flatnonzero(inside)
    size = np.diff(np.append(np.searchsorted(whole, first), len(whole)))
    # The content is the sum of the window hashes, which does not depend on the place in the
    # text, with the first window once more for the order.
    win = rolling(h, length)
    total = np.zeros(len(win) + 1, np.uint64)
    np.cumsum(win, out=total[1:])
    content = mix(total[first + size] - total[first] ^ (win[first] * np.uint64(3)))
    content = (content >> np.uint64(7) << np.uint64(7)) | size.astype(np.uint64)
    return first, text[first], g[place[first].astype(np.int64)], content


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """SEGMENTS: ``pos`` is the tag (31 bits) and the first word (32), ``content`` the hash of
    the segment's words and its number of windows (7 bits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, tag = (b.column(c).to_numpy(zero_copy_only=False) for c in ("did", "tag"))
            for a, e, _, at, _, _, h in batch_words(b.column("text"), lower=False):
                if len(h) < length:
                    continue
                first, text, key, content = _cut(h, at, length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[a:e][text]), pa.array((tag[a:e][text] << 32) + first - at[text]),
                     pa.array(key.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["did", "pos", "key", "content"])

    return docs.mapInArrow(run, SEGMENTS)


def _windows(content):
    return content.bitwiseAND(F.lit(127))


def segment_words(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(did, pos, key, hot, words): the word hashes of the wanted segments (did, pos, n, key, hot)."""
    per = wanted.select("did", F.shiftright("pos", 32).alias("tag"), "pos", "n", "key", "hot")
    per = per.groupBy("did", "tag").agg(F.collect_list(F.struct("pos", "n", "key", "hot")).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, lists = b.column("did").to_pylist(), b.column("segments")
            for a, e, _, at, _, _, h in batch_words(b.column("text"), lower=False):
                rows = []
                for row in range(a, e):
                    own = h[at[row - a]:at[row - a + 1]].view(np.int64)
                    for s in lists[row].as_py():
                        i = s["pos"] & 0xFFFFFFFF
                        rows.append((did[row], s["pos"], s["key"], s["hot"], own[i:i + s["n"] + length - 1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_()),
                     pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names=["did", "pos", "key", "hot", "words"])

    return (texts.join(per, ["did", "tag"]).select("did", "text", "segments")
                 .mapInArrow(run, "did bigint, pos bigint, key bigint, hot boolean, words array<bigint>"))


def shard_repeats(length: int):
    """For ``applyInPandas`` over a shard (did, pos, words): (did, pos, n) runs of windows that
    stand earlier in the shard."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["did", "pos"], kind="stable")
        words = [np.asarray(w, np.int64) for w in pdf["words"]]
        sizes = np.array([len(w) for w in words])
        alphabet, code = np.unique(np.concatenate(words), return_inverse=True)
        begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int((sizes + 1).sum()), np.int64)       # 0 ends a segment
        text[np.arange(len(code)) + np.repeat(np.arange(len(words)), sizes)] = code + 1
        n = sizes - length + 1
        row = np.repeat(np.arange(len(words)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = begin[row] + offset
        again = np.flatnonzero(earliest(text, place, length) < place)
        if not len(again):
            return pd.DataFrame({"did": [], "pos": [], "n": []}).astype("int64")
        new = np.concatenate([[True], np.diff(place[again]) != 1])
        first = again[new]
        count = np.diff(np.append(np.flatnonzero(new), len(again)))
        r = row[first]
        return pd.DataFrame({"did": pdf["did"].to_numpy()[r], "pos": pdf["pos"].to_numpy()[r] + offset[first], "n": count})

    return run


def hot_windows(words: DataFrame, length: int) -> DataFrame:
    """(did, pos, n = 1) of the windows of hot segments that stand earlier; one row per
    window, equal windows meet in an aggregate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for did, pos, w in zip(*(b.column(c) for c in ("did", "pos", "words"))):
                win = rolling(w.values.to_numpy().view(np.uint64), length).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(win), did.as_py())), pa.array(pos.as_py() + np.arange(len(win))), pa.array(win)],
                    names=["did", "pos", "window"])

    w = words.select("did", "pos", "words").mapInArrow(run, "did bigint, pos bigint, window bigint")
    first = w.groupBy("window").agg(F.min(F.struct("did", "pos")).alias("first"))
    return w.join(first, "window").where(F.struct("did", "pos") != F.col("first")).select(
        "did", "pos", F.lit(1).cast("bigint").alias("n"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_words: int = SHARD_WORDS,
            hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(runs, texts): runs (did, pos, n) of windows that stand earlier, and the texts
    (did, tag, text) that they may lie in.  ``docs`` has did, tag, text."""
    spark = docs.sparkSession
    seen = segments(docs, length, gram).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = land(seen.select("key"), "shared_keys")
    occ = land(segments(docs, length, gram).join(shared, "key"), "occurrences")
    texts = land(docs.join(occ.select("did", F.shiftright("pos", 32).alias("tag")).distinct(), ["did", "tag"], "left_semi"),
                 "involved")
    first = land(occ.groupBy("key", "content").agg(F.min(F.struct("did", "pos")).alias("first")), "first")
    copies = occ.join(first, ["key", "content"]).where(F.struct("did", "pos") != F.col("first")).select(
        "did", "pos", _windows(F.col("content")).alias("n"))
    many = first.groupBy("key").agg(F.count(F.lit(1)).alias("distinct")).where("distinct > 1")
    wanted = first.join(many, "key").select("first.did", "first.pos", _windows(F.col("content")).alias("n"), "key",
                                            (F.col("distinct") > hot).alias("hot"))
    words = land(segment_words(texts, wanted, length), "segment_words")
    total = words.where(~F.col("hot")).agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    cold = (words.where(~F.col("hot")).select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "did", "pos", "words")
                 .groupBy("shard").applyInPandas(shard_repeats(length), "did bigint, pos bigint, n bigint"))
    runs = copies.unionByName(cold).unionByName(hot_windows(words.where("hot"), length))
    return land(runs, "runs"), texts


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_words: int = SHARD_WORDS,
                   hot: int = HOT, with_text: bool = False, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Every word covered by a window whose words also start earlier (smaller doc_id, or the
    same document at an earlier word) is removed; windows are judged on the input.  Null,
    empty and blank texts have no words.  Rows that repeat id and text are one document, whose
    result each of them gets; texts that share an id are told apart and ordered by a hash; null
    ids come last.  Other columns are not read; an empty table gives no rows."""
    d = _identified(docs, id_col, text_col)
    fields = "did bigint, tag bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (
        ", kept_text string" if with_text else "")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column("runs") if "runs" in b.schema.names else None
            out = []
            for i, text in enumerate(b.column("text")):
                words = text.as_py().encode().split()       # ASCII white space
                n = len(words)
                if runs is not None:
                    gone = np.zeros(n + 1, np.int64)
                    for r in runs[i].as_py():
                        at = r["pos"] & 0xFFFFFFFF
                        gone[at] += 1
                        gone[min(n, at + r["n"] + length - 1)] -= 1
                    words = [w for w, g in zip(words, np.cumsum(gone)) if not g]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = [b.column("did"), b.column("tag"), *(pa.array([o[k] for o in out], t) for k, t in
                       enumerate((pa.int64(), pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns[:6 if with_text else 5],
                                             names=[f.split()[0] for f in fields.split(", ")][:6 if with_text else 5])

    runs, texts = repeats(d, length, gram, shard_words, hot)
    per = runs.select("did", F.shiftright("pos", 32).alias("tag"), "pos", "n").groupBy("did", "tag").agg(
        F.collect_list(F.struct("pos", "n")).alias("runs"))
    cut = land(texts.join(per, ["did", "tag"]).select("did", "tag", "text", "runs").mapInArrow(judge, fields)
                    .dropDuplicates(["did", "tag"]), "cut")
    whole = d.mapInArrow(judge, fields)
    better = cut.select("did", "tag", *[F.col(c).alias(f"__{c}") for c in cut.columns[3:]])
    out = whole.join(better, ["did", "tag"], "left")
    did = F.when(F.col("did") != 2**63 - 1, F.col("did")).alias("doc_id")
    return out.select(did, "n_words", *[F.coalesce(f"__{c}", c).alias(c) for c in cut.columns[3:]])
