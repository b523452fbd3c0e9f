"""Benchmark passages in documents: q-gram lemma, diagonal bands, banded alignment.

Texts are compared as code points after lower-casing A-Z and turning each run of ASCII white
space into one space.  An item of m characters may differ from a passage by
``floor(error * m)`` edits e.  By the q-gram lemma such a passage shares at least
m + 1 - q - q * e of the item's q-grams, all on diagonals (place in the text minus place in
the item) that are at most e apart.

1. Every q-gram of every text is looked up in the q-grams of a block of items.  A hit further
   than an item's longest passage from every place where hits are dense enough for some
   item drops out for that item, by a running count.
2. Hits are counted per item in diagonal bands of width 2e that overlap by e, so any passage
   lies in one band whole; bands that reach the lemma's bound are kept.
3. Kept bands are verified by an alignment restricted to their diagonals.

Items are taken in blocks of bounded size, and only a block's index is broadcast; a larger
benchmark means more passes over the texts, not a larger broadcast.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents, land

Q = 8
ERROR = 0.10
#: Items with fewer characters say nothing about contamination and are skipped.
MIN_CHARS = 32
#: Characters of items whose index is broadcast at a time.
BLOCK_CHARS = 4_000_000
GROUP_CHARS = 1 << 19
SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, distance int"
_TABLE_BITS = 22
_M = np.uint64(0x9E3779B97F4A7C15)


def normalise(points: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised points, their places before, the texts' new cuts)."""
    points = points + (((points >= 65) & (points <= 90)) * 32).astype(points.dtype)
    space = (points == 32) | ((points >= 9) & (points <= 13))
    again = np.zeros(len(points), bool)
    again[1:] = space[1:] & space[:-1]
    first = cuts[:-1][cuts[:-1] < len(points)]
    again[first] = space[first]                 # no space at a text's beginning
    kept = np.flatnonzero(~again)
    out = points[kept]
    out[space[kept]] = 32
    return out, kept, np.searchsorted(kept, cuts)


def decode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some texts, side by side, and their cuts."""
    cuts = np.cumsum([0] + [len(t) for t in texts])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), cuts


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * _M + points[j:j + n]
    h ^= h >> np.uint64(29)
    return h * _M


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int, error: float, min_chars: int):
        self.q, self.ids, self.points, e, need = q, [], [], [], []
        for item_id, text in items:
            points, cuts = decode([text or ""])
            p = normalise(points, cuts)[0]
            if len(p) and p[-1] == 32:
                p = p[:-1]
            if len(p) < max(min_chars, q):
                continue
            # Short items: as many edits as leave the lemma a bound above zero.
            edits = min(int(error * len(p)), (len(p) - q) // q)
            self.ids.append(item_id)
            self.points.append(p)
            e.append(edits)
            need.append(len(p) + 1 - q - q * edits)
        self.edits, self.need = np.array(e, int), np.array(need, int)
        self.sizes = np.array([len(p) for p in self.points], int)
        hashes = [gram_hashes(p, q) for p in self.points]
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, int)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(h))
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - _TABLE_BITS)] = True
        if len(self.ids):
            # A window of the shortest passage holds at least this many hits somewhere in
            # any passage that reaches its bound; the passage's other hits may be sparse, but
            # are no further away than it is long.
            self.reach = self.sizes + self.edits
            self.window = int((self.sizes + 2 * self.edits).min())
            parts = -(-(self.sizes + 2 * self.edits) // self.window)
            self.dense = int((-(-self.need // parts)).min())

    def __len__(self) -> int:
        return len(self.ids)


def candidates(ix: Index, points: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, lowest diagonal, highest diagonal), diagonals counted from the text's
    beginning, for bands that reach the lemma's bound."""
    h = gram_hashes(points, ix.q)
    if not len(h) or not len(ix):
        return []
    at = np.flatnonzero(ix.table[h >> np.uint64(64 - _TABLE_BITS)])
    k = np.searchsorted(ix.grams, h[at])
    ok = k < len(ix.grams)
    ok[ok] = ix.grams[k[ok]] == h[at[ok]]
    at, k = at[ok], k[ok]
    text = np.searchsorted(cuts, at, "right") - 1
    ok = at + ix.q <= cuts[text + 1]
    at, k, text = at[ok], k[ok], text[ok]
    if not len(at):
        return []
    # Sparse places: keep hits that lie in some window with enough of them, or near one.
    ahead = np.searchsorted(at, at + ix.window) - np.arange(len(at))
    mark = np.zeros(len(at) + 1, int)
    full = np.flatnonzero(ahead >= ix.dense)
    np.add.at(mark, full, 1)
    np.add.at(mark, full + ahead[full], -1)
    dense = at[np.cumsum(mark[:-1]) > 0]
    if not len(dense):
        return []
    after = np.searchsorted(dense, at)
    apart = np.minimum(np.abs(dense[np.minimum(after, len(dense) - 1)] - at), np.abs(at - dense[np.maximum(after - 1, 0)]))
    ok = apart <= ix.reach.max()
    at, k, text, apart = at[ok], k[ok], text[ok], apart[ok]
    many = ix.first[k + 1] - ix.first[k]
    row = np.repeat(np.arange(len(at)), many)
    entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + ix.first[k[row]]
    ok = apart[row] <= ix.reach[ix.item[entry]]
    row, entry = row[ok], entry[ok]
    item, text, local = ix.item[entry], text[row], at[row] - cuts[text[row]]
    diagonal = local - ix.place[entry]
    step = ix.edits[item] + 1
    band = np.floor_divide(diagonal, step)
    # Band b covers the diagonals [b * step, (b + 2) * step).
    key = np.concatenate([np.stack([text, item, band], 1), np.stack([text, item, band - 1], 1)])
    # A place of the item that is hit often on one band counts once: repeated words do not
    # make a passage.
    key = np.concatenate([key, np.tile(ix.place[entry], 2)[:, None]], 1)
    key = key[np.lexsort(key.T[::-1])]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    key = key[new][:, :3]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(key)))
    key = key[starts[n >= ix.need[key[starts, 1]]]]
    out: list[tuple[int, int, int, int]] = []
    for t, i, b in key.tolist():
        s = int(ix.edits[i]) + 1
        lo, hi = b * s, (b + 2) * s - 1
        if out and out[-1][:2] == (t, i) and lo <= out[-1][3] + 1 and hi - out[-1][2] < 6 * s:
            out[-1] = (t, i, out[-1][2], hi)
        else:
            out.append((t, i, lo, hi))
    return out


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, free: bool) -> np.ndarray:
    """Edit distances of the whole item to text[a:j], for j = len(item) + d, d from ``low`` to
    ``high`` (the diagonals allowed).  ``free``: any a on the band; else a = 0."""
    m, width = len(item), high - low + 1
    big = 1 << 20
    pad = np.full(m + width + 2, 0xFFFFFFFF, np.uint32)
    lo, hi = max(0, low), min(len(text), low + m + width)
    if hi > lo:
        pad[lo - low:hi - low] = text[lo:hi]
    d = np.arange(low, high + 1)
    if free:
        row = np.where((d >= 0) & (d <= len(text)), 0, big)
    else:
        row = np.where(d >= 0, d, big)
    step = np.arange(width)
    for i in range(1, m + 1):
        best = row + (pad[i - 1:i - 1 + width] != item[i - 1])          # column j = i + d, letter j - 1
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        row = np.minimum.accumulate(best - step) + step
        j = i + d
        row = np.where((j < 0) | (j > len(text)), big, row)
    return row


def verify(item: np.ndarray, edits: int, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """(start, end, distance) of the best passage on the diagonals [low, high]."""
    m = len(item)
    low, high = low - edits, high + edits
    # Equal text needs no alignment.
    a, b = max(0, low), min(len(text), high + m)
    at = text[a:b].tobytes().find(item.tobytes())
    while at >= 0 and at % 4:
        at = text[a:b].tobytes().find(item.tobytes(), at + 1)
    if at >= 0:
        return a + at // 4, a + at // 4 + m, 0
    row = banded(item, text, low, high, True)
    k = int(row.argmin())
    if row[k] > edits:
        return None
    end = m + low + k
    back = banded(item[::-1], text[:end][::-1], -edits, edits, False)
    size = m - edits + int(back.argmin())
    return end - size, end, int(row[k])


def regions(ix: Index, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item id, start, end, distance) in code points of the texts as given."""
    points, cuts = decode(texts)
    norm, kept, ncuts = normalise(points, cuts)
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for t, i, low, high in candidates(ix, norm, ncuts):
        found = verify(ix.points[i], int(ix.edits[i]), norm[ncuts[t]:ncuts[t + 1]], low, high)
        if found:
            best.setdefault((t, i), []).append((found[2], found[0], found[1]))
    for (t, i), found in sorted(best.items()):
        taken: list[tuple[int, int]] = []
        for d, s, e in sorted(set(found)):
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                origin = kept[ncuts[t]:ncuts[t + 1]] - cuts[t]
                yield t, ix.ids[i], int(origin[s]), int(origin[e - 1]) + 1, d


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t"))
    block, size = [], 0
    for r in rows.where(F.col("t").isNotNull()).distinct().orderBy("i", "t").toLocalIterator():
        if block and size + len(r["t"]) > chars:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    group, first, size = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py()
        if group and size + len(t) > GROUP_CHARS:
            yield first, group
            group, first, size = [], i, 0
        group.append(t)
        size += len(t)
    if group:
        yield first, group


def find_regions(docs: DataFrame, benchmark: DataFrame, q: int = Q, error: float = ERROR,
                 min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per passage found: doc_id, item_id, start, end (code points), distance.

    Clean documents give no row, nor do null and empty texts or an empty benchmark.  Items
    that repeat are searched once per id; null item texts and those under ``min_chars``
    normalised characters are skipped.  An item counts where it is found whole within its edits;
    a part of it quoted alone gives no row.  Of overlapping passages of one item the one with the
    fewest edits is reported.  Repeated rows are reported each; a null doc_id stays null."""
    spark, d = docs.sparkSession, documents(docs, id_col, text_col)
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        ix = spark.sparkContext.broadcast(Index(block, q, error, min_chars))

        def run(batches: Iterator[pa.RecordBatch], ix=ix) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, rows = b.column("doc_id"), []
                for first, texts in _groups(b.column("text")):
                    rows += [(ids[first + t].as_py(), *r) for t, *r in regions(ix.value, texts)]
                yield pa.RecordBatch.from_pydict(
                    {n: [r[k] for r in rows] for k, n in enumerate(("doc_id", "item_id", "start", "end", "distance"))},
                    schema=pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()),
                                      ("end", pa.int64()), ("distance", pa.int32())]))

        found = d.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark passage, with all their columns.  Rows are
    told apart by id and text, so a clean text stays where its id repeats."""
    key = lambda i, t: F.sha2(F.concat(F.coalesce(i.cast("bigint").cast("string"), F.lit("null")),
                                       F.lit(":"), F.coalesce(t.cast("string"), F.lit(""))), 256)
    rows = docs.select(F.xxhash64(key(F.col(id_col), F.col(text_col))).alias("doc_id"), F.col(text_col).alias("text"))
    hit = land(find_regions(rows, benchmark, **options).select(F.col("doc_id").alias("__vellum_key")).distinct(),
               "contaminated")
    keyed = docs.withColumn("__vellum_key", F.xxhash64(key(F.col(id_col), F.col(text_col))))
    return keyed.join(hit, "__vellum_key", "left_anti").drop("__vellum_key")
