"""MinHash near-duplicates from bottom-k sketches of one hash function.

1. One pass over the texts gives each document the size of its shingle set, a 128-bit sum
   of the set and its ``k`` smallest shingle hashes.  Documents with equal sets are one
   class from here on, however many copies there are; a document whose id stands on several
   texts is a member of several classes, and joins them.
2. Retained values held by one class only link nothing.  Two sets with a Jaccard index of
   ``threshold`` share about ``threshold * k`` retained values; fewer than
   ``floor * k`` has a chance below 1e-8.  So a class enters inverted lists only with its
   rarest ``k - ceil(floor * k) + 1`` values, of which any linked pair shares one, and a
   passage that many texts quote makes no list unless it fills most of a text.  Sets that
   are retained whole need no such margin: they share ``threshold`` of their values.
3. This is done twice.  A small sketch of every class (k = 64) finds the classes that may be
   linked at all, a tenth of them here; only those have their full sets rebuilt, and a
   large sketch of these (k = 512, most sets whole) makes the lists that are joined.
4. Lists are joined by pivots first: every list compares its members with two of them and
   verified links merge components, which settles a list of thousands of near copies in one
   pass.  What is left is compared across components, exactly, a pair at the rarest value it
   shares; the values before it in either set bound the overlap from above, and a pair whose
   bound is too small for its sizes is no candidate.
5. A candidate's Jaccard index is estimated on the union sketch first; what passes, with a
   margin of seven standard deviations, is verified on the full sets.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, documents, land
from .wordhash import batch_words, rolling, shingles

WORDS = 5
THRESHOLD = 85          # percent
K, FINE_K = 64, 512
#: Floors of the two sketches at THRESHOLD; floor_of gives those of other thresholds.
FLOOR, FINE_FLOOR = 0.50, 0.75
SKETCH = "doc_id bigint, n_shingles bigint, low bigint, high bigint, sketch array<bigint>"


def floor_of(percent: int, k: int) -> float:
    """The largest floor in hundredths that two sets at ``percent`` fall under, of k draws,
    with a chance below 1e-8."""
    p, tail, n = percent / 100, 0.0, 0
    while n < k:
        tail += math.comb(k, n) * p**n * (1 - p)**(k - n)
        if tail >= 1e-8:
            break
        n += 1
    return math.floor(100 * n / k) / 100


def margin_of(percent: int, k: int) -> float:
    """Estimates this far below the threshold are not verified: seven standard deviations,
    rounded up to hundredths."""
    p = percent / 100
    return math.ceil(700 * math.sqrt(p * (1 - p) / k)) / 100


def _sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, b, _, first, _, _, h in batch_words(texts, lower=True):
        rolled = rolling(h, words)
        for row in range(a, b):
            i, j = int(first[row - a]), int(first[row - a + 1])
            yield row, shingles(h[i:j], words, rolled[i:j - words + 1] if j - i >= words else None)


def sketches(docs: DataFrame, words: int = WORDS, k: int = K) -> DataFrame:
    """SKETCH rows of (doc_id, text).  ``low`` and ``high`` are two 64-bit sums over the set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, low, high, values, at = [], [], [], [], [0]
            for _, s in _sets(b.column("text"), words):
                n.append(len(s))
                sums = _sums(s)
                low.append(sums[0])
                high.append(sums[1])
                values.append(s[:k])
                at.append(at[-1] + len(values[-1]))
            flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                names=["doc_id", "n_shingles", "low", "high", "sketch"])

    return docs.mapInArrow(run, SKETCH)


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for a set, as signed numbers."""
    low = s.sum(dtype=np.uint64)
    high = (s * (s | np.uint64(1)) ^ (s >> np.uint64(32))).sum(dtype=np.uint64)
    return int(low.view(np.int64)), int(high.view(np.int64))


def full_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, shingles) of rows (id, text, low, high), without the texts of another set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = list(zip(b.column("low").to_pylist(), b.column("high").to_pylist()))
            for a, e, _, first, _, _, h in batch_words(b.column("text"), lower=True):
                sets = [shingles(h[first[i]:first[i + 1]], words) for i in range(e - a)]
                mine = [i for i, s in enumerate(sets) if _sums(s) == want[a + i]]
                if not mine:
                    continue
                at = np.cumsum([0] + [len(sets[i]) for i in mine])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array([a + i for i in mine])), pa.ListArray.from_arrays(
                        pa.array(at, pa.int32()), pa.array(np.concatenate([sets[i] for i in mine]).view(np.int64)))],
                    names=["id", "shingles"])

    return docs.mapInArrow(run, "id bigint, shingles array<bigint>")


def prefixes(classes: DataFrame, k: int, percent: int, floor: float) -> DataFrame:
    """(id, n, kept, solo, prefix): the rarest retained values of each class that other
    classes retain too, in the order of rarity, and the number of those that none other
    retains, which come before them.  A value is 31 bits of the hash: a chance collision
    adds a candidate."""
    post = classes.select("id", F.explode("sketch").alias("v"))
    post = post.select("id", F.pmod("v", F.lit(2**31 - 1)).cast("int").alias("value"))
    shared = post.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = post.join(shared, "value").groupBy("id").agg(
        F.array_sort(F.collect_set(F.struct("df", "value"))).alias("by_df"))
    sizes = classes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.max(F.size("sketch")).alias("kept"))
    mine = mine.join(sizes, "id")
    # A set so small that every set it can be linked with is retained whole.
    whole = F.col("n_shingles") * 100 <= k * percent
    share = F.when(whole, F.lit(percent / 100)).otherwise(F.lit(floor))
    # Values of one class alone come first in the order of rarity; the rest of the prefix
    # is taken from the shared ones.
    length = F.col("kept") - F.ceil(F.col("kept") * share) + 1 - (F.col("kept") - F.size("by_df"))
    return mine.where(length > 0).select(
        "id", F.col("n_shingles").alias("n"), "kept", (F.col("kept") - F.size("by_df")).alias("solo"),
        F.transform(F.slice("by_df", F.lit(1), F.greatest(length, F.lit(0)).cast("int")), lambda x: x["value"]).alias("prefix"))


def inverted(members: DataFrame) -> DataFrame:
    """The inverted lists: one row (value, and the member's columns) per prefix value."""
    return members.select(F.explode("prefix").alias("value"), *members.columns)


def estimate(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and whose union sketch does not speak
    against it: of the k smallest values of both sketches together, the share held by both.
    The upper 31 bits of the hashes keep their order and are enough to tell them apart."""
    c = classes.select("id", "n_shingles", F.transform("sketch", lambda v: F.shiftright(v, 32).cast("int")).alias("s"))
    p = (pairs.join(c.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("s").alias("sa")), "a")
              .join(c.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("s").alias("sb")), "b"))
    p = p.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return p.where(both >= F.size(union) * (percent / 100 - margin_of(percent, k))).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    s = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
              .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for i in range(b.num_rows):
                x, y = (b.column(c)[i].values.to_numpy() for c in ("x", "y"))
                n = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * n >= percent * (len(x) + len(y) - n))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return s.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _two_pivots(lists: DataFrame) -> DataFrame:
    """Each member with the pivots of its list: its smallest member and its largest."""
    ends = lists.groupBy("value").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    j = lists.select("value", "id").join(ends, "value")
    pivots = F.array_distinct(F.filter(F.array("lo", "hi"), lambda p: p != F.col("id")))
    pairs = j.select("id", F.explode(pivots).alias("p"))
    return pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _overlap_needed(percent: int, k: int) -> Column:
    """Least number of values that the sketches of a linked pair (x, y) share: for sets that
    are retained whole the overlap that the threshold asks of their sizes, else its
    expectation in k draws less seven standard deviations."""
    n = F.col("x_n") + F.col("y_n")
    whole = (F.col("x_n") <= F.col("x_kept")) & (F.col("y_n") <= F.col("y_kept"))
    p = n * (percent / (100 + percent)) / F.greatest("x_n", "y_n")
    drawn = p * k - 7 * F.sqrt(F.greatest(k * p * (1 - p), F.lit(0.0)))
    return F.when(whole, F.ceil(n * percent / (100 + percent) - 1e-9)).otherwise(drawn)


def _across(lists: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs of all lists whose members are in different components and whose sizes and
    places allow a link, each at the rarest value that both prefixes hold."""
    columns = ("id", "comp", "n", "kept", "solo", "prefix")
    x = lists.select("value", *[F.col(c).alias(f"x_{c}") for c in columns])
    y = lists.select("value", *[F.col(c).alias(f"y_{c}") for c in columns])
    at = x["value"]
    # Values of either set that come no earlier than the shared one.
    left = F.least(*[F.col(f"{s}_kept") - F.col(f"{s}_solo") - F.array_position(F.col(f"{s}_prefix"), at) + 1 for s in "xy"])
    return x.join(y, (at == y["value"]) & (F.col("x_id") < F.col("y_id")) & (F.col("x_comp") != F.col("y_comp"))
                  & (F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)
                  & (left >= _overlap_needed(percent, k))
                  & (F.get(F.array_intersect("x_prefix", "y_prefix"), F.lit(0)) == at)
                  ).select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))


def _meeting(members: DataFrame) -> DataFrame:
    """The ids of members that share a prefix value with another."""
    met = inverted(members).groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return (inverted(members).select("value", "id").join(met.select("value"), "value", "left_semi")
            .select("id").distinct())


def _floor(given: float | None, usual: float, percent: int, k: int, usual_k: int) -> float:
    if given is not None:
        return given
    return usual if (percent, k) == (THRESHOLD, usual_k) else floor_of(percent, k)


def link(classes: DataFrame, sets_of, k: int = K, percent: int = THRESHOLD, floor: float | None = None,
         fine_k: int = FINE_K, fine_floor: float | None = None) -> DataFrame:
    """(id, component) of the classes (id, n_shingles, sketch) that have a link.
    ``sets_of(ids)`` gives the full sets of some classes.  Floors not given follow from
    ``percent`` and the sketch's size."""
    floor = _floor(floor, FLOOR, percent, k, K)
    fine_floor = _floor(fine_floor, FINE_FLOOR, percent, fine_k, FINE_K)
    coarse = land(prefixes(classes, k, percent, floor), "coarse")
    sets = land(sets_of(land(_meeting(coarse), "ids")), "sets")
    fine = sets.select("id", F.size("shingles").cast("bigint").alias("n_shingles"),
                       F.slice("shingles", 1, fine_k).alias("sketch"))
    members = land(prefixes(fine, fine_k, percent, fine_floor).withColumn("comp", F.col("id")), "members")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return land(verify(estimate(pairs, fine, fine_k, percent), sets, percent), "links")

    links = confirmed(_two_pivots(inverted(members)))
    comps = land(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    members = members.drop("comp").join(comps.withColumnRenamed("node", "id"), "id", "left")
    members = land(members.withColumn("comp", F.coalesce("component", "id")).drop("component"), "pivoted")
    both = links.unionByName(confirmed(_across(inverted(members), percent, fine_k)))
    return components(both.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "id")


def near_duplicates(docs: DataFrame, percent: int = THRESHOLD, words: int = WORDS, k: int = K,
                    floor: float | None = None, fine_k: int = FINE_K, fine_floor: float | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A & B| >= percent * |A | B| over their sets of distinct
    shingles of ``words`` words (A-Z lower-cased); ``component_id`` is the smallest doc_id
    reachable.  Null or blank texts have an empty set and are linked with nothing.  Rows that
    repeat a doc_id are one document whose links are those of each of its texts.  A row with
    a null doc_id is linked with nothing that has an id: it gets a null component_id and
    kept = true.  An empty table gives no rows; other columns are not read."""
    d = documents(docs, id_col, text_col)
    rows = land(sketches(d, words, k), "sketches")
    key = ["n_shingles", "low", "high"]
    named = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # A class is a set, whatever documents hold it; ``first`` is its smallest document.  Ids of
    # classes grow with it: the pivot of a list is then the text that came first, which later
    # near copies are closer to than to each other.
    groups = named.groupBy(*key).agg(F.min("doc_id").alias("first")).orderBy("first", *key)
    groups = land(groups.withColumn("id", F.monotonically_increasing_id()), "classes")
    # Documents with several rows.  Most tables have none.
    many = land(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(*key)).alias("a"),
                                            F.max(F.struct(*key)).alias("b")).where("rows > 1"), "many")
    repeated = many.limit(1).count() > 0

    def once(df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["id"]) if repeated else df

    # One row per class; its sketch crosses this one shuffle.
    classes = land(once(named.join(groups.withColumnRenamed("first", "doc_id"), ["doc_id", *key])
                             .select("id", "n_shingles", "sketch")), "sets")

    def sets_of(ids: DataFrame) -> DataFrame:
        mine = groups.join(ids, "id", "left_semi").select("id", F.col("first").alias("doc_id"), "low", "high")
        return once(full_sets(d.join(mine, "doc_id").select("id", "text", "low", "high"), words))

    comps = link(classes, sets_of, k, percent, floor, fine_k, fine_floor)
    if repeated:
        # The sets of one document are one node more: each is joined to the document's first.
        mixed = many.where(F.col("a") != F.col("b")).select("doc_id")
        own = named.join(mixed, "doc_id", "left_semi").join(groups, key).select("doc_id", "id").distinct()
        to = own.groupBy("doc_id").agg(F.min("id").alias("u"))
        tied = own.join(to, "doc_id").select("u", F.col("id").alias("v"))
        comps = components(comps.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(tied)
                           ).withColumnRenamed("node", "id")
    groups = land(groups.join(comps, "id", "left").select(*key, "first", F.coalesce("component", "id").alias("c")), "groups")
    least = groups.groupBy("c").agg(F.min("first").alias("component_id"))
    out = rows.select("doc_id", *key).join(land(groups.join(least, "c").drop("c", "first"), "named"), key, "left")
    return out.select("doc_id", "n_shingles",
                      F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id"))
                       .otherwise(F.col("component_id")).alias("component_id")
                      ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with all their
    columns.  Rows without an id stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__vellum_id")).distinct()
    return docs.join(gone, F.col(id_col).cast("bigint") == F.col("__vellum_id"), "left_anti")
