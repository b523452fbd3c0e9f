"""Merkle manifest of a dataset: one hash tree per source, one tree over the sources.

1. A row becomes a leaf: the hash of its encoded columns, taken where the row lies.  No
   text is shuffled; only (source, doc_id, digest) goes on.
2. Leaves are numbered per source in range-sorted blocks (``operators.scan``), so a source
   with a third of all rows is no task of its own.  A level is one aggregate on (tree, place
   div 3): groups of three, however large the tree.  Each level is written before the next.
3. Proofs by pointer jumping.  At first every node holds the sibling segment towards its
   parent; a self-join on the ancestor then doubles the distance and concatenates the two
   segments, until every leaf holds the way to the root: log2 of the depth rounds.  Nodes
   that have arrived leave the join.  Ancestors of round k lie at least 2**k levels up, so
   that side shrinks to a 3**(2**k)-th; once its known row count is small it is broadcast,
   which is also where an ancestor has many nodes below it.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scan import null_safe_join, running_sums
from .common import land

FANOUT = 3
#: Columns of a row that its leaf covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over the subroots.
TOP = -1
#: Most bytes of a join side that is broadcast; a node counts as NODE_BYTES and SEGMENT_BYTES a level.
BROADCAST_BYTES = 8_000_000
NODE_BYTES, SEGMENT_BYTES = 100, 80

_SEGMENTS = "array<struct<l:binary,r:binary>>"
RESULT = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean")


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value: no two rows encode alike."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256 (binary) of the encoded columns."""
    return F.unhex(F.sha2(F.concat(*[field(values[c]) for c in COLUMNS]), 256))


def levels(n: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes until one remains."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


@dataclass
class Manifest:
    """A built manifest.  ``runs``: one row per run of up to ``fanout`` sibling nodes (tree,
    level, parent, n, kids), ``lone`` the leaves that are their source's subroot, ``subroots``
    (tree, source, digest) with tree = the source's place in order."""
    root: str
    depth: int
    depth_top: int
    n_leaves: int
    n_sources: int
    runs: DataFrame
    lone: DataFrame
    subroots: DataFrame


def _grow(level0: DataFrame, depth: int, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(runs per level, last nodes of each tree) over (tree, idx, n, digest, doc_id, other)."""
    runs, ends, cur = [], [level0.where("n = 1").select("tree", "digest")], level0.where("n > 1")
    for level in range(depth):
        kids = F.array_sort(F.collect_list(F.struct("idx", "digest", "doc_id", "other")))
        run = (cur.groupBy("tree", F.expr(f"idx div {fanout}").alias("parent"))
                  .agg(F.max("n").alias("n"), kids.alias("kids"))
                  .withColumn("level", F.lit(level)))
        run = land(run, f"{name}-{level}")
        runs.append(run)
        text = F.array_join(F.transform("kids", lambda k: hexed(k["digest"])), "")
        up = run.select("tree", F.col("parent").alias("idx"), F.ceil(F.col("n") / fanout).cast("bigint").alias("n"),
                        F.unhex(F.sha2(text, 256)).alias("digest"),
                        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("other"))
        ends.append(up.where("n = 1").select("tree", "digest"))
        cur = up.where("n > 1")
    last = ends[0]
    for e in ends[1:]:
        last = last.unionByName(e)
    return runs, last


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def build(leaves: DataFrame, fanout: int = FANOUT) -> Manifest | None:
    """The manifest of ``leaves`` (source, doc_id, digest, other); ``other`` is a second
    digest to try in the leaf's place, or null.  None for no leaves.

    Leaves of a source ascend by doc_id (null first); equal ids by digest, then ``other``."""
    leaves = land(leaves.select("source", "doc_id", "digest", "other"), "leaves")
    sizes = leaves.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.lit(1))
    sources = land(running_sums(sizes, ["one"], ["source"], {"tree": F.lit(1)}).select("source", "tree", "n"), "sources")
    n_sources, largest, total = sources.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if not n_sources:
        return None
    placed = running_sums(leaves, ["source"], ["doc_id", "digest", "other"], {"idx": F.lit(1)})
    level0 = land(null_safe_join(placed, sources, ["source"])
                  .select("tree", "idx", "n", "digest", "doc_id", "other"), "level0")
    depth, depth_top = levels(largest, fanout), levels(n_sources, fanout)
    runs, ends = _grow(level0, depth, fanout, "level")
    subroots = land(ends.join(sources, "tree").select("tree", "source", "digest"), "subroots")
    nodes = subroots.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("idx"),
                            F.lit(n_sources).cast("bigint").alias("n"), "digest",
                            F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("binary").alias("other"))
    top, end = _grow(nodes, depth_top, fanout, "top")
    root = end.select(hexed(F.col("digest"))).first()[0]       # one row: the dataset's root
    return Manifest(root, depth, depth_top, total, n_sources, _all(runs + top) if runs + top else None,
                    level0.where("n = 1"), subroots)


def _pointers(m: Manifest, fanout: int) -> DataFrame:
    """Every node but the root with its parent and the segment of siblings in between.  A
    source's subroot is the node (TOP, 0, tree)."""
    own = ["doc_id", "digest", "other"]
    ways = []
    if m.runs is not None:
        kid = m.runs.select("tree", "level", "parent", "n", "kids", F.posexplode("kids").alias("at", "kid"))
        side = lambda part: F.array_join(F.transform(part, lambda k: F.hex(k["digest"])), "")
        seg = F.struct(F.unhex(side(F.slice("kids", F.lit(1), F.col("at")))).alias("l"),
                       F.unhex(side(F.slice("kids", F.col("at") + 2, F.lit(fanout)))).alias("r"))
        is_sub = (F.col("tree") >= 0) & (F.col("n") <= fanout)      # the parent is a subroot
        ways.append(kid.select(
            "tree", "level", F.col("kid.idx").alias("idx"),
            F.when(is_sub, F.lit(TOP)).otherwise(F.col("tree")).cast("bigint").alias("a_tree"),
            F.when(is_sub, F.lit(0)).otherwise(F.col("level") + 1).cast("int").alias("a_level"),
            F.when(is_sub, F.col("tree")).otherwise(F.col("parent")).cast("bigint").alias("a_idx"),
            F.array(seg).cast(_SEGMENTS).alias("segs"), *[F.col(f"kid.{c}").alias(c) for c in own]))
    # A lone leaf is its source's subroot: no step in between.
    ways.append(m.lone.select("tree", F.lit(0).alias("level"), "idx", F.lit(TOP).cast("bigint").alias("a_tree"),
                              F.lit(0).alias("a_level"), F.col("tree").alias("a_idx"),
                              F.array().cast(_SEGMENTS).alias("segs"), *own))
    return _all(ways)


def proofs(m: Manifest, fanout: int = FANOUT) -> DataFrame:
    """(tree, doc_id, digest, other, segs) per leaf: ``segs`` holds, per level on the way to the
    root, the digests left and right of the node."""
    ptr = land(_pointers(m, fanout), "pointers")
    at_root = (F.col("a_tree") == TOP) & (F.col("a_level") == m.depth_top)
    done, active = ptr.where(at_root), ptr.where(~at_root)
    step, hops = 1, max(m.depth, 1) + m.depth_top       # from a lone leaf to its subroot is a hop too
    while step < hops:
        # Rows at least ``step`` levels up, from the tree sizes: the bound of the joined side.
        rows = 1.5 * (m.n_leaves / fanout ** step + m.n_sources) + step
        up = (active.unionByName(done).where((F.col("tree") == TOP) | (F.col("level") >= step))
              .select(F.col("tree").alias("a_tree"), F.col("level").alias("a_level"), F.col("idx").alias("a_idx"),
                      F.col("a_tree").alias("b_tree"), F.col("a_level").alias("b_level"),
                      F.col("a_idx").alias("b_idx"), F.col("segs").alias("b_segs")))
        if rows * (NODE_BYTES + step * SEGMENT_BYTES) <= BROADCAST_BYTES:
            up = F.broadcast(up)
        far = active.join(up, ["a_tree", "a_level", "a_idx"]).select(
            "tree", "level", "idx", F.col("b_tree").alias("a_tree"), F.col("b_level").alias("a_level"),
            F.col("b_idx").alias("a_idx"), F.concat("segs", "b_segs").alias("segs"), "doc_id", "digest", "other")
        far = land(far, f"jump-{step}")
        done, active = done.unionByName(far.where(at_root)), far.where(~at_root)
        step *= 2
    return done.where((F.col("tree") >= 0) & (F.col("level") == 0)).select("tree", "doc_id", "digest", "other", "segs")


def fold(leaf: Column, segs: Column) -> Column:
    """The root (hex) that a leaf (binary) and its proof lead to."""
    return F.aggregate(segs, hexed(leaf), lambda acc, s: F.sha2(F.concat(hexed(s["l"]), acc, hexed(s["r"])), 256))


def verify(docs: DataFrame, tampered: dict[str, Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` maps a column of COLUMNS to an expression for the value that is tried in its
    place (null values and expressions that change nothing leave the leaf as it is): the proof
    stays that of the untampered row, and ``folded_root`` tells whether it still leads to the root.

    A null in any column is a value of its own.  A null source is a source, the first in order; null
    ids come first in their source; rows that repeat an id, or the whole row, are leaves of
    their own.  One leaf alone is its subroot and root, with an empty proof.  No rows: no rows.
    Further columns are not read, whatever their names."""
    spark = docs.sparkSession
    plain = {c: F.col(c) for c in COLUMNS}
    digest = leaf_digest(plain)
    other = F.lit(None).cast("binary")
    if tampered:
        changed = {**plain, **{c: F.coalesce(e, plain[c]) for c, e in tampered.items()}}
        # Hashed a second time only where a value differs.
        differs = F.lit(False)
        for c in tampered:
            differs = differs | ~changed[c].eqNullSafe(plain[c])
        other = F.when(differs, leaf_digest(changed))
    m = build(docs.select("source", F.col("doc_id").cast("bigint").alias("doc_id"),
                          digest.alias("digest"), other.alias("other")), fanout)
    if m is None:
        return spark.createDataFrame([], RESULT)
    # Not more rows than sources, counted above.
    small = m.n_sources * NODE_BYTES <= BROADCAST_BYTES
    sub = m.subroots.select("tree", hexed(F.col("digest")).alias("subroot"))
    rows = proofs(m, fanout).join(F.broadcast(sub) if small else sub, "tree")
    siblings = F.array_join(F.transform("segs", lambda s: F.concat(hexed(s["l"]), hexed(s["r"]))), "")
    return rows.select(
        "doc_id", hexed(F.col("digest")).alias("leaf"), "subroot", F.lit(m.root).alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("other", "digest"), F.col("segs")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def write(m: Manifest, location: str) -> None:
    """The manifest as Parquet under ``location``: ``nodes`` (the sibling runs of all levels)
    and ``subroots``.  The root is all that a reader must be given."""
    if m.runs is not None:
        m.runs.write.mode("overwrite").parquet(f"{location}/nodes")
    m.subroots.write.mode("overwrite").parquet(f"{location}/subroots")


def stripped_newlines() -> dict[str, Column]:
    """The tampering of the registered query: where 2 divides crc32 of the decimal doc_id, the
    text loses its newlines.  A null id is not tampered with."""
    hit = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))}
