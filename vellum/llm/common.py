"""Helpers shared by the operators: scratch tables, components."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's part of the shared folder."""
    return scratch_path(spark, f"llm-{name}")


def land(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back with
    its own schema.  A lost executor costs a reread, never a recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


#: Rows of an Arrow batch, on both sides of a Python worker.  Texts are long: Spark's default
#: of 10,000 rows would hold tens of megabytes several times over in every task.
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ARROW_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that the operators read, under names that cannot clash with
    others: ``doc_id`` BIGINT and ``text`` (null text: empty)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _large_star(e: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows.  The minimum per
    node is a partial/final aggregate and returns to the edges by a join that AQE can
    split, so a hub never has its neighbours in one task."""
    sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m"))
    out = sym.join(low, "u").where(F.col("v") > F.col("u"))
    return out.select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    out = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (u, v): rows (node, component) with the
    smallest node reachable, for every node that has an edge to another.

    Alternating large-star and small-star steps (Kiveris et al., "Connected components
    in MapReduce and beyond") on edges kept as (larger, smaller).  A round is written to the
    shared folder, which cuts the lineage.  The rounds end when every node points to one
    smaller node that points nowhere: then the edges are the answer."""
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = land(e.distinct(), "edges")
    for _ in range(max_rounds):
        ends = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
        chained = ends.join(e.select(F.col("v").alias("u")), "u", "left_semi")
        if ends.where("n > 1").unionByName(chained).limit(1).count() == 0:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        e = land(_small_star(_large_star(e)), "stars")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
