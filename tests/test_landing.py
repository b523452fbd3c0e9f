"""Files landed by the tasks: one per key, in a bounded number of folders."""
import os

from pyspark.sql import functions as F

from vellum.plans import registry as R
from vellum.session import scratch_path
from vellum.sources import files as FS


def test_one_file_per_key_without_a_folder_each(spark):
    n = 2 * FS.FOLDERS
    rows = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("html"))
    more = spark.createDataFrame([(0, "again"), (-5, None), (None, "no id")], "page_id bigint, html string")
    path = scratch_path(spark, "t-land")
    for _ in range(2):                                  # an attempt done again replaces its files
        FS.land_files(rows.unionByName(more).repartition(3), path, "page_id", "html")
    files = FS.scan_files(spark, path, glob="*.txt")
    got = {r.k: (r.length, bytes(r.content).decode("utf-8")) for r in
           files.select(FS.landed_key("page_id").alias("k"), "length", "content").collect()}
    assert files.count() == len(got) == n + 2
    assert got[7] == (4, "é7\n") and got[-5] == (1, "\n") and got[None] == (6, "no id\n")
    assert sorted(got[0][1].splitlines()) == ["again", "é0"]
    folders = {os.path.dirname(r.path) for r in files.select("path").collect()}
    assert len(folders) <= FS.FOLDERS


def test_the_registered_queries_land_no_folder_per_page(spark, tmp_path):
    n = 2 * FS.FOLDERS
    spark.range(n).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("a\n\nb").alias("html")
                          ).write.parquet(f"{tmp_path}/pages.parquet")
    paths = [r.path for r in R._page_files_on_disk(spark, str(tmp_path)).select("path").collect()]
    assert len(paths) == n and len({os.path.dirname(p) for p in paths}) <= FS.FOLDERS
    assert {tuple(r) for r in R.scan_files(spark, str(tmp_path)).collect()} == {(k, 5, True) for k in range(n)}
    assert {tuple(r) for r in R.extract_errors(spark, str(tmp_path)).collect()} == {(k, 2, False) for k in range(n)}
