"""Persistent tables that survive a rerun, a lost driver and another session's settings.

``RunStore``: results of runs, published by manifest.  A run writes under an attempt folder of
its own; one manifest row then makes that attempt the run's content.  Readers see
published attempts only, so a run that died half way shows nothing, and a run that is done
again is replaced as a whole, whatever it wrote before.

``BucketedTable``: a keyed table, bucketed and sorted by its key, that later runs meet by a
sort-merge join without moving it.
"""
from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: ``tables``: the schema (JSON) of each table of the attempt.
MANIFEST_SCHEMA = "run string, attempt string, published bigint, tables map<string,string>"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class RunStore:
    """Tables of runs under ``location``: ``<table>/attempt=<id>/`` and ``manifest/``."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        self._schemas: dict[str, dict[str, str]] = {}

    def begin(self) -> str:
        """A new attempt: nothing of it is seen before ``publish``."""
        return f"a-{uuid.uuid4().hex}"

    def write(self, attempt: str, table: str, df: DataFrame) -> DataFrame:
        """Writes one table of an attempt and returns it as read back, so that what follows is
        computed from what was written."""
        path = f"{self.location}/{table}/attempt={attempt}"
        df.write.mode("overwrite").parquet(path)
        self._schemas.setdefault(attempt, {})[table] = df.schema.json()
        return self.spark.read.schema(df.schema).parquet(path)

    def _publish(self, rows: list[tuple]) -> None:
        """One file: the moment it appears, all of ``rows`` hold."""
        (self.spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1)
         .write.mode("append").parquet(f"{self.location}/manifest"))

    def publish(self, run: str, attempt: str) -> None:
        """From here on what the attempt has written is the content of ``run``."""
        self._publish([(run, attempt, time.time_ns(), self._schemas.pop(attempt, {}))])

    def put(self, run: str, **tables: DataFrame) -> None:
        """Writes and publishes a run in one go."""
        attempt = self.begin()
        for name, df in tables.items():
            self.write(attempt, name, df)
        self.publish(run, attempt)

    def runs(self) -> DataFrame:
        """(run, attempt, published, tables): the last attempt published for each run."""
        path = f"{self.location}/manifest"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        m = self.spark.read.schema(MANIFEST_SCHEMA).parquet(path)
        last = F.max_by(F.struct("attempt", "published", "tables"), F.struct("published", "attempt"))
        return m.groupBy("run").agg(last.alias("m")).select("run", "m.*")

    def read(self, table: str, schema: str | T.StructType | None = None) -> DataFrame:
        """The rows of all published runs, with ``run``.  The manifest has one row per run: its
        folders and schemas are named to the scan, so attempts that were replaced are not even
        listed and no file is opened to learn a schema.  ``schema``: of a table that nothing has
        published yet."""
        live = [r for r in self.runs().collect() if table in r.tables]
        if not live:
            if schema is None:
                raise ValueError(f"nothing published in {table}: pass its schema")
            return self.spark.createDataFrame([], schema).withColumn("run", F.lit(None).cast("string"))
        base, out = f"{self.location}/{table}", None
        for own in dict.fromkeys(r.tables[table] for r in live):        # a schema may have grown since
            fields = T.StructType.fromJson(json.loads(own)).add("attempt", T.StringType())
            paths = [f"{base}/attempt={r.attempt}" for r in live if r.tables[table] == own]
            df = self.spark.read.schema(fields).option("basePath", base).parquet(*paths)
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        run_of = self.spark.createDataFrame([(r.attempt, r.run) for r in live], "attempt string, run string")
        return out.join(F.broadcast(run_of), "attempt").drop("attempt")     # a row per run

    def compact(self, into: str, runs: list[str]) -> None:
        """Publishes the rows of ``runs`` as one run and empties those: the manifest and the
        number of folders stay small however many micro-batches have run."""
        done = [r for r in self.runs().collect() if r.run in set(runs) and r.run != into]
        attempt, names = self.begin(), [r.run for r in done]
        for t in sorted({t for r in done for t in r.tables}):
            self.write(attempt, t, self.read(t).where(F.col("run").isin(names)).drop("run"))
        now = time.time_ns()
        self._publish([(into, attempt, now, self._schemas.pop(attempt, {}))] + [(name, "none", now, {}) for name in names])


class BucketedTable:
    """A Parquet table at ``location``, bucketed and sorted by ``key``.

    The bucket count is fixed when the table is made and lies beside the files
    (``<location>.buckets``): a session with other settings opens the same table."""

    def __init__(self, spark: SparkSession, location: str, schema: str, key: str, buckets: int | None = None):
        self.spark, self.key, self.location = spark, key, location.rstrip("/")
        self.buckets = self._agreed(buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
        self.name = "vellum_" + hashlib.md5(self.location.encode()).hexdigest()
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}) USING parquet "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.location}'")

    def _agreed(self, wanted: int) -> int:
        at = f"{self.location}.buckets"
        if not path_exists(self.spark, at):
            try:
                self.spark.createDataFrame([(wanted,)], "buckets int").coalesce(1).write.json(at)
            except AnalysisException:       # another session made it just now
                pass
        return self.spark.read.schema("buckets int").json(at).first()[0]

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, df: DataFrame) -> None:
        """Appends rows, one file per bucket."""
        cols = self.read().columns
        df.select(*cols).repartition(self.buckets, self.key).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forgets the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
