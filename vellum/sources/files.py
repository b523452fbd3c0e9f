"""Files as rows: ``binaryFile`` scan, and page extraction (one chapter per page).

Page ids are 1-based positions in the file; blank pages are dropped and leave gaps in
the ids (never renumber after the filter).  One failing file does not fail the job:
its error goes to ``extract_error`` and it yields no pages."""
from __future__ import annotations

from typing import Callable, Iterator
import uuid

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..session import ship_code


#: Folders that landed files are spread over: enough to list them in parallel, and no more.
FOLDERS = 512


def land_files(rows: DataFrame, path: str, key_col: str, text_col: str) -> None:
    """One text file for every value of ``key_col``, ``folder=<n>/<key_col>=<value>.txt``, with the
    texts of its rows as lines (null: an empty line).

    The tasks write the files themselves: through ``partitionBy`` each file would get a folder
    of its own, to be made, moved by the driver and listed one by one.  A file gets its name
    when it is whole, so an attempt done again replaces it."""
    root = path.rstrip("/")
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:"):]         # as Hadoop prints a local path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pa_fs.FileSystem.from_uri(root)
        made, key, out, n = set(), None, None, 0

        def close() -> None:
            out.close()
            store.move(f"{at}/.{key}", f"{at}/{key[:-len(mark)]}.txt")
        mark = f"-{uuid.uuid4().hex}"
        for pdf in batches:
            for folder, value, text in zip(pdf["folder"], pdf["key"], pdf["text"]):
                this = f"{key_col}={value if value is not None else ''}{mark}"
                if this != key:
                    if out is not None:
                        close()
                    key, at, n = this, f"{base}/folder={folder}", n + 1
                    if at not in made:
                        store.create_dir(at)
                        made.add(at)
                    out = store.open_output_stream(f"{at}/.{key}")
                out.write(((text if text is not None else "") + "\n").encode("utf-8"))
        if out is not None:
            close()
        yield pd.DataFrame({"n": [n]})
    ship_code(rows.sparkSession)
    r = rows.select(F.pmod(F.hash(key_col), F.lit(FOLDERS)).alias("folder"), F.col(key_col).cast("string").alias("key"),
                    F.col(text_col).alias("text"))
    r.repartition("folder", "key").sortWithinPartitions("folder", "key").mapInPandas(run, "n bigint").write.format(
        "noop").mode("append").save()


def landed_key(key_col: str) -> Column:
    """The value of ``key_col`` (a whole number) in the path of a file that ``land_files`` wrote."""
    return F.nullif(F.regexp_extract("path", f"/{key_col}=(-?[0-9]+)\\.txt$", 1), F.lit("")).cast("bigint")


def scan_files(spark: SparkSession, path: str, glob: str | None = None,
               max_length: int | None = None) -> DataFrame:
    """``binaryFile`` source; a ``length`` filter is pushed into the listing and the
    ``content`` column is only read when selected."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.load(path)
    if max_length is not None:
        df = df.where(F.col("length") <= max_length)
    return df


def split_pages(files: DataFrame, text_col: str = "text", sep: str = "\f",
                file_col: str = "file") -> DataFrame:
    """Every page of every file, blank ones included: (file, id, text, blank)."""
    return files.select(
        F.col(file_col).alias("file"),
        F.posexplode(F.split(F.col(text_col), sep, -1)).alias("pos", "text"),
    ).select("file", (F.col("pos") + 1).cast("bigint").alias("id"), "text",
             T.is_blank("text").alias("blank"))


def extract_pages(files: DataFrame, text_col: str = "text", sep: str = "\f",
                  file_col: str = "file") -> DataFrame:
    """Chapters from pages: (file, id, content), blank pages dropped, text not trimmed."""
    return (split_pages(files, text_col, sep, file_col).where(~F.col("blank"))
            .select("file", "id", F.col("text").alias("content")))


def page_stats(files: DataFrame, text_col: str = "text", sep: str = "\f") -> DataFrame:
    """Adds ``n_pages``, the number of non-blank pages, on the row itself."""
    kept = F.filter(F.split(F.col(text_col), sep, -1), lambda p: ~T.is_blank(p))
    return files.withColumn("n_pages", F.size(kept).cast("bigint"))


#: Characters of page text that an extracting task hands on at a time.
PAGE_CHARS = 4_000_000
PAGES_SCHEMA = "path string, id bigint, content string, extract_error string"


def extract_with(files: DataFrame, extractor: Callable[[bytes, str], list[str]],
                 max_length: int | None = None) -> DataFrame:
    """Pluggable decoder (e.g. a PDF library) over ``binaryFile`` rows, in Arrow batches.
    ``extractor(content, name)`` returns the page texts or raises; a failure yields one
    row with ``extract_error`` and no pages.  Blank pages are dropped, ids keep gaps.
    Files above ``max_length`` are neither read nor decoded: the size test comes first."""
    if max_length is not None:
        files = files.where(F.col("length") <= max_length)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(        # noqa: E731
            rows, columns=["path", "id", "content", "extract_error"]).astype({"id": "Int64"})
        for pdf in batches:
            rows, held = [], 0
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    pages = extractor(bytes(content) if content is not None else b"", path)
                except Exception as e:  # noqa: BLE001 - reported per file
                    rows.append((path, None, None, str(e)))
                    continue
                for i, text in enumerate(pages):
                    if text is not None and text.strip():
                        rows.append((path, i + 1, text, None))
                        held += len(text)
                        if held > PAGE_CHARS:       # the pages of a batch never lie in memory together
                            yield frame(rows)
                            rows, held = [], 0
            yield frame(rows)
    ship_code(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, PAGES_SCHEMA)


def page_text_extractor(sep: str = "\f") -> Callable[[bytes, str], list[str]]:
    """Plain-text pages separated by ``sep``; undecodable bytes are an error."""
    def ex(content: bytes, name: str) -> list[str]:
        return content.decode("utf-8").split(sep)
    return ex


def ascii_line_extractor(content: bytes, name: str) -> list[str]:
    """A strict decoder (ASCII only) with one page per line; raises on any other byte."""
    return content.decode("ascii").split("\n")


def file_summary(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Per file: extracted page count and extraction error, for the intake checks."""
    per = pages.groupBy("path").agg(F.count("id").alias("n_pages"),
                                    F.max("extract_error").alias("extract_error"))
    return files.join(per, "path", "left")
