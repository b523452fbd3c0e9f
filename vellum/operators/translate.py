"""TextModel stage: a pluggable per-chunk function run in Arrow batches.

The model is a *parameter* of the job.  It is built once per Python worker
(one client per process), called once per non-blank chunk, retried with exponential
backoff, and its failures become an ``error`` column instead of failing the task:
a task retry would call the model again for the whole partition.
"""
from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterator, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions import text as T
from ..session import materialize, ship_code
from ..store import BucketedTable, RunStore
from .chunking import CHAPTER_KEY
from .scan import null_safe_join, running_sums

RESULT_COLUMNS = "translated string, attempts int, wait_s bigint, error string"
DEFAULT_CONCURRENCY = 8


class TextModel(Protocol):
    def translate(self, text: str, target_language: str, *, key=None, attempt: int = 1) -> str: ...


class FunctionModel:
    """Adapts a plain ``f(text, target_language) -> str``."""

    def __init__(self, fn: Callable[[str, str], str]):
        self.fn = fn

    def translate(self, text, target_language, *, key=None, attempt=1):
        return self.fn(text, target_language)


class LetterModel:
    """Deterministic stand-in that reads every character: letters a-z and A-Z move 13
    places, the rest stays, and the target language stands in front."""

    FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    TO = "nopqrstuvwxyzabcdefghijklmNOPQRSTUVWXYZABCDEFGHIJKLM"
    TABLE = str.maketrans(FROM, TO)

    def translate(self, text, target_language, *, key=None, attempt=1):
        return f"[{target_language}] {text.translate(self.TABLE)}"

    @classmethod
    def column(cls, text: Column, language: Column) -> Column:
        return F.concat(F.lit("["), language, F.lit("] "), F.translate(text, cls.FROM, cls.TO))


class PreviewModel:
    """Deterministic stand-in: 'Translated to {lang}: {text[:20]}...' ("" for "")."""

    def translate(self, text, target_language, *, key=None, attempt=1):
        if not text:
            return ""
        return f"{C.MOCK_TEXT_PREFIX}{target_language}: {text[:C.MOCK_TEXT_PREVIEW]}..."

    @staticmethod
    def column(text: Column, language: Column) -> Column:
        return T.mock_translate_text(text, language)


class IdentityModel:
    """Returns its input; shows the seams that chunking + stripping leave."""

    def translate(self, text, target_language, *, key=None, attempt=1):
        return text

    @staticmethod
    def column(text: Column, language: Column) -> Column:
        return text


class GlossaryModel:
    """Replaces whole words found in a glossary (e.g. names that must stay fixed, or a
    term list).  Pass a ``SparkContext.broadcast`` of the dict for a large glossary: it
    then reaches each executor once instead of with every task."""

    def __init__(self, glossary, case_sensitive: bool = True):
        self.glossary = glossary
        self.case_sensitive = case_sensitive
        self._rx = None

    def _table(self) -> dict:
        g = self.glossary
        return g.value if hasattr(g, "value") else g

    def translate(self, text, target_language, *, key=None, attempt=1):
        import regex
        table = self._table()
        if not table:
            return text
        if self._rx is None:
            words = sorted(table, key=len, reverse=True)
            flags = 0 if self.case_sensitive else regex.IGNORECASE
            self._rx = regex.compile(r"\b(" + "|".join(regex.escape(w) for w in words) + r")\b", flags)
            self._lookup = table if self.case_sensitive else {k.lower(): v for k, v in table.items()}
        if self.case_sensitive:
            return self._rx.sub(lambda m: self._lookup[m.group(0)], text)
        return self._rx.sub(lambda m: self._lookup[m.group(0).lower()], text)


def no_sleep(_seconds: float) -> None:
    """Backoff that records instead of waiting (tests, fault injection)."""
    return None


def wait_schedule(max_retries: int) -> tuple[int, ...]:
    """Seconds to wait after each failure that is followed by another attempt."""
    return tuple(C.BACKOFF_BASE ** k for k in range(1, max_retries + 1))


def translate_one(model: TextModel, text, language: str, key, max_retries: int,
                  sleep: Callable[[float], None], strip_output: bool = True):
    """Returns (translated, attempts, waited seconds, error) for one chunk."""
    if text is None:
        return None, 0, 0, "no text"
    if not text.strip():
        return "", 0, 0, None
    waited = 0
    for attempt, pause in enumerate((*wait_schedule(max_retries), None), 1):
        try:
            out = model.translate(text, language, key=key, attempt=attempt) or ""
        except Exception as e:  # noqa: BLE001 - any failure of the model is tried again
            if pause is None:
                return None, attempt, waited, C.RETRY_ERROR.format(n=max_retries, e=e)
            sleep(pause)
            waited += pause
        else:
            return (out.strip() if strip_output else out), attempt, waited, None


def _worker(factory: Callable[[], TextModel], text_col: str, lang_col: str, key_col: str | None,
            max_retries: int, sleep: Callable[[float], None], strip_output: bool,
            concurrency: int = 1):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tr = factory()
        pool = ThreadPoolExecutor(max_workers=concurrency) if concurrency > 1 else None
        try:
            for pdf in batches:
                yield _translate_batch(pdf, tr, pool)
        finally:
            if pool is not None:
                pool.shutdown(wait=True)

    def _translate_batch(pdf: pd.DataFrame, tr: TextModel, pool) -> pd.DataFrame:
        keys = pdf[key_col] if key_col else [None] * len(pdf)
        args = list(zip(pdf[text_col], pdf[lang_col], keys))

        def one(a):
            return translate_one(tr, a[0], a[1], a[2], max_retries, sleep, strip_output)

        # Calls are I/O bound: up to ``concurrency`` in flight per task, results in row order.
        res = list(pool.map(one, args)) if pool is not None else [one(a) for a in args]
        out = pdf.copy()
        out["translated"] = [r[0] for r in res]
        out["attempts"] = pd.array([r[1] for r in res], dtype="int32")
        out["wait_s"] = pd.array([r[2] for r in res], dtype="int64")
        out["error"] = [r[3] for r in res]
        return out

    return run


def translate_chunks(chunks: DataFrame, model: TextModel | Callable[[], TextModel] | None = None,
                     *, target_language: str | Column = C.DEFAULT_TARGET_LANGUAGE,
                     max_retries: int = C.MAX_RETRIES, key_col: str | None = None,
                     parallelism: int | None = None, sleep: Callable[[float], None] | None = None,
                     strip_output: bool = True, jvm: bool = False,
                     concurrency: int = DEFAULT_CONCURRENCY, dedupe: bool = False,
                     memory: TranslationMemory | None = None) -> DataFrame:
    """Adds ``translated, attempts, wait_s, error`` to every chunk row.

    * Chunks are spread by a hash of their identity over ``parallelism`` tasks before
      the call (one long chapter becomes many rows, so it does not hold up one task);
      an explicit count is never coalesced by AQE, so it bounds concurrent callers.
    * ``jvm=True`` with a model that has a ``column`` form (mock, identity) runs
      as a Column expression with no Python worker.
    * ``sleep`` defaults to real waiting; tests and fault injection pass a no-op and
      read the waits from ``wait_s``.
    * ``concurrency`` calls are in flight per task (threads; model calls wait on I/O), so
      the cluster has at most ``parallelism x concurrency`` open calls.  The model
      object is shared by the threads of a worker and must be thread-safe.
    * ``dedupe=True`` calls the model once per distinct (target language, chunk text):
      equal chunks (copied documents, boilerplate) share one call, whose ``attempts`` and
      ``wait_s`` every copy reports.  See ``translate_distinct``.
    * ``memory`` (implies ``dedupe``): translations kept from earlier runs.  Only pairs that it
      lacks reach the model; a remembered one reports no attempt.
    """
    tr = model if model is not None else LetterModel()
    lang = target_language if isinstance(target_language, Column) else F.lit(target_language)
    df = chunks.withColumn("target_language", lang)

    if jvm and hasattr(tr, "column"):
        blank = T.is_blank("chunk")
        out = T.strip(tr.column(F.col("chunk"), F.col("target_language"))) if strip_output \
            else tr.column(F.col("chunk"), F.col("target_language"))
        return df.withColumns({
            "translated": F.when(blank, F.lit("")).otherwise(out),
            "attempts": F.when(blank, F.lit(0)).otherwise(F.lit(1)),
            "wait_s": F.lit(0).cast("bigint"),
            "error": F.lit(None).cast("string"),
        })

    ship_code(df.sparkSession)
    factory = tr if (callable(tr) and not hasattr(tr, "translate")) else (lambda t=tr: t)
    n = parallelism or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    fn = _worker(factory, "chunk", "target_language", key_col, max_retries,
                 sleep or time.sleep, strip_output, concurrency)
    if dedupe or memory:
        if key_col:
            raise ValueError("dedupe shares one call among equal chunks: no per-row key_col")
        return translate_distinct(df, fn, n, memory)
    spread = df.repartition(n, *[F.col(c) for c in CHAPTER_KEY], F.col("chunk_idx"))
    return spread.mapInPandas(fn, _result_schema(spread))


def _result_schema(df: DataFrame) -> str:
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"{cols}, {RESULT_COLUMNS}"


class TranslationMemory:
    """Translations kept across runs: a table of (digest of language and chunk, translation),
    bucketed and sorted by digest, so that a run meets it by a sort-merge join which moves
    the run's distinct digests and not the memory.  Failures are not remembered."""

    SCHEMA = "_ck string, translated string"

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        self.table = BucketedTable(spark, location, self.SCHEMA, "_ck", buckets)

    def known(self) -> DataFrame:
        """One row per digest: runs that worked side by side may both have added it."""
        return self.table.read().groupBy("_ck").agg(F.min("translated").alias("translated"))

    def add(self, done: DataFrame) -> None:
        self.table.append(done.where(F.col("error").isNull()).select("_ck", "translated"))


def translate_distinct(df: DataFrame, fn, n: int, memory: TranslationMemory | None = None) -> DataFrame:
    """One call per distinct (target_language, chunk), joined back to every chunk row.

    * The distinct step is an aggregate on a SHA-256 of the pair, combined map-side, so a
      chunk repeated in a third of all rows reaches the reducer once per map task.
    * With a ``memory``, pairs that it holds leave by an anti-join before the model, and what
      the model gave is added to it once it is written.  A run that is done again after a
      failure hence calls for what is still missing.
    * The distinct chunks are spread over ``n`` tasks (explicit count, as without dedupe)
      and the translations written once (``materialize``): they are the expensive output,
      and the join back may be recomputed without calling the model again.
    * The join back on the hash is an equi-join whose one-row-per-key side AQE broadcasts
      when small; a hot key on the chunk side is split by AQE's skew join."""
    keyed = df.withColumn("_ck", F.sha2(F.concat_ws("\u0000", "target_language", "chunk"), 256))
    uniq = keyed.groupBy("_ck").agg(F.any_value("chunk").alias("chunk"),
                                    F.any_value("target_language").alias("target_language"))
    if memory is not None:
        known = materialize(uniq.select("_ck").join(memory.known().hint("merge"), "_ck").select(
            "_ck", "translated", F.lit(0).alias("attempts"), F.lit(0).cast("bigint").alias("wait_s"),
            F.lit(None).cast("string").alias("error")))
        uniq = uniq.join(known.select("_ck"), "_ck", "left_anti")
    spread = uniq.repartition(n, "_ck")
    done = materialize(spread.mapInPandas(fn, _result_schema(spread)).drop("chunk", "target_language"))
    if memory is not None:
        memory.add(done)
        done = done.unionByName(known)
    return keyed.join(done, "_ck").drop("_ck")


def wave_of(position: Column, first: int) -> Column:
    """Wave of a chunk by its position in the book: waves double, so a book of n chunks takes
    about log2(n / first) of them."""
    return (F.length(F.bin(F.floor(position / F.lit(first)) + 1)) - 1).cast("int")


def translate_in_waves(chunks: DataFrame, model=None, *, store: RunStore, run: str, first: int = 8,
                       **options) -> DataFrame:
    """Translates the chunks of every book in waves and stops a book after the wave in which a
    chunk of it has failed for good: its later chunks are never sent to the model.

    * Positions are running sums over slim rows (no book is gathered).  Wave w of a book holds
      ``first * 2**w`` chunks, so a failed book costs at most about twice the calls up to its first
      failure (and ``first``), and the number of waves grows with the logarithm of the largest book.
    * Between waves, books that have failed leave by an anti-join.
    * A wave is written and published (``store``) before the next begins: done again, the run goes
      on after the last wave that is there.

    Returns the translated chunks of all waves, with ``wave``."""
    slim = chunks.select(*CHAPTER_KEY, "chunk_idx")
    placed = running_sums(slim, ["book_id"], ["id", "ordinal", "chunk_idx"], {"_pos": F.lit(1)})
    waves = materialize(placed.select(*CHAPTER_KEY, "chunk_idx", wave_of(F.col("_pos"), first).alias("wave")))
    last = waves.agg(F.max("wave")).first()[0]
    there = {r.run for r in store.runs().collect()}
    failed = None
    for w in range(-1 if last is None else last + 1):
        name = f"{run}-wave-{w}"
        if name not in there:
            todo = waves.where(F.col("wave") == w)
            if failed is not None:
                todo = todo.join(failed, todo["book_id"].eqNullSafe(failed["_failed"]), "left_anti")
            work = null_safe_join(chunks, todo, [*CHAPTER_KEY, "chunk_idx"])
            store.put(name, chunks=translate_chunks(work, model, **options))
        got = store.read("chunks")
        failed = got.where(F.col("error").isNotNull() & F.col("run").startswith(f"{run}-wave-")).select(
            F.col("book_id").alias("_failed")).distinct()
    out = store.read("chunks") if last is not None else None
    if out is None:
        return translate_chunks(chunks.withColumn("wave", F.lit(0)), model, **options)
    return out.where(F.col("run").startswith(f"{run}-wave-")).drop("run")


def book_outcomes(chapters: DataFrame) -> DataFrame:
    """All or nothing per book, from reassembled chapter rows (``failed``, ``error``,
    ``n_chunks``, ``n_calls``): the book fails if any chunk failed; the reported error is
    the one of the first failing chapter in (id, ordinal) order.  An aggregate, so a
    huge book is combined map-side first."""
    first = F.struct("id", "ordinal")
    return chapters.groupBy("book_id").agg(
        F.bool_or("failed").alias("failed"),
        F.min_by(F.col("error"), F.when(F.col("failed"), first)).alias("error"),
        F.sum("n_chunks").cast("bigint").alias("n_chunks"),
        F.sum("n_calls").cast("bigint").alias("n_calls"),
    )


def ok_books(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(~F.col("failed")).select("book_id")


def build_prompts(chunks: DataFrame, target_language: str = C.DEFAULT_TARGET_LANGUAGE,
                  options: C.ModelOptions = C.ModelOptions()) -> DataFrame:
    """Chat messages per chunk (system template naming the language twice + user text)
    and the model options that go with each call."""
    system = (options.system_template.replace("{source}", options.source_language)
              .replace("{target}", target_language))
    msgs = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("chunk").alias("content")),
    )
    return chunks.select(*CHAPTER_KEY, "chunk_idx", msgs.alias("messages"),
                         F.lit(options.model).alias("model"),
                         F.lit(options.temperature).alias("temperature"),
                         F.lit(options.max_tokens).alias("max_tokens"))


def parse_completion(responses: DataFrame, col: str = "response") -> DataFrame:
    """``choices[0].message.content`` of a chat-completion JSON body."""
    return responses.withColumn("content", F.get_json_object(col, "$.choices[0].message.content"))
