"""Chunking, translation with retry, reassembly and the all-or-nothing rule."""
from pyspark.sql import functions as F

from vellum import config as C
from vellum.operators import chunking, translate
from vellum.plans import faults, pipeline

from conftest import chapters_df


def test_long_chapter_is_cut_into_4000_character_chunks(spark):
    ch = chapters_df(spark, [(1, "A" * 24000), (2, "B" * 7000), (3, "short"), (4, "")])
    plan = {r.id: r.n_chunks for r in chunking.chunk_plan(ch).collect()}
    assert plan == {1: 6, 2: 2, 3: 1, 4: 1}
    chunks = chunking.chunk_chapters(ch).where("id = 1").orderBy("chunk_idx").collect()
    assert [len(r.chunk) for r in chunks] == [4000] * 6


def test_identity_reassembly_strips_each_chunk_and_joins_with_newline(spark):
    text = ("word " * 1000)[:8001] + "   "          # spaces at both seams
    ch = chapters_df(spark, [(1, text), (2, " " * 4000 + "tail")])
    t = pipeline.translate_books(ch, translate.IdentityModel())
    got = {r.id: r.content for r in t.chapters.collect()}
    pieces = [text[i:i + 4000] for i in range(0, len(text), 4000)]
    assert got[1] == "\n".join(p.strip() for p in pieces)
    assert got[2] == "\ntail"                         # blank chunk -> "" plus its separator


def test_mock_model_and_blank_short_circuit(spark):
    ch = chapters_df(spark, [(1, "This is the first chapter content."), (2, "  　 "), (3, "")])
    out = translate.translate_chunks(chunking.chunk_chapters(ch), translate.PreviewModel(),
                                     target_language="Espanhol")
    got = {r.id: (r.translated, r.attempts) for r in out.collect()}
    assert got[1] == ("Translated to Espanhol: This is the first ch...", 1)
    assert got[2] == ("", 0)
    assert got[3] == ("", 0)


def test_retry_attempts_waits_and_final_error(spark):
    rows = [(k, f"text {k}") for k in range(6)]
    ch = chapters_df(spark, rows)
    tr = faults.FlakyModel(faults.fail_first_by_key(100))
    out = translate.translate_chunks(chunking.chunk_chapters(ch), tr, key_col="id",
                                     sleep=translate.no_sleep)
    got = {r.id: (r.attempts, r.wait_s, r.error) for r in out.collect()}
    assert [got[k][0] for k in range(6)] == [1, 2, 3, 4, 4, 4]
    assert [got[k][1] for k in range(6)] == [0, 2, 6, 14, 14, 14]
    assert got[3][2] is None
    assert got[4][2] == "Translation error after 3 attempts: injected failure on attempt 4"


def test_failing_model_with_one_retry_calls_twice():
    calls = []

    class Always:
        def translate(self, text, lang, *, key=None, attempt=1):
            calls.append(attempt)
            raise RuntimeError("boom")

    waited = []
    res = translate.translate_one(Always(), "x", "Português", None, 1, waited.append)
    assert calls == [1, 2]
    assert waited == [2]
    assert res == (None, 2, 2, "Translation error after 1 attempts: boom")


def test_book_fails_as_a_whole_and_others_go_on(spark):
    a = chapters_df(spark, [(1, "ok one"), (2, "ok two")], book="good")
    b = chapters_df(spark, [(1, "fine"), (2, "FAIL here")], book="bad")
    tr = faults.FlakyModel(faults.fail_listed({"bad-2"}, 9))
    ch = a.unionByName(b).withColumn("fk", F.concat_ws("-", "book_id", F.col("id").cast("string")))
    t = pipeline.translate_books(ch, tr, key_col="fk", sleep=translate.no_sleep)
    out = {r.book_id: r.failed for r in t.outcomes.collect()}
    assert out == {"good": False, "bad": True}
    assert {r.book_id for r in t.chapters.collect()} == {"good"}


def test_translation_order_is_independent_of_input_order(spark):
    rows = [(3, "third"), (1, "first"), (2, "second")]
    t = pipeline.translate_books(chapters_df(spark, rows), translate.PreviewModel())
    got = sorted((r.id, r.content) for r in t.chapters.collect())
    assert got == [(1, "Translated to Português: first..."), (2, "Translated to Português: second..."),
                   (3, "Translated to Português: third...")]


def test_prompts_name_the_language_twice(spark):
    ch = chunking.chunk_chapters(chapters_df(spark, [(1, "hello")]))
    p = translate.build_prompts(ch, "Alemão").first()
    assert [m.role for m in p.messages] == ["system", "user"]
    assert p.messages[0].content.count("Alemão") == 2
    assert p.messages[1].content == "hello"
    assert (p.model, p.temperature, p.max_tokens) == (C.MODEL, 0.3, 4000)


def test_glossary_model_replaces_whole_words(spark):
    g = spark.sparkContext.broadcast({"cat": "gato", "the cat": "o gato", "dog": "cão"})
    ch = chapters_df(spark, [(1, "the cat saw a dog; concat stays"), (2, "Cat")])
    out = translate.translate_chunks(chunking.chunk_chapters(ch), translate.GlossaryModel(g))
    got = {r.id: r.translated for r in out.collect()}
    assert got == {1: "o gato saw a cão; concat stays", 2: "Cat"}


def test_flagship_drops_books_with_a_failed_chunk(spark):
    a = chapters_df(spark, [(1, "ok one"), (2, "ok two")], book="good")
    b = chapters_df(spark, [(1, "fine"), (2, "FAIL here")], book="bad")
    ch = a.unionByName(b).withColumn("fk", F.concat_ws("-", "book_id", F.col("id").cast("string")))
    tr = faults.FlakyModel(faults.fail_listed({"bad-2"}, 9))
    pages = pipeline.flagship(ch, tr, key_col="fk", sleep=translate.no_sleep).collect()
    assert sorted((r.book_id, r.id, r.page_no) for r in pages) == [("good", 1, 1), ("good", 2, 2)]
    t = pipeline.translate_books(ch, tr, key_col="fk", sleep=translate.no_sleep)
    assert sorted((r.book_id, r.page_no) for r in pipeline.numbered_pages(t).collect()) == \
        [("good", 1), ("good", 2)]



def counting_model(log):
    """Mock-like output; each call appends a line to ``log`` (calls counted across workers)."""
    def f(text, target_language):
        with open(log, "a") as fh:
            fh.write("x\n")
        return f"{target_language}: {text[:20]}"
    return translate.FunctionModel(f)


def test_dedupe_calls_once_per_distinct_chunk_and_keeps_every_row(spark, tmp_path):
    long = "".join(chr(65 + i % 26) for i in range(9000))          # 3 chunks, all different
    a = chapters_df(spark, [(1, long), (2, "same"), (3, "  ")], book="a")
    b = chapters_df(spark, [(1, long), (2, "same"), (3, "other")], book="b")
    ch = chunking.chunk_chapters(a.unionByName(b))
    logs = [str(tmp_path / "dedupe.log"), str(tmp_path / "plain.log")]
    out = translate.translate_chunks(ch, counting_model(logs[0]), dedupe=True)
    plain = translate.translate_chunks(ch, counting_model(logs[1]))
    cols = ["book_id", "id", "chunk_idx", "chunk", "translated", "attempts", "error"]
    assert sorted(out.select(*cols).collect()) == sorted(plain.select(*cols).collect())
    assert out.count() == ch.count() == 10
    # distinct non-blank chunks: 3 of the long chapter, "same", "other"; a blank one is no call
    assert len(open(logs[0]).read().splitlines()) == 5
    assert len(open(logs[1]).read().splitlines()) == 9
    opts = C.PipelineOptions(dedupe=True)
    fast = pipeline.flagship(a.unionByName(b), translate.PreviewModel(), opts)
    slow = pipeline.flagship(a.unionByName(b), translate.PreviewModel())
    assert sorted(fast.collect()) == sorted(slow.collect())


def test_each_chunk_reaches_the_model_once_across_branches(spark, tmp_path):
    long = "lorem ipsum " * 900                                      # 3 chunks
    ch = chapters_df(spark, [(1, long), (2, "two"), (3, "")], book="a").unionByName(
        chapters_df(spark, [(1, "solo")], book="b"))
    log = str(tmp_path / "calls.log")
    t = pipeline.translate_books(ch, counting_model(log))
    t.outcomes.collect()
    t.chapters.collect()
    pipeline.numbered_pages(t).collect()
    t.all_chapters.count()
    assert len(open(log).read().splitlines()) == 5                 # 3 + "two" + "solo"; "" is no call
    pages = pipeline.flagship(ch, counting_model(str(tmp_path / "flag.log")))
    pages.collect()
    pages.count()
    assert len(open(tmp_path / "flag.log").read().splitlines()) == 5
