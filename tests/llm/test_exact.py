import hashlib
import re
from collections import defaultdict

from vellum.llm import exact_dedup
from vellum.session import scratch_path

from .data import SCHEMA, corpus, with_clashes


def test_decisions_equal_brute_force(spark):
    rows = corpus(7)
    got = exact_dedup.DigestIndex(spark).add(with_clashes(spark.createDataFrame(rows, SCHEMA))).collect()
    groups = defaultdict(list)
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows}
    for d, t in norm.items():
        groups[t].append(d)
    want = {(d, min(groups[t]), len(groups[t]), min(groups[t]) == d, hashlib.sha256(t.encode()).hexdigest())
            for d, t in norm.items()}
    assert {tuple(r) for r in got} == want


def test_later_batches_meet_the_index_and_a_rerun_changes_nothing(spark):
    at = scratch_path(spark, "test-index")
    first = spark.createDataFrame([(5, "a  b"), (6, "c"), (7, "a b")], SCHEMA)
    later = spark.createDataFrame([(1, "a b"), (2, "d"), (None, "e"), (9, "d")], SCHEMA)
    index = exact_dedup.DigestIndex(spark, at, buckets=4)
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.add(first).collect()} == {(5, 5, True), (6, 6, True), (7, 5, False)}
    again = exact_dedup.DigestIndex(spark, index.table.location)
    want = {(1, 5, False), (2, 2, True), (9, 2, False), (None, None, True)}
    for _ in range(2):
        assert {(r.doc_id, r.keep_id, r.kept) for r in again.add(later).collect()} == want
        assert again.table.read().count() == 4
    assert again.add(later.limit(0)).collect() == [] and again.table.read().count() == 4


def test_keep_first_keeps_one_row_per_text_with_all_columns(spark):
    df = with_clashes(spark.createDataFrame([(2, "x"), (2, "x"), (1, "x "), (3, None), (4, ""), (None, "n")], SCHEMA))
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "x "), ("2", "x"), ("3", None), ("None", "n")]
