"""Near-duplicates against a brute-force version over all pairs."""
import random
import re

import pytest

from vellum.llm import near_dup

from .data import SCHEMA, corpus, with_clashes


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset([tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else [])


def brute(rows, percent=85):
    """Rows of one doc_id are one document."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (union and 100 * inter >= percent * union) or (rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    root = {}
    for i, (d, _) in enumerate(rows):
        root[find(i)] = min(d, root.get(find(i), d))
    return {(d, len(sets[i]), root[find(i)], root[find(i)] == d) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("options", [{}, {"k": 16, "floor": 0.2}, {"fine_k": 32, "fine_floor": 0.3}])
def test_components_equal_brute_force(spark, options):
    """Small sketches retain few sets whole; the floors are low enough for these texts."""
    rows = corpus(3)
    got = near_dup.near_duplicates(with_clashes(spark.createDataFrame(rows, SCHEMA)), **options)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_a_document_with_several_texts_has_the_links_of_each(spark):
    rnd = random.Random(8)
    w = [f"w{i}" for i in range(900)]
    short = w[:60]
    rows = [(5, " ".join(w)), (5, " ".join(short)), (7, " ".join(short[:-1] + ["x"])), (9, " ".join(w[:-1] + ["y"])),
            (9, " ".join(w[:-1] + ["y"])), (11, "alone here with five words"), (5, None), (12, "")]
    assert {tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
    assert {r[2] for r in brute(rows) if r[0] in (7, 9)} == {5}
    mixed = [(d % 23 if d % 4 else d, t) for d, t in corpus(3)]
    rnd.shuffle(mixed)
    got = near_dup.near_duplicates(spark.createDataFrame(mixed, SCHEMA), fine_k=32, fine_floor=0.3)
    want = brute(mixed)
    empty = {d for d, n, _, _ in want if not n}
    assert {tuple(r) for r in got.collect() if r.n_shingles} == {r for r in want if r[1]}
    assert {r.doc_id for r in got.collect() if not r.n_shingles} == empty


def test_null_ids_repeated_rows_and_empty_tables(spark):
    text = "a b c d e f g h i j"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (9, None)], SCHEMA)
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [("2", 2, True), ("4", 2, False), ("4", 2, False), ("9", 9, True), ("None", None, True)]
    assert near_dup.near_duplicates(df.limit(0)).collect() == []
    kept = near_dup.keep_representatives(with_clashes(df))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "9", "None"]


def test_floors_follow_the_threshold(spark):
    """Two texts at exactly 0.80 whose sketches share 380 of 512 values, fewer than the floor of
    0.85 asks for; the floors and the margin of the usual threshold stay."""
    w = [f"a1108x{i}" for i in range(8004)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:6404]))], SCHEMA)
    assert [r.component_id for r in near_dup.near_duplicates(df, percent=80).collect()] == [1, 1]
    assert [r.kept for r in near_dup.near_duplicates(df).collect()] == [True, True]
    assert near_dup.margin_of(85, 512) == 0.12 and near_dup.floor_of(85, 512) == near_dup.FINE_FLOOR
    assert {tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(corpus(3), SCHEMA), fine_k=32, fine_floor=0.3).collect()
            } == brute(corpus(3))
