import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vellum.llm import merkle
from vellum.session import scratch_path

from .data import CLASHING

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(d, t, lang, s, n):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (d, s, lang, n, t)])


def tree(nodes):
    """(root, per leaf the list of (left, right) siblings), level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 3 * 3:a // 3 * 3 + 3]
            ways[i].append((run[:a % 3], run[a % 3 + 1:]))
        nodes = [H(*nodes[k:k + 3]) for k in range(0, len(nodes), 3)]
        at = [a // 3 for a in at]
    return nodes[0], ways


def brute(rows):
    per = defaultdict(list)
    for d, t, lang, s, n in rows:
        bad = d is not None and t is not None and zlib.crc32(str(d).encode()) % 2 == 0
        per[s].append((d is not None, d or 0, leaf(d, t, lang, s, n), d, leaf(d, t.replace("\n", "") if bad else t, lang, s, n)))
    order = sorted(per, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        per[s].sort(key=lambda x: (x[0], x[1], bytes.fromhex(x[2])))
        built[s] = tree([x[2] for x in per[s]])
    root, tops = tree([built[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for x, way in zip(per[s], built[s][1]):
            path, acc = way + top, x[4]
            for left, right in path:
                acc = H(*left, acc, *right)
            out.append((x[3], x[2], built[s][0], root, H(*[h for lr in path for part in lr for h in part]), acc, acc == root))
    return sorted(out, key=str)


def rows_of(seed, sizes):
    rnd, rows = random.Random(seed), []
    for s, n in sizes.items():
        for i in range(n):
            text = rnd.choice([None, "", "one\ntwo", "é \nü" * 5, f"text {rnd.random()}"])
            rows.append((rnd.randrange(10**6), text, rnd.choice(["en", None]), s, rnd.choice([None, 7, 12])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [
    {"hot": 200, "a": 1, "b": 2, "c": 3, "d": 4, None: 10, "é": 28, "": 9, "~": 27},
    {"only": 1}, {"x": 1, "y": 1}, {f"s{i}": 1 for i in range(11)},
])
def test_proofs_and_roots_equal_brute_force(spark, sizes):
    rows = rows_of(len(sizes), sizes)
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA), tampered=merkle.stripped_newlines()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_nulls_repeats_clashing_columns_and_no_rows(spark):
    rows = [(5, "a\nb", "en", "s", 3)] * 4 + [(None, None, None, None, None), (None, "x\n", "en", "s", 2), (8, "\n", None, "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("clash") for c in [*CLASHING, "tree", "idx", "level", "leaf", "segs", "other", "root"]})
    got = merkle.verify(df, tampered=merkle.stripped_newlines()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    empty = merkle.verify(df.limit(0))
    assert empty.collect() == [] and empty.columns == merkle.verify(df).columns
    assert all(r.verified for r in merkle.verify(df).collect())         # nothing tampered with


def test_a_very_long_text_is_one_leaf(spark):
    rows = [(1, "line\n" * 400_000, "en", "s", 2_000_000), (2, "x", "en", "s", 1)]
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA), tampered=merkle.stripped_newlines()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_proofs_come_out_of_small_joins_without_a_broadcast_too(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    rows = rows_of(3, {"a": 40, "b": 5})
    got = merkle.verify(spark.createDataFrame(rows, SCHEMA), tampered=merkle.stripped_newlines()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_manifest_is_written_with_every_node(spark):
    df = spark.createDataFrame(rows_of(9, {"a": 14, "b": 1}), SCHEMA)
    m = merkle.build(df.select("source", "doc_id", merkle.leaf_digest({c: F.col(c) for c in merkle.COLUMNS}).alias("digest"),
                               F.lit(None).cast("binary").alias("other")))
    at = scratch_path(spark, "manifest")
    merkle.write(m, at)
    kids = spark.read.parquet(f"{at}/nodes").select(F.explode("kids")).count()
    assert kids == (14 + 5 + 2) + 2                 # levels of a; the two subroots under the root
    assert spark.read.parquet(f"{at}/subroots").count() == 2
    assert m.root == merkle.verify(df).first().root
