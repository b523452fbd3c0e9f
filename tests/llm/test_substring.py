import hashlib
import random

import numpy as np
import pytest

from vellum.llm import fm_index, substring

from .data import SCHEMA, corpus, with_clashes

SPACE = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


def brute(rows, length=20):
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = split(t)
        gone = set()
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            if k in seen:
                gone.update(range(i, i + length))
            seen.add(k)
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"shard_words": 300}, {"hot": 1}])
def test_removal_equals_brute_force(spark, options):
    rows = corpus(5)
    got = substring.remove_repeats(with_clashes(spark.createDataFrame(rows, SCHEMA)), **options)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == brute(rows)


def test_repeated_rows_null_ids_kept_text_and_empty_tables(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, t), (3, t), (None, t), (7, "x " + t), (8, None)], SCHEMA)
    got = sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in substring.remove_repeats(df, with_text=True).collect())
    assert got == [("3", 0, t), ("3", 0, t), ("7", 30, "x"), ("8", 0, ""), ("None", 30, "")]
    assert substring.remove_repeats(df.limit(0)).collect() == []


def test_fm_index_finds_first_places():
    rnd = np.random.default_rng(1)
    for _ in range(60):
        n, length = int(rnd.integers(30, 300)), int(rnd.integers(1, 21))
        x = np.append(rnd.integers(1, 5, n), 0)
        places = np.arange(n - length + 1)
        first, want = {}, []
        for p in places:
            want.append(first.setdefault(tuple(x[p:p + length]), p))
        assert fm_index.earliest(x, places, length).tolist() == want


def test_words_of_texts_longer_than_a_block(spark, monkeypatch):
    from vellum.llm import wordhash
    rnd = random.Random(2)
    text = "".join(rnd.choice(["ab", "é", "C", " ", "\n", "x" * 50]) for _ in range(4000))
    import pyarrow as pa
    whole = [x[6] for x in wordhash.batch_words(pa.array([text]), True)]
    monkeypatch.setattr(wordhash, "BLOCK_BYTES", 512)
    parts = [x[6] for x in wordhash.batch_words(pa.array([text]), True)]
    assert np.array_equal(np.concatenate(whole), np.concatenate(parts))
    assert len(whole[0]) == len(split(text))
