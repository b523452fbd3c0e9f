"""Small document sets for the tests of the llm operators."""
from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string"
#: Columns that a careless operator would trip over.
CLASHING = ["id", "value", "digest", "part", "kept", "spans", "n", "length", "key", "did", "__row", "component_id",
            "n_words", "features", "blob", "rule"]


def words(rnd: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Copies, near copies of one text by the dozen, a passage that many texts quote, short,
    empty and null texts, odd white space."""
    rnd = random.Random(seed)
    rows, base, passage = [], words(rnd, 120), words(rnd, 60, 10**6)
    for i in range(40):
        w = base[:]
        for _ in range(i % 5):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append(" ".join(w))
    for _ in range(30):
        rows.append(" ".join(words(rnd, 30, 10**6) + passage + words(rnd, 25, 10**6)))
    rows += [" ".join(words(rnd, rnd.randrange(1, 200))) for _ in range(30)]
    rows += [rows[45]] * 6 + [rows[0].upper()] * 3
    rows += ["", None, " \t\n", "one", "One", "a b c d", "a  b\tc d", "By " * 90, "By " * 120, "é\u00a0ü x y z w"]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in CLASHING})
