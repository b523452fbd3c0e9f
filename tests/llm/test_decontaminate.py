import random

from vellum.llm import decontaminate

from .data import SCHEMA, with_clashes

ITEMS = "item_id bigint, text string"


def norm(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    return " ".join(x for x in t.split())


def distance(item, text):
    """Least edits from the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def fixture():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(12, 40)))) for i in range(6)] + [(50, None), (51, "short")]
    docs = []
    for k in range(40):
        t = [word() for _ in range(30)]
        if k % 2:
            text = list(items[k % 6][1])
            for _ in range(rnd.randrange(0, int(0.14 * len(text)))):
                p = rnd.randrange(len(text))
                text[p:p + 1] = rnd.choice([[], ["x"], [text[p], "y"]])
            t[15:15] = ["".join(text).replace(" ", "  " if k % 3 else " ").upper() if k % 5 == 1 else "".join(text)]
        docs.append((k, " ".join(t)))
    return docs + [(90, ""), (91, None), (92, "the " * 900)], items


def test_regions_equal_brute_force(spark):
    docs, items = fixture()
    got = decontaminate.find_regions(with_clashes(spark.createDataFrame(docs, SCHEMA)), spark.createDataFrame(items, ITEMS)).collect()
    want = set()
    for d, t in docs:
        for i, q in items:
            if q and len(norm(q)) >= decontaminate.MIN_CHARS and t:
                n = distance(norm(q), norm(t))
                if n <= int(decontaminate.ERROR * len(norm(q))):
                    want.add((d, i, n))
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(want) > 8
    text = dict(docs)
    for r in got:
        part = norm(text[r.doc_id][r.start:r.end])
        assert distance(norm(dict(items)[r.item_id]), part) == r.distance


def test_clustered_edits_and_items_of_unequal_length(spark):
    """Forty edits, eight characters apart, leave the 400 characters with 73 q-grams at two
    ends: exactly the bound, and at one end fewer than a window of the short item asks for."""
    rnd = random.Random(3)
    items = [(i, "".join(rnd.choice("etaoinshrdlu") for _ in range(n))) for i, n in enumerate((200, 400))]
    text = list(items[1][1])
    for p in range(52, 365, 8):
        text[p] = "x"
    docs = [(0, "".join(text)), (1, "".join(reversed(text))), (2, "y " * 300 + "".join(text) + " z" * 300 + items[0][1])]
    got = decontaminate.find_regions(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)).collect()
    want = {(d, i, distance(q, norm(t))) for d, t in docs for i, q in items}
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == {w for w in want if w[2] <= (20, 40)[w[1]]}
    assert (0, 1, 40) in want


def test_item_blocks_empty_tables_and_clean_rows(spark):
    docs, items = fixture()
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS)
    one = {tuple(r) for r in decontaminate.find_regions(df, bench).collect()}
    assert {tuple(r) for r in decontaminate.find_regions(df, bench, block_chars=100).collect()} == one
    assert decontaminate.find_regions(df.limit(0), bench).collect() == []
    assert decontaminate.find_regions(df, bench.limit(0)).collect() == []
    clashing = with_clashes(df.unionByName(spark.createDataFrame([(1, "clean text of a repeated id"), (None, "z")], SCHEMA)))
    kept = decontaminate.clean_documents(clashing, bench)
    dirty = {r[0] for r in one}
    assert kept.columns == clashing.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(
        map(str, [d for d, _ in docs if d not in dirty] + [1, None]))
