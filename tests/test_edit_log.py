"""The edit log against a fold by hand."""
import random

from vellum.operators import edit_log as E

LOG = "book_id string, seq bigint, op string, id bigint, content string"
CHAPTERS = "book_id string, id bigint, ordinal bigint, content string"


def by_hand(chapters, log):
    books, out = {}, []
    for b, i, o, c in sorted(chapters, key=lambda r: (r[0], r[2])):
        books.setdefault(b, []).append([i, o, c])
    nxt = {b: max(x[1] for x in v) + 1 for b, v in books.items()}
    for b, seq, op, i, c in sorted(log, key=lambda r: (r[0], r[1])):
        live = books.setdefault(b, [])
        status = "applied"
        if op == "append":
            i = max((x[0] for x in live), default=0) + 1
            live.append([i, nxt.get(b, 0), ""])
            nxt[b] = nxt.get(b, 0) + 1
        elif not any(x[0] == i for x in live):
            status = "missing"
        elif op == "update":
            for x in live:
                x[2] = c if x[0] == i else x[2]
        elif all(x[0] == i for x in live):
            status = "refused"
        else:
            books[b] = [x for x in live if x[0] != i]
        out.append((b, seq, op, i, status))
    return sorted((b, *x) for b, v in books.items() for x in v), sorted(out)


def check(spark, chapters, log):
    run = E.apply_log(spark.createDataFrame(chapters, CHAPTERS), spark.createDataFrame(log, LOG))
    want = by_hand(chapters, log)
    assert sorted(map(tuple, run.chapters.collect())) == want[0]
    assert sorted(map(tuple, run.outcomes.collect())) == want[1]


def test_random_logs(spark):
    rnd = random.Random(4)
    chapters, log = [], []
    for b in range(60):
        n = rnd.randrange(0, 7)
        chapters += [(f"b{b}", rnd.choice([i + 1, i + 1, rnd.randrange(1, 9)]), i, f"text {i}") for i in range(n)]
        for seq in range(rnd.randrange(0, 25)):
            op = rnd.choice(["append", "update", "remove", "remove"])
            log.append((f"b{b}", seq * 3, op, None if op == "append" else rnd.randrange(1, 12), f"v{seq}" if op == "update" else None))
    rnd.shuffle(log)
    check(spark, chapters, log)


def test_an_id_comes_back_after_a_removal_and_old_updates_do_not_follow_it(spark):
    chapters = [("b", 1, 0, "one"), ("b", 2, 1, "two")]
    log = [("b", 1, "update", 2, "old"), ("b", 2, "remove", 2, None), ("b", 3, "append", None, None),
           ("b", 4, "remove", 1, None), ("b", 5, "remove", 2, None), ("b", 6, "append", None, None), ("b", 7, "update", 3, "new")]
    check(spark, chapters, log)
    run = E.apply_log(spark.createDataFrame(chapters, CHAPTERS), spark.createDataFrame(log, LOG))
    assert sorted(map(tuple, run.chapters.collect())) == [("b", 2, 2, ""), ("b", 3, 3, "new")]
    assert [r.status for r in run.outcomes.orderBy("seq").collect()] == ["applied"] * 4 + ["refused"] + ["applied"] * 2


def test_edges(spark):
    check(spark, [], [("new", 1, "remove", 1, None), ("new", 2, "append", None, None), ("new", 3, "update", 1, "x"),
                      ("new", 4, "remove", 1, None)])
    check(spark, [("b", 5, 0, "a"), ("b", 5, 1, "b")], [("b", 1, "remove", 5, None), ("b", 2, "update", 5, "c")])
    check(spark, [("b", 1, 0, "a")], [])
    run = E.apply_log(spark.createDataFrame([("b", 1, 0, "a")], CHAPTERS),
                      spark.createDataFrame([(None, 1, "append", None, None), ("b", None, "append", None, None),
                                             ("b", 1, "remove", None, None)], LOG))
    assert [tuple(r) for r in run.chapters.collect()] == [("b", 1, 0, "a")] and run.outcomes.count() == 0
