import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vellum.llm import packing, token_count, tokenizer
from vellum.llm.queries import VOCABULARY

from .data import SCHEMA, corpus, with_clashes

JSON = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return JSON.encode(text or "", add_special_tokens=False).ids


def odd_texts(n):
    rnd = random.Random(4)
    pools = ["abc XYZ 's't 123 \n\t .,!?", "éèüßñ", "　\u200b\x85\x1c\x0b", "中文字", "😀👍🏽\u200d", "१२३Ⅷ²½", "\x00\x7f"]
    return ["".join(rnd.choice(rnd.choice(pools)) if rnd.random() < .9 else "<|endoftext|>"
                    for _ in range(rnd.randrange(1, 40))) for _ in range(n)]


def test_ranks_give_the_ids_of_the_json_vocabulary():
    for t in odd_texts(4000) + [t for _, t in corpus() if t]:
        assert tokenizer.ids(VOCABULARY, t) == ids(t), t


def test_long_texts_are_cut_at_safe_places(monkeypatch):
    text = " ".join(odd_texts(300)) + " word" * 500
    monkeypatch.setattr(tokenizer, "PIECE_CHARS", 100)
    parts = list(tokenizer.pieces(text, 100))
    assert "".join(parts) == text and len(parts) > 10
    assert tokenizer.ids(VOCABULARY, text) == ids(text)


def long_runs():
    prose = "some prose here " * 200
    return {"spaces": " " * 1_000_000, "newlines": "\n" * 1_000_000, "one word": "a" * 1_000_000,
            "inside prose": prose + " " * 1_000_000 + prose}


def test_long_runs_equal_the_json_vocabulary(spark):
    """The rank encoder's word pattern gives up on such texts."""
    rows = list(enumerate(long_runs().values()))
    df = spark.createDataFrame(rows, SCHEMA)
    want = {d: len(ids(t)) for d, t in rows}
    assert all(tokenizer.ids(VOCABULARY, t) == ids(t) for _, t in rows)
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, VOCABULARY).collect()} == want
    sizes = defaultdict(int)
    for r in packing.pack(df, VOCABULARY).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {d: n + 1 for d, n in want.items()}


def test_counts(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts(50) + [None, "", "word " * 30000])] + [(None, "x"), (1, "y")]
    got = token_count.count_tokens(with_clashes(spark.createDataFrame(rows, SCHEMA)), VOCABULARY).collect()
    want = sorted((str(d), len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_count.count_tokens(spark.createDataFrame([], SCHEMA), VOCABULARY).collect() == []


def test_sentencepiece_and_json_vocabularies(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = list(enumerate(odd_texts(20)))
    df = spark.createDataFrame(rows, SCHEMA)
    for name, f in (("piece_bpe_32k.model", sp.encode), ("byte_bpe_50k.json", ids)):
        got = {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, f"public:{name}").collect()}
        assert got == {i: len(f(t)) for i, t in rows}


def test_packing_round_trip(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(f"t{rnd.randrange(99)}" for _ in range(rnd.choice([0, 1, 5, 60, 300, 900])))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "null id"), (5, rows[5][1])]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA))
    got = packing.pack(df, VOCABULARY, seq_len=256, with_ids=True).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) <= 256 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for d, t in rows:
        if d in (None, 5):
            continue
        p = sorted(docs[d], key=lambda r: r.piece)
        assert [r.piece for r in p] == list(range(len(p)))
        assert [x for r in p for x in r.ids] == ids(t) + [0]
        assert [r.start for r in p] == list(np.cumsum([0] + [r.length for r in p])[:-1])
        assert all(r.length == 256 for r in p[1:])
    assert len(docs[5]) == 2 * len(ids(rows[5][1]) + [0]) // 256 + 2 or len(docs[5]) % 2 == 0
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == list(np.cumsum([0] + [r.length for r in s])[:-1])
        assert sum(r.length for r in s) <= 256
    total = sum(r.length for r in got)
    assert len(seqs) <= 1.02 * -(-total // 256) + 1
    assert packing.pack(df.limit(0), VOCABULARY).collect() == []


def test_sweep_equals_best_fit_decreasing():
    rnd = random.Random(3)
    for _ in range(40):
        sizes = [rnd.randrange(1, 101) for _ in range(rnd.randrange(1, 400))]
        runs = defaultdict(int)
        for s in sizes:
            runs[s] += 1
        gaps = []
        for s in sorted(sizes, reverse=True):
            fit = min((g for g in gaps if g >= s), default=None)
            if fit is None:
                gaps.append(100 - s)
            else:
                gaps[gaps.index(fit)] -= s
        used = set()
        for _, _, n, per, first, _ in packing.sweep(dict(runs), 100):
            used.update(range(first, first + -(-n // per)))
        assert len(used) == len(gaps)
