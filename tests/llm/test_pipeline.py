"""The pipeline's stages against plain versions, each on the stage's own input."""
import corpus_pipeline as P

from vellum.llm import toxicity
from vellum.llm.common import land

from .test_decontaminate import distance, norm
from .test_exact import re
from .test_near_dup import brute as near_brute
from .test_tokens import ids

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = land(stage(spark, docs, SF), f"t-{name}")
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert all(before[d] == t for d, t in after.items())
        if name == "toxicity":
            bad = {r.doc_id for r in toxicity.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.predicted}
            assert set(after) == set(before) - bad
        elif name == "exact_dedup":
            first = {}
            for d in sorted(before):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[d]), d)
            assert set(after) == set(first.values())
        elif name == "near_dup":
            assert set(after) == {d for d, _, _, kept in near_brute(sorted(before.items()), 80) if kept}
        else:
            gone = set(before) - set(after)
            for d in list(gone) + sorted(after)[:25]:
                text = norm(before[d])[:6000] if d in after else norm(before[d])
                hit = any(q in text or distance(q, text) <= int(0.1 * len(q)) for _, q in
                          (bench if d in gone else bench[:8]) if len(q) >= 32)
                assert hit == (d in gone), d
        docs, before = out, after
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    sizes = {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {d: len(ids(t)) + 1 for d, t in before.items()}


def test_run_returns_the_last_stage(spark):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(P.run(spark, SF).columns)
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dup", "decontaminate", "packing"]
