import corpus_pipeline as C
from helpers import contaminated, near_classes

from barlake.llm import toxicity
from barlake.llm.common import stored


def test_each_stage_against_brute_force(spark):
    """Each stage is judged on what its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert [n for n, _ in C.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    columns = docs.columns
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stored(stage(spark, docs, sf), f"stage-{name}")
        after = out.collect()
        if name == "toxicity":
            lexicon = toxicity.learn(docs, labels)
            want = {i for i, r in before.items() if lexicon.score(r.text) < 0.5}
        elif name == "near_duplicates":
            classes = near_classes([(i, r.text) for i, r in before.items()], 5, 80, 100)
            want = {i for i, c in classes.items() if c == i}
        elif name == "decontamination":
            hits = contaminated([(i, r.text) for i, r in before.items()], items, 10)
            want = {i for i, h in zip(before, hits) if not h[1]}
        else:
            want = {r.doc_id for r in after}
        assert {r.doc_id for r in after} == want and want <= set(before)
        if name == "sharding":
            assert len(after) == docs.count()
            for s in range(16):
                assert sorted(r.slot for r in after if r["shard"] == s) == list(range(sum(r["shard"] == s for r in after)))
        else:
            assert out.columns == columns
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in after)
            assert name == "mixing" or len(after) == len(want)
        docs = out


def test_an_empty_table_passes_through(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
