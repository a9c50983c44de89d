import corpus_pipeline
from lumbre.llm.queries import held_out
from lumbre.session import cut_lineage
from tests.llm.brute import groups, hits, repeats

BASE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents):
    """Each stage on what its predecessor kept, held against the plain version of its operator."""
    bench = [r["text"] for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect()]
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = cut_lineage(stage(spark, docs, BASE), "test")
        rows = out.collect()
        after = {r["doc_id"]: r for r in rows}
        texts = [r["text"] for r in before.values()]
        if name != "packing":
            assert out.columns == columns and len(rows) == len(after)
        if name == "near duplicates":
            assert set(after) == {g for _, g in groups([(k, r["text"]) for k, r in before.items()])}
        elif name == "substring dedup":
            for (k, r), (_, gone, kept) in zip(before.items(), repeats(texts, 35)):
                assert after[k]["text"] == (kept if gone else r["text"])
        elif name == "benchmark decontamination":
            assert set(after) == {k for k, (_, n, _) in zip(before, hits(texts, bench, 10)) if not n}
        elif name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
        elif name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BASE}/labels.parquet").where(held_out()).collect()}
            clean = [k for k in before if labels.get(k) == 0]
            assert sum(k in after for k in clean) >= 0.97 * len(clean)
            assert all(after[k] == before[k] for k in after)
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "substring dedup", "benchmark decontamination", "packing"]


def test_run(spark):
    assert corpus_pipeline.run(spark, BASE).count() > 0


def test_stages_take_odd_rows(spark, odd, no_rows):
    named = odd.select("doc_id", "text", odd["row"].alias("lang"), odd["key"].alias("source"), odd["doc_id"].alias("n_chars"), "bucket", "score", "kept")
    for rows in (named, named.limit(0)):
        docs = rows
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, BASE)
            assert _ == "packing" or out.columns == rows.columns
            docs = cut_lineage(out, "test")
