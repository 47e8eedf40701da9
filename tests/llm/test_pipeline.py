"""The pipeline's stages and the contract of its registration."""

import corpus_pipeline
from cadenza.llm import entry


def test_stages(spark, sf_dir, documents, labels):
    docs = documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name != "sentencepiece":
            assert docs.columns == documents.columns
    n = documents.count()
    clean = {r["doc_id"] for r in labels.where("toxic = 0 and quality = 1").collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    assert len(clean & set(kept["toxicity"])) > 0.97 * len(clean)
    assert len(toxic & set(kept["toxicity"])) < 0.5 * len(toxic)
    assert set(kept["simhash"]) <= set(kept["quality"]) <= set(kept["toxicity"]) and len(kept["toxicity"]) <= n
    assert len(set(kept["simhash"])) == len(kept["simhash"])
    assert sorted(kept["mixing"]) == sorted(kept["sentencepiece"])


def test_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len(names) == 14 and "pipeline" in names
