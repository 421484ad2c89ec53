"""The pipeline's stages, each against what its operator says of its own input."""

import corpus_pipeline as cp
from tessera.llm import language_id, minhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language_id", "near_dedup", "packing"]

    clean = cp.toxicity(spark, docs, SF)
    assert clean.columns == docs.columns
    scores = {r.doc_id: r.toxicity for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    kept = {r.doc_id for r in clean.collect()}
    assert kept == {d for d, p in scores.items() if p < 0.5}
    good = {r.doc_id for r in labels.filter("toxic = 0").collect()}
    assert len(good & kept) >= 0.97 * len(good)

    known = cp.language_id(spark, clean, SF)
    assert known.columns == docs.columns
    model = language_id.train(clean)
    found = {r.doc_id: r for r in language_id.identify_documents(clean, model).collect()}
    stay = {r.doc_id for r in clean.collect() if found[r.doc_id].language != "und" and (r.lang not in model.languages or r.lang == found[r.doc_id].language or found[r.doc_id].lead < 0.1)}
    assert {r.doc_id for r in known.collect()} == stay and len(stay) > 0.9 * len(kept)

    one = cp.near_dedup(spark, known, SF)
    assert one.columns == docs.columns
    groups = {r.doc_id: r.group_id for r in minhash.groups(known).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values()))

    packed = cp.pack(spark, one, SF)
    assert {r.doc_id for r in packed.collect()} <= set(groups.values())
    run = {tuple(r) for r in cp.run(spark, SF).collect()}
    assert run == {tuple(r) for r in packed.collect()}
