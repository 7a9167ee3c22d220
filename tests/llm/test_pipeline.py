"""The pipeline against brute force, stage by stage, on the small data."""

import collections

import corpus_pipeline
from ledgerlens.llm import decontaminate, mixing, quality_qda, secret_scan, simhash_dedup
from ledgerlens.llm.common import read, stored
from oracle_compare import canonical
from test_llm_brute import brute_classes


def test_stages_and_run(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    columns, after = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"test{i}")
        after.append(docs)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in after]

    # Quality: the documents that the classifier accepts.
    whole = read(spark, sf_dir, "documents")
    good = quality_qda.quality_scores(whole, labels).where("predicted = 1")
    assert ids[0] == sorted(r.doc_id for r in good.collect())
    # Near-duplicates: the smallest id of each class by brute force over the fingerprints.
    rows = sorted((r.doc_id, r.text or "") for r in after[0].collect())
    classes = brute_classes([simhash_dedup.fingerprint_of(t.encode(), 3) for _, t in rows])
    assert ids[1] == sorted({rows[c][0] for c in classes})
    # Decontamination: no document that shares most five-grams of an item.
    grams = collections.defaultdict(set)
    items = {r.item_id: decontaminate.tokens_of(r.text) for r in read(spark, sf_dir, "benchmark").collect()}
    for i, w in items.items():
        for k in range(len(w) - 4):
            grams[tuple(w[k:k + 5])].add(i)

    def leaked(text):
        w, hits = decontaminate.tokens_of(text), collections.Counter()
        for k in range(len(w) - 4):
            hits.update(grams.get(tuple(w[k:k + 5]), ()))
        return any(n >= 0.7 * (len(items[i]) - 4) for i, n in hits.items())

    assert ids[2] == sorted(r.doc_id for r in after[1].collect() if not leaked(r.text or ""))
    # Secrets: every document stays; what was confirmed is overwritten, other texts are unchanged.
    assert ids[3] == ids[2]
    found = {r.doc_id for r in secret_scan.scan(after[2]).where("is_secret").collect()}
    before = {r.doc_id: r.text for r in after[2].collect()}
    for r in after[3].collect():
        assert (r.text != before[r.doc_id]) == (r.doc_id in found)
    # Mixing: as its SQL says.
    import duckdb
    con = duckdb.connect()
    con.register("documents", after[3].toPandas())
    want = con.execute(mixing.mix_oracle())
    names = [d[0] for d in want.description]
    assert canonical(after[4].columns, [tuple(r) for r in after[4].collect()]) == canonical(names, want.fetchall())
    assert after[4].count() > 0

    run = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, run.collect()), key=str) == sorted(map(tuple, after[4].collect()), key=str)
