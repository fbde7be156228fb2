import corpus_pipeline
from tests.llm.test_dac import _expected
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_tiling import brute_tiles
from tramline.llm import mixing, quality, simhash, tiling
from tramline.llm.common import id_remainder

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights", "token codes"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        result = spark.read.parquet(str(tmp_path / str(n)))
        rows = result.collect()
        got = sorted(r.doc_id for r in rows)
        if n < 4:
            assert result.columns == names and {tuple(r) for r in rows} <= {tuple(r) for r in before}
        if n == 0:
            model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), may_learn=id_remainder(3) != 1)
            assert got == sorted(r.doc_id for r in before if model.score(quality.features(r.text)[None])[0] >= 0.5) and len(got) < len(before)
        elif n == 1:
            prints = {r.doc_id: brute_fingerprint(r.text) for r in before}
            pairs = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
            assert got == sorted(set(brute_components(prints, pairs).values())) and len(got) < len(before)
        elif n == 2:
            share = lambda t: max(sum(x[2] for x in brute_tiles(tiling.tokens(t)[:400], tiling.tokens(b), 5)) / len(tiling.tokens(b)) for _, b in bench)
            gone = {r.doc_id for r in before} - set(got)
            assert all(share(r.text) >= 0.6 for r in before if r.doc_id in gone and len(tiling.tokens(r.text)) <= 400)
            some = [r for r in before if r.doc_id not in gone and len(r.text or "") < 500][:10]
            assert all(share(r.text) < 0.6 for r in some)
        elif n == 3:
            place = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
            assert [place[r.doc_id] for r in rows] == list(range(len(before)))
        else:
            order = {r.doc_id: k for k, r in enumerate(before)}
            assert sorted((tuple(r) for r in rows), key=lambda r: r[1]) == _expected(before, lambda d: order[d.doc_id])
        docs = result
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_dedup_stage_does_not_broadcast_its_index(spark, monkeypatch):
    kept, stored = {}, simhash.stored
    monkeypatch.setattr(simhash, "stored", lambda df, tag: kept.setdefault(tag, df) and stored(df, tag))
    corpus_pipeline.deduplicate(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    plan = kept["simhash-index"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
