import pytest

from tramline.llm import registry
from tramline.llm.common import remove_stored

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pfair_mixing": {"doc_id": "bigint", "source": "string", "block": "bigint", "slot": "bigint", "position": "bigint"},
    "op2_nonnegative_pu": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_chroma_fingerprints": {"kind": "string", "id": "bigint", "class_id": "bigint", "match_id": "bigint", "offset": "int", "overlap": "int", "bit_errors": "double"},
    "op4_simhash_deletion_variants": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_sampled_splitters": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6_conditional_random_field": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op7_directly_addressable_codes": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_greedy_string_tiling": {"doc_id": "bigint", "contaminated": "boolean", "coverage": "double"},
    "op9_kneser_ney_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_text_to_tag_ratio": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op11_block_matrix_join": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op12_harmonic_grid": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13_importance_resampling": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    """Each query keeps its contract on a whole table: a row for each document, columns and types, and their bounds."""
    out = getattr(registry, name)(spark, SF)
    kinds = dict(out.dtypes)
    assert {k: kinds.get(k) for k in COLUMNS[name]} == COLUMNS[name]
    rows = out.collect()
    table = {"op3_chroma_fingerprints": "embeddings", "op11_block_matrix_join": "embeddings", "op10_text_to_tag_ratio": "pages"}.get(name, "documents")
    whole = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name.startswith("op11"):
        whole = 20 * spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 20 = 0").count()
    assert sum(getattr(r, "kind", "member") == "member" for r in rows) == whole
    for r in rows:
        if name.startswith("op2"):
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        elif name.startswith("op4"):
            assert len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() and r.component_id <= r.doc_id
        elif name.startswith("op8"):
            assert r.contaminated == (r.coverage >= 0.6)
        elif name.startswith("op9"):
            assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
        elif name.startswith("op10"):
            assert r.n_chars == len(r.text)
    assert remove_stored(spark) >= 0


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_oracle(spark, name):
    """The query's rows are those of its SQL."""
    import duckdb

    with duckdb.connect() as con:
        for table in ("documents", "embeddings", "benchmark"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        told = con.sql(registry.oracle_sql()[name])
        names = sorted(told.columns)
        want = sorted(told.select(*names).fetchall(), key=str)
    got = getattr(registry, name)(spark, SF)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want
