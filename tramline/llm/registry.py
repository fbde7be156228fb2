"""The queries of this subpackage, over the whole tables, with SQL oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tramline.llm import chroma, dac, htmltext, langid, melodies, mixing, neighbours, periodic, quality, resampling, secretscan, sharding, simhash, tiling
from tramline.llm.common import id_remainder, new_path, table


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_nonnegative_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), may_learn=id_remainder(3) != 1)
    rows = quality.scored(docs, model)
    return rows.select("doc_id", (id_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    return chroma.align(chroma.fingerprints(melodies.recordings(vectors)))


def op4_simhash_deletion_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40)


def op6_conditional_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = secretscan.scanned(docs, secretscan.train(docs))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_field")


def op7_directly_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    dac.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return dac.read_documents(spark, path)


def op8_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = tiling.tiled(docs, table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", (F.col("tiling.coverage") >= tiling.THRESHOLD).alias("contaminated"), "tiling.coverage", "tiling.item_id", "tiling.tiles", "tiling.items")


def op9_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, may_learn=id_remainder(4) != 2)
    rows = langid.predicted(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_text_to_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extracted(pages).select("page_id", "url", "text", "n_chars")


def op11_block_matrix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("values"))
    return neighbours.nearest(vectors, 20, is_query=F.col("vec_id") % 20 == 0)


def op12_harmonic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.scan(periodic.planted(table(spark, sf_dir, "documents")))
    # the greatest length; ties to the smallest start, then period
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.withColumn("first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.start").alias("start"), (-F.col("first.less")).alias("length"), "first.period",
        F.expr("-1000 * first.less div first.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_pfair_mixing, op2_nonnegative_pu, op3_chroma_fingerprints, op4_simhash_deletion_variants, op5_sampled_splitters, op6_conditional_random_field, op7_directly_addressable_codes, op8_greedy_string_tiling, op9_kneser_ney_language, op10_text_to_tag_ratio, op11_block_matrix_join, op12_harmonic_grid, op13_importance_resampling)
    return {"pipeline": corpus_pipeline.run, **{f.__name__: f for f in ops}}


def oracle_sql() -> dict[str, str]:
    known = {"op11_block_matrix_join": neighbours.ORACLE_SQL, "op13_importance_resampling": resampling.ORACLE_SQL}
    return known | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
