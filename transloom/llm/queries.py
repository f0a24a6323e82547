"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.llm import ann_tiles, bpe, conversation_repair, langid, packing, partenum, quality_pairs, quality_rules, sharding, simhash, suffix_dedup, toxicity, whitening
from transloom.llm.common import remainder, small_batches, table, vocabulary


def _held_out(modulus: int, value: int):
    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False)).alias("held_out")


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_pairs.score_documents(docs, table(spark, sf_dir, "labels"), ["doc_id", _held_out(5, 0)])
    return scored.select("*", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    model = langid.fit(docs, remainder("doc_id", 3) != 1)
    found = docs.select("doc_id", _held_out(3, 1), langid.identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.*")


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", _held_out(5, 0), toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tiles.nearest(table(spark, sf_dir, "embeddings"), query_modulus=50, k=5)


def op5_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"))


def op7_packing_least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return found.select("row.doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary()))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.join_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_bradley_terry, op2_adaptive_rules, op3_language_mixture, op4_block_matrix_neighbours, op5_simhash_bit_sliced, op6_sampled_splitter_shards, op7_packing_least_squares, op8_suffix_repeats, op9_bpe_codec, op10_toxicity_grammar, op11_feast_whitening, op12_conversation_repair, op13_partenum_join)
}
ORACLE_SQL = {"op4_block_matrix_neighbours": ann_tiles.SQL, "op2_adaptive_rules": quality_rules.SQL, "op12_conversation_repair": conversation_repair.SQL, "op13_partenum_join": partenum.SQL}
