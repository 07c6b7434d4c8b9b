"""Registered queries of the operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from . import bpe_stream, chat, curriculum, curve_search, decontaminate, lm_score, lsh_forest, nbsvm, repair, suffix_merge, suffix_tree, token_files, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents that ``labels`` marks as good; background: all others."""
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")
    out = lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return out.withColumns({c: F.round(c, 6) for c in ("ce_target", "ce_background", "score")})


def op2_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.remove_repeats(table(spark, sf_dir, "documents"), window=400).drop("kept_text")


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.remove_repeated_words(table(spark, sf_dir, "documents"), window=35).drop("kept_text")


def tokenizer(name: str) -> str:
    """File of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.shared_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path).drop("ids")


def op5_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    return nbsvm.score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op6_hilbert_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve_search.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.8).drop("row_key")


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix(table(spark, sf_dir, "documents")).drop("positions", "source", "row_key")


def op9_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("row_key", "component")


def op10_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"SELECT -1L AS conv_id, x.turn, x.role, '{said}' AS text FROM (VALUES (0L, 'user'), (1L, 'assistant')) AS x(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(probe)
    path, model = token_files.shared_path(spark, "chat"), tokenizer("byte_bpe_50k.json")
    chat.format_conversations(rows, model).write.parquet(path)
    return chat.read_back(spark.read.parquet(path), model)


def op11_checkpoint_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = repair.damage(table(spark, sf_dir, "conversations"))
    return repair.report(repair.repair(damaged, copies="copies"))


def op12_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer("word_bpe_49k.json")
    return bpe_stream.digests(bpe_stream.encode(table(spark, sf_dir, "documents"), model), model)


def op13_bidiagonal_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten.integers(table(spark, sf_dir, "embeddings"))
    return whiten.transform(rows, whiten.fit(rows, count=4))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_cross_entropy_difference, op2_suffix_merge, op3_suffix_tree, op4_token_files, op5_nb_svm, op6_hilbert_curves, op7_minhash_containment, op8_curriculum_mix, op9_lsh_forest, op10_chat_masks, op11_checkpoint_repair, op12_streaming_bpe, op13_bidiagonal_whitening)
}
