"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def part_of(key: str, n: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm.permutation_index import nearest

    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pairbench.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pairbench.llm.lm_scoring import scores

    return scores(read(spark, sf_dir, "documents"), part_of("doc_id", 10) == 0, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm.ngram_join import join

    return join(read(spark, sf_dir, "documents"), k=5, percent=75)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm import language_id

    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs.where(part_of("doc_id", 3) != 1))
    return language_id.identify(docs, model).select("doc_id", (part_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "langs", "shares")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm import html_extract

    pages = read(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages)).select("page_id", "url", "text", "n_chars")


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm import quality_fm

    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    machine = quality_fm.train(docs, labels.where(part_of("doc_id", 5) != 0))
    out = quality_fm.score(docs, machine)
    return out.select("doc_id", (part_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm.sharding import place

    return place(read(spark, sf_dir, "documents"), "doc_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm.decontaminate import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), threshold=0.75, k=5)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pairbench.llm.sentencepiece_merge import encode

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digests=True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm.conversation_repair import damage, repair

    rows = damage(read(spark, sf_dir, "conversations"))
    return repair(rows, "conv", there="there").withColumnRenamed("conv", "conv_id")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pairbench.llm.token_alignment import align

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pairbench.llm.suffix_dedup import dedup

    return dedup(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_permutation_index": op1_permutation_index,
        "op2_token_counts": op2_token_counts,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_ngram_join": op4_ngram_join,
        "op5_language_id": op5_language_id,
        "op6_html_extract": op6_html_extract,
        "op7_quality_fm": op7_quality_fm,
        "op8_sharding": op8_sharding,
        "op9_decontaminate": op9_decontaminate,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_token_alignment": op12_token_alignment,
        "op13_suffix_dedup": op13_suffix_dedup,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from pairbench.llm.sharding import place_sql

    return {"op8_sharding": place_sql("documents", "doc_id")}
