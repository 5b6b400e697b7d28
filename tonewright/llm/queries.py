"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify_quality

    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds sound: each vector of ``embeddings`` is played as a tune first."""
    from .chroma import fingerprint_media, match_media, render_vectors

    return match_media(fingerprint_media(render_vectors(read_table(spark, sf_dir, "embeddings"))))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and pages under -1 - page_id."""
    from .language_id import identify, of_documents, of_pages

    docs = read_table(spark, sf_dir, "documents")
    rows = of_documents(docs).unionByName(of_pages(read_table(spark, sf_dir, "pages")))
    return identify(rows, docs.select("lang", "text"))


def chat_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted conversations back: turns from the text, loss text from token offsets and mask."""
    from .chat import masked_text, parse

    for b in batches:
        rows = []
        for conv_id, _, formatted, _, starts, ends, loss in zip(*b.columns):
            text = formatted.as_py()
            turns = parse(text)
            seen = hashlib.sha256()
            for role, said in turns:
                seen.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            under = masked_text(text, *(np.asarray(x.values) for x in (starts, ends)), np.asarray(loss.values.to_numpy(zero_copy_only=False), bool))
            rows.append((conv_id.as_py(), len(turns), seen.hexdigest(), len(under), hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    done = format_conversations(table.unionByName(more), tokenizer_file("byte_bpe_50k.json"))
    return done.mapInArrow(chat_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_spans import remove_repeated_spans

    return remove_repeated_spans(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    done = remove_repeats(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit

    return audit(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_quality_classifier, op4_chroma, op5_mixing, op6_language_id, op7_chat_format, op8_sentence_spans, op9_packing, op10_suffix_dedup, op11_importance, op12_decontamination, op13_divergence_audit)}


def oracle_sql() -> dict[str, str]:
    from . import decontamination, divergence, importance, mixing

    return {"op5_mixing": mixing.ORACLE_SQL, "op11_importance": importance.ORACLE_SQL, "op12_decontamination": decontamination.ORACLE_SQL, "op13_divergence_audit": divergence.ORACLE_SQL}
