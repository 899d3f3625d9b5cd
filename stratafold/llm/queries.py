"""The registered queries of this package: name -> (callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import (
    byte_ppm, chosen_path, collection_bwt, column_search, conversation_repair, mixing, packing, pair_index_bpe, prefix_trie, quality_rules, secret_index,
    substring_dedup, toxic_segments)
from stratafold.llm.common import table
from stratafold.llm.repeats import text_keys


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = collection_bwt.find_repeats(docs)
    found = found.select("k1", "k2", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *text_keys("text")).join(found, ["k1", "k2"]).drop("k1", "k2")


def repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = substring_dedup.find_repeats(docs)
    found = found.select("k1", "k2", "n_words", "n_removed", F.size("ranges").alias("n_ranges"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *text_keys("text")).join(found, ["k1", "k2"]).drop("k1", "k2")


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "passes")


def likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return byte_ppm.score(table(spark, sf_dir, "documents"), held_out)


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "class_distance", "word_distance", "kept")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = toxic_segments.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxic_segments.apply_model(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                         "evidence", F.size("segments").alias("n_segments"))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_index.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin([r.name for r in secret_index.BASE_RULES]))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(r.name) for r in secret_index.BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pair_index_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    encoded = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = pair_index_bpe.decode(encoded)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found, fixed = conversation_repair.repair(conversation_repair.damage(rows))
    out = rows.select("conv_id").distinct()
    for part in (found, conversation_repair.digests(fixed)):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, runs = prefix_trie.trie(prefix_trie.rebuilt_turns(table(spark, sf_dir, "conversations")))
    return nodes.join(prefix_trie.end_digests(runs), "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


QUERIES = {
    "op1_collection_bwt": (repeated_bytes, None),
    "op2_window_packing": (pack, None),
    "op3_seed_extend": (repeated_words, substring_dedup.SQL),
    "op4_source_mixing": (mix, None),
    "op5_byte_ppm": (likelihood, None),
    "op6_column_search": (nearest, column_search.SQL),
    "op7_quality_divergence": (quality, None),
    "op8_toxic_segments": (toxicity, None),
    "op9_secret_index": (secrets, None),
    "op10_chosen_path": (near_join, None),
    "op11_pair_index_bpe": (tokens, None),
    "op12_conversation_repair": (repaired, conversation_repair.SQL),
    "op13_prefix_trie": (conversation_trie, prefix_trie.SQL),
}
