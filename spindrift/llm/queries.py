"""One thin query per numbered operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bytebpe, chat, epsgrid, langmix, lines, mergedrop, minhash, order, packing, phrases, variants, warc, wrappers
from spindrift.llm.workspace import cut
from spindrift.operators.layout import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


#: Conversation -1: its texts hold the control strings of a template.
_TRICKY = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted windows of all conversations, read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    windows = cut(chat.format_chats(rows.union(spark.createDataFrame(_TRICKY, "conv_id long, turn long, role string, text string"))), "windows")
    return chat.read_back(windows)


def op3_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    decoded = mergedrop.decode(mergedrop.encode(_table(spark, sf_dir, "documents")))
    return decoded.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.length("text").cast("long").alias("n_chars"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, line labels and verdict of every document."""
    return lines.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards in training order, read back."""
    return order.materialise(_table(spark, sf_dir, "documents"))


def op6_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    return langmix.identify(_table(spark, sf_dir, "documents"))


def op8_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return epsgrid.linked_vectors(_table(spark, sf_dir, "embeddings"))


def op9_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, read back through their merged index: captures
    in order of (url_key, captured, page_id)."""
    index = warc.archive_and_index(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over 2-word shingles at 0.8."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes they decode to."""
    decoded = bytebpe.decode(bytebpe.encode(_table(spark, sf_dir, "documents")))
    shown = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(shown.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with their near words' number, form and root."""
    return variants.group_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_chat_windows": op2_chat_windows,
    "op3_merge_dropout": op3_merge_dropout,
    "op4_line_crf": op4_line_crf,
    "op5_training_order": op5_training_order,
    "op6_wrappers": op6_wrappers,
    "op7_language_mixture": op7_language_mixture,
    "op8_epsilon_grid": op8_epsilon_grid,
    "op9_capture_index": op9_capture_index,
    "op10_minhash": op10_minhash,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_phrases": op12_phrases,
    "op13_spelling_variants": op13_spelling_variants,
}
