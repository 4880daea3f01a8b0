"""The corpus operators' queries over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, forest, packing, pii, quality, search, simhash, sql, substring, topk, toxicity, trie, warc
from .common import fold, new_path, read_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Score from which a document's quality is good.
KEPT_QUALITY = 0.7
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the base spans as counts and digest, and all spans."""
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_base = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.array_remove(of_base, F.lit(k))).cast("long") for k in range(len(pii.KINDS))]
    counts = [(F.size(of_base) - n).cast("long").alias(f"n_{name}") for n, name in zip(counts, pii.KINDS, strict=True)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its near-duplicates."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word stretches that an earlier one holds."""
    cut = substring.remove_repeats(read_table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed rows of all documents, as read back from the files written."""
    out = new_path(spark, "packed")
    packing.write_packed(read_table(spark, sf_dir, "documents"), RANKS, out).agg(F.sum("n_rows")).collect()
    rows = packing.read_packed(spark, out)
    return rows.select(
        "file",
        "row",
        F.element_at("cu_seqlens", -1).cast("long").alias("n_tokens"),
        F.size("starts").cast("long").alias("n_segments"),
        F.transform("doc_ids", lambda i: i.cast("long")).alias("doc_ids"),
        "starts",
        "cu_seqlens",
        "resets",
        F.sha2("ids", 256).alias("ids_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from four fifths of the labels."""
    docs = read_table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), fold("id", 5) != 0)
    scored = toxicity.score(docs, machine)
    return scored.select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.col("word").alias("strongest_word"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    coded = bpe.decode(bpe.encode(read_table(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    return coded.select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back, revisits resolved."""
    out = new_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), out)
    rows = warc.resolve(warc.read_records(spark, out))
    return rows.select(
        F.col("page").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    found = decontaminate.find_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), with_matches=False)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every hundredth vector against all vectors."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, voted by three quarters of the labels."""
    docs = read_table(spark, sf_dir, "documents")
    voters = quality.fit(docs, read_table(spark, sf_dir, "labels"), fold("id", 4) != 2)
    scored = quality.score(docs, voters)
    return scored.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= KEPT_QUALITY).cast("int").alias("predicted"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    return trie.build(read_table(spark, sf_dir, "conversations"))


def op12_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the number of its near-duplicates and the smallest id that they reach."""
    found = forest.near_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    found = search.top_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


QUERIES = {"op1_pii": op1_pii, "op2_simhash": op2_simhash, "op3_substring_dedup": op3_substring_dedup, "op4_pack_tokens": op4_pack_tokens, "op5_toxicity": op5_toxicity, "op6_byte_bpe": op6_byte_bpe, "op7_warc_revisits": op7_warc_revisits, "op8_decontaminate": op8_decontaminate, "op9_exact_top_k": op9_exact_top_k, "op10_quality_votes": op10_quality_votes, "op11_prefix_trie": op11_prefix_trie, "op12_vector_forest": op12_vector_forest, "op13_ranked_search": op13_ranked_search}
ORACLES: dict[str, str] = {"op3_substring_dedup": sql.OP3, "op7_warc_revisits": sql.OP7, "op8_decontaminate": sql.OP8, "op9_exact_top_k": sql.OP9, "op11_prefix_trie": sql.OP11, "op12_vector_forest": sql.OP12, "op13_ranked_search": sql.OP13}
