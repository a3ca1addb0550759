"""Thin queries: each reads a table, applies its operator and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatio.llm import line_dedup as lines
from fixatio.llm import alignment, ann, langid, mixing, neardup, packing, periods, quality, rangejoin, repeats, topk, warc
from fixatio.llm.common import scratch, store, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(
        table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False
    )


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.size(lines.lines_of(F.col("row.text"))).cast("long")
    return kept.select(
        "row.doc_id", n.alias("n_lines"), (n - F.size("kept")).alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = store(mixing.doc_sizes(table(spark, sf_dir, "documents")), "sizes")
    return mixing.mixed(sizes).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def quality_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = docs.filter("lang is not null and text is not null and doc_id is not null").filter(
        ~langid.held_out("doc_id")
    )
    found = langid.identify(docs, langid.learn(known.select("doc_id", "text", "lang")))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "class_size", "stays"
    )


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def collision_counting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), scratch(spark, "archives")
    warc.write_archives(pages.select("page_id", "url", "html"), path)
    # Digests of what was read; the payloads themselves are not kept.
    read = store(
        warc.read_archives(spark, path).select(
            "record_id", "kind", F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "refers_to",
            F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        ),
        "records",
    )
    origin = read.filter("kind = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"),
        F.col("payload_digest").alias("_digest"),
    )
    return read.join(origin, "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "_digest").alias("payload_digest"), F.col("kind").alias("record_type"),
        F.col("_page").alias("refers_to"),
    )


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_strings(table(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["stop"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", n.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.col("sha").alias("kept_sha256"),
    )


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every document whose crc32(doc_id) is divisible by 10, the words from a
    place on repeat with a period, as the contract of the query lays down."""
    h, words = F.crc32(F.col("doc_id").cast("string")), r"([^\x20\x09-\x0D]+)"
    found = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g")).withColumn(
        "w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(words), F.lit(1)))
    )
    n = F.size("w")
    placed = found.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int")).withColumn(
        "p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    )
    rest = n - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", 1, F.col("a")), F.slice(again, 1, rest)), " ")
    return placed.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(
        with_planted_period(table(spark, sf_dir, "documents")), carry=["doc_id"], keep_text=False
    )
    # The greatest length first, then the smallest start and period.
    order = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    each = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(each, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("top", order).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), "top.length",
        (-F.col("top.period")).alias("period"),
        F.expr("top.length * 1000 div -top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


def embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rangejoin.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("row.vec_id", "n_links", "component_id", "kept")


def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignment.aligned(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN, carry=["doc_id"], keep_groups=False,
    )
    return found.select(
        "row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256")
    )
