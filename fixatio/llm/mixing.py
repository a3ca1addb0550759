"""Mixing sources to target weights in DataFrame functions only.

Token counts are summed per source; targets are shares of the whole, stopped at a number of
repetitions of the source; every document is then emitted floor(rate) times, and once more with
the rest of the rate as probability, drawn from a hash of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixatio.llm.common import store, whole_row

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3


def size_of(text: str | Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str | Column, text_hash: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the document's id, text and the seed alone."""
    key = F.concat_ws(
        "|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit("")),
        text_hash,
    )
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, _rank): sources in order of code points from 0, null last.

    The order is made in ranges: each task numbers its own, and a table with a count per task
    gives the offsets, so that many sources are no single task's work.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    # Bytes of UTF-8 are in the order of code points.
    ordered = sums.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(
        F.col("source").asc_nulls_last()
    )
    local = store(
        ordered.withColumns({
            "_part": F.spark_partition_id(),
            "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }),
        "sources",
    )
    counts = sorted((r["_part"], r["n"]) for r in local.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:  # one pair for each task of the numbering
        offsets.append((part, total))
        total += n
    shift = sizes.sparkSession.createDataFrame(offsets, "_part int, _before long")
    return (
        local.join(F.broadcast(shift), "_part")
        .withColumn("_rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
    )


def targets(sources: DataFrame, weight: Column, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target``: shares of all sizes by weight, none above ``max_repeats`` times its source.

    What a source cannot take is shared again by weight. Each round is one sum over the sources;
    a round that stops no further source is the last.
    """
    weighed = sources.withColumn("_w", weight)
    cap = F.col("source_size") * max_repeats
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share = None  # words for each unit of weight
    while True:
        full = F.lit(False) if share is None else cap <= F.col("_w") * share
        taken, weights = weighed.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_w")))
        ).first()
        if not weights or share == (total - taken) / weights:
            break
        share = (total - taken) / weights
    # A source is full where its share would go beyond the cap.
    return weighed.withColumn(
        "target", F.least(cap.cast("double"), F.col("_w") * F.lit(float(share or 0)))
    ).drop("_w")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target), with weights 1, 2, 3 in turn over the ordered sources."""
    return targets(numbered_sources(sizes), F.col("_rank") % 3 + 1, max_repeats).drop("_rank", "_docs")


def copies(rate: Column, u: Column) -> Column:
    """floor(rate) copies and one more with the probability of the fraction."""
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mixed(sizes: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of a table (doc_id, source, size, text_hash).

    Null sources are one source, the last. Null ids and repeated rows are fine: the draw depends
    on id and text. A source without words has target 0 and no copies. An empty table gives an
    empty one.
    """
    goal = store(source_targets(sizes, max_repeats), "targets")
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeats)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    right = goal.select(F.col("source").alias("_source"), "source_size", "target")
    return (
        sizes.join(right, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("copies", copies(rate, draw("doc_id", "text_hash", seed)))
        .drop("_source")
    )


def doc_sizes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"),
        F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")).alias("text_hash"),
    )


def repeated_documents(docs: DataFrame, max_repeats: int = MAX_REPEATS, seed: int = 0) -> DataFrame:
    """The documents of the mix, with all their columns, each as often as the mix takes it."""
    sizes = store(docs.select(F.col("source").alias("source"), size_of("text").alias("size")), "sizes")
    goal = store(source_targets(sizes, max_repeats), "targets")
    rate = F.when(
        F.col("source_size") > 0, F.least(F.lit(float(max_repeats)), F.col("target") / F.col("source_size"))
    ).otherwise(0.0)
    u = draw(F.col("row.doc_id"), F.coalesce(F.md5(F.col("row.text").cast("binary")), F.lit("")), seed)
    return (
        docs.select(whole_row(docs)).join(goal, F.col("row.source").eqNullSafe(F.col("source")))
        .select("row", copies(rate, u).alias("n")).filter("n > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")
    )
