"""Line dedup in DataFrame functions only.

Every line is reduced to two 64-bit hashes of its key. Hashes are range-partitioned and sorted
by hash, document and position, so a line that a third of all documents hold is spread over
many tasks; each task streams its sorted run and gives one row per key (first occurrence and
count), and only those rows meet. What goes back to the documents is a bitmap, in the sparse
form word number -> 64 bits, and never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixatio.llm.common import ASCII_SPACE, LOWER, UPPER, row_key, store, whole_row


def lines_of(text: str | Column) -> Column:
    """The lines of a text, cut at \\n; a null or empty text has one empty line."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def _occurrences(docs: DataFrame, text: str, min_chars: int, keys: list[Column]) -> DataFrame:
    """A row per line with a key of at least ``min_chars``: hash pair, document pair, position,
    and whether it is the document's first line with this key."""
    key = F.transform(lines_of(text), line_key)
    hashed = F.transform(
        key,
        lambda x, i: F.when(
            F.char_length(x) >= min_chars,
            F.struct(
                F.xxhash64(F.lit(0), x).alias("_a"), F.xxhash64(F.lit(1), x).alias("_b"), i.alias("_pos")
            ),
        ),
    )
    in_order = F.sort_array(F.filter(hashed, lambda x: x.isNotNull()))
    rows = docs.select(*keys, in_order.alias("_s")).select(
        "_k1", "_k2", "_s", F.posexplode("_s").alias("_i", "_x")
    )
    before = F.get("_s", F.col("_i") - 1)
    same = (before["_a"] == F.col("_x._a")) & (before["_b"] == F.col("_x._b"))
    return rows.select(
        F.col("_x._a").alias("_a"), F.col("_x._b").alias("_b"), "_k1", "_k2",
        F.col("_x._pos").alias("_pos"), (~F.coalesce(same, F.lit(False))).alias("_first"),
    )


def dropped_lines(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id",
    min_docs: int = 10, keep: str = "none", min_chars: int = 1,
) -> DataFrame:
    """(_k1, _k2, drop map<int,long>) for each document that loses a line.

    A line is dropped if its key stands in at least ``min_docs`` documents; with
    ``keep="first"`` the first occurrence, by document key and position, stays.
    Rows are documents: repeated rows count each for itself.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    keys = row_key(id_col, text)
    found = store(_occurrences(docs, text, min_chars, keys), "line-hashes")
    order = ["_a", "_b", "_k1", "_k2", "_pos"]
    runs = found.repartitionByRange(*order).sortWithinPartitions(*order)
    # Stored, so that the join below has an exchange of its own, which Spark can split at a hot key.
    frequent = store(
        runs.groupBy("_a", "_b")
        .agg(
            F.sum(F.col("_first").cast("long")).alias("_docs"),
            F.min(F.struct("_k1", "_k2", "_pos")).alias("_at"),
        )
        .filter(F.col("_docs") >= min_docs),
        "frequent-lines",
    )
    gone = found.join(frequent, ["_a", "_b"])
    if keep == "first":
        gone = gone.filter(F.struct("_k1", "_k2", "_pos") != F.col("_at"))
    words = gone.groupBy("_k1", "_k2", F.shiftright("_pos", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _pos & 63)")).alias("_bits")
    )
    return words.groupBy("_k1", "_k2").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_drop")
    )


def kept_lines(text: str | Column, drop: str | Column) -> Column:
    """The lines that a bitmap leaves (all if it is null)."""
    drop = F.col(drop) if isinstance(drop, str) else drop
    lines = lines_of(text)
    n_words = F.shiftright(F.size(lines) - 1, 6)
    dense = F.transform(
        F.sequence(F.lit(0), n_words), lambda w: F.coalesce(F.try_element_at(drop, w), F.lit(0).cast("long"))
    )

    def bit(words: Column, i: Column) -> Column:
        return F.call_function("shiftright", F.get(words, F.shiftright(i, 6)), i % 64).bitwiseAND(F.lit(1).cast("long"))

    # The bitmap is unrolled once per document and looked up by position.
    zipped = F.transform(F.array(dense), lambda words: F.filter(lines, lambda x, i: bit(words, i) == 0))
    return F.when(drop.isNull(), lines).otherwise(F.element_at(zipped, 1))


def dedup_lines(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id",
    min_docs: int = 10, keep: str = "none", min_chars: int = 1,
) -> DataFrame:
    """(row, kept): each document as a struct, and the array of its lines that stay.

    Null or empty texts have one empty line, which has no key and stays. Null ids are fine:
    documents are told apart by id and text, and equal rows get equal results. An empty table
    gives an empty one. Other columns are carried along, whatever their names.
    """
    drop = dropped_lines(docs, text, id_col, min_docs, keep, min_chars)
    keyed = docs.select(whole_row(docs), *row_key(id_col, text))
    return keyed.join(drop, ["_k1", "_k2"], "left").select(
        "row", kept_lines(F.col("row")[text], "_drop").alias("kept")
    )


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none") -> DataFrame:
    """The documents, with all their columns, with the lines that stay as ``text`` and its length as
    ``n_chars``. A null text stays null."""
    found = dedup_lines(docs, min_docs=min_docs, keep=keep)
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
