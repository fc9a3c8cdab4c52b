"""Corpus-wide removal of repeated lines, in DataFrame functions only.

Long lines become 128-bit hashes, written once as a narrow table. That table is
range-partitioned by hash and document and sorted by position inside, so equal
hashes stream past together and a hash of any frequency is spread over many
tasks; the documents of a hash are counted from one partial row per task. The
decisions come back as sparse bitmaps per document (64 positions a word, only
words with a dropped line), and the texts are read once more to apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.shared import partitions_for, scratch, small_side, with_replaced

MIN_CHARS = 40
MIN_DOCS = 5
# The stripped characters (space and U+0009 to U+000D).
BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), _UPPER, _UPPER.lower())


def line_hashes(
    docs: DataFrame, text: str = "text", doc: str = "doc_id", min_chars: int = MIN_CHARS
) -> DataFrame:
    """One row per line whose key has `min_chars` code points or more:
    (h1, h2, doc, body, pos); `body` tells texts under one id apart."""
    lines = docs.select(
        F.col(f"`{doc}`").alias("doc"),
        F.xxhash64(F.col(f"`{text}`")).alias("body"),
        F.posexplode(_split(F.col(f"`{text}`"))).alias("pos", "line"),
    ).where(F.length("line") >= min_chars)
    keys = lines.select("doc", "body", "pos", _key(F.col("line")).alias("key")).where(
        F.length("key") >= min_chars
    )
    return keys.select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(17), "key").alias("h2"),
        "doc",
        "body",
        "pos",
    )


def drop_bitmaps(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, body, words): positions to drop as a map of word index to 64 bits.

    A hash found in `min_docs` documents or more is kept only in its largest
    document. Documents that lose nothing have no row."""
    n = partitions_for(hashes.sparkSession)
    ordered = hashes.repartitionByRange(n, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos")
    # Range-partitioned by (hash, document) and in order: equal hashes stream
    # past and the first occurrence in each document is marked without another
    # exchange; a frequent hash then meets as partial rows.
    run = Window.partitionBy("h1", "h2", "doc").orderBy("pos")
    firsts = ordered.withColumn("before", F.lag("pos").over(run)).where("before is null")
    repeated = (
        firsts.groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    words = (
        hashes.join(repeated, ["h1", "h2"])
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "body", F.expr("pos div 64").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("bits"))
    )
    return words.groupBy("doc", "body").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def dedup_lines(
    docs: DataFrame,
    text: str = "text",
    doc: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Every row of `docs` with `text` less its dropped lines, and n_lines
    (before dropping) and n_dropped.

    A null or empty text is one empty line and stays an empty text. Documents
    are told apart by `doc`: rows with one id count as one holder, a null id is
    the smallest; lines repeated inside the largest holder all stay. Columns
    named n_lines or n_dropped are replaced, all others kept. An empty table
    gives an empty result."""
    hashes = scratch(line_hashes(docs, text, doc, min_chars), "line-hashes")
    marks = scratch(drop_bitmaps(hashes, min_docs), "line-bitmaps")
    marks = marks.select(
        F.col("doc").alias("_ll_doc"), F.col("body").alias("_ll_body"), F.col("words").alias("_ll_w")
    )
    found = docs.join(
        small_side(marks, 200),
        F.col(f"`{doc}`").eqNullSafe(F.col("_ll_doc"))
        & (F.xxhash64(F.col(f"`{text}`")) == F.col("_ll_body")),
        "left",
    )
    lines = _split(F.col(f"`{text}`"))
    # A position is dropped if its word is in the map and has its bit set.
    kept = F.filter(
        lines,
        lambda _, i: F.getbit(
            F.coalesce(F.try_element_at("_ll_w", F.floor(i / 64).cast("long")), F.lit(0).cast("long")),
            (i % 64).cast("int"),
        )
        == 0,
    )
    dropped = F.coalesce(
        F.aggregate(F.map_values("_ll_w"), F.lit(0), lambda a, w: a + F.bit_count(w)), F.lit(0)
    )
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = with_replaced(
        found,
        {
            text: F.when(F.col("_ll_w").isNull(), whole).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": dropped.cast("long"),
        },
    )
    return out.drop("_ll_doc", "_ll_body", "_ll_w")
