"""Line dedup on content-defined chunks of lines, in DataFrame functions only.

A text is a list of lines; lines are wrapped behind punctuation, so a passage that fills one line has
lines of its own.  Every line is hashed, a rolling hash over two line hashes slides over the list, and
a local minimum of it opens a chunk.  Behind a line of 16 octets or more and before one of 48 or more a
chunk opens as well, so most lines are chunks of their own and only very short ones are put together: a
passage that is repeated loses its first few words and its last short lines at most.  A boundary
depends on four lines around it and nothing else, so the chunks of a passage are the same wherever it
stands.  A long line is a
chunk by itself.

Chunks are grouped over all documents by their bytes.  The document with the smallest doc_id keeps a
repeated chunk, at its first place; everywhere else it goes, if the run of repeated chunks it stands
in has at least ``min_words`` words.

All steps are linear in the length of a text: lists are cut and aligned by writing markers into the
text and splitting at them, never by looking up list elements one by one.  Texts are cut once and written
as their chunks, which every later step reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from journeyloom.llm.common import table
from journeyloom.sources.workspace import settle

# An escape character, what stands for it inside a text, and the marker between parts.
_ESCAPE, _ESCAPED, _MARK = "\u0001", "\u0001\u0003", "\u0001\u0002"
# Octets of a line from which it ends a chunk, and from which it opens one.
_ENDS, _OPENS = 16, 48


def _before(values: Column) -> Column:
    """The list moved by one place: element i is what was i - 1."""
    return F.slice(F.concat(F.array(F.lit(None).cast("bigint")), values), F.lit(1), F.size(values))


def _behind(values: Column) -> Column:
    return F.slice(F.concat(values, F.array(F.lit(None).cast("bigint"))), F.lit(2), F.size(values))


def chunks_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_chunks``: the (escaped) text cut at content-defined boundaries; a null text has none."""
    escaped = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(_ESCAPE), F.lit(_ESCAPED))
    lines = F.filter(F.split(escaped, r"(?<=[ \n])(?<=\n|[.!?,;:|] )", -1), lambda u: F.octet_length(u) > 0)
    cut = (
        docs.withColumn("_lines", lines)
        .withColumn("_hash", F.transform("_lines", lambda u: F.xxhash64(u)))
        .withColumn("_roll", F.zip_with(_before(F.col("_hash")), F.col("_hash"), lambda a, b: F.xxhash64(a, b)))
        .withColumn("_near", F.zip_with(_before(F.col("_roll")), _behind(F.col("_roll")), lambda a, b: F.least(a, b)))
        .withColumn("_low", F.zip_with("_roll", "_near", lambda r, near: r < near))
        .withColumn("_size", F.transform("_lines", lambda u: F.octet_length(u).cast("bigint")))
        .withColumn("_dense", F.zip_with(_before(F.col("_size")), F.col("_size"), lambda a, b: (a >= _ENDS) | (b >= _OPENS)))
        .withColumn("_opens", F.zip_with("_low", "_dense", lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))))
    )
    marked = F.zip_with("_lines", "_opens", lambda u, opens: F.when(opens, F.concat(F.lit(_MARK), u)).otherwise(u))
    parts = F.split(F.array_join(marked, ""), _MARK, -1)
    return cut.withColumn("_chunks", F.filter(parts, lambda c: F.octet_length(c) > 0)).drop(
        "_lines", "_hash", "_roll", "_near", "_low", "_size", "_dense", "_opens"
    )


def _second_hash(chunk: Column) -> Column:
    """Another hash than ``xxhash64(chunk)``: it starts from another seed."""
    return F.xxhash64(F.lit("second"), chunk)


def repeated_chunks(cut: DataFrame) -> DataFrame:
    """Per document key the repeated chunks that are not the kept one: their numbers ``_nos``, ascending, and ``_hashes``.

    ``cut`` has ``_doc`` and ``_chunks``.  Chunks are grouped by their bytes.  Their places carry a 64-bit
    hash only; whoever applies the marks compares a second, independent hash of the chunk it has before it.
    Starts jobs.
    """
    # The outer form, else the optimizer derives a filter on the list and repeats its steps below it.
    chunks = cut.select("_doc", F.posexplode_outer("_chunks").alias("_no", "_chunk")).where("_chunk is not null")
    # Same bytes, same group; the partial aggregate leaves one row per task of however hot a chunk.
    kept = (
        chunks.groupBy("_chunk")
        .agg(F.count("*").alias("_n"), F.min("_doc").alias("_first"))
        .where("_n > 1")
        .select(F.xxhash64("_chunk").alias("_hash"), _second_hash(F.col("_chunk")).alias("_again"), "_first")
    )
    # Written before the places are shuffled, so that the chunks' own shuffle is gone by then.
    kept = settle(kept, "kept_chunks")
    places = chunks.select("_doc", "_no", F.xxhash64("_chunk").alias("_hash"))
    found = places.join(kept, "_hash").groupBy("_doc").agg(
        F.collect_set(F.struct("_again", "_no", (F.col("_doc") == F.col("_first")).alias("_own"))).alias("_found")
    )
    # In the keeping document all but the first place of a chunk count as repeats.
    ordered = found.withColumn("_found", F.sort_array("_found")).withColumn("_last", _before(F.col("_found._again")))
    loose = F.filter(
        F.zip_with(
            "_found",
            "_last",
            lambda x, last: F.struct(x["_no"].alias("no"), x["_again"].alias("hash"), (~x["_own"] | x["_again"].eqNullSafe(last)).alias("out")),
        ),
        lambda x: x["out"],
    )
    marks = ordered.select("_doc", F.sort_array(loose).alias("_marks")).where(F.size("_marks") > 0)
    return marks.select("_doc", F.col("_marks.no").alias("_nos"), F.col("_marks.hash").alias("_hashes"))


def document_key() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("_doc")


def bitmap(marks: DataFrame) -> DataFrame:
    """A bit per key of ``marks``, written, so its size is known when a join to it is planned.

    32,768 keys share a row of 4 KB, so the bitmap is a small part of the marks; Spark sends it to all
    tasks or shuffles for it, by its size at run time.
    """
    bits = marks.groupBy(F.bitmap_bucket_number("_doc").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_doc")).alias("_bits")
    )
    return settle(bits, "marked_documents")


def marked_by(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Adds ``_marked``: whether a row's document has its bit set (exact)."""
    at = F.bitmap_bit_position("_doc")
    octet = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.expr("shiftright(_octet, _shift) & 1") == 1
    return (
        rows.withColumn("_bucket", F.bitmap_bucket_number("_doc"))
        .join(bits, "_bucket", "left")
        .withColumns({"_octet": F.coalesce(octet, F.lit(0)), "_shift": (at % 8).cast("int")})
        .withColumn("_marked", held)
        .drop("_bucket", "_bits", "_octet", "_shift")
    )


def with_bitmap(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds ``_marked``: whether a row's document may have marks."""
    return marked_by(rows, bitmap(marks))


def dedup_lines(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; all rows and all other columns stay.

    Null and empty texts stay as they are.  Rows with one doc_id count as one document (rows without
    as the last one), so an exactly repeated row keeps its text.  A text all of whose chunks are kept
    elsewhere becomes empty.  Columns may have any names; only doc_id and text are used.  Starts jobs.
    """
    names = docs.columns
    others = [c for c in names if c != "text"]
    # Texts are cut once; what is written takes the place of the text, so no step carries both.
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    cut = chunks_of(docs.select(document_key(), rest.alias("_rest"), F.col("text").alias("_text")), "_text").drop("_text")
    cut = settle(cut, "chunks", codec="zstd")
    marks = settle(repeated_chunks(cut), "marks")
    bits = bitmap(marks)
    # Only texts that lose something are shuffled.
    whole = docs.select(document_key(), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    untouched = marked_by(whole, bits).where("not _marked").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
    touched = marked_by(cut, bits).where("_marked").join(marks, "_doc")
    # Expected hash per chunk number: as many markers as numbers passed since the mark before.
    steps = F.zip_with("_nos", F.slice(F.concat(F.array(F.lit(0)), F.col("_nos")), F.lit(1), F.size("_nos")), lambda no, last: no - last)
    gaps = F.zip_with("_hashes", steps, lambda h, step: F.concat(F.repeat(F.lit(_MARK), step), h.cast("string")))
    expected = F.split(F.array_join(gaps, ""), _MARK, -1)
    kept_apart = F.zip_with(
        "_chunks",
        "_expected",
        lambda c, e: F.when(c.isNull(), F.lit("")).when(_second_hash(c).cast("string").eqNullSafe(e), c).otherwise(F.concat(F.lit(_MARK), c, F.lit(_MARK))),
    )
    # Even parts are runs of repeated chunks, odd parts are kept chunks.
    parts = F.split(F.array_join(kept_apart, ""), _MARK, -1)
    left = F.transform(
        "_parts",
        lambda p, i: F.when((i % 2 == 0) & (F.regexp_count(p, F.lit(r"\S+")) >= min_words), F.lit("")).otherwise(p),
    )
    clean = F.replace(F.array_join(left, ""), F.lit(_ESCAPED), F.lit(_ESCAPE))
    done = touched.withColumn("_expected", expected).withColumn("_parts", parts).withColumn("_clean", clean)
    places = {c: F.col(f"_rest.c{k}") for k, c in enumerate(others)} | {"text": F.col("_clean")}
    return untouched.unionByName(done.select(*[places[c].alias(c) for c in names]))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = docs.select("doc_id", "text", F.length("text").alias("chars_before"))
    clean = dedup_lines(before)
    return clean.select("doc_id", "text", "chars_before", F.length("text").alias("chars_after"))
