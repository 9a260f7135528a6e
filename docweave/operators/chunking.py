"""Structural chunking of texts, and rules over chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _lines(docs: DataFrame, by: str) -> DataFrame:
    parts = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", by)).alias("_p", "_line"))
    return parts.select("doc_id", (F.col("_p") + 1).cast("bigint").alias("pos"), T.strip(F.col("_line")).alias("line")).where("line <> ''")


def infer_level(line: Column) -> Column:
    """More than one sentence is a paragraph; a short closed line a sentence; anything else a paragraph."""
    closed = (T.word_count(line) <= 30) & line.rlike(r"[.!?]$")
    return F.when(F.size(T.sentences(line)) > 1, "paragraph").when(closed, "sentence").otherwise("paragraph")


def line_chunks(docs: DataFrame) -> DataFrame:
    """A chunk per non-empty line, numbered within its document, with its level and length in words.

    Lines of one document are numbered by a window over that document only; a document is one row of input, so the window is bounded.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = _lines(docs, "\n")
    return rows.select("doc_id", (F.row_number().over(w) - 1).cast("bigint").alias("chunk_id"), F.col("line").alias("text"), infer_level(F.col("line")).alias("level"), T.word_count(F.col("line")).alias("n_words"))


def blank_line_chunks(docs: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("pos")
    return _lines(docs, "\n\n").select("doc_id", (F.row_number().over(w) - 1).cast("bigint").alias("chunk_id"), F.col("line").alias("text"))


def running_sections(docs: DataFrame) -> DataFrame:
    """The section each line is in, and running numbers of sections and paragraphs; a line that begins with "# " opens a section."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(docs, "\n").withColumn("is_section", F.col("line").startswith("# "))
    return rows.select("doc_id", "pos", F.sum(F.when(F.col("is_section"), 1).otherwise(0)).over(w).alias("section_index"), F.sum(F.when(F.col("is_section"), 0).otherwise(1)).over(w).alias("paragraph_index"), F.last(F.when(F.col("is_section"), F.col("line")), ignorenulls=True).over(w).alias("section"))


def element_level(line: Column) -> Column:
    """What a line is of a document: a section's title, a row of a table, a figure's caption, a paragraph or a lone sentence."""
    return F.when(line.startswith("# "), "section").when(line.startswith("|"), "table").when(line.rlike(r"^(Figure|Fig\.) \d"), "figure").otherwise(infer_level(line))


def structural_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, text, level, context_only, section, section_id, paragraph_id, sentence_index, parent_id, parent_chunk_id, path) of the elements of each text.

    A title opens a section. A paragraph is a chunk of its own, and so is each of its sentences if there are several; a lone sentence stands under a
    paragraph that is kept for context only. Each chunk names the chunk above it. Running numbers come from windows over one document, one row of input.
    """
    e = _lines(docs, "\n").withColumn("_level", element_level(F.col("line")))
    own = F.lit(None).cast("string")
    piece = lambda level, text, number, only: F.struct(level.alias("level"), text.alias("text"), number.cast("int").alias("sentence_index"), F.lit(only).alias("context_only"))
    whole = piece(F.lit("paragraph"), F.col("line"), own, False)
    parts = F.transform(T.sentences(F.col("line")), lambda t, i: piece(F.lit("sentence"), t, i + 1, False))
    pieces = F.when(F.col("_level") == "paragraph", F.concat(F.array(whole), F.filter(parts, lambda x: x["text"] != F.col("line")))).when(F.col("_level") == "sentence", F.array(piece(F.lit("paragraph"), F.col("line"), own, True), piece(F.lit("sentence"), F.col("line"), F.lit(1), False))).otherwise(F.array(piece(F.col("_level"), F.col("line"), own, False)))
    e = e.withColumn("_pieces", pieces)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_start", (F.sum(F.size("_pieces")).over(w) - F.size("_pieces")).cast("bigint"))
    section, block = F.col("_level") == "section", F.col("_level").isin("paragraph", "sentence")
    e = e.withColumn("_sec", F.sum(section.cast("int")).over(w)).withColumn("_par", F.sum(block.cast("int")).over(w)).withColumn("section", F.last(F.when(section, F.col("line")), ignorenulls=True).over(w)).withColumn("_at", F.last(F.when(section, F.col("_start")), ignorenulls=True).over(w))
    e = e.withColumn("section_id", F.when(F.col("_sec") > 0, F.concat(F.lit("section:"), F.col("_sec").cast("string")))).withColumn("paragraph_id", F.when(block, F.concat(F.lit("paragraph:"), F.col("_par").cast("string"))))
    c = e.select("doc_id", "_level", "_start", "_at", "section", "section_id", "paragraph_id", F.posexplode("_pieces").alias("_k", "p")).select("doc_id", (F.col("_start") + F.col("_k")).alias("chunk_id"), "_level", "_start", "_at", "section", "section_id", "paragraph_id", "p.*")
    below = F.col("level") == "sentence"
    parent = F.when(below, F.col("paragraph_id")).when(F.col("level") != "section", F.col("section_id"))
    above = F.when(below, F.col("_start")).when(F.col("level") != "section", F.col("_at"))
    last = F.when(below, F.concat(F.lit("sentence:"), F.col("sentence_index").cast("string"))).when(F.col("level").isin("table", "figure"), F.concat_ws(":", "level", F.col("chunk_id").cast("string")))
    path = F.concat_ws("/", "section_id", "paragraph_id", last)
    return c.select("doc_id", "chunk_id", "text", "level", "context_only", "section", "section_id", "paragraph_id", "sentence_index", parent.alias("parent_id"), above.alias("parent_chunk_id"), path.alias("path"))


def rejected_chunks(chunks: DataFrame, least_words: int = 8) -> DataFrame:
    """Rows kept out of context: marked context_only, or a sentence of fewer words; with the reason."""
    n = T.word_count(F.col("text"))
    only = F.coalesce("context_only", F.lit(False))
    tiny = F.coalesce((F.lower("level") == "sentence") & (n < least_words), F.lit(False))
    rows = chunks.where("text is not null").where(only | tiny)
    return rows.select("chunk_uid", n.alias("word_count"), F.when(only, "context_only").otherwise("tiny_sentence").alias("reason"))


def page_images(chunks: DataFrame) -> DataFrame:
    """One image per page of a document, the smallest url."""
    return chunks.where("image_url is not null and page_no is not null").groupBy("document_id", "page_no").agg(F.min("image_url").alias("image_url"))


def attach_page_images(chunks: DataFrame) -> DataFrame:
    """Every chunk with the image of its page, never one of another document."""
    rows = chunks.select("chunk_uid", "document_id", "page_no").distinct()
    return rows.join(page_images(chunks), ["document_id", "page_no"], "left").select("chunk_uid", "page_no", "image_url")


def document_order(chunks: DataFrame, block: int = 10_000) -> DataFrame:
    """(document_id, chunk_uid, ord, next_uid): place of each chunk in its document by chunk_id, sentence and uid, and the chunk behind it.

    A document is numbered block by block of chunk ids, so no window holds more than a block, however long the document; only one row per
    block takes part in adding the blocks up. Rows without a chunk_id come last, by uid.
    """
    key = F.coalesce("chunk_id", F.lit(2**62))
    rows = chunks.groupBy("document_id", "chunk_uid").agg(F.min(key).alias("_k"), F.min(F.coalesce("hierarchy.sentence_index", F.lit(0))).alias("_s"))
    rows = rows.withColumn("_b", F.floor(F.col("_k") / block))
    inner = Window.partitionBy("document_id", "_b").orderBy("_k", "_s", "chunk_uid")
    rows = rows.select("document_id", "chunk_uid", "_b", F.row_number().over(inner).alias("_r"), F.lead("chunk_uid").over(inner).alias("_n"))
    blocks = rows.groupBy("document_id", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min_by("chunk_uid", "_r").alias("_first"))
    outer = Window.partitionBy("document_id").orderBy("_b")
    blocks = blocks.select("document_id", "_b", F.coalesce(F.sum("_c").over(outer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lead("_first").over(outer).alias("_then"))
    joined = rows.join(blocks, ["document_id", "_b"])
    return joined.select("document_id", "chunk_uid", (F.col("_before") + F.col("_r")).cast("bigint").alias("ord"), F.coalesce("_n", "_then").alias("next_uid"))
