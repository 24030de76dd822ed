"""Short stand-ins of whole books: contents, opening, ending and openings of the longest chapters, from rows of paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import word_count
from folioflow.operators.chunking import nodal_chapters
from folioflow.session import require

MOST_CHAPTERS = 240
OPENING = ENDING = 1000


def word_slice(text: Column, most: Column | int, from_end: bool = False) -> Column:
    """A text of at most `most` words as it is, else so many of its first (or last) words and a mark of what is left out."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    most = F.lit(most) if isinstance(most, int) else most
    kept = F.slice(words, F.greatest(F.lit(1), n - most + 1), most) if from_end else F.slice(words, F.lit(1), most)
    return F.when(n <= most, text).otherwise(F.concat(F.array_join(kept, " "), F.lit(" […]")))


def contents(chapters: DataFrame, key: str, most: int = MOST_CHAPTERS) -> DataFrame:
    """key, place and line of a book's contents: number, title and words of each chapter.

    Of more than `most` chapters the first three quarters of `most` and the rest of it from the end are shown, with a line that says how many are left
    out. chapters: key, section_order, title, words; an empty title is "Chapter n".
    """
    require(chapters, key, "section_order", "title", "words")
    w = Window.partitionBy(key)
    head = most * 3 // 4
    c = chapters.withColumns({"n": F.row_number().over(w.orderBy("section_order")), "all": F.count("*").over(w)})
    shown = c.filter((F.col("all") <= most) | (F.col("n") <= head) | (F.col("n") > F.col("all") - (most - head)))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("n").cast("string")))
    lines = shown.select(key, F.col("n").cast("double").alias("place"), F.concat(F.col("n").cast("string"), F.lit(". "), title, F.lit(" ("), F.format_number("words", 0), F.lit(" words)")).alias("line"))
    gone = chapters.groupBy(key).agg(F.count("*").alias("all")).filter(F.col("all") > most)
    mark = gone.select(key, F.lit(head + 0.5).alias("place"), F.concat(F.lit("... ("), F.format_number(F.col("all") - most, 0), F.lit(" chapters omitted from oversized TOC)")).alias("line"))
    return lines.union(mark)


def openings(paragraphs: DataFrame, key: str, most: int = OPENING, from_end: bool = False) -> DataFrame:
    """key, position and text of the paragraphs that make up a book's first (or last) `most` words; the one that crosses the bound is cut.

    paragraphs: key, position, text. Running sums over each book; only what is kept goes on.
    """
    order = F.desc("position") if from_end else F.asc("position")
    p = paragraphs.filter(F.length(F.trim("text")) > 0).withColumn("n", word_count(F.col("text")).cast("bigint"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = p.withColumn("before", before).filter(F.col("before") < most)
    return kept.select(key, "position", word_slice(F.col("text"), (F.lit(most) - F.col("before")).cast("int"), from_end).alias("text"))


def nodal_openings(paragraphs: DataFrame, key: str, per_chapter: int = 2, most: int = 250) -> DataFrame:
    """key, section_order, title, position and text of the first paragraphs of each book's longest inner chapters.

    paragraphs: key, section_order, title, position, text.
    """
    words = paragraphs.groupBy(F.col(key).alias("book_id"), "section_order").agg(F.sum(word_count(F.col("text")).cast("bigint")).alias("words"))
    picked = nodal_chapters(words).select(F.col("book_id").alias(key), "section_order")
    rows = paragraphs.filter(F.length(F.trim("text")) > 0).join(picked, [key, "section_order"])
    place = F.row_number().over(Window.partitionBy(key, "section_order").orderBy("position"))
    return rows.withColumn("__n", place).filter(F.col("__n") <= per_chapter).select(key, "section_order", "title", "position", word_slice(F.trim("text"), most).alias("text"))


def surrogates(paragraphs: DataFrame, key: str) -> DataFrame:
    """key, words and surrogate of every book.

    Small books (under one and a half times opening and ending) are given whole under their contents, the others as contents,
    opening, ending and openings of their longest chapters. A book without words is "[empty book]". What is gathered per book is bounded by
    the parts' own bounds. paragraphs: key, section_order, title, position, text.
    """
    require(paragraphs, key, "section_order", "title", "position", "text")
    live = paragraphs.withColumn("text", F.coalesce("text", F.lit("")))
    words = live.withColumn("n", word_count(F.col("text")).cast("bigint"))
    chapters = words.groupBy(key, "section_order").agg(F.min("title").alias("title"), F.sum("n").alias("words"))
    total = chapters.groupBy(key).agg(F.sum("words").alias("words"), F.count("*").alias("chapters"))
    small = F.col("words") < (OPENING + ENDING) * 1.5
    name = lambda: F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Chapter "), F.col("section_order").cast("string")))
    part = lambda df, zone, place, text: df.select(key, F.lit(zone).alias("zone"), place.cast("double").alias("at"), text.alias("text"))
    sizes = total.select(key, "words")
    few, many = live.join(sizes.filter(small & (F.col("words") > 0)), key), live.join(sizes.filter(~small), key)
    # of a small book's chapters the first paragraph carries the title
    first = F.row_number().over(Window.partitionBy(key, "section_order").orderBy("position")) == 1
    whole = few.filter(F.length(F.trim("text")) > 0).withColumn("text", F.when(first, F.concat(F.lit("## "), name(), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text")))
    nodal = nodal_openings(many, key)
    lead = F.row_number().over(Window.partitionBy(key, "section_order").orderBy("position")) == 1
    nodal = nodal.withColumn("text", F.when(lead, F.concat(F.lit("## "), name(), F.lit("\n"), F.col("text"))).otherwise(F.col("text")))
    parts = part(contents(chapters, key), 1, F.col("place"), F.col("line"))
    parts = parts.union(part(openings(many, key), 2, F.col("position"), F.col("text"))).union(part(openings(many, key, ENDING, True), 3, F.col("position"), F.col("text")))
    parts = parts.union(part(nodal, 4, F.col("position"), F.col("text"))).union(part(whole, 5, F.col("position"), F.col("text")))
    zones = parts.groupBy(key, "zone").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("xs"), F.count("*").alias("n"))
    heads = F.create_map(*[F.lit(x) for x in (1, "# Table of Contents", 2, "# Introduction (first ~1000 words)", 3, "# Conclusion (last ~1000 words)", 4, "# Nodal Slices (opening paragraphs of the longest chapters)", 5, "# Full Text (book is too small for distillation)")])
    glue = F.when(F.col("zone") == 1, "\n").otherwise("\n\n")
    body = zones.select(key, "zone", F.concat_ws("\n", heads[F.col("zone")], F.aggregate("xs", F.lit(None).cast("string"), lambda s, x: F.coalesce(F.concat(s, glue, x["text"]), x["text"]))).alias("text"))
    joined = body.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("zone", "text"))).alias("zs"))
    out = total.join(joined, key, "left").withColumn("surrogate", F.when(F.col("words") == 0, "[empty book]").otherwise(F.array_join(F.transform("zs", lambda z: z["text"]), "\n\n")))
    return out.select(key, "words", "surrogate")
