"""Rows and files as they are stored: canonical vector rows, cut metadata, markdown of books, blobs by content."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import word_count
from folioflow.session import require


def scalar_text(value: Column, kind: str) -> Column:
    """A metadata value as one scalar text: arrays of strings between bars, other nested values as JSON, dates in ISO form, numbers that are none as null."""
    if kind == "array<string>":
        return F.when(value.isNotNull(), F.concat(F.lit("|"), F.array_join(value, "|"), F.lit("|")))
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(value)
    if kind.startswith("timestamp"):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if kind in ("double", "float"):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value.cast("string"))
    return value.cast("string")


def canonical_rows(points: DataFrame, known: list[str], key: str = "id", vector: str = "vector") -> DataFrame:
    """key, vector, all `known` columns as scalar texts (null where points lack them) and extra: the other columns as one JSON text, or null."""
    require(points, key, vector)
    kinds = dict(points.dtypes)
    others = [c for c in points.columns if c not in (*known, key, vector)]
    column = lambda c: scalar_text(F.col(f"`{c}`"), kinds[c]) if c in kinds else F.lit(None).cast("string")
    some = F.coalesce(*[column(c) for c in others]).isNotNull() if others else F.lit(False)
    extra = F.when(some, F.to_json(F.struct(*[column(c).alias(c) for c in others]))) if others else F.lit(None).cast("string")
    return points.select(F.col(key).cast("string").alias(key), vector, *[column(c).alias(c) for c in known], extra.alias("extra"))


def unpacked(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Canonical rows with the wanted fields of extra as columns again; a field that is a column already stays as it is."""
    return rows.withColumns({c: F.get_json_object("extra", f"$.{c}") for c in wanted if c not in rows.columns})


def cut_metadata(meta: Column, each: int = 500, all_: int = 8000, keys: int = 40) -> Column:
    """A map of texts as JSON: values over `each` characters end in an ellipsis; over `all_` characters in all, a note with at most `keys` of its names
    and how many more there are stands instead, so that what is stored always parses."""
    short = F.transform_values(meta, lambda k, v: F.when(F.char_length(v) > each, F.concat(F.substring(v, 1, each - 1), F.lit("…"))).otherwise(v))
    text = F.to_json(short)
    names = F.map_keys(meta)
    note = F.to_json(F.struct(F.lit(True).alias("__truncated"), F.char_length(text).alias("approxChars"), F.slice(names, 1, keys).alias("keys"), F.nullif(F.greatest(F.size(names) - keys, F.lit(0)), F.lit(0)).alias("keysDropped")))
    least = F.to_json(F.struct(F.lit(True).alias("__truncated"), F.size(names).alias("keyCount")))
    return F.when(F.char_length(text) <= all_, text).when(F.char_length(note) <= all_, note).otherwise(least)


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Stored vectors with new ones in place of those of the same key; of new ones with one key the last by their order column `at` counts, if there is one."""
    if "at" in new.columns:
        rest = [c for c in new.columns if c != key]
        new = new.groupBy(key).agg(F.max_by(F.struct(*rest), "at").alias("r")).select(key, "r.*")
    return old.join(new.select(key), key, "left_anti").unionByName(new.drop("at") if "at" not in old.columns else new)


def put_blobs(blobs: DataFrame, path: str) -> DataFrame:
    """sha and size of binary contents, each written once under its hash, partitioned by the hash's first two digits.

    Contents that stand there already are not written again; null ones are left out. blobs: content.
    """
    spark = blobs.sparkSession
    fresh = blobs.filter("content IS NOT NULL").select(F.sha2("content", 256).alias("sha"), "content").groupBy("sha").agg(F.first("content").alias("content"))
    try:
        known = spark.read.parquet(path).select("sha")
    except AnalysisException:  # nothing is stored yet
        known = spark.createDataFrame([], "sha string")
    put = fresh.join(known, "sha", "left_anti").withColumn("shard", F.substring("sha", 1, 2))
    put.write.mode("append").partitionBy("shard").parquet(path)
    return fresh.select("sha", F.octet_length("content").alias("size"))


# --- markdown of books

_NUMBERS = ("wordCount", "chapterCount", "qualityScore", "conceptualDensity", "originality", "year")


def _unquoted(v: str) -> str:
    if len(v) < 2 or v[0] != '"' or v[-1] != '"':
        return v
    return re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), v[1:-1])


def typed_front_matter(text: str | None) -> dict:
    """Keys of a front matter with their types: lists inline or by lines, numbers of the known number fields, truth values, texts with quotes undone."""
    m = re.match(r"---\n(.*?)\n---\n", text or "", re.S)
    out: dict = {}
    key = None
    for line in (m[1] if m else "").split("\n"):
        item = re.match(r"  - (.*)", line)
        if item:
            if key:
                out[key].append(_unquoted(item[1].strip()))
            continue
        key = None
        name, colon, value = line.partition(":")
        name, value = name.strip(), value.strip()
        if not colon:
            continue
        if not value:
            key, out[name] = name, []
        elif value[0] == "[" and value[-1] == "]":
            out[name] = [_unquoted(x.strip()) for x in value[1:-1].split(",")] if value[1:-1].strip() else []
        elif name in _NUMBERS and re.fullmatch(r"-?\d+(?:\.\d+)?", value):
            out[name] = float(value) if "." in value else int(value)
        else:
            out[name] = value == "true" if name == "isFictionOrWater" else _unquoted(value)
    return out


def stored_chapters(books: DataFrame, key: str, markdown: str = "markdown") -> DataFrame:
    """key, chapter_no, title, paragraphs and words of stored books: behind the front matter, chapters open at second-level headings.

    Blank lines part paragraphs; those that are image references alone are left out, and so is what stands before the first chapter or
    behind the mark of image references. Texts without a front matter have no chapters.
    """
    body = F.regexp_extract(F.col(markdown), r"(?s)^---\n.*?\n---\n(.*)\z", 1)
    body = F.regexp_replace(body, r"(?s)\n(?:---\n)?<!-- image refs.*\z", "")
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(body, r"\r\n", "\n")), r"\n##\s+")
    rows = books.filter(F.col(markdown).rlike(r"(?s)^---\n.*?\n---\n")).select(key, F.posexplode(parts).alias("chapter_no", "chapter")).filter("chapter_no > 0")
    text = F.regexp_replace(F.regexp_extract("chapter", r"(?s)^[^\n]*\n?(.*)\z", 1), r"(?m)^# .*$", "")
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.btrim(p, F.lit(" \t\n"))), lambda p: (p != "") & ~p.rlike(r"^!\[[^\]]*\]\[[^\]]+\]\z"))
    out = rows.select(key, "chapter_no", F.trim(F.regexp_extract("chapter", r"^([^\n]*)", 1)).alias("title"), paragraphs.alias("paragraphs"))
    return out.withColumn("words", word_count(F.array_join("paragraphs", " ")))


# How lines open that mark a chapter.
CHAPTER_MARK = r"(?m)^[ \t]*((?:ГЛАВА|Глава|Розділ|РОЗДІЛ|Chapter|CHAPTER|Часть|ЧАСТЬ|Part|PART|Раздел|РАЗДЕЛ)\s+(?:[IVXLCDM]+|[0-9]{1,3})[.\s:].{0,200})$"


def marked_chapters(texts: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """key, chapter_no, title and body of texts that are cut at chapter marks; fewer than `least` chapters with a body leave the text alone."""
    marked = F.regexp_replace(F.col(text), CHAPTER_MARK, "\u0001$1")
    parts = texts.select(key, F.posexplode(F.split(marked, "\u0001")).alias("chapter_no", "part")).filter("chapter_no > 0")
    rows = parts.select(key, "chapter_no", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("title"), F.btrim(F.regexp_extract("part", r"(?s)^[^\n]*\n(.*)\z", 1), F.lit(" \t\r\n")).alias("body")).filter("body <> ''")
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(key))).filter(F.col("__n") >= least).drop("__n")


def folded_chapters(sections: DataFrame, key: str) -> DataFrame:
    """key, chapter_no, title and paragraphs: sections of level 3 and deeper fold into the chapter before them as heading lines.

    sections: key, section_order, level, title, paragraphs. A chapter without a title, and one of stray deeper sections, is "Body".
    """
    w = Window.partitionBy(key).orderBy("section_order").rowsBetween(Window.unboundedPreceding, 0)
    s = sections.withColumn("chapter_no", F.sum((F.col("level") <= 2).cast("int")).over(w))
    line = F.when((F.col("level") > 2) & (F.coalesce("title", F.lit("")) != ""), F.array(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("title")))).otherwise(F.array().cast("array<string>"))
    rows = s.select(key, "chapter_no", "section_order", "level", "title", F.concat(line, "paragraphs").alias("ps"))
    first = F.min_by(F.when(F.col("level") <= 2, F.col("title")), "section_order")
    got = rows.groupBy(key, "chapter_no").agg(first.alias("title"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section_order", "ps"))), lambda x: x["ps"])).alias("paragraphs"))
    return got.select(key, "chapter_no", F.coalesce(F.nullif("title", F.lit("")), F.lit("Body")).alias("title"), "paragraphs")
