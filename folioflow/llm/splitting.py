"""Problem 3: oversized items cut into pieces at natural boundaries, with balanced targets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import bounded_collect, require

# Kinds of boundary, strongest first; a cut falls behind the match.
_BOUNDARIES = (
    (5, re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*")),
    (4, re.compile(r"\r\n|\r|\n")),
    (3, re.compile(r"[.!?…]+[\"'»”’)\]]*\s+")),
    (2, re.compile(r"[,;:—–]\s+")),
    (1, re.compile(r"\s+")),
)
#: How far, as a share of the balanced step, a cut may move from its target for a weaker boundary kind.
_REACH = {5: 0.45, 4: 0.35, 3: 0.3, 2: 0.2, 1: 0.15}


def _boundaries(text: str) -> dict[int, int]:
    """Cut position -> strength of the strongest boundary that ends there."""
    at: dict[int, int] = {}
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            at.setdefault(m.end(), strength)
    return at


def split_points(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans of code points of the pieces of one text.

    The minimum piece count k gives equal-length targets; every target is snapped to the strongest
    boundary near it (nearest first among equals); when the rest no longer fits in the pieces that are
    left, k grows by one. Consecutive pieces share exactly `overlap` code points. Where no boundary
    lies in reach, the nearest weaker one anywhere in the allowed range serves, and only a text
    without any boundary there is cut at the target itself.
    """
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    ordered = sorted(_boundaries(text).items())
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        spans, start = [], 0
        step = (n - overlap) / k
        for i in range(1, k):
            left = k - i
            # the cut must leave progress here and no more behind it than the pieces left can hold
            low = max(start + overlap + 1, n - left * (limit - overlap))
            high = min(start + limit, n - 1)
            if low > high:
                break
            target = min(max(round(overlap + i * step), low), high)
            end = _snap(ordered, target, low, high, step)
            spans.append((start, end))
            start = end - overlap
        else:
            if n - start <= limit:
                return [*spans, (start, n)]
        k += 1


def _snap(ordered: list[tuple[int, int]], target: int, low: int, high: int, step: float) -> int:
    import bisect

    near = ordered[bisect.bisect_left(ordered, (low, 0)) : bisect.bisect_right(ordered, (high, 9))]
    reach = [(s, -abs(p - target), p) for p, s in near if abs(p - target) <= _REACH[s] * step]
    if reach:
        return max(reach)[2]
    return min((abs(p - target), -s, p) for p, s in near)[2] if near else target


def _pieces(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int, str]]:
    spans = split_points(text, limit, min(max(overlap or 0, 0), limit - 1))
    return [(i, s, text[s:e]) for i, (s, e) in enumerate(spans, 1)]


_PIECE_TYPE = "array<struct<piece_n:int,start_char:int,text:string>>"


def limit_of_level(limits: DataFrame, level: Column) -> tuple[Column, Column]:
    """CASE expressions for the limit and overlap of a level; the limits are a small fixed table (at most 1,000 rows)."""
    rows = bounded_collect(limits.select("level", "max_chars", "overlap_chars"), 1000, "the table of limits")
    most = overlap = F.lit(None).cast("int")
    for r in rows:
        if r.level is not None and r.max_chars is not None and r.max_chars > 0:
            most = F.when(level == r.level, F.lit(r.max_chars)).otherwise(most)
            overlap = F.when(level == r.level, F.lit(r.overlap_chars or 0)).otherwise(overlap)
    return most, overlap


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the chunks whose text exceeds the limit of their level.

    One row per piece, with all columns of the chunk (path_titles among them), text replaced by the
    piece's text, and the columns piece_n, pieces (numbered inside the chunk) and start_char added; input
    columns of these names are replaced. A null text, a null level or a level without a positive limit
    is never oversized. Repeated rows give repeated pieces. An overlap of a limit or more is reduced
    to one less than the limit; a negative or null one is none. An empty table gives an empty result.
    No shuffle: lengths are compared in the JVM and only oversized rows reach Python.
    """
    require(chunks, "level", "text")
    most, overlap = limit_of_level(limits, F.col("level"))
    cut = F.udf(_pieces, _PIECE_TYPE, useArrow=True)
    kept = [c for c in chunks.columns if c not in ("text", "piece_n", "pieces", "start_char")]
    over = chunks.filter(F.col("text").isNotNull() & (F.char_length("text") > most))
    cuts = over.select(*[F.col(f"`{c}`") for c in kept], cut("text", most, overlap).alias("__cuts"))
    return cuts.select(
        *[F.col(f"`{c}`") for c in kept], F.size("__cuts").alias("pieces"), F.explode("__cuts").alias("__cut")
    ).select(*[F.col(f"`{c}`") for c in kept], "pieces", "__cut.piece_n", "__cut.start_char", "__cut.text")


def renumbered_pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces with part_n and part_of numbered anew within their section.

    A section is (book_id, level, section_order). Its old parts count once each, also where a chunk is
    stored twice; a part that was cut counts with the most pieces any of its copies has. Chunks within
    their limit keep their text but move on by the pieces before them, so they appear here too where
    their section has a cut; other sections are untouched and left out. A null part_n counts as 1.
    """
    require(chunks, "vec_rowid", "book_id", "level", "section_order", "part_n", "text")
    key = ["book_id", "level", "section_order"]
    cut = split_oversized(chunks, limits)
    part = F.coalesce("part_n", F.lit(1))
    touched = cut.filter("piece_n = 1").select(*key, part.alias("__p"), "pieces").groupBy(*key, "__p").agg(F.max("pieces").alias("pieces"))
    # per section one small struct list: only its cut parts, never its rows
    grown = touched.groupBy(*key).agg(F.collect_list(F.struct(F.col("__p"), F.col("pieces"))).alias("__grown"))
    total = chunks.groupBy(*key).agg(F.max(F.greatest(part, F.coalesce("part_of", F.lit(1)))).alias("__parts"))
    extra = lambda cond: F.aggregate("__grown", F.lit(0), lambda acc, g: acc + F.when(cond(g), g["pieces"] - 1).otherwise(0))
    section = grown.select(*[F.col(c).alias(f"__{c}") for c in key], "__grown")
    section = section.join(total, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]).drop(*key)
    link = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    most, _ = limit_of_level(limits, F.col("level"))
    fit = F.col("text").isNull() | ~F.coalesce(F.char_length("text") > most, F.lit(False))
    whole = chunks.filter(fit).withColumns({"piece_n": F.lit(1), "pieces": F.lit(1), "start_char": F.lit(0)})
    rows = cut.unionByName(whole.select(*cut.columns))
    return rows.join(section, link).select(
        "vec_rowid", *key, *[c for c in ("path_titles",) if c in rows.columns],
        (part + F.col("piece_n") - 1 + extra(lambda g: g["__p"] < part)).cast("int").alias("part_n"),
        (F.col("__parts") + extra(lambda g: F.lit(True))).cast("int").alias("part_of"),
        "piece_n", "start_char", "text",
    )


def oversized_ids(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Ids of the chunks that the operator had to cut, one row each."""
    return split_oversized(chunks, limits).filter("piece_n = 1 AND pieces > 1").select("vec_rowid").distinct()
