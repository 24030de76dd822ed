"""Column functions on text: tokens, similarity, cleaning, quality, language, headings, titles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII word boundary, as in engines whose \b knows only [A-Za-z0-9_].
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

#: What stands around lines and is no part of them.
BLANKS = " \t\r\n\f\v\u00a0\ufeff"


def tokens(text: Column, least: int = 2, most: int = 64) -> Column:
    """Lower-case runs of letters and digits of the given lengths; null text gives null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: (F.length(x) >= least) & (F.length(x) <= most))


def token_set(text: Column, least: int = 3) -> Column:
    return F.array_distinct(tokens(text, least, 1 << 30))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token sets; both empty 1, one empty 0."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def token_similarity(a: Column, b: Column) -> Column:
    """Shared tokens over the larger set; 0 where one is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def levenshtein_ratio(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: F.length(x) > 0))


def canonical_name(text: Column) -> Column:
    """Lower case, punctuation out, blanks collapsed and trimmed; apply normalized() before where text is not in that form."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s_-]", ""), r"\s+", " "))


def normalized(text: Column, form: str = "NFKC") -> Column:
    """Unicode normal form, in Arrow batches; Spark has no function for it."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if t is None else unicodedata.normalize(form, t) for t in b.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def _without(text: Column, pattern: str) -> Column:
    """Characters of a text that match a one-character pattern, counted by what is left without them."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def approx_tokens(text: Column) -> Column:
    """Estimated model tokens by script: ASCII / 4 + Cyrillic / 2 + CJK / 1.5 + rest / 3, rounded up."""
    n = F.char_length(text)
    ascii_, cyr, cjk = _without(text, r"[\x00-\x7f]+"), _without(text, "[Ѐ-ӿ]+"), _without(text, "[぀-ヿ一-鿿]+")
    return F.ceil(ascii_ / 4 + cyr / 2 + cjk / 1.5 + (n - ascii_ - cyr - cjk) / 3).cast("bigint")


def token_budget(text: Column, most: int) -> Column:
    """struct<text, tokens, trimmed>: a text over `most` estimated tokens cut in proportion less five hundredths.

    The cut falls behind the last end of a sentence where that lies in the last three tenths, else an ellipsis follows.
    """
    n = approx_tokens(text)
    room = F.floor(F.char_length(text) * (F.lit(most) / n) * 0.95).cast("int")
    head = F.substring(text, F.lit(1), room)
    last = lambda mark: F.when(F.locate(mark[::-1], F.reverse(head)) > 0, F.char_length(head) - F.locate(mark[::-1], F.reverse(head)) - len(mark) + 1).otherwise(-1)
    end = F.greatest(*[last(m) for m in (". ", "! ", "? ", "…", ".\n", "?\n", "!\n")])
    cut = F.when(end > room * 0.7, F.substring(head, F.lit(1), end + 1)).otherwise(F.concat(F.rtrim(head), F.lit(" …")))
    return F.when(n <= most, F.struct(text.alias("text"), n.alias("tokens"), F.lit(False).alias("trimmed"))).otherwise(F.struct(cut.alias("text"), n.alias("tokens"), F.lit(True).alias("trimmed")))


def text_quality(text: Column) -> Column:
    """0 below 200 characters, half letters, 50 words of 2 to 30 characters, or a mean outside 2..15; else 0.5 to 1.

    The score is the share of letters, with a tenth more from 1,000 characters and from 200 words on.
    """
    n = F.char_length(text)
    share = F.try_divide(_without(text, r"\p{L}+"), n)
    words = F.filter(F.split(text, r"\s+"), lambda w: F.char_length(w).between(2, 30))
    count = F.size(words)
    mean = F.try_divide(F.char_length(F.array_join(words, "")), count)
    score = share + F.when(n >= 1000, 0.1).otherwise(0.0) + F.when(count >= 200, 0.1).otherwise(0.0)
    good = (n >= 200) & (share >= 0.5) & (count >= 50) & mean.between(2, 15)
    return F.when(F.coalesce(good, F.lit(False)), F.least(F.greatest(score, F.lit(0.5)), F.lit(1.0))).otherwise(0.0)


def script_language(text: Column) -> Column:
    """Language by marks of the first 2,048 characters (a fixed window of this detector): uk, ru, de, fr, es, en or unknown."""
    head = F.substring(text, 1, 2048)
    low = F.lower(head)
    n = lambda p: _without(low, p)
    uk, ru, cyr, lat = n("[іїєґ]+"), n("[ёыъэ]+"), n("[Ѐ-ӿ]+"), n("[a-z]+")
    rules = [
        (F.char_length(F.trim(head)) < 4, "unknown"),
        ((uk >= 2) & (cyr > 20), "uk"),
        ((ru >= 2) & (cyr > 20) & (uk == 0), "ru"),
        ((cyr > 50) & (uk == 0), "ru"),
        ((n("[äöüß]+") >= 3) & (lat > 20), "de"),
        ((n("[àâçéèêëîïôûùüÿœæ]+") >= 3) & (lat > 20), "fr"),
        ((n("[áéíóúñ¿¡]+") >= 2) & (lat > 20), "es"),
        ((lat > 50) & (lat / F.greatest(F.lit(1), lat + cyr) >= 0.8), "en"),
    ]
    return reduce(lambda out, r: F.when(r[0], F.lit(r[1])).otherwise(out), reversed(rules), F.lit("unknown"))


# Words that open a heading.
HEADING_WORDS = r"(?iu)^(?:глава|раздел|часть|введение|заключение|приложение|предисловие|послесловие|содержание|оглавление|chapter|section|part|introduction|conclusion|appendix|preface|foreword|bibliography|references|teil|chapitre|annexe)" + ASCII_BOUNDARY


def heading(line: Column) -> Column:
    """Whether a line of at most 120 characters looks like a heading.

    It opens with a chapter word, or is numbered, in capitals, or has two to ten words of which six tenths start with a capital.
    """
    s = F.btrim(line, F.lit(BLANKS))
    n = F.char_length(s)
    numbered = s.rlike(r"^(?:§\s*)?[0-9]+(?:\.[0-9]+)*\.?\s+\S") & (n < 100) & ~F.substring(s, 21, 120).rlike(r"[.!?]\s+\S")
    capitals = s.rlike(r"^[А-ЯЁA-Z0-9\s.,:;«»\-—()]+\z") & (n < 80)
    words = F.split(s, r"\s+")
    large = F.size(F.filter(words, lambda x: x.rlike('^[\\p{Lu}0-9«"(]')))
    titled = (n < 100) & ~s.rlike(r"[.!?]\s*\z") & F.size(words).between(2, 10) & (large >= F.size(words) * 0.6)
    return F.coalesce((n > 0) & (n <= 120) & (s.rlike(HEADING_WORDS) | numbered | capitals | titled), F.lit(False))


def clean_paragraph(text: Column) -> Column:
    """Soft hyphens and control characters out, line ends unified, runs of blanks and blank lines shortened; null stays null."""
    steps = (("­", ""), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "))
    return F.regexp_replace(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text), r"^\s+|\s+\z", "")


# Paragraphs of books that are no content (page marks, legal notes, ornaments), and marks of footnotes at an end.
PAGE_MARKS = r"(?iu)^(?:[-—–]\s*[0-9]{1,4}\s*[-—–]|\[\s*[0-9]{1,4}\s*\]|(?:page|p\.|стр\.?|страница)\s*[0-9]{1,4}|[0-9]{1,4}|—{2,}\s*[0-9]+\s*—{2,})\s*\z"
BOILERPLATE = r"(?iu)^(?:isbn[\s\-:]?\s*[0-9]|©\s*[0-9]{4}|copyright\s*©?\s*[0-9]{4}|all\s+rights\s+reserved|все\s+права\s+защищены|printed\s+in\s+|напечатано\s+в\s+|library\s+of\s+congress)"
ORNAMENTS = r"(?iu)^(?:\s*[*•·⋅★☆◆◇■□▪▫◦‣⁃]\s*[*•·⋅★☆◆◇■□▪▫◦‣⁃]\s*[*•·⋅★☆◆◇■□▪▫◦‣⁃]\s*|[-—–_=]{3,}\s*|(?:end of chapter|конец главы|конец|the end|fin)\s*\.?\s*)\z"
FOOTNOTE = r"(?:^|\s)(?:\[[0-9]+\]|†+|‡+|\^?[0-9]+)\s*\z"


def clean_paragraphs(df: DataFrame, key: str, paragraphs: Column, *, pages: bool = True, boilerplate: bool = True, ornaments: bool = True, running: bool = True, footnotes: bool = True, repeats: int = 3) -> DataFrame:
    """key, position and paragraph of what is content: page marks, legal notes, ornaments and running lines are left out, marks of
    footnotes at the end are cut, and what holds no letter is dropped.

    A running line has fewer than 40 characters and stands `repeats` times or more under one key; lines are counted by an
    aggregation over (key, line), never within one row. Null arrays and null paragraphs give nothing.
    """
    rows = df.select(F.col(f"`{key}`"), F.posexplode(paragraphs).alias("position", "paragraph")).withColumn("paragraph", F.btrim("paragraph", F.lit(BLANKS))).filter(F.char_length("paragraph") > 0)
    p = F.col("paragraph")
    keep = F.lit(True)
    for wanted, pattern in ((pages, PAGE_MARKS), (boilerplate, BOILERPLATE), (ornaments, ORNAMENTS)):
        keep = keep & ~p.rlike(pattern) if wanted else keep
    out = rows
    if running:
        often = rows.filter(F.char_length("paragraph") < 40).groupBy(F.col(f"`{key}`").alias("__k"), p.alias("__p")).agg(F.count("*").alias("n")).filter(F.col("n") >= repeats)
        out = rows.join(often, rows[key].eqNullSafe(often["__k"]) & (rows["paragraph"] == often["__p"]), "left_anti")
    out = out.filter(keep)
    if footnotes:
        out = out.withColumn("paragraph", F.rtrim(F.regexp_replace("paragraph", FOOTNOTE, "")))
    return out.filter(F.col("paragraph").rlike(r"\p{L}"))


def compressed_chapter(text: Column, head: int = 6000, tail: int = 2000) -> Column:
    return F.when(F.char_length(text) <= head + tail, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n…\n"), F.right(text, F.lit(tail))))


def plain_isbn13(text: Column) -> Column:
    """An ISBN field as 13 digits: blanks and hyphens out, ISBN-10 converted, check digits as they are; null where it is neither."""
    d = F.regexp_replace(text, r"[-\s]", "")
    body = F.concat(F.lit("978"), F.substring(d, 1, 9))
    total = reduce(lambda s, i: s + F.substring(body, i, 1).cast("int") * (1 if i % 2 else 3), range(1, 13), F.lit(0))
    return F.when(d.rlike(r"^97[89]") & (F.length(d) == 13), d).when(d.rlike(r"^[0-9]{9}[0-9Xx]\z"), F.concat(body, ((10 - total % 10) % 10).cast("string")))


def isbns(text: Column, most: int = 3) -> Column:
    """Valid ISBNs in a text as 13 digits, each once, `most` at most: those of 13 digits in their order, then those of 10, converted."""
    found = F.regexp_extract_all(text, F.lit(r"((?:97[89][- ]?)?[0-9](?:[- ]?[0-9]){8}[- ]?[0-9Xx])"), 1)
    plain = F.transform(found, lambda x: F.upper(F.regexp_replace(x, "[- ]", "")))
    digit = lambda x, i: F.substring(x, i, 1).cast("int")
    check13 = lambda x: (10 - reduce(lambda a, i: a + digit(x, i) * (1 if i % 2 else 3), range(1, 13), F.lit(0)) % 10) % 10
    sum10 = lambda x: reduce(lambda a, i: a + digit(x, i) * (11 - i), range(1, 10), F.lit(0))
    tenth = lambda x: F.when(F.substring(x, 10, 1) == "X", 10).otherwise(digit(x, 10))
    long = F.filter(plain, lambda x: (F.length(x) == 13) & ~x.contains("X") & (check13(x) == digit(x, 13)))
    short = F.filter(plain, lambda x: (F.length(x) == 10) & ((sum10(x) + tenth(x)) % 11 == 0))
    body = lambda x: F.concat(F.lit("978"), F.substring(x, 1, 9))
    as13 = F.transform(short, lambda x: F.concat(body(x), check13(F.concat(body(x), F.lit("0"))).cast("string")))
    return F.slice(F.array_distinct(F.concat(long, as13)), 1, most)


def isbn13(text: Column) -> Column:
    """The first valid ISBN of a text, null where none is valid."""
    return F.get(isbns(text, 1), F.lit(0))


def head_and_tail(paragraphs: Column, head: int = 250, tail: int = 150) -> Column:
    """The paragraphs at the beginning and the end of a book in which its numbers stand, as one text."""
    rest = F.greatest(F.size(paragraphs) - head, F.lit(0))
    end = F.slice(F.reverse(paragraphs), F.lit(1), F.least(rest, F.lit(tail)))
    return F.array_join(F.concat(F.slice(paragraphs, 1, head), F.reverse(end)), " ")
