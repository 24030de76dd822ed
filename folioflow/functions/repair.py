"""Repair of text and titles: lines read in a wrong charset, scripts mixed in words, titles that say nothing or stand in hexadecimal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters that look Cyrillic, pieces of wrongly read text, and glyphs of broken PDF fonts.
LOOKALIKES = "pcoaexyPCOAEXBHMTK"
WRONG = ("Ã", "Â", "Ð", "Ñ", "ð", "ñ", "Ç", "È", "Í", "Î", "Ï", "ß")
GLYPHS = "ŁłæÆŒœØøı˚ˇ˛˝ˆ˜"
# Titles that are parts of books, and how structural titles look.
NO_TITLES = ("предисловие", "введение", "оглавление", "содержание", "об авторе", "об авторх", "об авторах", "about the author", "about the authors", "contents", "table of contents", "foreword", "preface", "introduction", "copyright", "colophon", "title page")
STRUCTURAL = r"(?iu)^(?:chapter|section|page|глава|раздел|страница)\s+[0-9ivxlcdm]+\z"
_HEX = re.compile(r"\s*<\s*([0-9A-Fa-f\s]+?)\s*>\s*\Z")


def _weight(text: str) -> tuple[int, int]:
    """How much a text looks like Cyrillic and how little like wrongly read bytes; and its Cyrillic letters."""
    cyrillic = sum("Ѐ" <= c <= "ӿ" for c in text)
    bad = 2 * sum("À" <= c <= "ÿ" for c in text) + 5 * sum("\x80" <= c <= "\x9f" for c in text) + 3 * sum(text.count(w) for w in WRONG) + 3 * sum(c in GLYPHS for c in text)
    return 3 * cyrillic - bad, cyrillic


def _recoded(line: str, read: str, written: str) -> str | None:
    """The line's bytes under one charset, read under another; characters that the first lacks become question marks."""
    try:
        return line.encode(read, "replace").decode(written, "replace")
    except UnicodeError:
        return None


def repaired_line(line: str) -> tuple[str, str | None]:
    """A line and the repair it took: 'double_utf8', 'koi8' or 'latin1', or none.

    UTF-8 read as CP1251 shows in two letters that make up a third of the Cyrillic, and its bytes must be UTF-8 throughout; KOI8-R read as
    CP1251 shows in more П than О, which stand for о and н then, and о must be as frequent as usual after the repair; CP1251 read as Latin-1 shows in four
    odd characters or more, and its repair must raise the weight of the text.
    """
    before, cyrillic = _weight(line)
    if cyrillic >= 20 and sum(c in "РС" for c in line) > 0.35 * cyrillic:
        try:
            return line.encode("cp1251").decode("utf-8"), "double_utf8"
        except UnicodeError:
            pass
    # shares in small numbers of letters mean nothing, hence the least counts
    if cyrillic >= 40 and line.count("П") > 0.06 * cyrillic and line.count("П") > 1.2 * line.count("О"):
        out = _recoded(line, "cp1251", "koi8-r")
        if out and sum(c in "оО" for c in out) > 0.05 * cyrillic and _weight(out)[1] >= 0.9 * cyrillic:
            return out, "koi8"
    odd = sum("À" <= c <= "ÿ" or "\x80" <= c <= "\x9f" for c in line) + sum(line.count(w) for w in WRONG)
    if odd >= 4 and all(c <= "ÿ" for c in line):
        out = _recoded(line, "latin-1", "cp1251") or line
        after, n = _weight(out)
        if after >= before + 12 and n > cyrillic:
            return out, "latin1"
    return line, None


def repaired_lines(text: Column) -> Column:
    """struct<text, double_utf8, koi8, latin1, problem>: a text with its lines repaired and how many by each repair.

    problem is 'encoding_garble' from five repaired lines on, 'ocr_confusion' where odd characters outweigh the rest, else 'clean'. A null text stays null.
    """
    names = ("double_utf8", "koi8", "latin1")
    kind = pa.struct([("text", pa.string()), *((n, pa.int32()) for n in names), ("problem", pa.string())])

    def one(t: str | None) -> dict | None:
        if t is None:
            return None
        lines = [repaired_line(x) for x in t.split("\n")]
        out = "\n".join(x for x, _ in lines)
        count = {n: sum(how == n for _, how in lines) for n in names}
        cyrillic = sum("Ѐ" <= c <= "ӿ" for c in out)
        odd = sum("À" <= c <= "ÿ" for c in out) + 2 * sum("\x80" <= c <= "\x9f" for c in out) + 3 * sum(out.count(w) for w in WRONG) + 3 * sum(c in GLYPHS for c in out)
        problem = "encoding_garble" if sum(count.values()) >= 5 else "ocr_confusion" if odd >= 240 and odd > 2 * cyrillic else "clean"
        return {"text": out, **count, "problem": problem}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([one(t) for t in b.to_pylist()], kind)

    return F.arrow_udf(run, "struct<text:string,double_utf8:int,koi8:int,latin1:int,problem:string>")(text)


def mixed_scripts(text: Column) -> Column:
    """struct<lookalikes, digits, mixed, tokens, confused>: words of three characters or more that mix scripts.

    lookalikes: three Cyrillic letters or more beside Latin ones that look alike; mixed: two or more beside other Latin letters but i; digits: a digit between
    letters, one of them Cyrillic. A text is confused from three weighted words on (five from 50 words on), by their share of 0.03, or where
    Latin letters make up a twentieth to two fifths of its letters.
    """
    left = lambda t, keep: F.char_length(F.regexp_replace(t, f"[^{keep}]", ""))
    words = F.filter(F.split(text, r"\s+"), lambda w: F.char_length(w) >= 3)
    cyr = lambda w: left(w, "Ѐ-ӿ")
    alike = F.filter(words, lambda w: (cyr(w) >= 3) & (left(w, LOOKALIKES) >= 1))
    mixed = F.filter(words, lambda w: ~((cyr(w) >= 3) & (left(w, LOOKALIKES) >= 1)) & (cyr(w) >= 2) & (left(w, "A-HJ-Za-hj-z") >= 1))
    digit = F.filter(words, lambda w: w.rlike("[Ѐ-ӿ][0-9]+[a-zA-ZЀ-ӿ]|[a-zA-ZЀ-ӿ][0-9]+[Ѐ-ӿ]"))
    n, a, m, d = F.size(words), F.size(alike), F.size(mixed), F.size(digit)
    weighted = a + 2 * d + m
    cyrillic, latin = left(text, "Ѐ-ӿ"), left(text, "A-HJ-Za-hj-z")
    share = latin / F.greatest(F.lit(1), cyrillic + latin)
    confused = (weighted >= F.when(n < 50, 3).otherwise(5)) | ((n > 0) & (weighted > 0.03 * n)) | ((cyrillic > 50) & (share > 0.05) & (share < 0.4))
    return F.when(text.isNotNull(), F.struct(a.alias("lookalikes"), d.alias("digits"), m.alias("mixed"), n.alias("tokens"), confused.alias("confused")))


def hex_title(raw: str | None) -> str | None:
    """A title in hexadecimal between angle brackets, read as UTF-16 with a mark, CP1251, UTF-16 or ASCII, whichever is most readable; null below 0.8."""
    m = _HEX.match(raw or "")
    digits = re.sub(r"\s+", "", m[1]) if m else ""
    if not digits or len(digits) % 2:
        return None
    data = bytes.fromhex(digits)
    readings = [data[2:].decode("utf-16-be", "replace")] if data[:2] == b"\xfe\xff" else []
    readings += [data.decode("cp1251", "replace"), data.decode("utf-16-be", "replace"), "".join(chr(b) if 0x20 <= b < 0x7F else "�" for b in data)]
    good = re.compile("[ -~\xa0-ɏͰ-ϿЀ-ӿ -⃏№]")
    best, share = None, 0.0
    for text in (re.sub(r"[\x00-\x1f\x7f]", "", t).strip() for t in readings):
        if text and (s := len(good.findall(text)) / len(text)) > share:
            best, share = text, s
    return best if share >= 0.8 else None


def sane_title(raw: Column) -> Column:
    """A raw title trimmed; hexadecimal ones decoded; null where it is empty, garbage, or 250 characters without a blank."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([hex_title(t) for t in b.to_pylist()], pa.string())

    t = F.btrim(raw, F.lit(" \t\r\n"))
    is_hex = t.rlike(r"^<\s*[0-9A-Fa-f\s]+\s*>\z")
    plain = F.when(is_hex, F.arrow_udf(run, "string")(F.when(is_hex, t))).otherwise(t)
    weird = F.char_length(F.regexp_replace(plain, "[^\\x00-\\x1f-�]", ""))
    junk = ((F.char_length(plain) >= 30) & (weird >= 0.8 * F.char_length(plain))) | ((F.char_length(plain) >= 250) & ~plain.rlike(r"\s"))
    return F.when((plain != "") & ~junk, plain)


def says_nothing(title: Column) -> Column:
    """Whether a title is null, empty, the name of a part of a book, or a chapter's number."""
    t = F.regexp_replace(F.lower(F.btrim(title, F.lit(" \t\r\n"))), "^[\\s\"'`(\\[{]+|[\\s\"'`)\\].,:;!?]+\\z", "")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.coalesce((t == "") | t.isin(*NO_TITLES) | t.rlike(STRUCTURAL), F.lit(True))


def best_title(*candidates: Column) -> Column:
    """The first sane candidate that says something, else the first sane one, else null."""
    sane = [sane_title(c) for c in candidates]
    return F.coalesce(*[F.when(~says_nothing(c), c) for c in sane], *sane)
