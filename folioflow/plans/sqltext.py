"""Pieces of DuckDB SQL that several queries need: decomposed text, letters as single bytes, edit distances by characters."""

from __future__ import annotations

import unicodedata

_SINGLE = "абвгдежзийклмнопрстуфхцчшщъыьэюяєіґßœæøđłı"
_BYTES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_`{|}~"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfkd(expr: str) -> str:
    """The text decomposed (NFKD) for characters below U+0530 and general punctuation."""
    table = {chr(c): d for c in [*range(0xA0, 0x530), *range(0x2000, 0x2150)] if (d := unicodedata.normalize("NFKD", chr(c))) != chr(c)}
    entries = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items())
    return f"array_to_string(list_transform(regexp_extract_all({expr}, '(?s).'), lambda ch: coalesce(MAP {{{entries}}}[ch], ch)), '')"


def as_bytes(expr: str) -> str:
    """A normalised text (small letters of two scripts, digits, blanks) with one byte a letter, for levenshtein(), which counts bytes."""
    return f"translate({expr}, {quoted(_SINGLE)}, {quoted(_BYTES[: len(_SINGLE)])})"


def edit_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN 1.0 ELSE 1.0 - levenshtein({as_bytes(a)}, {as_bytes(b)}) / greatest(length({a}), length({b}))::DOUBLE END)"
