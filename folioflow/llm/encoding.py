"""Problem 4: text decoded with the wrong charset, found and restored by round trips.

A text is re-encoded under a candidate legacy charset and strictly decoded as the intended one;
a step is kept when a garbling cost (bits of a character-bigram model of clean text) drops, and
steps repeat for nested layers. Where no whole unit can be re-encoded, the UTF-8 sequences in it
are repaired one by one. Replacement characters and C1 controls mark what can't be restored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import bounded_collect, require

# Charsets as which text was read by mistake, and charsets in which it was written.
READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "koi8-u", "cp866", "mac_roman", "cp437", "cp850", "utf-16-le")
WRITTEN_IN = ("utf-8", "cp1251", "koi8-u", "koi8-r", "cp866", "cp1252", "mac_roman")
# Letters, digits, blanks and marks that clean text of the languages in use holds.
_CLEAN = (
    r"\x00-\x7Fа-яА-ЯёЁіїєґІЇЄҐéèêëàâçîïôûùüöäßñáíóúœÉÈÊÀÂÇÎÔÛÜÖÄÑÁÍÓÚŒ¿¡«»„“”’‘–—…°±µμ§·•‐‑¬­\xa0×№²³→≤≥"
)
#: A text without any of these holds no garbling: unexpected characters, two scripts in a word, capitals behind small letters,
#: three accented letters in a row, quotes and dashes of one code page read as letters of another.
SUSPECT = (
    rf"[^{_CLEAN}]|[a-z][а-яёА-ЯЁіїєґ]|[а-яёіїєґ][a-zA-Z]|[A-Z][а-яё]|[А-ЯЁ][a-zA-Z]|[а-яёіїєґ][А-ЯЁІЇЄҐ]|[a-zà-ÿ][À-Þ]|[À-ÿ]{{3}}|[‘’“”„«»°±µ§·][A-Za-z]?[‘“„»°±µ§]"
    r"|(?<!\w)ô(?=[a-zA-Z]{2})(?!t[eé])|[a-zA-Z.,!?]ö(?!\w)|(?<!\w)[ùû](?!\w)|(?<=[a-z,;] )[ЧЦ](?= [a-zA-Z])"
)
_SUSPECT = re.compile(SUSPECT)
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
#: Bits that a step must save at least, and bits per changed character.
LEAST_BITS, LEAST_BITS_PER_CHAR = 8.0, 1.0
#: Characters of texts that are looked at in one go.
_AT_ONCE = 1 << 21

class GarblingCost:
    """Bits a text costs under character bigrams of clean text; unseen characters and pairs cost most."""

    def __init__(self, texts: Iterable[str] = (), pairs: dict[str, int] | None = None) -> None:
        """Of texts, or of the counts of their character pairs."""
        pairs = Counter(pairs or {})
        for t in texts:
            if t and not _SUSPECT.search(t):
                t = _fold(t)
                pairs.update(map("".join, zip(t, t[1:], strict=False)))
        heads: Counter[str] = Counter()
        for p, n in pairs.items():
            heads[p[0]] += n
        chars = len(heads) + 100
        self.bits = {p: -math.log2((n + 0.05) / (heads[p[0]] + 0.05 * chars)) for p, n in pairs.items()}
        # an unseen pair of known characters, and a pair with an unknown one
        self.unseen = {c: -math.log2(0.05 / (n + 0.05 * chars)) for c, n in heads.items()}
        self.unknown = 16.0

    def __call__(self, text: str) -> float:
        t = _fold(text)
        bits, unseen, unknown = self.bits, self.unseen, self.unknown
        total = 0.0
        for a, b in zip(t, t[1:], strict=False):
            c = bits.get(a + b)
            if c is None:
                c = min(unseen[a], 14.0) if a in unseen and b in unseen else unknown
            total += c
        return total


def _fold(text: str) -> str:
    return " " + re.sub(r"\s", " ", re.sub(r"\d", "0", text)) + " "


@cache
def _byte_of(charset: str) -> dict[int, int]:
    """Code point -> byte, where undefined bytes stand for the control characters that decoders leave in their place."""
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(charset))] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):
        if b not in table.values():
            table.setdefault(b, b)
    return table


def _encode(text: str, charset: str) -> bytes | None:
    if charset == "utf-16-le":
        return text.encode(charset, "ignore") if any(c > "\u3000" for c in text) else None
    try:
        return text.encode(charset)
    except UnicodeEncodeError:
        if not _LOST.search(text):
            return None
    table = _byte_of(charset)
    return bytes(map(table.__getitem__, map(ord, text))) if table.keys() >= set(map(ord, text)) else None


def _decode(data: bytes, charset: str) -> str | None:
    try:
        return data.decode(charset)
    except UnicodeDecodeError:
        return None


@cache
def _runs_of(charset: str) -> re.Pattern[str]:
    """Runs of characters that are UTF-8 sequences under the charset."""
    char = {b: re.escape(chr(c)) for c, b in _byte_of(charset).items()}
    kind = lambda lo, hi: "[" + "".join(char[b] for b in range(lo, hi + 1) if b in char) + "]"
    more = kind(0x80, 0xBF)
    return re.compile(f"(?:{kind(0xC2, 0xDF)}{more}|{kind(0xE0, 0xEF)}{more}{{2}}|{kind(0xF0, 0xF4)}{more}{{3}})+")


def _pieces_repaired(text: str, charset: str) -> str:
    """The text with every run that reads as UTF-8 under the charset decoded, all else as it is."""
    table = _byte_of(charset)
    return _runs_of(charset).sub(lambda m: _decode(bytes(table[ord(c)] for c in m[0]), "utf-8") or m[0], text)


def _suspects(text: str) -> str:
    """The distinct words that hold something suspect; only they tell a garbled reading from a clean one."""
    return " ".join(sorted({w for w in text.split() if _SUSPECT.search(w)}))


def _marks(text: str) -> int:
    return sum(1 for _ in _SUSPECT.finditer(text))


def _high(text: str) -> int:
    return sum(c >= "\x80" for c in text)


def _round_trip(text: str, cost: GarblingCost, declared: str | None) -> tuple[str, str] | None:
    """The best single step for a whole text, by name, or nothing.

    Candidates are ranked on the suspect words alone; the best ones must then also encode and decode the whole
    text strictly, leave fewer suspect places in it and lower its cost.
    """
    words = _suspects(text)
    for wrong, right in _ranked(words, cost, declared):
        data = _encode(text, wrong)
        out = data and _decode(data, right)
        if out and _fewer(text, out, right) and cost(text) - cost(out) >= LEAST_BITS / 2:
            return out, f"{right} read as {wrong}"
    return None


def _fewer(text: str, out: str, right: str) -> bool:
    """Decoding as UTF-8 is strong evidence by itself; any other charset must clear half of the suspect places."""
    return _marks(out) < _marks(text) if right == "utf-8" else 2 * _marks(out) <= _marks(text)


@lru_cache(maxsize=50_000)
def _ranked(words: str, cost: GarblingCost, declared: str | None) -> list[tuple[str, str]]:
    now, least = cost(words), LEAST_BITS + LEAST_BITS_PER_CHAR * _high(words)
    ranked, seen = [], {words}
    for wrong in (declared, *READ_AS) if declared in READ_AS else READ_AS:
        data = _encode(words, wrong)
        if data is None:
            continue
        for right in WRITTEN_IN:
            out = _decode(data, right) if right != wrong else None
            if not out or out in seen:
                continue
            seen.add(out)
            if _fewer(words, out, right) and now - (c := cost(out)) >= least * (0.5 if right == "utf-8" else 1):
                ranked.append((right != "utf-8", c, wrong, right))
    return [(wrong, right) for _, _, wrong, right in sorted(ranked)]


def _in_parts(text: str, cost: GarblingCost) -> tuple[str, str] | None:
    """The best repair of single UTF-8 runs, for a text that no strict round trip fits as a whole."""
    words = _suspects(text)
    best, name = cost(words) - LEAST_BITS, ""
    for wrong in ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "koi8-r", "cp866"):
        out = _pieces_repaired(words, wrong)
        if out != words and _marks(out) < _marks(words) and (c := cost(out)) < best:
            best, name = c, wrong
    return (_pieces_repaired(text, name), f"utf-8 read as {name}, in parts") if name else None


_LINES = re.compile(r"[^\n\r]+")
_SENTENCES = re.compile(r"\S(?:.*?)(?:[.!?…](?=\s)|$)", re.S)


def _repair(text: str, cost: GarblingCost, declared: str | None, steps: list[str], parts: tuple) -> str:
    """Layers of round trips over the whole text, then the same over its smaller parts that are still suspect."""
    while _SUSPECT.search(text) and (got := _round_trip(text, cost, declared)):  # every step lowers the cost
        text, step = got
        steps.append(step)
    if not _SUSPECT.search(text):
        return text
    if parts:
        return parts[0].sub(lambda m: _repair(m[0], cost, declared, steps, parts[1:]) if _SUSPECT.search(m[0]) else m[0], text)
    while _SUSPECT.search(text) and (got := _in_parts(text, cost)):
        text, step = got
        steps.append(step)
    return text


def repair_text(text: str | None, cost: GarblingCost, declared: str | None = None) -> tuple[str | None, list[str], bool]:
    """Restored text, the steps taken, and whether garbling is left that can't be restored.

    The whole text is tried first, then its lines, then their sentences, as garbling may cover a part.
    """
    if not text or not _SUSPECT.search(text):
        return text, [], False
    steps: list[str] = []
    out = _repair(text, cost, declared, steps, (_LINES, _SENTENCES))
    return out, list(dict.fromkeys(steps)), bool(_LOST.search(out))


def _declared(name: str | None) -> str | None:
    n = (name or "").strip().lower().replace("_", "-")
    return {"windows-1252": "cp1252", "latin1": "latin-1", "iso-8859-1": "latin-1", "windows-1251": "cp1251", "utf-16le": "utf-16-le"}.get(n, n or None)


class _Characters:
    """Classes of characters for a quick look at whole batches, and numbers of the clean ones, of which there are few."""

    def __init__(self) -> None:
        chars = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
        held = lambda c: {x for x in chars if re.match(f"[{c}]", x)}
        clean = held(_CLEAN)
        self.clean = sorted(clean)
        # the sets that the pattern names; characters alike in all of them are one class
        names = ["a-z", "A-Z", "а-яёіїєґ", "А-ЯЁІЇЄҐ", "а-яёА-ЯЁіїєґ", "à-ÿ", "À-Þ", "‘’“”„«»°±µ§·", "‘“„»°±µ§", "ô", "ö", "ùû", "ЧЦ", r"\w"]
        sets = [held(n) for n in names]
        of = {x: tuple(x in s for s in sets) if x in clean else None for x in clean}
        kinds = sorted(set(of.values()))
        number = {k: i + 1 for i, k in enumerate(kinds)}
        self.kind = np.zeros(0x10000, np.uint8)  # 0: not clean
        self.number = np.full(0x10000, -1, np.int32)
        for i, x in enumerate(self.clean):
            self.kind[ord(x)] = number[of[x]]
            folded = " " if x.isspace() else "0" if x.isdigit() else x
            self.number[ord(x)] = self.clean.index(folded)
        n = len(kinds) + 1
        flag = np.zeros((len(sets), n), bool)
        for k, i in number.items():
            flag[:, i] = k
        low, cap, cyr_low, cyr_cap, cyr, ext, ext_cap, mark_a, mark_b, o1, o2, alone, dash, word = flag
        both = lambda a, b: np.logical_and.outer(a, b)
        self.pair = both(low, cyr) | both(cyr_low, low | cap) | both(cap, cyr) | both(cyr_cap, low | cap) | both(cyr_low, cyr_cap) | both(low | ext, ext_cap) | both(mark_a, mark_b) | both(~word, o1) | both(o2, ~word)
        self.first_alone, self.then = both(~word, alone | dash), both(alone | dash, ~word)
        self.accented, self.mark_a, self.mark_b, self.latin = ext | ext_cap, mark_a, mark_b, low | cap

    def suspects(self, codes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Whether each text may match SUSPECT; text holds the number of the text of every character, by which they are sorted."""
        k = np.where(codes < 0x10000, self.kind[np.minimum(codes, 0xFFFF)], 0)
        bad = k == 0
        if len(k) > 1:
            same = text[1:] == text[:-1]
            bad[1:] |= self.pair[k[:-1], k[1:]] & same
            starts, ends = np.ones(len(k), bool), np.ones(len(k), bool)
            starts[1:] = ~same | self.first_alone[k[:-1], k[1:]]
            ends[:-1] = ~same | self.then[k[:-1], k[1:]]
            odd = np.isin(codes, [ord(c) for c in "ùûЧЦôö"])
            bad |= odd & starts & ends
            bad |= odd & np.where(codes == ord("ô"), np.append(True, ~same), (codes == ord("ö")) & np.append(~same, True))
        if len(k) > 2:
            same = text[2:] == text[:-2]
            a, m, z = k[:-2], k[1:-1], k[2:]
            bad[2:] |= same & ((self.accented[a] & self.accented[m] & self.accented[z]) | (self.mark_a[a] & self.latin[m] & self.mark_b[z]))
        return np.bincount(text[bad], minlength=texts) > 0


@cache
def _characters() -> _Characters:
    return _Characters()


def _looked_at(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: first and last row, code points, the row of each, and the rows that may hold garbling."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + _AT_ONCE, "right")) - 1)
        codes = np.frombuffer("".join(t for t in texts.slice(a, b - a).to_pylist() if t).encode("utf-32-le"), np.uint32)
        row = np.repeat(np.arange(b - a), sizes[a:b])
        yield a, b, codes, row, _characters().suspects(codes, row, b - a)
        a = b


def fit_cost(texts: DataFrame, column: str = "text") -> GarblingCost:
    """A cost model of the character pairs of all texts that hold nothing suspect.

    Pairs are counted per task before the shuffle; clean texts hold a few hundred characters, so their pairs are bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars = _characters()
        n = len(chars.clean)
        blank = chars.clean.index(" ")
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for _, _, codes, row, bad in _looked_at(batch.column(0)):
                keep = ~bad[row]
                c, r = chars.number[codes[keep]], row[keep]
                if not len(c):
                    continue
                first, last = np.append(True, r[1:] != r[:-1]), np.append(r[1:] != r[:-1], True)
                inside = ~last[:-1]
                total += np.bincount((c[:-1] * n + c[1:])[inside], minlength=n * n)
                total += np.bincount(blank * n + c[first], minlength=n * n) + np.bincount(c[last] * n + blank, minlength=n * n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    counted = texts.select(F.col(f"`{column}`").cast("string").alias("t")).mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    clean = _characters().clean
    rows = bounded_collect(counted, len(clean) ** 2, "the table of character pairs")
    return GarblingCost(pairs={clean[r.pair // len(clean)] + clean[r.pair % len(clean)]: r.n for r in rows})


def repair(df: DataFrame, cost: GarblingCost, text: str, encoding: str | None = None) -> DataFrame:
    """The rows of df with restored, steps and lost.

    restored is the text as it reads after repair (the text itself where nothing was done), steps names the
    round trips taken, lost tells that garbling is left which can't be restored. Columns of these names are
    replaced. Null and empty texts, and texts without anything suspect, pass with no steps and lost false; plain ASCII
    never leaves the JVM. Repeated rows stay repeated. One pass, no shuffle.
    """
    require(df, text, *([encoding] if encoding else []))
    hint = F.col(f"`{encoding}`").cast("string") if encoding else F.lit(None).cast("string")

    def fix(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("restored", pa.string()), ("steps", pa.list_(pa.string())), ("lost", pa.bool_())])
        for texts, hints in batches:
            out: list[dict | None] = [None] * len(texts)
            for a, _, _, _, bad in _looked_at(texts):
                for i in np.flatnonzero(bad) + a:
                    restored, steps, lost = repair_text(texts[i].as_py(), cost, _declared(hints[i].as_py()))
                    if steps or lost:
                        out[i] = {"restored": restored, "steps": steps, "lost": lost}
            yield pa.array(out, kind)

    fixed = F.arrow_udf(fix, "struct<restored:string,steps:array<string>,lost:boolean>")
    kept = [c for c in df.columns if c not in ("restored", "steps", "lost")]
    col = F.col(f"`{text}`").cast("string")
    other = F.when(F.octet_length(col) != F.char_length(col), col)
    looked = df.select(*[F.col(f"`{c}`") for c in kept], fixed(other, hint).alias("__r"))
    return looked.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce("__r.restored", col).alias("restored"),
        F.coalesce("__r.steps", F.array().cast("array<string>")).alias("steps"),
        F.coalesce("__r.lost", F.lit(False)).alias("lost"),
    )


def garbled(repaired: DataFrame) -> DataFrame:
    """Rows whose text held garbling, restored or not."""
    return repaired.filter((F.size("steps") > 0) | F.col("lost"))
