"""Problem 2: noise of scanned pages in section texts: broken words, misread characters, running lines, page numbers.

Correction candidates come from an inverted index of character pairs over the frequent words; boosted trees rank them.
Boosted classifiers of line pairs tell broken words from hyphens and running lines from text. All three learn
from noise that is put into clean text of the corpus itself.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.boosting import Boosted
from folioflow.session import cut, hash_sample, require

#: A word is frequent from this share of all words on, so there are at most 1 / FREQUENT frequent words at any size.
FREQUENT = 5e-6
LEAST_COUNT = 4
#: Texts whose clean parts the classifiers learn from, at most; those with the smallest hashes.
TRAINING_TEXTS = 1500
#: Words that are not frequent from which the ranker learns, at most.
RARE_WORDS = 3000
#: A word with more misreadings than this is beyond repair.
MOST_MISREADINGS = 3
HYPHENS = "-\xad‐‑¬"

# What scanners read for what is printed.
MISREADINGS = (
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("n", "ii"), ("u", "ii"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("e", "c"), ("c", "e"), ("c", "("), ("i", "l"), ("l", "i"), ("i", "1"), ("l", "1"), ("í", "l"), ("o", "0"), ("s", "5"),
    ("g", "9"), ("q", "9"), ("é", "6"), ("b", "6"), ("a", "o"), ("o", "a"), ("v", "y"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("ö", "6"), ("z", "2"), ("B", "8"), ("l", "I"), ("I", "l"), ("S", "5"), ("O", "0"), ("i", "j"), ("r", "n"), ("n", "u"), ("u", "n"), ("y", "v"), ("в", "8"), ("ó", "6"), ("é", "e"), ("í", "i"), ("ä", "a"), ("è", "e"), ("ü", "u"), ("ö", "o"),
    ("о", "0"), ("з", "3"), ("б", "6"), ("ч", "4"), ("и", "u"), ("п", "л"), ("л", "п"), ("й", "и"), ("и", "й"), ("н", "и"), ("и", "н"), ("ш", "щ"), ("щ", "ш"), ("ы", "ьi"), ("ы", "ы"), ("ц", "u"), ("в", "з"), ("е", "с"), ("с", "е"), ("і", "1"), ("ї", "i"), ("т", "m"), ("п", "n"), ("г", "r"), ("ь", "b"), ("н", "п"), ("п", "н"), ("ж", "х"), ("ю", "to"), ("ы", "bl"), ("л", "n"),
)
# Letters of two scripts that look alike.
LOOKALIKES = dict(zip("аеорсухіАВЕКМНОРСТХ", "aeopcyxiABEKMHOPCTX", strict=True))

_MIXED = re.compile(r"[A-Za-zÀ-ÿ][а-яёіїєґА-ЯЁ]|[а-яёіїєґА-ЯЁ][A-Za-zÀ-ÿ]")
_ODD = re.compile(r"[^\W\d_][\d(]|[\d(][^\W\d_]")
_EDGE = ".,;:!?…»”\"'«“„)*_`[]{}<>|"


def core(token: str) -> str:
    """A token without the punctuation around it; an opening bracket stays unless it is closed or nothing else is odd."""
    t = token.strip(_EDGE)
    return t if not t.startswith("(") or ")" not in token else t.strip("(")


def confusions() -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for printed, read in [*MISREADINGS, *LOOKALIKES.items(), *((b, a) for a, b in LOOKALIKES.items())]:
        if printed != read:
            out[read].append(printed)
    return out


_READ = confusions()


@lru_cache(maxsize=100_000)
def explained(read: str, printed: str, most: int = 3) -> int:
    """Misreadings that turn one word into the other, or most + 1 where listed ones do not suffice."""
    best = most + 1
    if abs(len(read) - len(printed)) > most:
        return best
    stack = [(0, 0, 0)]
    seen = set()
    while stack:
        i, j, n = stack.pop()
        if n >= best or (i, j, n) in seen:
            continue
        seen.add((i, j, n))
        while i < len(read) and j < len(printed) and read[i] == printed[j]:
            for k in (1, 2):  # a misreading may also start here
                for p in _READ.get(read[i : i + k], ()):
                    if printed.startswith(p, j):
                        stack.append((i + k, j + len(p), n + 1))
            i, j = i + 1, j + 1
        if i == len(read) and j == len(printed):
            best = min(best, n)
            continue
        for k in (1, 2):
            if i + k <= len(read):
                for p in _READ.get(read[i : i + k], ()):
                    if printed.startswith(p, j):
                        stack.append((i + k, j + len(p), n + 1))
    return best


def pairs_of(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 2] for i in range(len(w) - 1)]


class Retrieval:
    """Inverted index of character pairs over the frequent words."""

    def __init__(self, counts: dict[str, int], upper: dict[str, float] | None = None) -> None:
        self.words = sorted(counts)
        self.upper = np.array([(upper or {}).get(w, 0.0) for w in self.words])
        self.counts = np.array([counts[w] for w in self.words], float)
        self.total = float(self.counts.sum()) or 1.0
        self.length = np.array([len(w) for w in self.words])
        self.pairs = np.array([len(set(pairs_of(w))) for w in self.words])
        lists: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            for g in set(pairs_of(w)):
                lists[g].append(i)
        self.lists = {g: np.array(v, np.int32) for g, v in lists.items()}

    def candidates(self, word: str) -> list[tuple[int, float]]:
        """All words that misreadings lead to, those with the most shared pairs for their lengths first, ties by count.

        A misreading breaks two pairs of the token, or three where it reads two characters, and three of the word at
        most, so every word within two misreadings is found, whatever its rank.
        """
        mine = set(pairs_of(word))
        twos = sum(word[i : i + 2] in _READ for i in range(len(word) - 1))
        hits = [self.lists[g] for g in mine if g in self.lists]
        if not hits:
            return []
        shared = np.bincount(np.concatenate(hits), minlength=len(self.words))
        near = np.flatnonzero((np.abs(self.length - len(word)) <= MOST_MISREADINGS) & (shared >= np.maximum(max(1, len(mine) - 4 - min(2, twos)), self.pairs - 6)))
        near = [i for i in near.tolist() if self.words[i] != word and explained(word, self.words[i]) <= MOST_MISREADINGS]
        score = {i: 2 * float(shared[i]) / (self.length[i] + 1 + len(word) + 1) for i in near}
        return [(i, float(score[i])) for i in sorted(near, key=lambda i: (-score[i], -self.counts[i], i))]


FEATURES = ("pairs", "edits", "length", "longer", "count", "digit", "bracket", "mixed", "rank", "own", "ending", "capital", "capitals", "start", "candidate_upper", "cased_edits")


def cased(printed: str, read: str) -> str:
    """A word of the index in the case of the token that it is put for."""
    if read.isupper():
        return printed.upper()
    return printed[0].upper() + printed[1:] if read[0].isupper() or (read[0].isdigit() and read[1:2].isupper()) else printed


def features(index: Retrieval, word: str, candidate: int, pairs: float, rank: int, own: int, start: bool) -> list[float]:
    """A token against a candidate; case and place tell a name from a misread noun: the latter's printed word is often a capitalised one."""
    c = index.words[candidate]
    lower = word.lower()
    return [
        pairs, explained(lower, c), len(word), len(c) - len(word), np.log(index.counts[candidate] / index.total),
        sum(ch.isdigit() for ch in word), word.count("("), bool(_MIXED.search(word)), rank, np.log1p(own), lower[-2:] == c[-2:],
        word[0].isupper(), word.isupper(), start, index.upper[candidate], explained(word, cased(c, word)),
    ]


def _spoil(word: str, r: random.Random) -> str:
    """A word with one or two misreadings, as scanners make them."""
    by_printed: dict[str, list[str]] = defaultdict(list)
    for p, q in [*MISREADINGS, *LOOKALIKES.items()]:
        if p != q:
            by_printed[p].append(q)
    for _ in range(r.choice((1, 1, 1, 2))):
        at = [(i, p) for p in by_printed for i in range(len(word)) if word.startswith(p, i)]
        if not at:
            break
        i, p = r.choice(at)
        word = word[:i] + r.choice(by_printed[p]) + word[i + len(p) :]
    return word


@dataclass
class ScanModel:
    index: Retrieval
    ranker: Boosted
    joiner: Boosted
    furniture: Boosted

    def frequent(self, word: str) -> bool:
        return word in self.known

    def __post_init__(self) -> None:
        self.known = dict(zip(self.index.words, self.index.counts, strict=True))
        self.memo: dict[str, tuple[str, bool]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def corrections(self, words: list[tuple[str, bool]], own: list[int]) -> list[tuple[str, float] | None]:
        """For every word, with whether it starts a sentence, the printed one with its probability where it is misread, else none; ranked in one go."""
        rows, at = [], []
        for i, ((word, start), n) in enumerate(zip(words, own, strict=True)):
            lower = word.lower()
            if lower not in self.known:
                for k, (c, s) in enumerate(self.index.candidates(lower)):
                    rows.append(features(self.index, word, c, s, k, n, start))
                    at.append((i, c))
        out: list[tuple[str, float] | None] = [None] * len(words)
        for (i, c), p in zip(at, self.ranker.probability(np.array(rows)) if rows else [], strict=True):
            if p >= 0.5 and (out[i] is None or p > out[i][1]):
                out[i] = (cased(self.index.words[c], words[i][0]), float(p))
        return out


# --- lines

_PAGE = re.compile(r"^\W*(?:(?:page|p|pp|pag|pág|página|стр|с|сторінка|страница|s|seite|folio|f)\W*)?\d{1,4}(?:\s*(?:/|of|из|von|de)\s*\d{1,4})?\W*$", re.I)
_ROMAN_PAGE = re.compile(r"^\W*(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\W*$")
_SIDE_NUMBER = re.compile(r"^\s*\d{1,4}\s{2,}\S|\S\s{2,}\d{1,4}\s*$|^\s*\d{1,4}\s*[|·•]\s*\S|\S\s*[|·•]\s*\d{1,4}\s*$")
_CHAPTER = re.compile(r"^\W*(?:§|chapter|глава|розділ|раздел|kapitel|chapitre|cap[ií]tulo|часть|teil|part)\W*\s*\d{1,3}\b", re.I)
_SPACED = re.compile(r"^(?:\W*[^\W\d_]\W? ){4,}")
_ENTRY = re.compile(r"^\s*(?:[-*•–—+]|#+|\(?\d{1,3}[.)]|\[.?\]|№)\s")
_END = re.compile(r"[.!?…:;][\"'»”’)\]]*$")


def letters(text: str) -> str:
    return "".join(re.findall(r"[^\W\d_]", text.lower()))


def page_number(line: str) -> bool:
    """A line that is nothing but a page number, with or without a word or marks around it."""
    return len(line) <= 60 and bool(_PAGE.match(line) or _ROMAN_PAGE.match(line))


LINE_FEATURES = ("words", "chars", "upper", "title", "chapter", "spaced", "side", "separator", "ends", "breaks", "lower", "near_page", "repeated", "entry", "digits", "alone", "width")


class Page:
    """The lines of a text with what their features need, gathered in one pass."""

    def __init__(self, lines: list[str], titles: list[str]) -> None:
        self.lines, self.titles = lines, titles
        self.plain = [x.strip() for x in lines]
        self.numbers = [bool(s) and page_number(x) for s, x in zip(self.plain, lines, strict=True)]
        self.folded = [letters(s) if len(s) <= 90 else s for s in self.plain]
        self.often = Counter(self.folded)
        self.longest = max((len(x) for x in lines), default=0)
        self.before, self.after = [""] * len(lines), [""] * len(lines)
        last = ""
        for i, s in enumerate(self.plain):
            self.before[i] = last
            if s and not self.numbers[i]:
                last = s
        last = ""
        for i in range(len(lines) - 1, -1, -1):
            self.after[i] = last
            if self.plain[i] and not self.numbers[i]:
                last = self.plain[i]

    def features(self, i: int) -> list[float]:
        """A line among its neighbours: what it looks like and whether the sentence runs on across it."""
        line, s, own, before, after = self.lines[i], self.plain[i], self.folded[i], self.before[i], self.after[i]
        cased = [c for c in s if c.isalpha()]
        title = max((len(own) / max(len(t), 1) if own and t.startswith(own) else len(t) / max(len(own), 1) if t and t in own else 0.0 for t in self.titles), default=0.0)
        around = [k for k in (i - 1, i + 1) if 0 <= k < len(self.lines)]
        runs = bool(before and after and not _END.search(before) and (after[:1].islower() or before[-1:] in HYPHENS))
        return [
            len(s.split()), len(s), sum(c.isupper() for c in cased) / max(1, len(cased)), title, bool(_CHAPTER.match(s)), bool(_SPACED.match(s)), bool(_SIDE_NUMBER.search(line)),
            bool(re.search(r"\s[·|•]\s", s)), bool(_END.search(s)), runs, s[:1].islower(), any(self.numbers[k] for k in around), self.often[own] > 1,
            bool(_ENTRY.match(line)) and not _CHAPTER.match(s), sum(c.isdigit() for c in s) / max(1, len(s)), not any(self.plain[k] for k in around), self.longest,
        ]

    def may_run(self, i: int) -> bool:
        """Whether a line can be a running line at all: short, and no plain continuation of a sentence in small letters."""
        s = self.plain[i]
        return bool(s) and len(s) <= 90 and (not s[0].islower() or bool(re.search(r"\s[·|•]\s|\s{2,}\d", s)))


def break_features(model_known: dict[str, float], left: str, right: str, mark: str) -> list[float]:
    """Two word parts around a hyphen at a line's end."""
    n = lambda w: np.log1p(model_known.get(w.lower(), 0))
    a, b = left.split("-")[-1], re.match(r"[^\W\d_]*", right)[0]
    joined = a + b
    return [n(joined), n(a), n(b), len(a), len(b), "-" in left, b[:1].islower(), mark != "-", n(joined) - max(n(a), n(b)), "-" in right]


def wrapped(text: str) -> bool:
    return re.search(r"[^\n]\n[^\n]", text) is not None


@dataclass
class LineNoise:
    header: list[int]
    page_no: list[int]
    hyphens: list[tuple[int, int]]


def line_noise(text: str, titles: list[str], model: ScanModel) -> tuple[list[str], LineNoise]:
    """Running lines, page-number lines and (line, next text line) of broken words."""
    return line_noise_of([(text, titles)], model)[0]


def line_noise_of(items: list[tuple[str, list[str]]], model: ScanModel) -> list[tuple[list[str], LineNoise]]:
    """line_noise for many texts, with one call of each classifier for all of them."""
    out = [(text.split("\n"), LineNoise([], [], [])) for text, _ in items]
    rows, at = [], []
    for k, ((lines, found), (_, titles)) in enumerate(zip(out, items, strict=True)):
        if len(lines) < 2:
            continue
        page = Page(lines, [letters(t) for t in titles if t])
        found.page_no += [i for i, n in enumerate(page.numbers) if n]
        for i in range(len(lines)):
            if not page.numbers[i] and page.may_run(i):
                rows.append(page.features(i))
                at.append((k, i))
    for (k, i), p in zip(at, model.furniture.probability(np.array(rows)) if rows else [], strict=True):
        if p >= 0.5:
            lines, found = out[k]
            found.header.append(i)
            if _SIDE_NUMBER.search(lines[i]) and re.search(r"(?<!\d)\d{1,4}\s*$|^\s*\d{1,4}\s", lines[i]):
                found.page_no.append(i)
    rows, where = [], []
    for lines, found in out:
        skip = set(found.header) | set(found.page_no)
        for i, line in enumerate(lines[:-1]):
            t = line.rstrip()
            if i in skip or len(t) < 2 or t[-1] not in HYPHENS or not t[-2].isalpha():
                continue
            j = next((k for k in range(i + 1, len(lines)) if lines[k].strip() and k not in skip), None)
            if j is None or not lines[j].strip()[0].isalpha():
                continue
            left = re.search(r"[^\s«“„(]*$", t[:-1])[0]
            rows.append(break_features(model.known, left, lines[j].split()[0], t[-1]))
            where.append((found, i, j))
    for (found, i, j), p in zip(where, model.joiner.probability(np.array(rows)) if rows else [], strict=True):
        if p >= 0.5:
            found.hyphens.append((i, j))
    return out


# --- learning from noise put into clean text


def _furniture_examples(texts: list[tuple[str, list[str]]], r: random.Random) -> tuple[list[list[float]], list[int]]:
    x, y = [], []
    titles_of_all = [t for _, ts in texts for t in ts if t]
    for text, titles in texts:
        lines: list[str] = []
        width = r.choice((40, 48, 56, 64, 72))
        for paragraph in text.split("\n\n"):
            line = ""
            if "\n" in paragraph:
                lines += paragraph.split("\n")
            else:
                for w in paragraph.split(" "):
                    if line and len(line) + 1 + len(w) > width:
                        lines.append(line)
                        line = w
                    else:
                        line = f"{line} {w}".strip()
                lines.append(line)
            lines.append("")
        if r.random() < 0.25 and titles:
            lines.insert(0, r.choice(("# ", "## ", "### ", "")) + titles[-1])
        if r.random() < 0.2:
            lines += [f"{k}{r.choice('.)')} {r.choice(titles_of_all)}" for k in range(1, 6)]
        marks = [0] * len(lines)
        for _ in range(r.choice((1, 1, 2, 3))):
            t = r.choice(titles) if titles and r.random() < 0.7 else r.choice(titles_of_all)
            n = str(r.randint(2, 480))
            form = r.choice((lambda: t.upper(), lambda: t.upper()[: r.randint(15, 40)], lambda: f"{r.choice(('Chapter', 'Глава', 'Kapitel', 'Chapitre', 'Capítulo', 'Розділ'))} {r.randint(1, 30)}. {t}", lambda: f"§ {r.randint(1, 30)}. {t}", lambda: "   ".join(" ".join(w) for w in t.upper().split())[: r.randint(25, 60)], lambda: f"{r.choice(titles_of_all).split(' ')[0]} {r.choice(('·', '|'))} {t}"[: r.randint(25, 60)], lambda: t[: r.randint(20, 60)]))
            head = form()
            head = r.choice((head, head, f"{head}    {n}", f"{n}    {head}"))
            at = r.randrange(1, max(2, len(lines)))
            while at < len(lines) - 1 and not lines[at].strip() and r.random() < 0.5:
                at += 1
            block = [head, r.choice((n, f"- {n} -", f"[{n}]", f"— {n} —", f"      {n}"))] if r.random() < 0.4 else [head]
            if r.random() < 0.3:
                block = ["", *block, ""]
            r.shuffle(block) if r.random() < 0.2 and len(block) == 2 else None
            lines[at:at] = block
            marks[at:at] = [int(b == head) for b in block]
        folded = [letters(t) for t in titles if t]
        page = Page(lines, folded)
        for i in range(len(lines)):
            if not page.numbers[i] and page.may_run(i):
                x.append(page.features(i))
                y.append(marks[i])
    return x, y


def _break_examples(words: list[str], known: dict[str, float], rare: list[str], compounds: list[str], r: random.Random) -> tuple[list[list[float]], list[int]]:
    x, y = [], []
    long = [w for w in words if len(w) >= 5 and "-" not in w] or ["example"]
    for _ in range(1500):
        w = r.choice(long) if r.random() < 0.75 or not rare else r.choice(rare)
        if len(w) < 4:
            continue
        i = r.randint(2, len(w) - 2)
        x.append(break_features(known, w[:i], w[i:], r.choice(HYPHENS)))
        y.append(1)
    parts = compounds or ["state-of-the-art", "long-term", "well-known"]
    for _ in range(900):
        w = r.choice(parts)
        at = [m.start() for m in re.finditer("-", w)]
        i = r.choice(at)
        x.append(break_features(known, w[:i], w[i + 1 :], "-"))
        y.append(0)
    for _ in range(300):  # dashes behind whole words
        a, b = r.choice(long), r.choice(long)
        x.append(break_features(known, a, b, "-"))
        y.append(0)
    return x, y


def _places(sample: list[tuple[str, list[str]]], words: set[str]) -> tuple[dict[str, list[tuple[str, bool]]], float]:
    """Spellings of the words in the sample, each with whether it starts a sentence, and the share of starts among capitalised tokens."""
    seen: dict[str, list[tuple[str, bool]]] = defaultdict(list)
    capital = starts = 0
    for text, _ in sample:
        for _, tokens in places(text.split("\n"), LineNoise([], [], [])):
            for token, start in tokens:
                t = core(token)
                if t[:1].isupper():
                    capital += 1
                    starts += start
                if t.lower() in words:
                    seen[t.lower()].append((t, start))
    return seen, starts / max(1, capital)


def _ranker_examples(index: Retrieval, rare: list[str], sample: list[tuple[str, list[str]]], r: random.Random) -> tuple[list[list[float]], list[int]]:
    x, y = [], []
    known = set(index.words)
    words = [w for w in index.words if len(w) >= 4 and w.isalpha()]
    weights = [float(n) ** 0.5 for w, n in zip(index.words, index.counts, strict=True) if len(w) >= 4 and w.isalpha()] if len(words) < 3000 else None
    seen, first = _places(sample, known)
    upper = dict(zip(index.words, index.upper, strict=True))

    def printed(w: str) -> tuple[str, bool]:
        if seen.get(w):
            return r.choice(seen[w])
        return (w[0].upper() + w[1:], r.random() < first) if r.random() < upper[w] else (w, False)

    for w in r.choices(words, weights, k=2500) if words else []:
        t, start = printed(w)
        bad = _spoil(t, r)
        if bad == t or bad.lower() in known:
            continue
        for k, (c, s) in enumerate(index.candidates(bad.lower())):
            x.append(features(index, bad, c, s, k, r.choice((1, 1, 2, 4)), start))
            y.append(int(index.words[c] == w))
    # words that are as printed: names, rare words, and frequent ones against their neighbours
    right = [(w, w[0].isupper() and r.random() < first) for w in r.sample(rare, min(1500, len(rare)))] + [printed(w) for w in r.sample(words, min(1500, len(words)))]
    for w, start in right:
        for k, (c, s) in enumerate(index.candidates(w.lower())):
            x.append(features(index, w, c, s, k, r.choice((1, 1, 2, 4)), start))
            y.append(0)
    return x, y


def word_counts(chunks: DataFrame, text: str = "text") -> DataFrame:
    """word, n and how often it is capitalised (upper) over all texts, in small letters, counted per batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    c.update(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", t))
            n: Counter[str] = Counter()
            upper: Counter[str] = Counter()
            for w, k in c.items():
                n[w.lower()] += k
                upper[w.lower()] += k * w[0].isupper()
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([upper[w] for w in n], pa.int64())], ["word", "n", "upper"])

    got = chunks.select(F.col(f"`{text}`")).mapInArrow(count, "word string, n bigint, upper bigint")
    return got.groupBy("word").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"))


def fit(chunks: DataFrame, text: str = "text", titles: str = "path_titles") -> ScanModel:
    """Word counts over all texts, and three classifiers fitted to noise in at most TRAINING_TEXTS of them."""
    require(chunks, text, titles)
    counts = cut(word_counts(chunks, text))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, FREQUENT * total)
    rows = counts.filter(F.col("n") >= least).collect()  # at most 1 / FREQUENT words
    frequent, upper = {r.word: r.n for r in rows}, {r.word: r.upper / r.n for r in rows}
    seldom = counts.filter((F.col("n") < least) & (F.length("word") > 4) & ~F.col("word").contains("-"))
    spelt = F.when(2 * F.col("upper") >= F.col("n"), F.initcap("word")).otherwise(F.col("word"))
    rare = hash_sample(seldom.select(spelt.alias("word")), "word", RARE_WORDS, spare=2)
    plain = ~F.col("v.t").rlike(r"[0-9]\s*\n|\p{Lu}{3}|[-¬­‐]\n")
    texts = chunks.filter(F.col(f"`{text}`").isNotNull()).select(F.struct(F.col(f"`{text}`").alias("t"), F.col(f"`{titles}`").alias("p")).alias("v"))
    sample = [(v.t, [x for x in v.p or [] if x]) for v in hash_sample(texts, "v", TRAINING_TEXTS, plain, spare=8)]
    return model_of(frequent, rare, sample, upper=upper)


def model_of(frequent: dict[str, int], rare: list[str], sample: list[tuple[str, list[str]]], seed: int = 0, upper: dict[str, float] | None = None) -> ScanModel:
    """rare: with a capital where mostly printed so. upper: by frequent word the share of its places with a capital."""
    r = random.Random(seed)
    frequent = frequent or {"example": 1, "examples": 1, "text": 1, "word": 1}
    # readings that are a frequent word's misreading are no frequent words themselves, however often they occur
    words = {w: n for w, n in frequent.items() if not _MIXED.search(w)}
    index = Retrieval(words, upper)
    known = dict(zip(index.words, index.counts, strict=True))
    sample = [s for s in sample if s[0]] or [("This is a text. It has lines.", ["Title"])]
    if not any(t for _, ts in sample for t in ts):
        sample = [(t, ["Title of a section"]) for t, _ in sample]
    compounds = [w for w in words if "-" in w]
    fx, fy = _furniture_examples(sample, r)
    bx, by = _break_examples(list(words), known, rare, compounds, r)
    rx, ry = _ranker_examples(index, rare, sample, r)
    if not rx:
        rx, ry = [[0.0] * len(FEATURES)], [0]
    return ScanModel(index, Boosted(np.array(rx), np.array(ry)), Boosted(np.array(bx), np.array(by), trees=20), Boosted(np.array(fx), np.array(fy)))


def places(lines: list[str], noise: LineNoise) -> list[tuple[int, list[tuple[str, bool]]]]:
    """By line of text its number and tokens, each with whether it starts a sentence; a broken word is joined on the line where it begins."""
    skip = set(noise.header) | set(noise.page_no)
    tokens = {k: line.split() for k, line in enumerate(lines) if k not in skip}
    for i, j in sorted(noise.hyphens, reverse=True):
        if tokens[i] and tokens[j]:
            tokens[i][-1] = tokens[i][-1].rstrip(HYPHENS) + tokens[j].pop(0)
    out = []
    start = True
    for k, line in tokens.items():
        start = start or not lines[k].strip()
        got = []
        for token in line:
            got.append((token, start))
            start = token[-1] in ".!?…:" or (start and not any(c.isalpha() for c in token))
        out.append((k, got))
    return out


def _suspicion(token: str, model: ScanModel) -> tuple[str, bool]:
    """The core of a token and whether it may be misread: whatever is no frequent word, of any case."""
    t = core(token)
    lower = t.lower()
    if len(t) <= 2 or len(t) > 40 or lower in model.known or t[-1] in HYPHENS or "‐" in t or not any(c.isalpha() for c in t):
        return t, False
    inner = "(" in t[1:-1] and ")" not in t and len(t) > 14  # a call, as in code
    return t, not (inner or t.lstrip("(").lower() in model.known or all(p in model.known for p in lower.split("-")))


def suspects(lines: list[str], noise: LineNoise, model: ScanModel) -> list[tuple[str, bool]]:
    """Tokens that are not frequent words and may be misread, broken ones joined, each with whether it starts a sentence."""
    out = []
    memo = model.memo
    if len(memo) > 300_000:
        memo.clear()
    for _, tokens in places(lines, noise):
        for token, start in tokens:
            got = memo.get(token)
            if got is None:
                got = memo[token] = _suspicion(token, model)
            if got[1]:
                out.append((got[0], start))
    return out


def chunk_noise(chunks: DataFrame, model: ScanModel) -> DataFrame:
    """vec_rowid, header, page_no and hyphen counts, and the suspect tokens of every text; no shuffle."""
    require(chunks, "vec_rowid", "text", "path_titles")
    kind = pa.struct([("header", pa.int32()), ("page_no", pa.int32()), ("hyphen", pa.int32()), ("suspects", pa.list_(pa.struct([("token", pa.string()), ("start", pa.bool_())])))])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, titles in batches:
            items = [(t or "", p or []) for t, p in zip(texts.to_pylist(), titles.to_pylist(), strict=True)]
            out = []
            for at in range(0, len(items), 512):
                for lines, noise in line_noise_of(items[at : at + 512], model):
                    out.append({"header": len(noise.header), "page_no": len(noise.page_no), "hyphen": len(noise.hyphens), "suspects": [{"token": t, "start": b} for t, b in suspects(lines, noise, model)]})
            yield pa.array(out, kind)

    look = F.arrow_udf(run, "struct<header:int,page_no:int,hyphen:int,suspects:array<struct<token:string,start:boolean>>>")
    return chunks.select("vec_rowid", look("text", "path_titles").alias("n")).select("vec_rowid", "n.*")


def corrections(noise: DataFrame, model: ScanModel) -> DataFrame:
    """token, start, printed and probability of the suspect tokens that are misread; each distinct token is ranked once for either place."""
    tokens = noise.select(F.inline("suspects")).groupBy("token", "start").agg(F.count("*").cast("int").alias("n"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for t, start, n in batches:
            got = model.corrections(list(zip(t.to_pylist(), start.to_pylist(), strict=True)), n.to_pylist())
            yield pa.array([{"printed": g[0], "probability": g[1]} if g else None for g in got], pa.struct([("printed", pa.string()), ("probability", pa.float64())]))

    ranked = tokens.withColumn("c", F.arrow_udf(run, "struct<printed:string,probability:double>")("token", "start", "n"))
    return ranked.filter("c IS NOT NULL").select("token", "start", "c.printed", "c.probability")


def found(noise: DataFrame, fixed: DataFrame) -> DataFrame:
    """vec_rowid and noise, one row per chunk and kind present."""
    kinds = noise.select("vec_rowid", F.explode(F.array(*[F.when(F.col(k) > 0, F.lit(k)) for k in ("hyphen", "header", "page_no")])).alias("noise")).filter("noise IS NOT NULL")
    misread = noise.select("vec_rowid", F.inline("suspects")).join(fixed.select("token", "start"), ["token", "start"]).select("vec_rowid", F.lit("misread").alias("noise"))
    return kinds.union(misread).distinct()


def repaired_text(text: str | None, titles: list[str] | None, model: ScanModel) -> str | None:
    """Continuous paragraphs: running lines and page numbers out, broken words joined, lines joined, misread words replaced.

    For a text by itself; repair() ranks every token with its count in the whole table, as corrections() does.
    """
    lines, noise = line_noise_of([(text or "", [x for x in titles or [] if x])], model)[0]
    count = Counter(suspects(lines, noise, model))
    odd = sorted(count)
    bad = {t: c[0] for t, c in zip(odd, model.corrections(odd, [count[t] for t in odd]), strict=True) if c}
    return _rebuilt(lines, noise, bad) if text else text


def _rebuilt(lines: list[str], noise: LineNoise, bad: dict[tuple[str, bool], str]) -> str:
    skip = set(noise.header) | set(noise.page_no)
    words = dict(places(lines, noise))
    joins = {i for i, _ in noise.hyphens}
    paragraphs: list[str] = [""]
    carry = False
    for i, line in enumerate(lines):
        if i in skip:
            continue
        s = line.strip()
        if not s:
            gap = any(k in skip for k in (i - 1, i + 1))
            if paragraphs[-1] and not carry and not (gap and not _END.search(paragraphs[-1])):
                paragraphs.append("")
            continue
        carry = i in joins
        entry = _ENTRY.match(s)
        s = " ".join(token.replace(core(token), bad[core(token), start]) if (core(token), start) in bad else token for token, start in words[i])
        if s and paragraphs[-1]:
            paragraphs[-1] += "\n" if entry else " "
        paragraphs[-1] += s
    return "\n\n".join(p for p in paragraphs if p)


def repair(chunks: DataFrame, model: ScanModel) -> DataFrame:
    """The chunks with their texts repaired; null and empty texts stay as they are, all other columns too.

    Misread words are those of corrections() over the whole table, so that p2's two results agree on every word; they are joined to
    the chunks that hold them by vec_rowid, and what is gathered is bounded by a chunk's own words.
    """
    require(chunks, "vec_rowid", "text", "path_titles")
    noise = cut(chunk_noise(chunks, model))
    tokens = noise.select("vec_rowid", F.inline("suspects")).distinct()
    bad = tokens.join(corrections(noise, model).select("token", "start", "printed"), ["token", "start"])
    bad = bad.groupBy("vec_rowid").agg(F.collect_list(F.struct("token", "start", "printed")).alias("__bad"))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, titles, fixes in batches:
            items = list(zip(texts.to_pylist(), titles.to_pylist(), fixes.to_pylist(), strict=True))
            out = []
            for at in range(0, len(items), 512):
                some = items[at : at + 512]
                pages = line_noise_of([(text or "", [x for x in named or [] if x]) for text, named, _ in some], model)
                for (text, _, fix), (lines, found_) in zip(some, pages, strict=True):
                    out.append(_rebuilt(lines, found_, {(f["token"], f["start"]): f["printed"] for f in fix or []}) if text else text)
            yield pa.array(out, pa.string())

    joined = chunks.join(bad, "vec_rowid", "left")
    rebuilt = F.arrow_udf(run, "string")("text", "path_titles", "__bad")
    return joined.withColumn("text", rebuilt).select(*chunks.columns)
