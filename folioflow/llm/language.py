"""Problem 5: the language of documents and of the segments of mixed ones, by hierarchical discrimination.

The family of a sentence comes first, then one-versus-one linear support vector machines separate the
languages inside it. Features are character n-grams inside words, so that every machine's score of a
sentence is a sum over its words; words are scored once and remembered.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import require

# Families of closely related languages.
FAMILY = {"ru": "slavic", "uk": "slavic", "en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}
# Names of languages as catalogues write them (codes, English names and own names).
NAMES = {
    "en": ("en", "eng", "english"),
    "ru": ("ru", "rus", "russian", "русский"),
    "uk": ("uk", "ukr", "ukrainian", "українська"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
}
#: Bound of the training sample, per language; documents with the smallest hashes are taken.
TRAINING_DOCUMENTS = 250
#: Longer runs of letters are no words.
LONGEST_WORD = 40
#: A sentence counts as evidence of its own from so many words of three letters, confidence and share of known words on.
LEAST_WORDS, LEAST_CONFIDENCE, LEAST_KNOWN = 3, 0.9, 0.4

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|\n\s*\n|\r\n\s*\r\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’ʼ][^\W\d_]+)*")


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; single line ends inside a paragraph do not end one."""
    spans, at = [], 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            spans.append((at, m.start()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


class Machine:
    """A linear support vector machine fitted by averaged stochastic subgradient steps, with a logistic scale."""

    def __init__(self, rows: list[np.ndarray], signs: np.ndarray, grams: int, epochs: int = 6, rate: float = 1e-4) -> None:
        w, total, b = np.zeros(grams), np.zeros(grams), 0.0
        order, t = np.random.default_rng(0), 0
        scale = 1.0
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                t += 1
                x, y = rows[i], signs[i]
                if y * (scale * w[x].mean() + b) < 1:
                    np.add.at(w, x, y * 20.0 / len(x) / scale)
                    b += 0.01 * y
                scale *= 1 - rate
            total += scale * w
        self.w, self.b = total / epochs, b
        margin = np.array([self.w[x].mean() + b for x in rows]) * signs
        self.slope = 1.0
        for _ in range(200):  # one-parameter logistic fit of the margins
            p = 1 / (1 + np.exp(-np.clip(self.slope * margin, -30, 30)))
            self.slope += 0.5 * float(np.mean((1 - p) * margin))
        self.slope = min(self.slope, 12.0)


class LanguageModel:
    """Hierarchy of machines: pairs of families, then pairs of languages inside a family."""

    def __init__(self, labelled: Iterable[tuple[str, str]]) -> None:
        units: dict[str, list[list[str]]] = defaultdict(list)
        seen: Counter[str] = Counter()
        for text, lang in labelled:
            for s, e in sentences(text):
                words = [w.lower() for w in _WORD.findall(text[s:e]) if len(w) <= LONGEST_WORD]
                if len(words) >= LEAST_WORDS and len(set(words)) > 2:
                    seen.update(set(words))
                    units[lang].append(words)
        grams: Counter[str] = Counter()
        for w, n in seen.items():
            grams.update(dict.fromkeys(_grams(w), n))
        self.gram_ids = {g: i for i, g in enumerate(sorted(g for g, n in grams.items() if n >= 2))}
        rows = {x: [r for r in (self._row(words) for words in us) if len(r)] for x, us in units.items()}
        self.langs = sorted(rows)
        self.known = {w for w, n in seen.items() if n >= 2}
        family = {x: FAMILY.get(x, x) for x in self.langs}
        self.families = sorted(set(family.values()))
        self.members = {f: [x for x in self.langs if family[x] == f] for f in self.families}
        self.pairs: list[tuple[str, str]] = []
        machines = []
        for level, groups in ((self.families, self.members), *((m, {x: [x] for x in m}) for m in self.members.values())):
            for a, b in combinations(level, 2):
                xs = [[r for x in groups[side] for r in rows[x]] for side in (a, b)]
                self.pairs.append((a, b))
                machines.append(Machine(xs[0] + xs[1], np.array([1.0] * len(xs[0]) + [-1.0] * len(xs[1])), len(self.gram_ids)))
        self.weights = np.stack([m.w for m in machines], 1) if machines else np.zeros((len(self.gram_ids), 0))
        self.bias = np.array([m.b for m in machines])
        self.slope = np.array([m.slope for m in machines])
        self._forget()

    def _row(self, words: list[str]) -> np.ndarray:
        ids = self.gram_ids
        return np.array([ids[g] for w in words for g in _grams(w) if g in ids], np.int64)

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.matrix = np.zeros((1 << 14, len(self.pairs) + 3))

    def _remember(self, word: str) -> int:
        """The row of a word's sums: machines, known n-grams, whether it is a word of three letters or more, and a known one."""
        i = self.ids[word] = len(self.ids)
        if i == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        w = word.lower()
        # capitalised words that training never saw are mostly names and tell no language
        if len(word) <= LONGEST_WORD and (w in self.known or not word[0].isupper()):
            g = self._row([w])
            k = len(self.pairs)
            self.matrix[i, :k] = self.weights[g].sum(0)
            self.matrix[i, k:] = len(g), len(w) > 2, len(w) > 2 and w in self.known
        return i

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("ids", "matrix")} | {"weights": self.weights.astype(np.float32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def sums(self, units: list[list[str]]) -> np.ndarray:
        """One row per unit: the machines' sums, n-grams, longer words, known ones of them."""
        if len(self.ids) > 400_000:
            self._forget()
        ids, remember = self.ids, self._remember
        flat = [ids[w] if w in ids else remember(w) for words in units for w in words]
        ends = np.concatenate([[0], np.cumsum([len(u) for u in units], dtype=np.int64)])
        total = np.concatenate([np.zeros((1, len(self.pairs) + 3)), np.cumsum(self.matrix[flat], 0)])
        return total[ends[1:]] - total[ends[:-1]]

    def decide(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and confidence of each row of sums; no words give no language."""
        margin = sums[:, : len(self.pairs)] / np.maximum(sums[:, [len(self.pairs)]], 1) + self.bias
        p = 1 / (1 + np.exp(-np.clip(self.slope * margin, -30, 30)))
        at = {pair: i for i, pair in enumerate(self.pairs)}

        def shares(names: list[str]) -> np.ndarray:
            """Per name the least certain of its duels, so that one clear defeat rules it out."""
            out = np.ones((len(p), len(names)))
            for i, x in enumerate(names):
                for y in names:
                    if x != y:
                        q = p[:, at[x, y]] if (x, y) in at else 1 - p[:, at[y, x]]
                        out[:, i] = np.minimum(out[:, i], q)
            return out

        fam = shares(self.families)
        lang, sure = np.full(len(p), None, object), np.zeros(len(p))
        best = fam.argmax(1)
        for i, f in enumerate(self.families):
            mine = shares(self.members[f])
            pick = mine.argmax(1)
            here = best == i
            lang[here] = np.array(self.members[f], object)[pick[here]]
            sure[here] = (fam[:, i] * mine.max(1))[here]
        none = sums[:, len(self.pairs) + 1] == 0
        lang[none], sure[none] = None, 0.0
        return lang, sure


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of at most TRAINING_DOCUMENTS labelled documents of each language, those with the smallest hashes."""
    rows = labelled.select(F.col(f"`{text}`").alias("t"), F.lower(F.trim(f"`{lang}`")).alias("l"))
    rows = rows.filter(F.col("l").isin(*FAMILY) & (F.char_length("t") > 40))
    best = Window.partitionBy("l").orderBy("h")
    # the hash bound keeps the ranked set small before the window sees it: about ten times the sample
    share = rows.groupBy("l").agg(F.count("*").alias("n"))
    rows = rows.withColumn("h", F.xxhash64("t")).join(F.broadcast(share), "l")  # one row for each of the known languages
    near = rows.filter(F.abs(F.col("h") / 9.3e18) < 10.0 * TRAINING_DOCUMENTS / F.col("n"))
    sample = near.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= TRAINING_DOCUMENTS).select("t", "l").collect()
    return LanguageModel((r.t, r.l) for r in sorted(sample, key=lambda r: (r.l, r.t)))


def label_code(label: Column) -> Column:
    """Two-letter code that a catalogue label names, or null; regions and case do not matter."""
    plain = F.lower(F.trim(label))
    main = F.split(plain, "[-_]").getItem(0)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(plain.isin(*names) | main.isin(*names), F.lit(code)).otherwise(out)
    return out


_RESULT = pa.struct(
    [
        ("lang", pa.string()),
        ("confidence", pa.float64()),
        ("langs", pa.list_(pa.string())),
        ("segments", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())]))),
    ]
)
RESULT_DDL = "struct<lang:string,confidence:double,langs:array<string>,segments:array<struct<start:int,stop:int,lang:string,confidence:double>>>"


def _batch(model: LanguageModel, texts: list[str | None], want_segments: bool) -> list[dict]:
    spans = [sentences(t) if t else [] for t in texts]
    units = [_WORD.findall(t[s:e]) for t, ss in zip(texts, spans, strict=True) for s, e in ss]
    k = len(model.pairs)
    sums = model.sums(units) if units else np.zeros((0, k + 3))
    lang, sure = model.decide(sums)
    strong = (sums[:, k + 1] >= LEAST_WORDS) & (sure >= LEAST_CONFIDENCE) & (sums[:, k + 2] >= LEAST_KNOWN * sums[:, k + 1])
    ends = np.cumsum([0] + [len(s) for s in spans])
    upto = np.concatenate([np.zeros((1, k + 3)), np.cumsum(sums, 0)])
    whole = upto[ends[1:]] - upto[ends[:-1]]
    doc_lang, doc_sure = model.decide(whole)
    out = []
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        own = lang[a:b]
        found = sorted(set(own[strong[a:b]].tolist()))
        segments: list[dict] = []
        if want_segments and len(found) > 1:
            for j in range(a, b):
                s, e = spans[i][j - a]
                # a weak sentence goes with the one before it
                name = lang[j] if strong[j] or not segments else segments[-1]["lang"]
                if segments and segments[-1]["lang"] == name:
                    segments[-1]["stop"] = e
                    if strong[j]:
                        segments[-1]["confidence"] = max(segments[-1]["confidence"], float(sure[j]))
                else:
                    segments.append({"start": s, "stop": e, "lang": name, "confidence": float(sure[j])})
        elif want_segments and doc_lang[i] is not None:
            segments = [{"start": 0, "stop": len(texts[i]), "lang": doc_lang[i], "confidence": float(doc_sure[i])}]
        out.append({"lang": doc_lang[i], "confidence": float(doc_sure[i]), "langs": found, "segments": segments})
    return out


def detect(df: DataFrame, model: LanguageModel, text: str = "text", segments: bool = True) -> DataFrame:
    """All columns of df and the struct `detected`: lang and confidence of the whole text, the languages with whole
    sentences in it (langs), and the segments by language as code-point spans.

    A null or empty text, and one without words, has a null language, confidence 0 and no segments. A sentence
    counts for itself from LEAST_WORDS words, LEAST_CONFIDENCE and LEAST_KNOWN on, so single foreign terms, code
    and garbled text make no segment. A column `detected` of df is replaced. No shuffle.
    """
    require(df, text)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = []
            all_texts = texts.to_pylist()
            for at in range(0, len(all_texts), 512):
                got += _batch(model, all_texts[at : at + 512], segments)
            yield pa.array(got, _RESULT)

    kept = [F.col(f"`{c}`") for c in df.columns if c != "detected"]
    return df.select(*kept, F.arrow_udf(run, RESULT_DDL)(F.col(f"`{text}`")).alias("detected"))


def book_languages(detected: DataFrame) -> DataFrame:
    """Per book the language of most of its level 1 chunks, with the share of chunks and the mean confidence.

    Chunks without a language do not count; of equally frequent languages the first by name wins. Counts are
    taken per book and language before the choice, so a book of any size costs a few rows.
    """
    votes = detected.filter("level = 1 AND detected.lang IS NOT NULL").groupBy("book_id", F.col("detected.lang").alias("lang"))
    votes = votes.agg(F.count("*").alias("n"), F.sum("detected.confidence").alias("c"))
    per = votes.groupBy("book_id").agg(
        F.max(F.struct("n", F.translate("lang", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba").alias("inv"), "lang", "c")).alias("m"),
        F.sum("n").alias("total"),
    )
    return per.select("book_id", F.col("m.lang").alias("lang"), (F.col("m.n") / F.col("total")).alias("share"), (F.col("m.c") / F.col("m.n")).alias("confidence"))
