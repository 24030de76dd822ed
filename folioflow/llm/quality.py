"""Problem 10: per-document text statistics in native SQL, and an induced rule list that tells prose from the rest.

The rules are learned by incremental reduced-error pruning on documents that are labelled by construction
(labelled.py); their thresholds become one SQL CASE expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.session import bounded_collect, hash_sample, require

KINDS = ("table", "junk", "list", "prose")
#: Tests of a rule, at most; what a rule must reach on rows it was not grown on, and failures after which a kind ends.
MOST_TESTS, LEAST_PRECISION, MOST_FAILURES = 6, 0.9, 5
#: Bound of the common-word table, which becomes one pattern.
MOST_COMMON_WORDS = 20_000

_BETWEEN_WORDS = r"[^\p{L}\p{N}'’]+"
# A line of cells holds two separators (bars, tabs, semicolons or commas without a blank, wide gaps) or is a rule.
_CELLS = r"(?:[|\t]|[;,](?=\S)|\S {2,}(?=\S)).*?(?:[|\t]|[;,](?=\S)|\S {2,}(?=\S)|[;,]$)|^[-+=|: ]{5,}$"
# Digits and letters in one word, as dumps have.
_MIXED = r"\p{L}\p{N}|\p{N}\p{L}"
# Marks that open an entry of a list, and what closes an entry of an index or contents.
_ENTRY = r"^(?:[-*•–—+·>▪◦‣]|\(?\d{1,3}[.)]|№\s*\d+\.?|\[[ xX✓]?\]|[☐☑✓]|\(?[a-zа-яё][.)]|\(?[ivxlcIVXLC]{1,5}[.)]|\d+(?:\.\d+)+\.?|\[\d+\])\s+\S"
_NUMBER_END = r"(?:\d|[ivxlc])\s*$"


def common_words(common: DataFrame) -> list[str]:
    """All words of the table of common words, a small fixed table (checked against MOST_COMMON_WORDS)."""
    rows = bounded_collect(common.select(F.lower("word").alias("w")).filter("length(w) > 0").distinct(), MOST_COMMON_WORDS, "the table of common words")
    return sorted(r.w for r in rows)


def _count(text: Column, piece: str) -> Column:
    """Occurrences of a piece, by byte lengths: several times faster than a pattern."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def _per(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(F.lit(0.0)).cast("double")


FEATURES = (
    "words", "mean_word_length", "symbol_share", "closed_line_share", "common_share", "letter_share", "digit_share", "words_per_line",
    "entry_share", "number_end_share", "cells_per_line", "distinct_share", "sentence_rate", "separator_rate", "short_token_share", "markup_rate", "lines",
    "cell_line_share", "distinct_pair_share", "mixed_share", "distinct_line_share",
)

#: Statistics that rules test; those that follow the length of a text are left out.
TESTED = tuple(f for f in FEATURES if f not in ("words", "lines", "distinct_share"))


def statistics(documents: DataFrame, common: list[str], text: str = "text") -> DataFrame:
    """All columns of documents and the statistics in FEATURES, all computed inside the JVM without a shuffle.

    words counts runs of letters, digits and apostrophes, and mean_word_length their characters; symbol_share is the share of other characters among those that are not
    blank; closed_line_share is the share of non-blank lines that end in closing punctuation; common_share is the
    share of words on the list of common words. Lines end in \\n, \\r\\n or \\r. A null text counts as empty: its
    counts and shares are 0. Columns of documents with these names are replaced.
    """
    require(documents, text)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [c for c in documents.columns if c not in FEATURES]
    lower = F.lower(t)
    staged = documents.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.char_length(t) - F.char_length(F.translate(t, "0123456789", ""))).alias("__digits"),
        F.char_length(F.regexp_replace(t, r"\s+", "")).alias("__solid"),
        F.filter(F.split(lower, _BETWEEN_WORDS), lambda x: F.length(x) > 0).alias("__words"),
        F.regexp_count(t, F.lit(r"[.!?…][»”\"')\]]*+(?=\s|$)")).alias("__ends"),
        (_count(t, ";") + _count(t, ",")).alias("__seps"),
        (_count(t, "\t") + _count(t, "|") + _count(t, ";") + _count(t, ",") - _count(t, ", ") + _count(t, "   ")).alias("__cells"),
        (_count(t, "<") + _count(t, "{") + _count(t, "}") + _count(t, "=")).alias("__marks"),
        F.filter(F.transform(F.split(t, r"[\r\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) > 0).alias("__lines"),
    )
    share = lambda cond: F.size(F.filter("__lines", cond))
    staged = staged.withColumns(
        {
            "lines": F.size("__lines"),
            "__closed": share(lambda x: F.right(x, F.lit(2)).rlike(r"[.!?…:][»”\"')\]]?$")),
            "__entry": share(lambda x: x.rlike(_ENTRY)),
            "__number_end": share(lambda x: x.rlike(_NUMBER_END)),
            "words": F.size("__words"),
            "__inside": F.char_length(F.array_join("__words", "")),
            "__common": F.size(F.filter("__words", lambda x: x.isin(common) if common else F.lit(False))),
            "__short": F.size(F.filter("__words", lambda x: F.length(x) <= 2)),
            "__distinct": F.size(F.array_distinct("__words")),
            "__cell_lines": share(lambda x: x.rlike(_CELLS)),
            "__distinct_pairs": F.size(F.array_distinct(F.transform("__words", lambda x, i: F.xxhash64(x, F.get("__words", i + 1))))),
            "__mixed": F.size(F.filter("__words", lambda x: x.rlike(_MIXED))),
            "__distinct_lines": F.size(F.array_distinct("__lines")),
        }
    )
    c = F.col
    solid = c("__solid")
    return staged.select(
        *[c(f"`{k}`") for k in kept],
        "words",
        _per(c("__inside"), c("words")).alias("mean_word_length"),
        _per(solid - c("__inside"), solid).alias("symbol_share"),
        _per(c("__closed"), c("lines")).alias("closed_line_share"),
        _per(c("__common"), c("words")).alias("common_share"),
        _per(c("__inside") - c("__digits"), solid).alias("letter_share"),
        _per(c("__digits"), solid).alias("digit_share"),
        _per(c("words"), c("lines")).alias("words_per_line"),
        _per(c("__entry"), c("lines")).alias("entry_share"),
        _per(c("__number_end"), c("lines")).alias("number_end_share"),
        _per(c("__cells"), c("lines")).alias("cells_per_line"),
        _per(c("__distinct"), c("words")).alias("distinct_share"),
        _per(c("__ends"), c("words")).alias("sentence_rate"),
        _per(c("__seps"), c("words")).alias("separator_rate"),
        _per(c("__short"), c("words")).alias("short_token_share"),
        _per(c("__marks"), c("words")).alias("markup_rate"),
        "lines",
        _per(c("__cell_lines"), c("lines")).alias("cell_line_share"),
        _per(c("__distinct_pairs"), c("words")).alias("distinct_pair_share"),
        _per(c("__mixed"), c("words")).alias("mixed_share"),
        _per(c("__distinct_lines"), c("lines")).alias("distinct_line_share"),
    )


@dataclass
class Rule:
    kind: str
    tests: list[tuple[str, str, float]] = field(default_factory=list)

    def mask(self, x: np.ndarray) -> np.ndarray:
        m = np.ones(len(x), bool)
        for name, op, v in self.tests:
            col = x[:, FEATURES.index(name)]
            m &= (col <= v) if op == "<=" else (col >= v)
        return m

    def sql(self) -> str:
        return " AND ".join(f"{n} {op} {v!r}" for n, op, v in self.tests) or "TRUE"


def _grow(kind: str, x: np.ndarray, y: np.ndarray, thresholds: list[np.ndarray]) -> Rule:
    """Add the test with the most information gain until no other kind is covered."""
    rule, m = Rule(kind), np.ones(len(x), bool)
    bins = [np.searchsorted(t, x[:, j]) for j, t in enumerate(thresholds)]
    while (m & ~y).any() and len(rule.tests) < MOST_TESTS:
        p, n = (m & y).sum(), (m & ~y).sum()
        best = (1e-9, None, None)
        for j, name in enumerate(FEATURES):
            size = len(thresholds[j])
            if not size or name not in TESTED:
                continue
            # rows at or below each threshold, and the rest
            low_p, low_n = (np.cumsum(np.bincount(bins[j][m & k], minlength=size + 1))[:size] for k in (y, ~y))
            for op, tp, tn in (("<=", low_p, low_n), (">=", p - low_p, n - low_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(tp > 0, tp * (np.log2(tp / (tp + tn)) - np.log2(p / (p + n))), -1.0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    v = float(thresholds[j][i])
                    best = (gain[i], (name, op, v), m & ((x[:, j] <= v) if op == "<=" else (x[:, j] >= v)))
        if best[1] is None:
            break
        rule.tests.append(best[1])
        m = best[2]
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drop final tests as long as the held-out value (p - n) / (p + n) does not fall."""

    def value(r: Rule) -> float:
        m = r.mask(x)
        return ((m & y).sum() - (m & ~y).sum()) / max(m.sum(), 1) if m.any() else -1.0

    best, at = rule, value(rule)
    for k in range(len(rule.tests) - 1, 0, -1):
        r = Rule(rule.kind, rule.tests[:k])
        if value(r) >= at:
            best, at = r, value(r)
    return best


def induce(x: np.ndarray, y: np.ndarray, most_rules: int = 16, seed: int = 0) -> list[Rule]:
    """Ordered rule list by incremental reduced-error pruning; kinds in the order of KINDS, prose as the default.

    Thresholds lie halfway between neighbouring values, 48 quantiles per statistic and 48 evenly among its values. Two thirds of what is not yet covered
    grow a rule, one third prunes it; a rule must be right on LEAST_PRECISION of what it covers there.
    """
    rng, rules, left = np.random.default_rng(seed), [], np.ones(len(x), bool)
    thresholds = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        mid = (v[1:] + v[:-1]) / 2
        q = mid[np.unique(np.linspace(0, len(mid) - 1, 48).astype(int))] if len(mid) else mid
        extra = np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 48)))
        near = mid[np.minimum(np.searchsorted(mid, extra), len(mid) - 1)] if len(mid) else mid
        thresholds.append(np.unique(np.round(np.concatenate([q, near]), 4)))
    for kind in KINDS[:-1]:
        failures = 0
        for _ in range(most_rules):
            rows = np.flatnonzero(left)
            positive = y[rows] == kind
            take = rng.random(len(rows)) < 2 / 3
            if positive.sum() < 3 or not (positive & take).any() or not (positive & ~take).any():
                break
            rule = _prune(_grow(kind, x[rows[take]], positive[take], thresholds), x[rows[~take]], positive[~take])
            held = rule.mask(x[rows[~take]])
            if (held & positive[~take]).sum() < LEAST_PRECISION * max(held.sum(), 1):
                failures += 1
                if failures == MOST_FAILURES:
                    break
                continue
            rules.append(rule)
            left &= ~rule.mask(x)
    return rules


def decide(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    """Kinds that the rule list gives to rows of statistics."""
    out = np.full(len(x), KINDS[-1], object)
    for r in reversed(rules):
        out[r.mask(x)] = r.kind
    return out


def best_rules(x: np.ndarray, y: np.ndarray, corpus: np.ndarray | None = None, runs: int = 48) -> list[Rule]:
    """Of several rule lists, each grown and pruned on another split of three quarters of the rows, one of the best on the last quarter.

    Lists are compared by their mean of precision and recall over the kinds. With statistics of unlabelled documents of the corpus, the
    quarter of the lists that is best there is asked about them, and the list is taken that agrees most often with the others:
    what only suits the documents made for learning is outvoted.
    """
    rng = np.random.default_rng(0)
    held = rng.random(len(x)) < 0.25
    lists: list[tuple[float, list[Rule]]] = []
    for seed in range(runs):
        rules = induce(x[~held], y[~held], seed=seed)
        got = decide(x[held], rules)
        score = float(np.mean([2 * ((got == k) & (y[held] == k)).sum() / max((got == k).sum() + (y[held] == k).sum(), 1) for k in KINDS]))
        lists.append((score, rules))
    lists.sort(key=lambda sr: -sr[0])
    best = [rules for _, rules in lists[: max(1, runs // 4)]]
    if corpus is None or not len(corpus):
        return best[0]
    votes = np.array([decide(corpus, rules) for rules in best])
    alike = [np.mean([(v == w).mean() for w in votes]) for v in votes]
    return best[int(np.argmax(alike))]


def case_sql(rules: list[Rule]) -> str:
    """The rule list as one CASE expression over the statistics; a document without words or symbols is junk."""
    arms = " ".join(f"WHEN {r.sql()} THEN '{r.kind}'" for r in rules)
    return f"CASE WHEN lines = 0 THEN 'junk' {arms} ELSE 'prose' END"


def classify(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with the column kind: prose, list, table or junk (an empty text is junk)."""
    return stats.withColumn("kind", F.expr(case_sql(rules)))


def _plain(t: Column) -> Column:
    """Whether a text holds plain sentences alone."""
    return t.rlike(r"^\p{Lu}") & t.rlike(r"\.\s*$") & ~t.rlike(r"[|\t;{}<>\[\]=]|\n[^\n]|\d{4}") & F.char_length(t).between(200, 100_000)


#: Documents of which labelled ones are built, at most, and unlabelled ones on which rule lists are compared, about; those with the smallest hashes are taken.
BASE_DOCUMENTS, COMPARED_DOCUMENTS = 300, 3000


def fit_rules(documents: DataFrame, common: list[str], text: str = "text") -> list[Rule]:
    """Rules learned on labelled documents, which are built from at most BASE_DOCUMENTS texts of plain sentences."""
    from folioflow.llm.labelled import build

    base = hash_sample(documents, text, BASE_DOCUMENTS, _plain(F.col("v")))
    if not base:
        base = ["This is a plain sentence with some words. It is followed by another one of them. The third one ends the text here."]
    rows = documents.sparkSession.createDataFrame(build(base), "text string, label string")
    got = statistics(rows, common).select(*FEATURES, "label").toPandas()
    share = min(1.0, COMPARED_DOCUMENTS / max(documents.count(), 1))
    some = documents.select(F.col(f"`{text}`").alias("text")).filter(F.abs(F.xxhash64("text") / 9.3e18) < share).distinct()
    corpus = statistics(some, common).select(*FEATURES).toPandas()  # numbers alone, of about COMPARED_DOCUMENTS documents
    corpus = corpus.sort_values(list(FEATURES)).to_numpy(float)
    return best_rules(got[list(FEATURES)].to_numpy(float), got["label"].to_numpy(), corpus)
