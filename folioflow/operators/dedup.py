"""Duplicates: exact hashes, format priorities, near-duplicate and work keys, fuzzy pairs, revisions, greedy tier dedup."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import ASCII_BOUNDARY, levenshtein_ratio, normalized, plain_isbn13, token_set
from folioflow.operators.catalog import blank_to_null
from folioflow.session import cut, require

# Which format of a book is kept, by priority; formats that are not listed have -1.
FORMAT_PRIORITY = {
    "epub": 100, "pdf": 80, "djvu": 70, "djv": 69, "fb2": 60, "docx": 50, "doc": 40, "azw3": 36, "mobi": 35, "azw": 35, "rtf": 30, "odt": 25,
    "lit": 24, "lrf": 23, "snb": 21, "pdb": 20, "prc": 20, "chm": 15, "cbz": 12, "cbr": 11, "tcr": 10, "txt": 10, "html": 5, "htm": 5,
}
# Priorities that change where DjVu is preferred over PDF.
DJVU_FIRST = {"djvu": 90, "djv": 89}


def format_priority(fmt: Column, djvu_first: bool = False) -> Column:
    """Priority of a format name in any case; -1 for null and unknown ones."""
    table = FORMAT_PRIORITY | (DJVU_FIRST if djvu_first else {})
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(known[F.lower(fmt)], F.lit(-1))


def best_format(files: DataFrame, directory: Column, name: Column, fmt: Column, arrival: list[str], djvu_first: bool = False) -> DataFrame:
    """Of files alike in directory and base name but for case, the one of the best format; of equal ones the first by `arrival`.

    An aggregation, so that any number of files under one name combines before the shuffle. Null parts count as empty.
    """
    key = F.concat_ws("|", F.lower(F.coalesce(directory, F.lit(""))), F.lower(F.coalesce(name, F.lit(""))))
    order = F.struct((-format_priority(fmt, djvu_first)).alias("p"), *arrival)
    row = F.struct(*[F.col(f"`{c}`") for c in files.columns])
    return files.groupBy(key.alias("__key")).agg(F.min_by(row, order).alias("r")).select("r.*")


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """hash, kept key and copies of texts that occur more than once; copies combine before the shuffle."""
    return df.filter(F.col(text).isNotNull()).groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(key).alias("kept"), F.count("*").alias("copies")).filter("copies > 1")


def near_key(title: Column, author: Column, chapters: Column, title_en: Column | None = None, author_en: Column | None = None) -> Column:
    """title|author|chapters, of the English fields where they are filled, decomposed and stripped to letters and digits of two scripts.

    Null for titles that leave fewer than four characters; no chapters count as 0.
    """
    first = lambda a, b: F.coalesce(*[blank_to_null(x) for x in (b, a) if x is not None], F.lit(""))
    plain = lambda c: F.regexp_replace(F.lower(normalized(c, "NFKD")), "[^a-z0-9а-яё]+", "")
    t = plain(first(title, title_en))
    return F.when(F.length(t) >= 4, F.concat_ws("|", t, plain(first(author, author_en)), F.coalesce(chapters, F.lit(0)).cast("string")))


# Marks of revisions in titles (years, ordinals, edition and version numbers, words); \b is one of ASCII words.
_B = ASCII_BOUNDARY
REVISION_MARKS = (
    rf"{_B}(?:19[0-9]{{2}}|20[0-9]{{2}}){_B}",
    rf"(?iu){_B}[0-9]{{1,3}}(?:st|nd|rd|th)\s*ed(?:ition)?{_B}",
    rf"(?iu){_B}(?:edition|ed\.?|версия|version|v)\s*[0-9]{{1,3}}{_B}",
    rf"(?iu){_B}(?:revised|updated|update|переработан|исправлен|дополнен|редакция|издание){_B}",
)
# Patterns that give an edition's number, and the words of a revised one.
EDITION_NUMBERS = (
    rf"{_B}([0-9]{{1,2}})(?:st|nd|rd|th)\s*ed(?:ition)?{_B}",
    rf"{_B}(?:edition|ed\.?|издани[ея]|редакци[яи])\s*([0-9]{{1,2}}){_B}",
    rf"{_B}([0-9]{{1,2}})\s*(?:edition|ed\.?|издани[ея]|редакци[яи]){_B}",
    rf"{_B}v(?:er(?:sion)?)?[\s._-]*([0-9]{{1,3}}){_B}",
)
REVISED = rf"{_B}(?:revised|updated|update|переработан|исправлен|дополнен|новая редакция){_B}"


def plain_key(c: Column) -> Column:
    """Decomposed, in small letters, runs of all but digits and letters of two scripts as one blank."""
    return F.trim(F.regexp_replace(F.lower(normalized(c, "NFKD")), "[^a-z0-9\u0400-\u04ff]+", " "))


def work_key(title: Column, author: Column, title_en: Column | None = None, author_en: Column | None = None) -> Column:
    """title|author of a work, of the English fields where they are filled, without marks of revisions.

    Null for titles under four characters, and for those under ten where the author has fewer than two.
    """
    filled = lambda a, b: F.coalesce(*[F.when(F.length(x) > 0, x) for x in (b, a) if x is not None], F.lit(""))
    t = plain_key(reduce(lambda c, mark: F.regexp_replace(c, mark, " "), REVISION_MARKS, filled(title, title_en)))
    a = plain_key(filled(author, author_en))
    return F.when(F.length(t) < 4, None).when(F.length(a) >= 2, F.concat_ws("|", t, a)).when(F.length(t) >= 10, F.concat(t, F.lit("|")))


def revision_score(*texts: Column) -> Column:
    """Years of the latest year named since 1900, four for each edition number up to 40 a mention, 20 for a word of revision."""
    text = F.concat_ws(" ", *[F.when(F.length(t) > 0, t) for t in texts])
    years = F.regexp_extract_all(text, F.lit(rf"{_B}(19[0-9]{{2}}|20[0-9]{{2}}){_B}"), 1)
    low = F.lower(text)
    numbers = F.concat(*[F.regexp_extract_all(low, F.lit(p), 1) for p in EDITION_NUMBERS])
    editions = F.aggregate(numbers, F.lit(0), lambda s, x: s + F.least(F.lit(40), 4 * x.cast("int")))
    latest = F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(years, lambda y: y.cast("int"))) - 1900, F.lit(0)))
    return latest + editions + F.when(low.rlike(REVISED), 20).otherwise(0)


def latest_revisions(books: DataFrame, work: str = "work", score: str = "score", key: str = "id") -> DataFrame:
    """work, key and score of each work's latest revision: the highest score, of equal ones the smallest key. Combines before the shuffle."""
    best = books.filter(F.col(work).isNotNull()).groupBy(work).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias("b"))
    return best.select(work, F.col("b.k").alias(key), (-F.col("b.s")).alias(score))


def revision_decisions(books: DataFrame, work: str = "work", score: str = "score", key: str = "id") -> DataFrame:
    """key, rival and decision of every book against the latest other revision of its work.

    'older' where the other's score is higher, 'replaces' where it is lower, 'same' where both stay, 'new' without another.
    """
    rows = books.select(key, work, score)
    first = latest_revisions(rows, work, score, key).select(work, F.col(key).alias("k1"), F.col(score).alias("s1"))
    ranked = rows.join(first, work, "left")
    rest = ranked.filter(F.col(work).isNotNull() & (F.col(key) != F.col("k1")))
    second = latest_revisions(rest, work, score, key).select(work, F.col(key).alias("k2"), F.col(score).alias("s2"))
    both = ranked.join(second, work, "left")
    own = F.col(key) == F.col("k1")
    rival, against = F.when(own, F.col("k2")).otherwise(F.col("k1")), F.when(own, F.col("s2")).otherwise(F.col("s1"))
    decision = F.when(rival.isNull(), "new").when(F.col(score) < against, "older").when(F.col(score) > against, "replaces").otherwise("same")
    return both.select(key, rival.alias("rival"), decision.alias("decision"))


def edition_score(fmt: Column, year: Column) -> Column:
    """Format priority and a hundredth for every year since 1900; no year adds nothing."""
    return format_priority(fmt) + F.coalesce(F.when(year != 0, (year - 1900) * 0.01), F.lit(0.0))


def edition_groups(books: DataFrame) -> DataFrame:
    """id, work, score and recommended for the editions of works with two or more, after equal files are folded into one.

    Of equal files (sha256) the best format stays, of equal ones the smallest id. recommended is the id of the best score.
    """
    require(books, "id", "sha256", "title", "author", "year", "original_format")
    one = books.groupBy("sha256").agg(F.min_by(F.struct("id", "title", "author", "year", "original_format"), F.struct((-format_priority(F.col("original_format"))).alias("p"), F.col("id"))).alias("r")).select("r.*")
    keyed = one.select("id", work_key(F.col("title"), F.col("author")).alias("work"), edition_score(F.col("original_format"), F.col("year")).alias("score")).filter("work IS NOT NULL")
    groups = keyed.groupBy("work").agg(F.count("*").alias("editions"), F.min(F.struct((-F.col("score")).alias("s"), F.col("id"))).alias("b")).filter("editions > 1")
    return keyed.join(groups, "work").select("id", "work", F.round("score", 2).alias("score"), F.col("b.id").alias("recommended"))


def scan_report(books: DataFrame) -> DataFrame:
    """files, exact_duplicates, format_duplicates, groups, fuzzy (pairs of singles at 0.85 or more), unique_books (floor 0) and estimate_ms."""
    groups = edition_groups(books).groupBy("work").agg(F.count("*").alias("n"))
    grouped = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("format_duplicates"))
    files = books.agg(F.count("*").alias("files"), F.countDistinct("sha256").alias("shas"), F.count_if(F.col("sha256").isNull()).alias("lost"))
    one = books.groupBy("sha256").agg(F.min_by(F.struct("id", "title", "author", "year", "isbn"), F.struct((-format_priority(F.col("original_format"))).alias("p"), F.col("id"))).alias("r")).select("r.*")
    singles = one.join(edition_groups(books).select("id"), "id", "left_anti")
    fuzzy = fuzzy_pairs(singles, 0.85).agg(F.count("*").alias("fuzzy"))
    all_ = files.crossJoin(grouped).crossJoin(fuzzy)  # one row each
    shas = F.col("shas") + F.when(F.col("lost") > 0, 1).otherwise(0)
    single = shas - F.col("format_duplicates") - F.col("groups")
    unique = F.greatest(F.lit(0), single + F.col("groups") - F.col("fuzzy"))
    return all_.select("files", (F.col("files") - shas).alias("exact_duplicates"), "format_duplicates", "groups", "fuzzy", unique.alias("unique_books"), (200 * F.col("files")).alias("estimate_ms"))


def isbn_decisions(books: DataFrame) -> DataFrame:
    """id, isbn13, kept and decision for books with an ISBN: the first of an ISBN (by created_at, id) is known; a later one of no
    better format is a 'duplicate', one of a better format 'supersedes' it; the first itself is 'first'."""
    require(books, "id", "isbn", "original_format", "created_at")
    known = books.select("id", plain_isbn13(F.col("isbn")).alias("isbn13"), format_priority(F.col("original_format")).alias("p"), "created_at").filter("isbn13 IS NOT NULL")
    first = known.groupBy("isbn13").agg(F.min_by(F.struct("id", "p"), F.struct("created_at", "id")).alias("f"))
    both = known.join(first, "isbn13")
    decision = F.when(F.col("id") == F.col("f.id"), "first").when(F.col("p") <= F.col("f.p"), "duplicate").otherwise("supersedes")
    return both.select("id", "isbn13", F.col("f.id").alias("kept"), decision.alias("decision"))


# Articles and words of editions that fuzzy comparison leaves out.
ARTICLES = rf"(?i){_B}(?:the|a|an|и|в|на|по|для|из|от){_B}"
EDITION_WORDS = (rf"(?i){_B}[0-9]{{1,2}}(?:st|nd|rd|th)\s*(?:edition|ed\.?){_B}", rf"(?iu){_B}(?:edition|ed\.?|revised|updated|expanded|annotated|издани[ея]|редакци[яи]|переработан){_B}", rf"{_B}(?:19|20)[0-9]{{2}}{_B}")


def fuzzy_normal(c: Column) -> Column:
    """Decomposed, in small letters, letters and digits with single blanks, without articles."""
    t = F.regexp_replace(F.lower(normalized(c, "NFKD")), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, ARTICLES, " "), r"\s+", " "))


def without_editions(c: Column) -> Column:
    return F.trim(F.regexp_replace(reduce(lambda x, p: F.regexp_replace(x, p, " "), EDITION_WORDS, c), r"\s+", " "))


def surname_and_initial(normal: Column) -> Column:
    """Last word and first letter of a normalised name; a single word stays, no word gives the empty string."""
    parts = F.split(normal, " ")
    return F.when(F.size(parts) == 1, normal).otherwise(F.concat_ws(" ", F.element_at(parts, -1), F.substring(parts[0], 1, 1)))


def year_score(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0.5).when(d == 0, 1.0).when(d <= 3, 0.8).when(d <= 5, 0.3).otherwise(0.0)


def fuzzy_pairs(books: DataFrame, threshold: float = 0.7) -> DataFrame:
    """id_a, id_b and score of likely equal books: half title, three tenths author, the rest year and ISBN.

    Compared are books alike in the first six characters of the normalised title and in the surname. Rows alike in all that is
    compared are one representative, named by their smallest id, so that a group of copies of any size is one row. Titles
    that normalise to nothing have no partner; a missing author on both sides counts 0.3, on one side 0.
    """
    require(books, "id", "title", "author", "year", "isbn")
    t = books.filter("title IS NOT NULL").select("id", fuzzy_normal(without_editions(F.col("title"))).alias("title"), fuzzy_normal(F.coalesce("author", F.lit(""))).alias("who"), "year", "isbn")
    t = t.filter("title <> ''")
    reps = t.groupBy("title", "who", "year", "isbn").agg(F.min("id").alias("id"))
    reps = reps.select("*", F.concat_ws("|", F.substring("title", 1, 6), F.element_at(F.split("who", " "), -1)).alias("block"), surname_and_initial(F.col("who")).alias("author"))
    a, b = reps.alias("a"), reps.alias("b")
    j = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id")))
    no_a, no_b = F.col("a.author") == "", F.col("b.author") == ""
    author = F.when(no_a & no_b, 0.3).when(no_a | no_b, 0.0).otherwise(levenshtein_ratio(F.col("a.author"), F.col("b.author")))
    isbn = F.when((F.col("a.isbn") == F.col("b.isbn")) & (F.col("a.isbn") != ""), 1.0).otherwise(0.0)
    score = 0.5 * levenshtein_ratio(F.col("a.title"), F.col("b.title")) + 0.3 * author + 0.15 * year_score(F.col("a.year"), F.col("b.year")) + 0.05 * isbn
    return j.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round(score, 4).alias("score")).filter(F.col("score") >= threshold)


def propositions(relations: DataFrame) -> DataFrame:
    """'S P O.' with blanks for underscores, at most 400 characters, ten at least, each text once per concept in first order."""
    text = F.substring(F.concat(F.concat_ws(" ", "subject", F.regexp_replace("predicate", "_", " "), "object"), F.lit(".")), 1, 400)
    t = relations.select("concept_id", "part", text.alias("text")).filter(F.length("text") >= 10)
    w = Window.partitionBy("concept_id", F.lower("text")).orderBy("part")
    return t.withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


def components(pairs: DataFrame) -> DataFrame:
    """tier, node and root (the smallest node reached) of the groups that pairs (tier, a, b) link; labels spread until none changes."""
    both = cut(pairs.select("tier", F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select("tier", "b", "a")).distinct())
    state = cut(both.groupBy("tier", "node").agg(F.least(F.min("node"), F.min("other")).alias("root")))
    while True:
        # the smallest root among neighbours, then one jump along the roots
        near = both.join(state.select("tier", F.col("node").alias("other"), F.col("root").alias("r")), ["tier", "other"]).groupBy("tier", "node").agg(F.min("r").alias("r"))
        step = state.join(near, ["tier", "node"]).select("tier", "node", F.col("root").alias("old"), F.least("root", "r").alias("root"))
        jump = step.select("tier", F.col("node").alias("root"), F.col("root").alias("r2"))
        new = cut(step.join(jump, ["tier", "root"], "left").select("tier", "node", "old", F.least("root", F.coalesce("r2", "root")).alias("root")))
        state = new.select("tier", "node", "root")
        if new.filter("old <> root").isEmpty():
            return state


#: Words of 64 bits in the bitmap of lines that are compared; it is bounded and only spares reading, any line may pass it.
SCREEN_WORDS = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """Integers of 64 bits, scattered."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_hashes(sets: pa.ListArray, threshold: float) -> pa.ListArray:
    """Hashes of which any two different sets more alike (Jaccard) than threshold share one; sets are of hashed tokens.

    Sizes fall into classes by powers of 1 / threshold, so that partners are of one class or of neighbouring ones. Partners with at most
    r tokens each differ in at most d = 2 r (1 - threshold) / (1 + threshold) tokens, so when all tokens are dealt to d + 1 parts by their
    hash, one part is equal in both. A set is hashed for its own class and, as the smaller partner, for the next one.
    """
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = sets.flatten().to_numpy().view(np.uint64)
    like = min(threshold, 1 - 1e-6)
    own = np.floor(np.log(np.maximum(sizes, 1)) / -np.log(like))
    tags = np.stack([own, own + 1], axis=1)
    most = np.floor(like ** -(tags + 1) + 1e-6)
    differ = np.floor(2 * most * (1 - like) / (1 + like) + 1e-9).astype(np.int64)
    # where partners can't differ they are equal, and need no hashes
    parts = np.where((differ > 0) & (sizes > 0)[:, None], differ + 1, 0)
    starts = np.concatenate([[0], np.cumsum(parts.ravel())])
    out = np.zeros(starts[-1], np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for t in (0, 1):
        n = parts[row, t]
        dealt = n > 0
        slot = starts[:-1].reshape(-1, 2)[row[dealt], t] + (tokens[dealt] % n[dealt].astype(np.uint64)).astype(np.int64)
        np.bitwise_xor.at(out, slot, tokens[dealt])
    part = np.arange(len(out)) - np.repeat(starts[:-1], parts.ravel())
    tag = np.repeat(tags.ravel(), parts.ravel()).astype(np.int64)
    out = _mixed(out ^ _mixed((tag << 32 | part).astype(np.uint64) + np.uint64(1)))
    return pa.ListArray.from_arrays(pa.array(starts[::2], pa.int32()), pa.array(out.view(np.int64)))


def greedy_tiers(lines: DataFrame, threshold: float = 0.92, key: str = "line_id", tier: str = "tier", text: str = "text") -> DataFrame:
    """Lines that survive greedy deduplication inside their tier: a line falls when an earlier kept line is more similar than threshold.

    Only lines with a partner above the threshold can fall. Lines of the same tokens are one, by a digest; partners of the others share one
    of their part_hashes, so only those few numbers of a line are shuffled. Tokens are compared for lines that share one with another.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield part_hashes(b, threshold)

    t = lines.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(tier, F.lit("")).alias("tier"), F.coalesce(text, F.lit("")).alias("text"))
    sets = t.select("id", "tier", token_set(F.col("text")).alias("set"))
    short = sets.select("id", "tier", F.unhex(F.sha2(F.concat_ws(" ", F.sort_array("set")), 256)).alias("same"), F.transform("set", lambda w: F.xxhash64(w)).alias("set"))
    short = short.select("id", "tier", "same", F.arrow_udf(hashed, "array<bigint>")("set").alias("parts"))
    first = F.row_number().over(Window.partitionBy("tier", "same").orderBy("id")) == 1
    short = short.withColumn("first", first)
    short = cut(short.select("id", "first", F.when(F.col("first"), F.transform("parts", lambda h: F.xxhash64("tier", h))).alias("parts")))
    copies = short.filter("NOT first").select("id")
    shared = short.filter("first").select("id", F.explode("parts").alias("h")).withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1")
    shared = cut(shared.select("h", "id"))
    cand = shared.select("h", F.col("id").alias("a")).join(shared.select("h", F.col("id").alias("b")), "h").filter("a < b").select("a", "b").distinct()
    # only lines that may be compared are read again with their text
    bit = F.pmod(F.xxhash64("id"), F.lit(SCREEN_WORDS * 64))
    screen = shared.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit"))
    screen = screen.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    again = t.withColumns({"word": F.shiftright(bit, 6), "bit": F.pmod(bit, F.lit(64)).cast("int")}).join(F.broadcast(screen), "word")
    again = again.filter(F.getbit("bits", "bit") == 1).select("id", "tier", token_set(F.col("text")).alias("set"))
    left = again.select(F.col("id").alias("a"), "tier", F.col("set").alias("sa"))
    right = again.select(F.col("id").alias("b"), F.col("tier").alias("tb"), F.col("set").alias("sb"))
    near = cand.join(left, "a").join(right, "b").filter("tier = tb")
    near = cut(near.filter(F.size(F.array_intersect("sa", "sb")) > threshold * F.size(F.array_union("sa", "sb"))).select("tier", "a", "b"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        fallen: set = set()
        for x, y in sorted(zip(pdf["a"], pdf["b"], strict=True), key=lambda p: (p[1], p[0])):
            if x not in fallen:
                fallen.add(y)
        return pd.DataFrame({"id": sorted(fallen)}, dtype="int64")

    # a line depends only on those it is linked with, so each linked group is folded by itself
    at = components(near)
    fallen = near.join(at.select("tier", F.col("node").alias("a"), "root"), ["tier", "a"]).groupBy("tier", "root").applyInPandas(fold, "id bigint").union(copies)
    return lines.join(fallen.withColumnRenamed("id", key), key, "left_anti")


def idea_clusters(ideas: DataFrame, threshold: float = 0.92, group: str = "book_id", order: str = "seq", vector: str = "embedding") -> DataFrame:
    """Greedy centroid clusters per group, in order: an idea joins its best cluster from the threshold on, else opens one.

    A fold over one group's ideas (those of a book), inherently sequential; groups run in parallel.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums: list[np.ndarray] = []
        counts: list[int] = []
        first: list[int] = []
        for i, v in zip(*(pdf.sort_values(order)[c] for c in (order, vector)), strict=True):
            v = np.asarray(v, float)
            v = v / max(np.linalg.norm(v), 1e-12)
            sims = [float(s @ v / max(np.linalg.norm(s), 1e-12)) for s in sums]
            best = int(np.argmax(sims)) if sims else -1
            if best >= 0 and sims[best] >= threshold:
                sums[best] = sums[best] + v
                counts[best] += 1
            else:
                sums.append(v)
                counts.append(1)
                first.append(i)
        return pd.DataFrame({group: [key[0]] * len(sums), "cluster": range(len(sums)), "ideas": counts, "sample": first})

    kinds = dict(ideas.dtypes)
    return ideas.groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, cluster int, ideas int, sample {kinds[order]}")


