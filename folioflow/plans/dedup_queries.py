"""Queries over duplicates, editions and revisions of books, with SQL written from the rules themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import catalog as C
from folioflow.operators import dedup as X
from folioflow.plans.registry import query
from folioflow.plans.sqltext import edit_ratio, nfkd
from folioflow.session import table

Spark = SparkSession
_BOOKS = "(SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"


def _books(s: Spark, d: str) -> DataFrame:
    return C.latest(table(s, d, "books"), "id", "updated_at")


# the rules in SQL, each written out on its own
_PRIO = "coalesce(MAP {'epub': 100, 'pdf': 80, 'djvu': 70, 'djv': 69, 'fb2': 60, 'docx': 50, 'doc': 40, 'azw3': 36, 'mobi': 35, 'azw': 35, 'rtf': 30, 'odt': 25, 'lit': 24, 'lrf': 23, 'snb': 21, 'pdb': 20, 'prc': 20, 'chm': 15, 'cbz': 12, 'cbr': 11, 'tcr': 10, 'txt': 10, 'html': 5, 'htm': 5}[lower(original_format)], -1)"
_MARKS = (r"\b(19\d{2}|20\d{2})\b", r"(?i)\b\d{1,3}(st|nd|rd|th)\s*ed(ition)?\b", r"(?i)\b(?:edition|ed\.?|версия|version|v)\s*\d{1,3}\b", r"(?i)\b(?:revised|updated|update|переработан|исправлен|дополнен|редакция|издание)\b")


def _plain(expr: str) -> str:
    return f"trim(regexp_replace(lower({nfkd(expr)}), '[^a-z0-9\\x{{400}}-\\x{{4ff}}]+', ' ', 'g'))"


def _stripped(expr: str) -> str:
    return reduce(lambda e, p: f"regexp_replace({e}, '{p}', ' ', 'g')", _MARKS, expr)


def _work(title: str, author: str) -> str:
    return f"(SELECT id, CASE WHEN length(t) < 4 THEN NULL WHEN length(a) >= 2 THEN t || '|' || a WHEN length(t) >= 10 THEN t || '|' END AS work FROM (SELECT id, {_plain(_stripped(title))} AS t, {_plain(author)} AS a FROM {_BOOKS} b) k)"


_FULL_WORK = _work("coalesce(nullif(title_en, ''), nullif(title, ''), '')", "coalesce(nullif(author_en, ''), nullif(author, ''), '')")
_NUMBERS = (r"\b(\d{1,2})(?:st|nd|rd|th)\s*ed(?:ition)?\b", r"\b(?:edition|ed\.?|издани[ея]|редакци[яи])\s*(\d{1,2})\b", r"\b(\d{1,2})\s*(?:edition|ed\.?|издани[ея]|редакци[яи])\b", r"\bv(?:er(?:sion)?)?[\s._-]*(\d{1,3})\b")
_CORPUS = "concat_ws(' ', nullif(title, ''), nullif(title_en, ''), nullif(source_archive, ''))"
_EDITIONS = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(lower({_CORPUS}), '{p}', 1), lambda v: least(40, 4 * v::INT))), 0)" for p in _NUMBERS)
_SCORE = f"CAST(greatest(0, coalesce(list_max(list_transform(regexp_extract_all({_CORPUS}, '\\b(19\\d{{2}}|20\\d{{2}})\\b', 1), lambda y: y::INT)), 0) - 1900) + {_EDITIONS} + CASE WHEN regexp_matches(lower({_CORPUS}), '\\b(revised|updated|update|переработан|исправлен|дополнен|новая редакция)\\b') THEN 20 ELSE 0 END AS INT)"
_SCORED = f"(SELECT b.id, w.work, {_SCORE} AS score FROM {_BOOKS} b JOIN {_FULL_WORK} w ON w.id = b.id)"


def _scored(s: Spark, d: str) -> DataFrame:
    work = X.work_key(F.col("title"), F.col("author"), F.col("title_en"), F.col("author_en"))
    return _books(s, d).select("id", work.alias("work"), X.revision_score(F.col("title"), F.col("title_en"), F.col("source_archive")).alias("score"))


@query("format_priorities", f"SELECT id, {_PRIO} AS priority, CASE lower(original_format) WHEN 'djvu' THEN 90 WHEN 'djv' THEN 89 ELSE {_PRIO} END AS djvu_first FROM books")
def format_priorities(s: Spark, d: str) -> DataFrame:
    f = F.col("original_format")
    return table(s, d, "books").select("id", X.format_priority(f).alias("priority"), X.format_priority(f, djvu_first=True).alias("djvu_first"))


# files: one per book and format of a book's chapters, under the archive and the publisher as directory and base name
@query("format_priority_pick", f"SELECT id, original_format FROM (SELECT *, lower(coalesce(source_archive, '')) || '|' || lower(coalesce(publisher, '')) AS k FROM {_BOOKS} b) x QUALIFY row_number() OVER (PARTITION BY k ORDER BY {_PRIO} DESC, created_at, id) = 1")
def format_priority_pick(s: Spark, d: str) -> DataFrame:
    b = _books(s, d)
    return X.best_format(b.select("id", "original_format", "source_archive", "publisher", "created_at"), F.col("source_archive"), F.col("publisher"), F.col("original_format"), ["created_at", "id"]).select("id", "original_format")


def _alnum(expr: str) -> str:
    return f"regexp_replace(lower({nfkd(expr)}), '[^a-z0-9а-яё]+', '', 'g')"


def _first(en: str, own: str) -> str:
    return f"coalesce(nullif(trim({en}), ''), nullif(trim({own}), ''), '')"


@query("near_dup_key", f"SELECT t || '|' || a || '|' || coalesce(chapter_count, 0) AS key, count(*) AS n, min(id) AS first FROM (SELECT id, chapter_count, {_alnum(_first('title_en', 'title'))} AS t, {_alnum(_first('author_en', 'author'))} AS a FROM {_BOOKS} b) x WHERE length(t) >= 4 GROUP BY 1")
def near_dup_key(s: Spark, d: str) -> DataFrame:
    k = X.near_key(F.col("title"), F.col("author"), F.col("chapter_count"), F.col("title_en"), F.col("author_en"))
    return _books(s, d).select("id", k.alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("work_keys", _FULL_WORK[1:-1])
def work_keys(s: Spark, d: str) -> DataFrame:
    return _scored(s, d).select("id", "work")


@query("revision_scores", f"SELECT id, {_SCORE} AS score FROM {_BOOKS} b")
def revision_scores(s: Spark, d: str) -> DataFrame:
    return _scored(s, d).select("id", "score")


@query("revision_pick", f"SELECT work, id, score FROM {_SCORED} x WHERE work IS NOT NULL QUALIFY row_number() OVER (PARTITION BY work ORDER BY score DESC, id) = 1")
def revision_pick(s: Spark, d: str) -> DataFrame:
    return X.latest_revisions(_scored(s, d))


# the works of authors alone, so that there are rivals: the key is the author
@query("revision_decisions", f"WITH r AS (SELECT b.id, {_plain('author')} AS work, {_SCORE} AS score FROM {_BOOKS} b WHERE author IS NOT NULL), o AS (SELECT a.id, b.id AS rival, a.score AS own, b.score AS other FROM r a JOIN r b ON a.work = b.work AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.score DESC, b.id) = 1) SELECT r.id, o.rival, CASE WHEN o.rival IS NULL THEN 'new' WHEN own < other THEN 'older' WHEN own > other THEN 'replaces' ELSE 'same' END AS decision FROM r LEFT JOIN o ON o.id = r.id")
def revision_decisions(s: Spark, d: str) -> DataFrame:
    score = X.revision_score(F.col("title"), F.col("title_en"), F.col("source_archive"))
    return X.revision_decisions(_books(s, d).filter("author IS NOT NULL").select("id", X.plain_key(F.col("author")).alias("work"), score.alias("score")))


_ISBN13 = "CASE WHEN regexp_full_match(n, '97[89].{10}') THEN n WHEN regexp_full_match(n, '\\d{9}[\\dXx]') THEN '978' || left(n, 9) || CAST((10 - (38 + 3 * substr(n, 1, 1)::INT + substr(n, 2, 1)::INT + 3 * substr(n, 3, 1)::INT + substr(n, 4, 1)::INT + 3 * substr(n, 5, 1)::INT + substr(n, 6, 1)::INT + 3 * substr(n, 7, 1)::INT + substr(n, 8, 1)::INT + 3 * substr(n, 9, 1)::INT) % 10) % 10 AS VARCHAR) END"


@query("isbn_duplicates", f"WITH k AS (SELECT id, {_ISBN13} AS isbn13, p, created_at FROM (SELECT id, regexp_replace(isbn, '[-\\s]', '', 'g') AS n, {_PRIO} AS p, created_at FROM books) x), f AS (SELECT * FROM k WHERE isbn13 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY isbn13 ORDER BY created_at, id) = 1) SELECT k.id, k.isbn13, f.id AS kept, CASE WHEN k.id = f.id THEN 'first' WHEN k.p <= f.p THEN 'duplicate' ELSE 'supersedes' END AS decision FROM k JOIN f ON f.isbn13 = k.isbn13")
def isbn_duplicates(s: Spark, d: str) -> DataFrame:
    return X.isbn_decisions(table(s, d, "books"))


# parts as files: name and brand as title and author, sizes as years and formats, so that works have several editions
_PARTS = "(SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, md5(p_name || p_brand || p_size) AS sha256, p_name || ' handbook' AS title, p_brand AS author, CASE WHEN p_size > 5 THEN 1950 + p_size END AS year, ['epub', 'pdf', 'djvu', 'txt'][p_size % 4 + 1] AS original_format, NULL::VARCHAR AS isbn FROM part)"


def _parts(s: Spark, d: str) -> DataFrame:
    p = table(s, d, "part")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("epub", "pdf", "djvu", "txt")]), (F.col("p_size") % 4 + 1).cast("int"))
    year = F.when(F.col("p_size") > 5, F.col("p_size") + 1950)
    sha = F.md5(F.concat("p_name", "p_brand", F.col("p_size").cast("string")))
    return p.select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), sha.alias("sha256"), F.concat("p_name", F.lit(" handbook")).alias("title"), F.col("p_brand").alias("author"), year.alias("year"), fmt.alias("original_format"), F.lit(None).cast("string").alias("isbn"))


def _one(source: str) -> str:
    return f"(SELECT * FROM {source} b QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY {_PRIO} DESC, id) = 1)"


def _work_of(source: str) -> str:
    return f"(SELECT id, CASE WHEN length(t) < 4 THEN NULL WHEN length(a) >= 2 THEN t || '|' || a WHEN length(t) >= 10 THEN t || '|' END AS work FROM (SELECT id, {_plain(_stripped("coalesce(title, '')"))} AS t, {_plain("coalesce(author, '')")} AS a FROM {source} b) k)"


def _grouped(source: str) -> str:
    return f"(SELECT o.id, w.work, {_PRIO} + CASE WHEN coalesce(year, 0) <> 0 THEN (year - 1900) * 0.01 ELSE 0 END AS score, count(*) OVER (PARTITION BY w.work) AS n FROM {_one(source)} o JOIN {_work_of(source)} w ON w.id = o.id WHERE w.work IS NOT NULL)"


@query("edition_groups", f"SELECT id, work, round(score, 2)::DOUBLE AS score, first_value(id) OVER (PARTITION BY work ORDER BY score DESC, id) AS recommended FROM {_grouped(_PARTS)} g WHERE n > 1")
def edition_groups(s: Spark, d: str) -> DataFrame:
    return X.edition_groups(_parts(s, d))


_ARTICLES = r"(?i)\b(the|a|an|и|в|на|по|для|из|от)\b"
_EDITION_WORDS = (r"(?i)\b\d{1,2}(st|nd|rd|th)\s*(edition|ed\.?)\b", r"(?i)\b(edition|ed\.?|revised|updated|expanded|annotated|издани[ея]|редакци[яи]|переработан)\b", r"\b(19|20)\d{2}\b")


def _fuzzy(expr: str) -> str:
    letters = f"regexp_replace(lower({nfkd(expr)}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({letters}, '{_ARTICLES}', ' ', 'g'), '\\s+', ' ', 'g'))"


_TITLE = "trim(regexp_replace(" + reduce(lambda e, p: f"regexp_replace({e}, '{p}', ' ', 'g')", _EDITION_WORDS, "title") + r", '\s+', ' ', 'g'))"


def _fuzzy_sql(source: str, threshold: float) -> str:
    return f"""WITH t AS MATERIALIZED (SELECT id, {_fuzzy(_TITLE)} AS t, {_fuzzy("coalesce(author, '')")} AS w, year, isbn FROM {source} b WHERE title IS NOT NULL),
r AS MATERIALIZED (SELECT min(id) AS id, t, w, year, isbn, string_split(w, ' ')[-1] AS surname, CASE WHEN contains(w, ' ') THEN string_split(w, ' ')[-1] || ' ' || left(w, 1) ELSE w END AS a FROM t WHERE t <> '' GROUP BY t, w, year, isbn)
SELECT * FROM (SELECT x.id AS id_a, y.id AS id_b, round(0.5 * {edit_ratio('x.t', 'y.t')} + 0.3 * CASE WHEN x.a = '' AND y.a = '' THEN 0.3 WHEN x.a = '' OR y.a = '' THEN 0 ELSE {edit_ratio('x.a', 'y.a')} END
+ 0.15 * CASE WHEN x.year IS NULL OR y.year IS NULL THEN 0.5 WHEN x.year = y.year THEN 1 WHEN abs(x.year - y.year) <= 3 THEN 0.8 WHEN abs(x.year - y.year) <= 5 THEN 0.3 ELSE 0 END + CASE WHEN x.isbn = y.isbn AND x.isbn <> '' THEN 0.05 ELSE 0 END, 4) AS score
FROM r x JOIN r y ON left(x.t, 6) = left(y.t, 6) AND x.surname = y.surname AND x.id < y.id) z WHERE score >= {threshold}"""


_NAMES = "(SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, 'The ' || p_name || CASE WHEN p_size > 25 THEN ' 2nd edition' ELSE '' END AS title, p_brand AS author, CAST(1990 + p_size // 10 AS INT) AS year, NULL::VARCHAR AS isbn FROM part)"


@query("fuzzy_pairs", _fuzzy_sql(_NAMES, 0.7))
def fuzzy_pairs(s: Spark, d: str) -> DataFrame:
    """Names of parts as titles, brands as authors; parts alike in all that is compared are one representative."""
    title = F.concat(F.lit("The "), F.col("p_name"), F.when(F.col("p_size") > 25, " 2nd edition").otherwise(""))
    rows = table(s, d, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("id"), title.alias("title"), F.col("p_brand").alias("author"), (1990 + F.floor(F.col("p_size") / 10)).cast("int").alias("year"), F.lit(None).cast("string").alias("isbn"))
    return X.fuzzy_pairs(rows)


@query("fuzzy_book_pairs", _fuzzy_sql(_BOOKS, 0.5))
def fuzzy_book_pairs(s: Spark, d: str) -> DataFrame:
    return X.fuzzy_pairs(_books(s, d), 0.5)


def _report_sql(source: str) -> str:
    groups = f"(SELECT work, count(*) AS n FROM {_grouped(source)} q WHERE n > 1 GROUP BY work)"
    fuzzy = _fuzzy_sql(f"(SELECT o.* FROM {_one(source)} o ANTI JOIN (SELECT id FROM {_grouped(source)} g WHERE n > 1) e ON e.id = o.id)", 0.85)
    return f"WITH f AS ({fuzzy}), g AS {groups} SELECT t.files, t.files - t.shas AS exact_duplicates, coalesce((SELECT sum(n - 1) FROM g), 0)::BIGINT AS format_duplicates, (SELECT count(*) FROM g) AS groups, (SELECT count(*) FROM f) AS fuzzy, greatest(0, t.shas - coalesce((SELECT sum(n - 1) FROM g), 0) - (SELECT count(*) FROM f))::BIGINT AS unique_books, t.files * 200 AS estimate_ms FROM (SELECT count(*) AS files, (SELECT count(*) FROM {_one(source)} o) AS shas FROM {source} b) t"


@query("scan_report_parts", _report_sql(_PARTS))
def scan_report_parts(s: Spark, d: str) -> DataFrame:
    return X.scan_report(_parts(s, d))


@query("scan_report", _report_sql(_BOOKS))
def scan_report(s: Spark, d: str) -> DataFrame:
    return X.scan_report(_books(s, d))


@query("sha_duplicates", "SELECT id, user_id, sha256 FROM books b WHERE sha256 IS NOT NULL AND (SELECT count(*) FROM books o WHERE o.user_id = b.user_id AND o.sha256 = b.sha256) > 1")
def sha_duplicates(s: Spark, d: str) -> DataFrame:
    """Rows whose file the same user holds more than once; another user's copy is none."""
    b = table(s, d, "books")
    twice = b.groupBy("user_id", "sha256").agg(F.count("*").alias("n")).filter("n > 1").select("user_id", "sha256")
    return b.join(twice, ["user_id", "sha256"], "left_semi").select("id", "user_id", "sha256")
