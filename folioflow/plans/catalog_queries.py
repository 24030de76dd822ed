"""Queries over the catalogue, the chunk tree and the exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.repair import best_title
from folioflow.operators import catalog as C
from folioflow.operators import chunking as K
from folioflow.operators import dedup as X
from folioflow.operators import export as E
from folioflow.operators.filters import compile_filter
from folioflow.plans.registry import query
from folioflow.session import table

Spark = SparkSession


def _books(s: Spark, d: str) -> DataFrame:
    return C.latest(table(s, d, "books"), "id", "updated_at")


_BOOKS = "(SELECT * FROM books QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"


@query("latest_books", f"SELECT id, title, year, status FROM {_BOOKS} b")
def latest_books(s: Spark, d: str) -> DataFrame:
    return _books(s, d).select("id", "title", "year", "status")


@query("catalog_query", f"SELECT id, title, quality_score FROM {_BOOKS} b WHERE quality_score >= 5 AND NOT coalesce(is_fiction_or_water, false) AND status IN ('indexed', 'evaluated') ORDER BY quality_score DESC NULLS LAST, title, id LIMIT 50 OFFSET 10")
def catalog_query(s: Spark, d: str) -> DataFrame:
    return C.query_catalog(_books(s, d), least_quality=5, hide_fiction=True, statuses=["indexed", "evaluated"], order="quality", limit=50, offset=10).select("id", "title", "quality_score")


@query("catalog_count", f"SELECT status, count(*) AS n FROM {_BOOKS} b WHERE NOT coalesce(is_fiction_or_water, false) GROUP BY status")
def catalog_count(s: Spark, d: str) -> DataFrame:
    return _books(s, d).filter(~F.coalesce("is_fiction_or_water", F.lit(False))).groupBy("status").agg(F.count("*").alias("n"))


@query("catalog_title_search", f"SELECT id, title FROM {_BOOKS} b WHERE contains(lower(title), 'system')")
def catalog_title_search(s: Spark, d: str) -> DataFrame:
    return _books(s, d).filter(F.lower("title").contains("system")).select("id", "title")


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"


@query("full_text_search", f"SELECT id, title FROM (SELECT id, title, {_TOKENS.format("concat_ws(' ', title, title_en, author, author_en)")} AS w FROM {_BOOKS} b) x WHERE list_contains(w, 'the') AND len(list_filter(w, lambda y: starts_with(y, 'sch'))) > 0")
def full_text_search(s: Spark, d: str) -> DataFrame:
    return C.full_text(_books(s, d), ["title", "title_en", "author", "author_en"], "the sch*").select("id", "title")


@query("catalog_query_wide", f"SELECT id, evaluated_at FROM {_BOOKS} b WHERE is_fiction_or_water IS NULL OR NOT is_fiction_or_water ORDER BY coalesce(evaluated_at, TIMESTAMP '1970-01-01') DESC, id LIMIT 20000")
def catalog_query_wide(s: Spark, d: str) -> DataFrame:
    return C.query_catalog(_books(s, d), hide_fiction=True, order="evaluated", limit=999_999, most=20_000).select("id", "evaluated_at")


@query("catalog_page_total", f"SELECT count(*) AS total, least(count(*), 500) AS shown FROM {_BOOKS} b WHERE domain = 'data' AND quality_score BETWEEN 10 AND 90")
def catalog_page_total(s: Spark, d: str) -> DataFrame:
    found = {"domain": "data", "least_quality": 10, "most_quality": 90}
    page = C.query_catalog(_books(s, d), limit=10_000, **found)
    return C.matching(_books(s, d), **found).agg(F.count("*").alias("total")).crossJoin(page.agg(F.count("*").alias("shown")))


@query("catalog_keyset_page", f"SELECT id, status FROM {_BOOKS} b WHERE status IN ('failed', 'imported') AND id > '4' ORDER BY id LIMIT 40")
def catalog_keyset_page(s: Spark, d: str) -> DataFrame:
    return C.keyset_page(_books(s, d), ["failed", "imported"], "4", 40).select("id", "status")


@query("json_filter", f"SELECT id FROM {_BOOKS} b WHERE (year > 1980 AND year <= 2010) AND (language IN ('en', 'ru') OR quality_score >= 8) AND status <> 'failed'")
def json_filter(s: Spark, d: str) -> DataFrame:
    spec = {"$and": [{"year": {"$gt": 1980, "$lte": 2010}}, {"$or": [{"language": {"$in": ["en", "ru"]}}, {"quality_score": {"$gte": 8}}]}], "status": {"$ne": "failed"}}
    return _books(s, d).filter(compile_filter(spec, {"year", "language", "quality_score", "status"})).select("id")


@query("ids_order_preserving", "SELECT vec_rowid, position, level FROM chunks JOIN (VALUES (7, 0), (3, 1), (11, 2), (5, 3)) t(id, position) ON vec_rowid = id")
def ids_order_preserving(s: Spark, d: str) -> DataFrame:
    return C.by_ids(table(s, d, "chunks").select("vec_rowid", "level"), [7, 3, 11, 5], "vec_rowid").select("vec_rowid", "position", "level")


@query("batch_gate", f"SELECT i.id, CASE WHEN b.id IS NULL THEN 'not_found' WHEN is_fiction_or_water THEN 'fiction_or_water' WHEN evaluated_at IS NULL THEN 'unevaluated' WHEN coalesce(quality_score, 0) < 5 THEN 'low_quality' END AS reason FROM (SELECT DISTINCT book_id AS id FROM documents WHERE book_id IS NOT NULL UNION SELECT 'none') i LEFT JOIN {_BOOKS} b ON b.id = i.id")
def batch_gate(s: Spark, d: str) -> DataFrame:
    ids = table(s, d, "documents").select(F.col("book_id").alias("id")).filter("id IS NOT NULL").distinct()
    return C.gate(_books(s, d), ids.union(s.createDataFrame([("none",)], "id string")), 5)


_LABEL = "coalesce(nullif(trim({c}), ''), '{u}') AS label, count(*) AS n, min(id) AS first_id"


@query("by_domain", f"SELECT {_LABEL.format(c='domain', u='unclassified')} FROM {_BOOKS} b GROUP BY 1")
def by_domain(s: Spark, d: str) -> DataFrame:
    return C.group_by_label(_books(s, d), F.col("domain"), "unclassified")


@query("by_author_locale", f"SELECT {_LABEL.format(c='coalesce(nullif(trim(author_ru), %s), nullif(trim(author_en), %s), nullif(trim(author), %s))' % (chr(39) * 2, chr(39) * 2, chr(39) * 2), u='Unknown Author')} FROM {_BOOKS} b GROUP BY 1")
def by_author_locale(s: Spark, d: str) -> DataFrame:
    b = _books(s, d)
    return C.group_by_label(b, C.localized(b, "author"), "Unknown Author")


@query("by_source_archive", f"SELECT coalesce(nullif(trim(source_archive), ''), 'unsorted') AS label, count(*) AS n, min(id) AS first_id FROM {_BOOKS} b GROUP BY 1")
def by_source_archive(s: Spark, d: str) -> DataFrame:
    return C.group_by_label(_books(s, d), F.col("source_archive"), "unsorted")


@query("domain_members", f"SELECT coalesce(nullif(trim(domain), ''), 'unclassified') AS label, id FROM {_BOOKS} b")
def domain_members(s: Spark, d: str) -> DataFrame:
    return C.members(_books(s, d), F.col("domain"), "unclassified")


@query("author_members_en", f"SELECT coalesce(nullif(trim(author_en), ''), nullif(trim(author_ru), ''), nullif(trim(author), ''), 'Unknown Author') AS label, id FROM {_BOOKS} b")
def author_members_en(s: Spark, d: str) -> DataFrame:
    b = _books(s, d)
    return C.members(b, C.localized(b, "author", "en"), "Unknown Author")


@query("tag_members", f"SELECT DISTINCT trim(t) AS tag, id FROM {_BOOKS} b, unnest(tags) u(t) WHERE trim(t) <> ''")
def tag_members(s: Spark, d: str) -> DataFrame:
    return C.tag_members(_books(s, d))


@query("top_domains", f"SELECT domain, count(*) AS n FROM {_BOOKS} b WHERE domain IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def top_domains(s: Spark, d: str) -> DataFrame:
    return _books(s, d).filter("domain IS NOT NULL").groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(10)


@query("by_year_unknown_last", f"SELECT coalesce(CAST(year AS VARCHAR), 'Unknown Year') AS label, count(*) AS n, CAST(row_number() OVER (ORDER BY year DESC NULLS LAST) AS INTEGER) AS place FROM {_BOOKS} b GROUP BY year")
def by_year_unknown_last(s: Spark, d: str) -> DataFrame:
    years = _books(s, d).groupBy("year").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("year")))  # over one row per year
    return years.select(F.coalesce(F.col("year").cast("string"), F.lit("Unknown Year")).alias("label"), "n", place.alias("place"))


@query("by_tag", f"SELECT tag, count(*) AS n FROM (SELECT DISTINCT id, trim(t) AS tag FROM {_BOOKS} b, unnest(tags) u(t)) x WHERE tag <> '' GROUP BY tag")
def by_tag(s: Spark, d: str) -> DataFrame:
    return C.group_by_tag(_books(s, d))


@query("tag_stats", f"SELECT tag, count(*) AS n FROM (SELECT trim(t) AS tag FROM {_BOOKS} b, unnest(tags) u(t)) x WHERE tag <> '' GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def tag_stats(s: Spark, d: str) -> DataFrame:
    return C.group_by_tag(_books(s, d), per_book_once=False).orderBy(F.desc("n"), "tag").limit(20)


@query("by_language_format", f"SELECT language, original_format, count(*) AS n, sum(word_count) AS words, max(year) AS newest FROM {_BOOKS} b GROUP BY ALL")
def by_language_format(s: Spark, d: str) -> DataFrame:
    return _books(s, d).groupBy("language", "original_format").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"), F.max("year").alias("newest"))


@query("collection_counts", "SELECT collection_name, count(*) AS n FROM chatml_lines GROUP BY 1")
def collection_counts(s: Spark, d: str) -> DataFrame:
    return table(s, d, "chatml_lines").groupBy("collection_name").agg(F.count("*").alias("n"))


@query("storage_usage", f"SELECT user_id, sum(coalesce(chars, 0)) AS chars, count(*) AS books, bool_or(chars IS NULL) AS partial FROM {_BOOKS} b LEFT JOIN (SELECT book_id, sum(length(text)) AS chars FROM chunks GROUP BY 1) c ON c.book_id = b.id GROUP BY user_id")
def storage_usage(s: Spark, d: str) -> DataFrame:
    chars = table(s, d, "chunks").groupBy("book_id").agg(F.sum(F.char_length("text").cast("bigint")).alias("chars"))
    j = _books(s, d).select("id", "user_id").join(chars, F.col("id") == F.col("book_id"), "left")
    return j.groupBy("user_id").agg(F.sum(F.coalesce("chars", F.lit(0))).alias("chars"), F.count("*").alias("books"), F.bool_or(F.col("chars").isNull()).alias("partial"))


@query("outcome_counts", f"SELECT count(*) FILTER (status = 'indexed') AS indexed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (last_error IS NOT NULL) AS errors, count(*) AS total FROM {_BOOKS} b")
def outcome_counts(s: Spark, d: str) -> DataFrame:
    n = lambda c: F.count_if(c)
    return _books(s, d).agg(n(F.col("status") == "indexed").alias("indexed"), n(F.col("status") == "failed").alias("failed"), n(F.col("last_error").isNotNull()).alias("errors"), F.count("*").alias("total"))


@query("books_with_tags", f"SELECT b.id, coalesce(array_to_string(list_sort(list(DISTINCT trim(t)) FILTER (trim(t) <> '')), ','), '') AS tags FROM {_BOOKS} b LEFT JOIN unnest(b.tags) u(t) ON true GROUP BY b.id")
def books_with_tags(s: Spark, d: str) -> DataFrame:
    """Books joined with the table of their tags; a book without tags keeps an empty list."""
    b = _books(s, d)
    tags = C.tag_members(b).groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    return b.select("id").join(tags, "id", "left").select("id", F.coalesce("tags", F.lit("")).alias("tags"))


@query("catalog_upsert", f"SELECT id, status FROM {_BOOKS} b WHERE year < 1990 OR year IS NULL UNION ALL SELECT id, 'reset' FROM {_BOOKS} b WHERE year >= 1990")
def catalog_upsert(s: Spark, d: str) -> DataFrame:
    b = _books(s, d).select("id", "status", "year")
    return C.upsert(b.select("id", "status"), b.filter("year >= 1990").select("id", F.lit("reset").alias("status")))


@query("stale_books", "SELECT id FROM books WHERE status IN ('evaluating', 'crystallizing') AND updated_at < TIMESTAMP '2026-01-01 00:00:00' - INTERVAL 5 MINUTE")
def stale_books(s: Spark, d: str) -> DataFrame:
    return table(s, d, "books").filter(F.col("status").isin("evaluating", "crystallizing") & (F.col("updated_at") < F.expr("TIMESTAMP_NTZ '2026-01-01 00:00:00' - INTERVAL 5 MINUTE"))).select("id")


@query("recent_lines", "SELECT line_id, source FROM split_lines WHERE concept_id IS NOT NULL ORDER BY created_at DESC, line_id DESC LIMIT 50")
def recent_lines(s: Spark, d: str) -> DataFrame:
    return table(s, d, "split_lines").filter("concept_id IS NOT NULL").orderBy(F.desc("created_at"), F.desc("line_id")).limit(50).select("line_id", "source")


@query("exact_hash_dedup", "SELECT sha256(text) AS hash, min(doc_id) AS kept, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_hash_dedup(s: Spark, d: str) -> DataFrame:
    return X.exact_groups(table(s, d, "documents"), "doc_id", "text")


# --- chunk tree

_SEC = "PARTITION BY book_id, level, section_order"


@query("sibling_links", f"SELECT vec_rowid, lag(vec_rowid) OVER ({_SEC} ORDER BY part_n, vec_rowid) AS prev_rowid, lead(vec_rowid) OVER ({_SEC} ORDER BY part_n, vec_rowid) AS next_rowid FROM chunks")
def sibling_links(s: Spark, d: str) -> DataFrame:
    return K.sibling_links(table(s, d, "chunks"))


@query("part_of", f"SELECT vec_rowid, CAST(row_number() OVER ({_SEC} ORDER BY part_n, vec_rowid) AS INTEGER) AS n, count(*) OVER ({_SEC}) AS of FROM chunks")
def part_of(s: Spark, d: str) -> DataFrame:
    return K.part_numbers(table(s, d, "chunks"))


@query("tree_parents", "SELECT c.vec_rowid, c.level, c.parent_vec_rowid, p.parent_vec_rowid AS grand_vec_rowid, p.level AS parent_level FROM chunks c LEFT JOIN chunks p ON c.parent_vec_rowid = p.vec_rowid")
def tree_parents(s: Spark, d: str) -> DataFrame:
    from folioflow.operators.graph import walk_up

    return walk_up(table(s, d, "chunks")).select("vec_rowid", "level", "parent_vec_rowid", "grand_vec_rowid", "parent_level")


@query("chunk_counts", "SELECT book_id, level, count(*) AS n, sum(length(text)) AS chars FROM chunks GROUP BY ALL")
def chunk_counts(s: Spark, d: str) -> DataFrame:
    return table(s, d, "chunks").groupBy("book_id", "level").agg(F.count("*").alias("n"), F.sum(F.char_length("text").cast("bigint")).alias("chars"))


@query("nodal_chapters", "WITH w AS (SELECT book_id, section_order, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS words FROM chunks WHERE level = 1 GROUP BY ALL), k AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n, min(section_order) OVER (PARTITION BY book_id) AS a, max(section_order) OVER (PARTITION BY book_id) AS z FROM w) SELECT book_id, section_order, words FROM k WHERE n > 2 AND section_order <> a AND section_order <> z QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY words DESC, section_order) <= CASE WHEN n // 4 > 5 THEN 5 WHEN n // 4 < 3 THEN 3 ELSE n // 4 END")
def nodal_chapters(s: Spark, d: str) -> DataFrame:
    per = table(s, d, "chunks").filter("level = 1").groupBy("book_id", "section_order").agg(F.sum(T.word_count(F.col("text")).cast("bigint")).alias("words"))
    return K.nodal_chapters(per)


@query("ledger", "SELECT vec_rowid, coalesce(array_to_string(list(left(text, 80)) OVER (PARTITION BY book_id ORDER BY section_order, vec_rowid ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '|'), '') AS earlier FROM chunks WHERE level = 2 AND text IS NOT NULL")
def ledger(s: Spark, d: str) -> DataFrame:
    w = Window.partitionBy("book_id").orderBy("section_order", "vec_rowid").rowsBetween(-5, -1)
    return table(s, d, "chunks").filter("level = 2 AND text IS NOT NULL").select("vec_rowid", F.array_join(F.collect_list(F.substring("text", 1, 80)).over(w), "|").alias("earlier"))


@query("markdown_sections")
def markdown_sections(s: Spark, d: str) -> DataFrame:
    return K.sections(table(s, d, "documents"), "doc_id", "text").withColumn("path_titles", F.array_join("path_titles", " > ")).withColumn("paragraphs", F.size("paragraphs"))


@query("section_chunks")
def section_chunks(s: Spark, d: str) -> DataFrame:
    return K.section_chunks(K.units(K.sections(table(s, d, "documents"), "doc_id", "text"), "doc_id"), "doc_id").withColumn("path_titles", F.array_join("path_titles", " > "))


@query("char_chunks")
def char_chunks(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.posexplode(K.char_chunks_of(F.col("text"))).alias("i", "text"))
    return rows.withColumn("id", F.sha1(F.concat_ws("|", "doc_id", "i", F.substring("text", 1, 64))))


# --- text

@query("word_counts", "SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents")
def word_counts(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query("token_similarity", "SELECT id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / greatest(len(a), len(b)) END, 6) AS sim FROM (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(author), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS a, list_distinct(list_filter(regexp_split_to_array(lower(author_en), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS b FROM books WHERE author IS NOT NULL AND author_en IS NOT NULL) x")
def token_similarity(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "books").filter("author IS NOT NULL AND author_en IS NOT NULL")
    return b.select("id", F.round(T.token_similarity(T.token_set(F.col("author")), T.token_set(F.col("author_en"))), 6).alias("sim"))


@query("levenshtein_titles")
def levenshtein_titles(s: Spark, d: str) -> DataFrame:
    """Titles of every script by characters; DuckDB compares bytes, so there is no SQL."""
    b = table(s, d, "books").filter("title IS NOT NULL AND title_en IS NOT NULL")
    return b.select("id", F.round(T.levenshtein_ratio(F.col("title"), F.col("title_en")), 6).alias("ratio"))


@query("approx_tokens", "SELECT doc_id, CAST(ceil(a / 4.0 + c / 2.0 + k / 1.5 + (n - a - c - k) / 3.0) AS BIGINT) AS tokens FROM (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) AS a, length(regexp_replace(text, '[^\\x{400}-\\x{4ff}]', '', 'g')) AS c, length(regexp_replace(text, '[^\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]', '', 'g')) AS k FROM documents WHERE text IS NOT NULL) x")
def approx_tokens(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query("text_quality", "SELECT doc_id, round(CASE WHEN n < 200 OR letters / n < 0.5 OR len(w) < 50 OR NOT (list_sum(list_transform(w, lambda x: length(x))) / len(w) BETWEEN 2 AND 15) THEN 0 ELSE least(1, greatest(0.5, letters / n + CASE WHEN n >= 1000 THEN 0.1 ELSE 0 END + CASE WHEN len(w) >= 200 THEN 0.1 ELSE 0 END)) END, 6)::DOUBLE AS quality FROM (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '\\P{L}+', '', 'g')) AS letters, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: length(x) BETWEEN 2 AND 30) AS w FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) a) b")
def text_quality(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.round(T.text_quality(F.coalesce("text", F.lit(""))), 6).alias("quality"))


@query("script_language", "WITH h AS (SELECT doc_id, left(text, 2048) AS head, lower(left(text, 2048)) AS t FROM documents), c AS (SELECT doc_id, head, " + ", ".join(f"length(t) - length(regexp_replace(t, '[{p}]', '', 'g')) AS {n}" for n, p in (("uk", "іїєґ"), ("ru", "ёыъэ"), ("cyr", "\\x{400}-\\x{4ff}"), ("lat", "a-z"), ("de", "äöüß"), ("fr", "àâçéèêëîïôûùüÿœæ"), ("es", "áéíóúñ¿¡"))) + " FROM h) SELECT doc_id, CASE WHEN length(trim(head)) < 4 THEN 'unknown' WHEN cyr > 20 AND uk >= 2 THEN 'uk' WHEN uk = 0 AND ((cyr > 20 AND ru >= 2) OR cyr > 50) THEN 'ru' WHEN lat > 20 AND de >= 3 THEN 'de' WHEN lat > 20 AND fr >= 3 THEN 'fr' WHEN lat > 20 AND es >= 2 THEN 'es' WHEN lat > 50 AND lat >= 0.8 * (lat + cyr) THEN 'en' ELSE 'unknown' END AS language FROM c")
def script_language(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.script_language(F.col("text")).alias("language"))


@query("canonical_names", "SELECT author, trim(regexp_replace(regexp_replace(lower(replace(replace(author, chr(160), ' '), chr(8230), '...')), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s+', ' ', 'g')) AS canonical FROM (SELECT DISTINCT author FROM books WHERE author IS NOT NULL) x")
def canonical_names(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "books").filter("author IS NOT NULL").select("author").distinct()
    return b.select("author", T.canonical_name(T.normalized(F.col("author"))).alias("canonical"))


_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279))"
_WORDS = "глава|раздел|часть|введение|заключение|приложение|предисловие|послесловие|содержание|оглавление|chapter|section|part|introduction|conclusion|appendix|preface|foreword|bibliography|references|teil|chapitre|annexe"


@query("heading_lines", f"SELECT doc_id, line, t FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL) a, LATERAL (SELECT {_TRIM.format('t')} AS x) b WHERE x <> '' AND length(x) <= 120 AND (regexp_matches(x, '(?i)^({_WORDS})\\b') OR (length(x) < 100 AND regexp_matches(x, '^(?:§\\s*)?\\d+(?:\\.\\d+)*\\.?\\s+\\S') AND NOT regexp_matches(substr(x, 21), '[.!?]\\s+\\S')) OR (length(x) < 80 AND regexp_full_match(x, '[А-ЯЁA-Z0-9\\s.,:;«»\\-—()]+')) OR (length(x) < 100 AND NOT regexp_matches(x, '[.!?]\\s*$') AND len(regexp_split_to_array(x, '\\s+')) BETWEEN 2 AND 10 AND len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: regexp_matches(w, '^[\\p{{Lu}}0-9«\"(]'))) >= 0.6 * len(regexp_split_to_array(x, '\\s+'))))")
def heading_lines(s: Spark, d: str) -> DataFrame:
    lines = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.filter(T.heading(F.col("t"))).select("doc_id", "line", "t")


@query("clean_paragraphs", f"WITH p AS (SELECT vec_rowid, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position, {_TRIM.format('unnest(string_split(text, chr(10)))')} AS x FROM chunks WHERE level = 1 AND text IS NOT NULL), k AS (SELECT *, count(*) OVER (PARTITION BY vec_rowid, x) AS n FROM p WHERE x <> '') SELECT vec_rowid, position, rtrim(regexp_replace(x, '(?:^|\\s)(\\[\\d+\\]|†+|‡+|\\^?\\d+)\\s*$', '')) AS paragraph FROM k WHERE NOT (length(x) < 40 AND n >= 3) AND NOT regexp_matches(x, '(?i)^([-—–]\\s*\\d{{1,4}}\\s*[-—–]|\\[\\s*\\d{{1,4}}\\s*\\]|(page|p\\.|стр\\.?|страница)\\s*\\d{{1,4}}|\\d{{1,4}}|—{{2,}}\\s*\\d+\\s*—{{2,}})\\s*$') AND NOT regexp_matches(x, '(?i)^(isbn[\\s\\-:]?\\s*\\d|©\\s*\\d{{4}}|copyright\\s*©?\\s*\\d{{4}}|all\\s+rights\\s+reserved|все\\s+права\\s+защищены|printed\\s+in\\s+|напечатано\\s+в\\s+|library\\s+of\\s+congress)') AND NOT regexp_matches(x, '(?i)^(\\s*[*•·⋅★☆◆◇■□▪▫◦‣⁃]\\s*[*•·⋅★☆◆◇■□▪▫◦‣⁃]\\s*[*•·⋅★☆◆◇■□▪▫◦‣⁃]\\s*|[-—–_=]{{3,}}\\s*|(end of chapter|конец главы|конец|the end|fin)\\s*\\.?\\s*)$') AND regexp_matches(regexp_replace(x, '(?:^|\\s)(\\[\\d+\\]|†+|‡+|\\^?\\d+)\\s*$', ''), '\\p{{L}}')")
def clean_paragraphs(s: Spark, d: str) -> DataFrame:
    return T.clean_paragraphs(table(s, d, "chunks").filter("level = 1"), "vec_rowid", F.split("text", "\n"))


@query("compressed_chapters", "SELECT doc_id, CASE WHEN length(text) <= 8000 THEN text ELSE left(text, 6000) || chr(10) || '…' || chr(10) || right(text, 2000) END AS text FROM documents WHERE text IS NOT NULL")
def compressed_chapters(s: Spark, d: str) -> DataFrame:
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.compressed_chapter(F.col("text")).alias("text"))


@query("content_ids", "SELECT doc_id, sha256(coalesce(text, '')) AS sha, substr(md5(coalesce(text, '')), 1, 8) AS short FROM documents")
def content_ids(s: Spark, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(s, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), F.substring(F.md5(t), 1, 8).alias("short"))


@query("best_titles", f"SELECT id, CASE WHEN a IS NOT NULL AND NOT regexp_matches(lower(a), '^(предисловие|введение|оглавление|содержание|contents|preface|introduction|foreword)$') THEN a WHEN b IS NOT NULL AND NOT regexp_matches(lower(b), '^(предисловие|введение|оглавление|содержание|contents|preface|introduction|foreword)$') THEN b ELSE coalesce(a, b, c) END AS title FROM (SELECT id, nullif(trim(title_en), '') AS a, nullif(trim(title_ru), '') AS b, nullif(trim(title), '') AS c FROM {_BOOKS} x) y")
def best_titles(s: Spark, d: str) -> DataFrame:
    return _books(s, d).select("id", best_title(F.col("title_en"), F.col("title_ru"), F.col("title")).alias("title"))


# --- exports

@query("chatml_render", "SELECT line_id, array_to_string(list_transform(messages, lambda m: '<|im_start|>' || m.role || chr(10) || coalesce(m.content, '') || '<|im_end|>'), chr(10)) AS text FROM chatml_lines")
def chatml_render(s: Spark, d: str) -> DataFrame:
    return table(s, d, "chatml_lines").select("line_id", E.chatml(F.col("messages")).alias("text"))


@query("sharegpt_roles", "SELECT line_id, array_to_string(list_transform(messages, lambda m: CASE m.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' WHEN 'system' THEN 'system' ELSE 'human' END), ',') AS roles FROM chatml_lines")
def sharegpt_roles(s: Spark, d: str) -> DataFrame:
    return E.to_sharegpt(table(s, d, "chatml_lines")).select("line_id", F.array_join(F.transform("conversations", lambda m: m["from"]), ",").alias("roles"))


@query("line_meta", "SELECT line_id, json_extract_string(meta, '$.conceptId') AS concept_id, json_extract_string(meta, '$.tier') AS tier FROM chatml_lines")
def line_meta(s: Spark, d: str) -> DataFrame:
    return table(s, d, "chatml_lines").select("line_id", F.get_json_object("meta", "$.conceptId").alias("concept_id"), F.get_json_object("meta", "$.tier").alias("tier"))


@query("hash_split", "SELECT line_id, CASE WHEN CAST('0x' || left(sha256('42#' || line_id), 8) AS BIGINT) % 1000000 < 900000 THEN 'train' ELSE 'val' END AS split FROM chatml_lines")
def hash_split(s: Spark, d: str) -> DataFrame:
    return table(s, d, "chatml_lines").select("line_id", E.hash_split(F.col("line_id"), 42, 0.9).alias("split"))


_M = "4294967296::HUGEINT"
_XMUR = f"list_reduce(list_prepend((xor(1779033703, length(k)))::HUGEINT, list_transform(string_split(k, ''), lambda ch: ord(ch)::HUGEINT)), lambda h, c: ((((xor(h, c) * 3432918353) % {_M}) * 8192) % {_M}) + (((xor(h, c) * 3432918353) % {_M}) // 524288))"
_STEP = f"((xor(h, h // {{}}) * {{}}) % {_M})"


@query("split_assign", f"SELECT id, i, CASE WHEN xor(h, h // 65536)::DOUBLE / 4294967296 < 0.9 THEN 'train' ELSE 'val' END AS split FROM (SELECT id, i, {_STEP.format(8192, 3266489909)} AS h FROM (SELECT id, i, {_STEP.format(65536, 2246822507)} AS h FROM (SELECT id, i, {_XMUR} AS h FROM (SELECT concept_id AS id, i, '42|' || concept_id || '|' || i AS k FROM synth_raw_samples, range(3) r(i) WHERE concept_id IS NOT NULL) a) b) c) e")
def split_assign(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "synth_raw_samples").filter("concept_id IS NOT NULL").select(F.col("concept_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)).cast("array<bigint>")).alias("i"))
    return rows.select("id", "i", E.split_bucket(F.col("id"), F.col("i"), 42, 0.9).alias("split"))


@query("tier_turns", "SELECT source, tier, count(*) AS lines, sum(len(messages)) AS turns FROM split_lines GROUP BY ALL")
def tier_turns(s: Spark, d: str) -> DataFrame:
    return table(s, d, "split_lines").groupBy("source", "tier").agg(F.count("*").alias("lines"), F.sum(F.size("messages").cast("bigint")).alias("turns"))


@query("greedy_tier_dedup")
def greedy_tier_dedup(s: Spark, d: str) -> DataFrame:
    said = F.array_join(F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.coalesce(m["content"], F.lit(""))), " ")
    lines = table(s, d, "split_lines").select("line_id", F.concat_ws("/", "split", "tier").alias("tier"), said.alias("text"))
    return X.greedy_tiers(lines).select("line_id")


_ATOM = "(SELECT vec_rowid, CASE WHEN len(path_titles) > 1 THEN 'science' END AS domain, array_to_string(path_titles, ' > ') AS context, text AS essence, path_titles[-1] AS cipher, right(text, 900) AS proof, CASE WHEN section_order = 1 THEN 'causality' ELSE 'revision' END AS flag, path_titles AS tags, path_titles[1] AS subject, replace(lower(left(text, 6)), ' ', '_') AS predicate FROM chunks WHERE level = 2)"


@query("atom_validation", f"SELECT vec_rowid, concat_ws(',', CASE WHEN coalesce(length(domain), 0) NOT BETWEEN 2 AND 60 THEN 'domain' END, CASE WHEN coalesce(length(context), 0) NOT BETWEEN 10 AND 300 THEN 'chapter_context' END, CASE WHEN coalesce(length(essence), 0) NOT BETWEEN 30 AND 800 THEN 'essence' END, CASE WHEN coalesce(length(cipher), 0) NOT BETWEEN 5 AND 500 THEN 'cipher' END, CASE WHEN coalesce(length(proof), 0) NOT BETWEEN 10 AND 800 THEN 'proof' END, CASE WHEN flag = 'causality' THEN 'flags' END, CASE WHEN coalesce(len(tags), 0) NOT BETWEEN 1 AND 10 OR len(list_filter(tags, lambda t: length(t) > 40 OR t = '')) > 0 THEN 'tags' END, CASE WHEN coalesce(length(subject), 0) NOT BETWEEN 2 AND 120 OR coalesce(length(predicate), 0) NOT BETWEEN 3 AND 60 OR coalesce(length(cipher), 0) NOT BETWEEN 2 AND 120 THEN 'relations' END, CASE WHEN regexp_full_match(trim(predicate), '(?i)(is|was|are|were|has|have|had|be|been|will|would|do|does|did)(_(a|an|the))?') THEN 'predicate' END) AS issues FROM {_ATOM} a")
def atom_validation(s: Spark, d: str) -> DataFrame:
    """Atoms made of chapter summaries: the breadcrumb gives the context, tags and one relation, whose predicate is how the text begins."""
    c = table(s, d, "chunks").filter("level = 2")
    path = F.col("path_titles")
    relation = F.array(F.struct(F.get(path, F.lit(0)).alias("subject"), F.replace(F.lower(F.substring("text", 1, 6)), F.lit(" "), F.lit("_")).alias("predicate"), F.element_at(path, -1).alias("object")))
    flags = F.array(F.lit("causality"), F.when(F.col("section_order") == 1, "causality").otherwise("revision"))
    atom = F.struct(F.when(F.size(path) > 1, "science").alias("domain"), F.array_join(path, " > ").alias("chapter_context"), F.col("text").alias("essence"), F.element_at(path, -1).alias("cipher"), F.right("text", F.lit(900)).alias("proof"), F.lit(None).cast("string").alias("applicability"), flags.alias("flags"), path.alias("tags"), relation.alias("relations"))
    return c.select("vec_rowid", F.array_join(E.atom_issues(atom), ",").alias("issues"))


@query("evaluation_validation", f"SELECT id, concat_ws(',', CASE WHEN coalesce(title_ru, '') = '' THEN 'title_ru' END, CASE WHEN coalesce(author_ru, '') = '' THEN 'author_ru' END, CASE WHEN coalesce(title_en, '') = '' THEN 'title_en' END, CASE WHEN coalesce(author_en, '') = '' THEN 'author_en' END, CASE WHEN coalesce(domain, '') = '' THEN 'domain' END, CASE WHEN year NOT BETWEEN 1400 AND 2100 THEN 'year' END, CASE WHEN coalesce(len(tags), 0) NOT BETWEEN 8 AND 12 THEN 'tags' END, CASE WHEN is_fiction_or_water IS NULL THEN 'is_fiction_or_water' END, CASE WHEN coalesce(conceptual_density, -1) NOT BETWEEN 0 AND 100 THEN 'conceptual_density' END, CASE WHEN coalesce(originality, -1) NOT BETWEEN 0 AND 100 THEN 'originality' END, CASE WHEN coalesce(quality_score, -1) NOT BETWEEN 0 AND 100 THEN 'quality_score' END) AS issues FROM {_BOOKS} b")
def evaluation_validation(s: Spark, d: str) -> DataFrame:
    b = _books(s, d)
    return b.select("id", F.array_join(E.evaluation_issues(b), ",").alias("issues"))


@query("section_filter", "SELECT vec_rowid, title, no_content FROM (SELECT vec_rowid, title, coalesce(regexp_full_match(n, '(?i)(contents|table\\s+of\\s+contents|toc|index|foreword|preface|bibliography|references|copyright|credits|содержание|оглавление|указатель|предисловие|литература|библиография|благодарности)') OR (length(n) < 80 AND regexp_matches(n, '(?i)^(contents|table\\s+of\\s+contents|содержание|оглавление)\\b')), false) AS no_content FROM (SELECT vec_rowid, title, trim(regexp_replace(regexp_replace(title, '[#*_`~]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM (SELECT vec_rowid, CASE WHEN part_of > 2 THEN '**Contents** ' || path_titles[1] ELSE path_titles[-1] END AS title FROM chunks WHERE level = 1) a) b) c WHERE no_content OR title IS NOT NULL")
def section_filter(s: Spark, d: str) -> DataFrame:
    """Titles of sections; those of many parts stand for contents lists that were taken for a title."""
    path = F.col("path_titles")
    title = F.when(F.col("part_of") > 2, F.concat(F.lit("**Contents** "), F.get(path, F.lit(0)))).otherwise(F.element_at(path, -1))
    t = table(s, d, "chunks").filter("level = 1").select("vec_rowid", title.alias("title"))
    return t.withColumn("no_content", E.no_content(F.col("title"))).filter("no_content OR title IS NOT NULL")


@query("domain_filter", f"SELECT id, domain FROM {_BOOKS} b WHERE domain IN ('ui', 'web', 'mobile', 'ux', 'perf', 'arch', 'copy', 'seo', 'research', 'data', 'security', 'devops', 'ai', 'business', 'science', 'psychology', 'philosophy', 'engineering', 'medicine', 'economics', 'other')")
def domain_filter(s: Spark, d: str) -> DataFrame:
    return _books(s, d).filter(F.col("domain").isin(*E.DOMAINS)).select("id", "domain")


@query("meta_noise", f"SELECT id FROM {_BOOKS} b WHERE regexp_matches(lower(concat_ws(' ', domain, title, title_en, publisher, array_to_string(tags, ' '), last_error)), '\\b(table of contents|bibliographic|book endorsement|endorsements|marketing material|promotional|publisher blurb|credits|copyright|about the author|about the reviewer|structural metadata|оглавление|содержание|краткое содержание|библиограф|рекламн|аннотац|об авторах|об авторе)\\b') OR title_en IS NULL")
def meta_noise(s: Spark, d: str) -> DataFrame:
    """Books whose fields speak of the book as such, beside those without an English title."""
    fields = [F.col(c) for c in ("domain", "title", "title_en", "publisher")] + [F.array_join("tags", " "), F.col("last_error")]
    return _books(s, d).filter(E.about_the_book(*fields) | F.col("title_en").isNull()).select("id")


@query("template_dialogues", f"SELECT b.id AS concept_id, q.depth, 'Ты эксперт в области: ' || coalesce(domain, '') || '. Отвечай по существу, без украшений.' AS system, q.question, trim(concat_ws(chr(10) || chr(10), nullif(title, ''), CASE WHEN q.depth > 1 THEN coalesce('Обоснование: ' || nullif(title_ru, ''), 'Формула: ' || nullif(title_en, '')) END, CASE WHEN q.depth > 2 THEN 'Применение: ' || nullif(publisher, '') END)) AS answer FROM {_BOOKS} b, (VALUES (1, 'Сформулируй ключевой принцип одним-двумя предложениями.'), (2, 'В чём суть? Дай конкретно, без воды.'), (3, 'Объясни главную идею профессионалу в этой области.'), (4, 'Назови основной принцип и кратко его обоснуй.'), (5, 'Дай рабочую формулировку, которую можно применять.')) q(depth, question) WHERE trim(concat_ws('', title, CASE WHEN q.depth > 1 THEN concat_ws('', title_ru, title_en) END, CASE WHEN q.depth > 2 THEN publisher END)) <> ''")
def template_dialogues(s: Spark, d: str) -> DataFrame:
    c = _books(s, d).select("id", "domain", F.col("title").alias("essence"), F.col("title_ru").alias("proof"), F.col("title_en").alias("cipher"), F.col("publisher").alias("applicability"))
    return E.template_dialogues(c, 5)


@query("book_markdown")
def book_markdown(s: Spark, d: str) -> DataFrame:
    """Front matter and title of every book with its chapter summaries; a book's rows are its chapters, not its text."""
    body = table(s, d, "chunks").filter("level = 2").groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_order", "vec_rowid", "text"))), lambda x: x["text"]), "\n\n").alias("body"))
    j = _books(s, d).join(body, F.col("id") == F.col("book_id"))
    return j.select("id", E.markdown_of(F.coalesce("title", F.lit("Untitled")), F.col("author"), F.col("year"), F.col("body")).alias("markdown"))