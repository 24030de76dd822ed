"""Queries over whole books as paragraphs, and over files before they are parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions.repair import mixed_scripts, repaired_lines
from folioflow.operators import chunking as K
from folioflow.operators import ingest as I
from folioflow.operators import seams as M
from folioflow.operators import stored as S
from folioflow.operators import surrogates as U
from folioflow.plans.registry import query
from folioflow.session import table

Spark = SparkSession


def _paragraphs(s: Spark, d: str) -> DataFrame:
    """Section chunks as the paragraphs of their books, in order."""
    c = table(s, d, "chunks").filter("level = 1")
    return c.select("book_id", "section_order", F.element_at("path_titles", -1).alias("title"), F.col("vec_rowid").alias("position"), F.coalesce("text", F.lit("")).alias("text"))


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')"
_CHAPTERS = f"(SELECT book_id, section_order, min(path_titles[-1]) AS title, sum(len({_WORDS})) AS words FROM chunks WHERE level = 1 GROUP BY ALL)"


@query("toc_lines", f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_order) AS n, count(*) OVER (PARTITION BY book_id) AS k FROM {_CHAPTERS} a) SELECT book_id, n::DOUBLE AS place, n || '. ' || coalesce(nullif(trim(title), ''), 'Chapter ' || n) || ' (' || format('{{:,}}', words::BIGINT) || ' words)' AS line FROM c WHERE k <= 8 OR n <= 6 OR n > k - 2 UNION ALL SELECT DISTINCT book_id, 6.5, '... (' || format('{{:,}}', k - 8) || ' chapters omitted from oversized TOC)' FROM c WHERE k > 8")
def toc_lines(s: Spark, d: str) -> DataFrame:
    """Contents with a bound of eight chapters, so that longer ones are cut."""
    chapters = _paragraphs(s, d).groupBy("book_id", "section_order").agg(F.min("title").alias("title"), F.sum(T.word_count(F.col("text")).cast("bigint")).alias("words"))
    return U.contents(chapters, "book_id", 8)


def _opening(order: str, kept: str) -> str:
    return f"WITH p AS (SELECT book_id, vec_rowid AS position, text, {_WORDS} AS w FROM chunks WHERE level = 1 AND trim(coalesce(text, '')) <> ''), b AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY book_id ORDER BY position {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT book_id, position, md5(CASE WHEN len(w) <= 1000 - before THEN text ELSE array_to_string({kept}, ' ') || ' […]' END) AS hash FROM b WHERE before < 1000"


@query("book_openings", _opening("ASC", "w[1:(1000 - before)::BIGINT]"))
def book_openings(s: Spark, d: str) -> DataFrame:
    return U.openings(_paragraphs(s, d), "book_id").select("book_id", "position", F.md5("text").alias("hash"))


@query("book_endings", _opening("DESC", "w[(len(w) - (1000 - before) + 1)::BIGINT:]"))
def book_endings(s: Spark, d: str) -> DataFrame:
    return U.openings(_paragraphs(s, d), "book_id", from_end=True).select("book_id", "position", F.md5("text").alias("hash"))


@query("book_surrogates")
def book_surrogates(s: Spark, d: str) -> DataFrame:
    return U.surrogates(_paragraphs(s, d), "book_id")


@query("token_budget")
def token_budget(s: Spark, d: str) -> DataFrame:
    t = table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.token_budget(F.col("text"), 200).alias("b"))
    return t.select("doc_id", "b.tokens", "b.trimmed", F.md5("b.text").alias("hash"))


@query("drift_boundaries")
def drift_boundaries(s: Spark, d: str) -> DataFrame:
    rows = table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("position", "paragraph"))
    return M.drift_boundaries(rows, "doc_id", M.HashedEmbedder())


@query("semantic_chunks")
def semantic_chunks(s: Spark, d: str) -> DataFrame:
    chapters = table(s, d, "documents").select("doc_id", F.lit(1).alias("section_order"), F.col("source").alias("title"), F.split("text", r"\n\s*\n").alias("paragraphs"))
    return M.semantic_chunks(chapters, "doc_id", M.HashedEmbedder(), safe=400, least=80, hard=600).select("doc_id", "part_n", "part_of", F.md5("text").alias("hash"), "overlap")


@query("chapter_summaries")
def chapter_summaries(s: Spark, d: str) -> DataFrame:
    """Summaries by the stand-in provider, over at most twelve propositions a section in order of their rows."""
    from pyspark.sql import Window

    c = table(s, d, "chunks").filter("level = 0 AND text IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("book_id", "section_order").orderBy("vec_rowid"))
    kept = c.withColumn("n", first).filter("n <= 12")  # the feature: twelve essences a summary
    units = kept.groupBy("book_id", "section_order").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("essences"), F.min_by("path_titles", "n").alias("path_titles"))
    return M.summaries(units, M.echo_provider).select("book_id", "section_order", "summary")


@query("concept_texts", "SELECT id, 'domain: ' || coalesce(domain, '') || chr(10) || 'essence: ' || coalesce(title, '') || chr(10) || 'cipher: ' || coalesce(title_en, '') || chr(10) || 'tags: ' || coalesce(array_to_string(tags, ', '), '') || chr(10) || 'proof: ' || coalesce(title_ru, '') AS text FROM books")
def concept_texts(s: Spark, d: str) -> DataFrame:
    b = table(s, d, "books").select("id", "domain", F.col("title").alias("essence"), F.col("title_en").alias("cipher"), "tags", F.col("title_ru").alias("proof"))
    return b.select("id", M.concept_text(b).alias("text"))


_FILES = "(SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 'images/' WHEN n_chars % 7 = 1 THEN 'src/' ELSE '' END || coalesce(source, 'x') || '/' || CASE WHEN n_chars % 5 = 0 THEN 'chapter ' WHEN n_chars % 5 = 1 THEN 'solution ' ELSE coalesce(source, 'x') || ' ' END || doc_id || ['.txt', '.html', '.pdf', '.epub'][n_chars % 4 + 1] AS path, n_chars * 20 AS size FROM documents)"


def _files(s: Spark, d: str) -> DataFrame:
    n = F.col("n_chars")
    source = F.coalesce("source", F.lit("x"))
    folder = F.when(n % 7 == 0, "images/").when(n % 7 == 1, "src/").otherwise("")
    name = F.when(n % 5 == 0, "chapter ").when(n % 5 == 1, "solution ").otherwise(F.concat(source, F.lit(" ")))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".txt", ".html", ".pdf", ".epub")]), (n % 4 + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", F.concat(folder, source, F.lit("/"), name, F.col("doc_id").cast("string"), ext).alias("path"), (n * 20).alias("size"))


@query("file_candidates", f"SELECT doc_id, NOT starts_with(path, 'images/') AND NOT starts_with(path, 'src/') AND CASE WHEN ends_with(path, '.txt') THEN size >= 10240 AND NOT contains(path, '/solution ') WHEN ends_with(path, '.html') THEN size >= 65536 AND NOT contains(path, '/chapter ') AND len(list_intersect(w, p)) >= 0.45 * greatest(len(w), len(p)) AND len(w) > 0 AND len(p) > 0 WHEN ends_with(path, '.pdf') THEN NOT contains(path, '/solution ') ELSE true END AS candidate FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(regexp_replace(string_split(path, '/')[-1], '[.][^.]*$', ''), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS w, list_distinct(list_filter(regexp_split_to_array(string_split(path, '/')[-2], '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS p FROM {_FILES} f) x")
def file_candidates(s: Spark, d: str) -> DataFrame:
    return I.candidates(_files(s, d)).select("doc_id", "candidate")


_RANK = "coalesce(MAP {'epub': 100, 'pdf': 80, 'djvu': 70, 'fb2': 60, 'docx': 50, 'doc': 40, 'azw3': 36, 'mobi': 35, 'rtf': 30, 'odt': 25, 'pdb': 20, 'prc': 20, 'chm': 15, 'cbz': 12, 'txt': 10, 'html': 5}[original_format], -1)"


@query("main_books", f"SELECT user_id AS folder, id || '.' || original_format AS path FROM books WHERE {_RANK} >= 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_RANK} DESC, coalesce(word_count, 0) DESC, id || '.' || original_format) = 1")
def main_books(s: Spark, d: str) -> DataFrame:
    f = table(s, d, "books").select(F.col("user_id").alias("folder"), F.concat_ws(".", "id", "original_format").alias("path"), F.coalesce("word_count", F.lit(0)).alias("size"))
    return I.main_books(f)


@query("bundle_kinds", f"SELECT CASE WHEN original_format IN ('tiff', 'tif') THEN 'image' WHEN original_format IN ('html', 'htm') THEN 'html-site' WHEN {_RANK} >= 0 THEN 'book' ELSE 'unknown' END AS kind, count(*) AS n FROM books GROUP BY 1")
def bundle_kinds(s: Spark, d: str) -> DataFrame:
    return table(s, d, "books").select(I.kind_of(F.concat_ws(".", "id", "original_format")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("bundle_markdown")
def bundle_markdown(s: Spark, d: str) -> DataFrame:
    """A bundle per book: its file and one sidecar for each of its tags."""
    b = table(s, d, "books").select(F.col("id").alias("folder"), "original_format", "word_count", "tags")
    own = b.select("folder", F.concat_ws(".", "folder", "original_format").alias("path"), F.coalesce("word_count", F.lit(0)).alias("size"))
    side = b.select("folder", F.explode("tags").alias("tag")).select("folder", F.concat("tag", F.lit(".png")).alias("path"), F.lit(1).cast("bigint").alias("size"))
    return I.bundle_markdown(own.union(side).distinct())


@query("natural_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_size, p_partkey) AS place FROM part")
def natural_order(s: Spark, d: str) -> DataFrame:
    """Names with their sizes, sorted by the natural key: a range shuffle sorts them, and places follow from the sizes of the ranges."""
    p = table(s, d, "part").select("p_partkey", I.natural_key(F.concat_ws(" ", "p_name", "p_size", "p_partkey")).alias("k"))
    ranged = p.repartitionByRange("k").withColumn("range", F.spark_partition_id())
    from pyspark.sql import Window

    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a range
    place = F.row_number().over(Window.partitionBy("range").orderBy("k", "p_partkey"))
    return ranged.withColumn("at", place).join(F.broadcast(before), "range").select("p_partkey", (F.col("at") + F.col("before")).alias("place"))


@query("path_segments", "SELECT id, CASE WHEN length(s) > 50 THEN regexp_replace(left(s, 50), '_+$', '') ELSE s END AS segment FROM (SELECT id, CASE WHEN t = '' THEN '_unnamed' ELSE regexp_replace(t, '\\s+', '_', 'g') END AS s FROM (SELECT id, trim(regexp_replace(regexp_replace(trim(replace(regexp_replace(nfc_normalize(title), '[<>:\"/\\\\|?*\\x00-\\x1f\\x7f]', '', 'g'), '..', '.')), '^\\.+', ''), '\\.+$', '')) AS t FROM books WHERE title IS NOT NULL) a) b")
def path_segments(s: Spark, d: str) -> DataFrame:
    return table(s, d, "books").filter("title IS NOT NULL").select("id", I.path_segment(F.col("title")).alias("segment"))


@query("script_mixing", "WITH w AS (SELECT vec_rowid, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: length(x) >= 3) AS w FROM chunks WHERE text IS NOT NULL), c AS (SELECT vec_rowid, length(regexp_replace(text, '[^\\x{400}-\\x{4ff}]', '', 'g')) AS cyr, length(regexp_replace(text, '[^A-HJ-Za-hj-z]', '', 'g')) AS lat, len(w) AS n, list_transform(w, lambda x: {'c': length(regexp_replace(x, '[^\\x{400}-\\x{4ff}]', '', 'g')), 'a': length(regexp_replace(x, '[^pcoaexyPCOAEXBHMTK]', '', 'g')), 'l': length(regexp_replace(x, '[^A-HJ-Za-hj-z]', '', 'g')), 'd': regexp_matches(x, '[\\x{400}-\\x{4ff}][0-9]+[a-zA-Z\\x{400}-\\x{4ff}]|[a-zA-Z\\x{400}-\\x{4ff}][0-9]+[\\x{400}-\\x{4ff}]')}) AS t FROM w), k AS (SELECT *, len(list_filter(t, lambda x: x.c >= 3 AND x.a >= 1)) AS lookalikes, len(list_filter(t, lambda x: x.d)) AS digits, len(list_filter(t, lambda x: NOT (x.c >= 3 AND x.a >= 1) AND x.c >= 2 AND x.l >= 1)) AS mixed FROM c) SELECT vec_rowid, lookalikes, digits, mixed, lookalikes + 2 * digits + mixed >= CASE WHEN n < 50 THEN 3 ELSE 5 END OR (n > 0 AND lookalikes + 2 * digits + mixed > 0.03 * n) OR (cyr > 50 AND lat / greatest(1, cyr + lat) > 0.05 AND lat / greatest(1, cyr + lat) < 0.4) AS confused FROM k")
def script_mixing(s: Spark, d: str) -> DataFrame:
    got = table(s, d, "chunks").filter("text IS NOT NULL").select("vec_rowid", mixed_scripts(F.col("text")).alias("m"))
    return got.select("vec_rowid", "m.lookalikes", "m.digits", "m.mixed", "m.confused")


@query("line_repairs")
def line_repairs(s: Spark, d: str) -> DataFrame:
    got = table(s, d, "chunks").select("vec_rowid", repaired_lines(F.col("text")).alias("r"))
    return got.select("vec_rowid", "r.double_utf8", "r.koi8", "r.latin1", "r.problem", F.md5("r.text").alias("hash"))


@query("folded_chapters")
def folded_chapters(s: Spark, d: str) -> DataFrame:
    chapters = S.folded_chapters(K.sections(table(s, d, "documents"), "doc_id", "text"), "doc_id")
    return chapters.select("doc_id", "chapter_no", "title", F.size("paragraphs").alias("paragraphs"))


@query("stored_chapters", "SELECT id, 1 AS chapter_no, trim(title) AS title, CAST(len(list_filter(regexp_split_to_array(coalesce(title_en, ''), '\\s+'), lambda x: x <> '')) AS INT) AS words FROM books WHERE title IS NOT NULL UNION ALL SELECT id, 2, 'End', 1 FROM books WHERE title IS NOT NULL")
def stored_chapters(s: Spark, d: str) -> DataFrame:
    """Stored markdown of two chapters a book, made of its titles."""
    lines = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), "id"), F.lit("---"), F.lit("# Book"), F.concat(F.lit("## "), "title"), F.lit(""), F.coalesce("title_en", F.lit("")), F.lit(""), F.lit("![Cover][img-1]"), F.lit(""), F.lit("## End"), F.lit(""), F.lit("over"))
    return S.stored_chapters(table(s, d, "books").filter("title IS NOT NULL").select("id", lines.alias("markdown")), "id").select("id", "chapter_no", "title", "words")


@query("canonical_rows", "SELECT id, domain, year::VARCHAR AS year, '|' || array_to_string(tags, '|') || '|' AS tags, NULL AS missing, publisher FROM books")
def canonical_rows(s: Spark, d: str) -> DataFrame:
    points = table(s, d, "books").select("id", F.array(F.lit(1.0)).alias("vector"), "domain", "year", "tags", "publisher", "isbn")
    rows = S.unpacked(S.canonical_rows(points, ["domain", "year", "tags", "missing"]), ["publisher"])
    return rows.select("id", "domain", "year", "tags", "missing", "publisher")


@query("cut_metadata", "SELECT doc_id, length(CASE WHEN length(text) > 500 THEN left(text, 499) || '…' ELSE text END) AS kept FROM documents WHERE text IS NOT NULL AND source IS NOT NULL")
def cut_metadata(s: Spark, d: str) -> DataFrame:
    docs = table(s, d, "documents").filter("text IS NOT NULL AND source IS NOT NULL")
    cut = S.cut_metadata(F.create_map(F.lit("source"), F.col("source"), F.lit("text"), F.col("text")))
    return docs.select("doc_id", F.char_length(F.get_json_object(cut, "$.text")).alias("kept"))


@query("vector_upsert", "SELECT vec_id, label FROM embeddings WHERE label <> 1 UNION ALL SELECT vec_id, 100 FROM embeddings WHERE label = 1")
def vector_upsert(s: Spark, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"))
    return S.upserted(e, e.filter("label = 1").select("vec_id", F.lit(100).alias("label")), "vec_id")


@query("book_isbns", "SELECT id, isbn13 FROM (SELECT id, regexp_replace(isbn, '[- ]', '', 'g') AS isbn13 FROM books WHERE isbn IS NOT NULL) x WHERE length(isbn13) = 13 AND (10 - list_sum(list_transform(range(1, 13), lambda i: substr(isbn13, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 = substr(isbn13, 13, 1)::INT")
def book_isbns(s: Spark, d: str) -> DataFrame:
    """Numbers found in what a book's first and last paragraphs would say; check digits must hold."""
    b = table(s, d, "books").filter("isbn IS NOT NULL")
    text = T.head_and_tail(F.array(F.lit("Printed 2001."), F.concat(F.lit("ISBN "), "isbn", F.lit(". All rights."))))
    return b.select("id", F.explode(T.isbns(text)).alias("isbn13"))
