"""Queries pN_ over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import encoding, language, mixing, names, overlap, packing, pairs, quality, scans, splitting, tokens
from folioflow.session import bounded_collect, cut, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("p3_pieces")
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.renumbered_pieces(table(spark, d, "chunks"), table(spark, d, "piece_limits"))


@query(
    "p3_found",
    "SELECT vec_rowid FROM chunks JOIN piece_limits USING (level) WHERE length(text) > max_chars",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized_ids(table(spark, d, "chunks"), table(spark, d, "piece_limits"))


def _p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("record_kind"), F.col("vec_rowid").cast("string").alias("record_id"), "text", F.lit(None).cast("string").alias("encoding"))
    books = table(spark, d, "books").select(F.lit("book"), "id", "title", F.lit(None).cast("string"))
    mobi = table(spark, d, "mobi_metadata").select(F.lit("mobi"), "book_id", "title", "encoding")
    records = chunks.union(books).union(mobi)
    return encoding.repair(records, encoding.fit_cost(records), "text", "encoding")


@query("p4_repaired")
def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _p4_repaired(spark, d).select("record_kind", "record_id", "restored", "steps", "lost")


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(_p4_repaired(spark, d)).select("record_kind", "record_id").distinct()


def _p5_detected(spark: SparkSession, d: str, segments: bool) -> DataFrame:
    model = language.fit(table(spark, d, "documents"))
    chunks = table(spark, d, "chunks").select("vec_rowid", "book_id", "level", "text")
    return language.detect(chunks, model, segments=segments)


@query("p5_segments")
def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    found = _p5_detected(spark, d, True).select("vec_rowid", F.posexplode("detected.segments").alias("segment_no", "s"))
    return found.select("vec_rowid", "segment_no", "s.*")


@query("p5_books")
def p5_books(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "mobi_metadata").select("book_id", "language").distinct()
    votes = language.book_languages(_p5_detected(spark, d, False).select("book_id", "level", "detected"))
    return labels.join(votes, "book_id", "left").withColumn("label_lang", language.label_code(F.col("language")))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # one pass over the texts serves both kinds of record: its small columns are written once
    small = cut(_p5_detected(spark, d, False).select("vec_rowid", "book_id", "level", F.struct("detected.lang", "detected.confidence", "detected.langs").alias("detected")))
    mixed = small.filter(F.size("detected.langs") > 1)
    mixed = mixed.select(F.lit("chunk").alias("record_kind"), F.col("vec_rowid").cast("string").alias("record_id"), F.explode("detected.langs").alias("lang"))
    labels = table(spark, d, "mobi_metadata").select("book_id", language.label_code(F.col("language")).alias("label")).distinct()
    wrong = language.book_languages(small).join(labels, "book_id").filter(~F.col("lang").eqNullSafe(F.col("label")))
    return mixed.union(wrong.select(F.lit("book"), "book_id", "lang")).distinct()


def _p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text")
    common = quality.common_words(table(spark, d, "common_words"))
    rules = quality.fit_rules(documents, common)
    return quality.classify(quality.statistics(documents, common), rules).drop("text")


@query("p10_statistics")
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _p10_kinds(spark, d)


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    # written first: the filter must not be pushed below the statistics, which would then be computed in its every term
    kinds = cut(_p10_kinds(spark, d).select("doc_id", "kind"))
    return kinds.filter("kind <> 'prose'").distinct()


def _p7_defects(spark: SparkSession, d: str) -> DataFrame:
    chats = pairs.pairs_of_chats(table(spark, d, "chatml_lines"))
    raws = pairs.pairs_of_raw(table(spark, d, "synth_raw_samples"))
    # parsed once: the end model reads all answers before the pairs are judged
    both = cut(chats.unionByName(raws))
    return pairs.defects(both, language.fit(table(spark, d, "documents")), pairs.fit_ends(both))


@query("p7_pairs")
def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _p7_defects(spark, d)


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7_defects(spark, d).filter("defect IS NOT NULL").select("record_kind", "record_no", "pair_no", "defect").distinct()


@query("p1_report")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(table(spark, d, "split_lines"))


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.pairs(table(spark, d, "split_lines")).select("line_a", "line_b").distinct()


def _p6_entities(spark: SparkSession, d: str) -> DataFrame:
    books = table(spark, d, "books")
    strings = books.select(F.explode(F.array("author", "author_ru", "author_en")).alias("name"))
    return names.entities(strings, table(spark, d, "name_forms"))


@query("p6_entities")
def p6_entities(spark: SparkSession, d: str) -> DataFrame:
    return _p6_entities(spark, d)


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked(_p6_entities(spark, d)).distinct()


def _p2_sections(spark: SparkSession, d: str) -> tuple[DataFrame, scans.ScanModel]:
    sections = table(spark, d, "chunks").filter("level = 1").select("vec_rowid", "path_titles", "text")
    return sections, scans.fit(sections)


@query("p2_repaired")
def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    sections, model = _p2_sections(spark, d)
    return scans.repair(sections, model).select("vec_rowid", "text")


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    sections, model = _p2_sections(spark, d)
    noise = cut(scans.chunk_noise(sections, model))
    return scans.found(noise, scans.corrections(noise, model)).select("vec_rowid", "noise")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", tokens.count(F.col("text")).alias("tokens"))
    return cut(documents)


def _p8_packed(spark: SparkSession, d: str) -> list[tuple[str, int, DataFrame]]:
    sizes = _sizes(spark, d)
    kinds = bounded_collect(table(spark, d, "pack_sizes"), 100, "the table of pack sizes")
    return [(k.pack_name, k.capacity_tokens, packing.pack(sizes, k.capacity_tokens)) for k in kinds]


@query("p8_packs")
def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("pack_name"), "*") for n, _, p in _p8_packed(spark, d)])


@query("p8_summary")
def p8_summary(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [packing.summary(p, c).select(F.lit(n).alias("pack_name"), "*") for n, c, p in _p8_packed(spark, d)])


@query("p9_mix")
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


@query("p9_shares")
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(_sizes(spark, d), targets), targets)
