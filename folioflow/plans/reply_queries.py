"""Queries over model replies, concepts and stored lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import replies as R
from folioflow.plans.registry import query
from folioflow.session import table

Spark = SparkSession
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_T = f"trim(raw, {_BLANK})"
_UNFENCED = f"trim(regexp_replace(regexp_replace({_T}, '^(?i)```(?:json)?\\s*', ''), '\\s*```$', ''), {_BLANK})"


@query("tolerant_json", f"SELECT sample_id, CASE WHEN coalesce({_T}, '') = '' THEN 'empty' WHEN lower({_T}) = 'null' OR {_UNFENCED} = 'null' THEN 'null' WHEN json_valid({_UNFENCED}) THEN 'value' ELSE 'failure' END AS state, CASE WHEN {_T} <> '' AND {_UNFENCED} <> 'null' AND json_valid({_UNFENCED}) THEN md5({_UNFENCED}) END AS hash FROM synth_raw_samples")
def tolerant_json(s: Spark, d: str) -> DataFrame:
    got = table(s, d, "synth_raw_samples").select("sample_id", R.replies(F.col("raw")).alias("r"))
    return got.select("sample_id", "r.state", F.md5("r.json").alias("hash"))


@query("reasoning_split", "SELECT sample_id, CASE WHEN o = 0 THEN NULL WHEN c = 0 THEN trim(substr(raw, o + 7), ' ' || chr(10)) ELSE nullif(trim(substr(raw, o + 7, c - 1), ' ' || chr(10)), '') END AS reasoning, CASE WHEN o = 0 THEN raw WHEN c = 0 THEN '' ELSE trim(substr(raw, o + 7 + c + 7), ' ' || chr(10)) END AS payload FROM (SELECT sample_id, raw, strpos(raw, '<think>') AS o, CASE WHEN strpos(raw, '<think>') > 0 THEN strpos(substr(raw, strpos(raw, '<think>') + 7), '</think>') ELSE 0 END AS c FROM synth_raw_samples WHERE raw <> '') x")
def reasoning_split(s: Spark, d: str) -> DataFrame:
    got = table(s, d, "synth_raw_samples").filter("raw <> ''").select("sample_id", R.reasoned(F.col("raw")).alias("r"))
    return got.select("sample_id", "r.reasoning", "r.payload")


@query("reply_objects")
def reply_objects(s: Spark, d: str) -> DataFrame:
    got = table(s, d, "synth_raw_samples").select("sample_id", R.reasoned(F.col("raw")).alias("r"), R.last_object(F.col("raw")).alias("last"), R.last_array(F.col("raw")).alias("list"))
    return got.select("sample_id", "r.problem", F.md5("r.json").alias("first_object"), F.md5("last").alias("last_object"), F.md5("list").alias("last_array"))


@query("accepted_concepts", "SELECT line_id, json_extract_string(meta, '$.bookId') AS book_id, json_extract_string(meta, '$.tier') AS tier FROM chatml_lines WHERE json_valid(meta) AND collection_name = (SELECT min(collection_name) FROM chatml_lines)")
def accepted_concepts(s: Spark, d: str) -> DataFrame:
    lines = table(s, d, "chatml_lines")
    first = lines.agg(F.min("collection_name")).first()[0]
    rows = lines.select(F.col("line_id").alias("id"), F.lit("u").alias("user_id"), "collection_name", F.lit(True).alias("accepted"), "created_at", F.col("meta").alias("payload"))
    good, _ = R.accepted_concepts(rows, "u", first)
    return good.select(F.col("id").alias("line_id"), F.expr("variant_get(delta, '$.bookId', 'string')").alias("book_id"), F.expr("variant_get(delta, '$.tier', 'string')").alias("tier"))


_POINT = "json_object('principle', trim(title), 'domain', domain, 'explanation', title_ru, 'tagsCsv', '|' || array_to_string(tags, '|') || '|', 'book_title', publisher)"


@query("concept_decode", "SELECT id, trim(title) AS essence, domain, nullif(title_ru, '') AS proof, array_to_string(list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> ''), ',') AS tags, nullif(publisher, '') AS book_title FROM books WHERE trim(coalesce(title, '')) <> '' AND trim(coalesce(domain, '')) <> ''")
def concept_decode(s: Spark, d: str) -> DataFrame:
    """Points stored with older field names: principle for essence, explanation for proof, tags between bars."""
    fields = F.struct(F.col("title").alias("principle"), "domain", F.col("title_ru").alias("explanation"), F.concat(F.lit("|"), F.array_join(F.coalesce("tags", F.array()), "|"), F.lit("|")).alias("tagsCsv"), F.col("publisher").alias("book_title"))
    points = table(s, d, "books").select("id", R.concept_of(F.to_json(fields)).alias("c")).filter("c IS NOT NULL")
    return points.select("id", "c.essence", "c.domain", "c.proof", F.array_join("c.tags", ",").alias("tags"), "c.book_title")


@query("text_meta", "SELECT id, nullif(trim(title), '') AS title, CASE WHEN year > 1000 AND year < 2100 THEN year END AS year, CASE WHEN regexp_full_match(trim(language), '[A-Za-z]{2,3}') THEN lower(trim(language)) END AS language, nullif(trim(publisher), '') AS publisher FROM books WHERE trim(coalesce(title, '')) <> '' OR (year > 1000 AND year < 2100) OR regexp_full_match(trim(coalesce(language, '')), '[A-Za-z]{2,3}') OR trim(coalesce(publisher, '')) <> ''")
def text_meta(s: Spark, d: str) -> DataFrame:
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct("title", F.col("year").cast("string").alias("year"), "language", "publisher")), F.lit("\n```"))
    got = table(s, d, "books").select("id", R.text_meta(reply).alias("m")).filter("m IS NOT NULL")
    return got.select("id", "m.title", "m.year", "m.language", "m.publisher")


@query("jsonl_head", "SELECT line_id AS line_no, line, parsed, total > 20 AS truncated FROM (SELECT line_id, coalesce(meta, 'no json') AS line, CASE WHEN meta IS NOT NULL THEN json_extract_string(meta, '$.tier') END AS parsed, (SELECT count(*) FROM chatml_lines) AS total FROM chatml_lines ORDER BY line_id LIMIT 20) x")
def jsonl_head(s: Spark, d: str) -> DataFrame:
    lines = table(s, d, "chatml_lines").select(F.col("line_id").alias("line_no"), F.coalesce("meta", F.lit("no json")).alias("line"))
    return R.jsonl_head(lines, 20).withColumn("parsed", F.get_json_object("parsed", "$.tier"))


@query("telemetry_tail", "SELECT line_id, tier FROM (SELECT line_id, meta, json_extract_string(meta, '$.tier') AS tier FROM chatml_lines ORDER BY line_id DESC LIMIT 50) x WHERE meta IS NOT NULL")
def telemetry_tail(s: Spark, d: str) -> DataFrame:
    """The last 50 lines, then those of them that are JSON."""
    lines = table(s, d, "chatml_lines").orderBy(F.desc("line_id")).limit(50)
    return lines.filter(F.expr("try_parse_json(meta) IS NOT NULL")).select("line_id", F.get_json_object("meta", "$.tier").alias("tier"))
