"""Replies of models: tolerant JSON, reasoning blocks, balanced objects, concept payloads. Parsing runs in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags around reasoning, and how replies begin that reason in prose.
OPEN, CLOSE = "<think>", "</think>"
PROSE = re.compile(
    r"(?:thinking process:|here'?s? a? thinking process:|first,?\s+i\s+(?:need|will|should|have)\s+to|first,?\s+let\s+(?:me|us|'?s)|okay,?\s+(?:let'?s|so)|let\s+me\s+(?:analyze|think|extract|evaluate|consider|look)"
    r"|let'?s\s+(?:analyze|think|extract|evaluate|consider|look)|хорошо,?\s+(?:давайте|мне\s+нужно|нужно)|analysis:|step\s*1[:.])",
    re.I,
)


def _loads(text: str):  # noqa: ANN202
    """The value of strict JSON; NaN and infinities are none."""
    return json.loads(text, parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))


def _valid(text: str) -> bool:
    try:
        _loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def unfenced(text: str) -> str:
    """A reply without a fence of backticks around it."""
    return re.sub(r"\s*```\Z", "", re.sub(r"\A```(?:json)?\s*", "", text.strip(), flags=re.I)).strip()


def reply_state(raw: str | None) -> tuple[str, str | None]:
    """State and JSON text of a reply: 'empty', 'null' (it says null), 'value' (valid JSON, given as it stands) or 'failure'."""
    text = (raw or "").strip()
    if not text:
        return "empty", None
    if text.lower() == "null":
        return "null", None
    plain = unfenced(text)
    if not _valid(plain):
        return "failure", None
    return ("null", None) if plain == "null" else ("value", plain)


def balanced(text: str, start: int = 0, open_: str = "{", close: str = "}") -> tuple[int, int] | None:
    """First place, from start on, of a bracket that is closed again, and the end of it; brackets inside strings do not count."""
    marks = re.compile(rf'\\.|["{re.escape(open_)}{re.escape(close)}]', re.S)
    begin = text.find(open_, start)
    while begin >= 0:
        depth, quoted = 0, False
        for m in marks.finditer(text, begin):
            c = m[0]
            if c == '"':
                quoted = not quoted
            elif not quoted and c in (open_, close):
                depth += 1 if c == open_ else -1
                if not depth:
                    return begin, m.end()
        begin = text.find(open_, begin + 1)
    return None


def all_balanced(text: str, open_: str, close: str) -> list[str]:
    out, at = [], 0
    while (span := balanced(text, at, open_, close)) is not None:
        out.append(text[span[0] : span[1]])
        at = span[1]
    return out


def last_json(text: str | None, open_: str = "{", close: str = "}") -> str | None:
    """The last balanced piece of a text that is valid JSON, without fences; null where there is none."""
    pieces = all_balanced(re.sub(r"```(?:json)?", " ", text or "", flags=re.I).strip(), open_, close)
    return next((p for p in reversed(pieces) if _valid(p)), None)


def split_reasoning(raw: str | None) -> tuple[str | None, str]:
    """Reasoning and payload of a reply. A block that is never closed is all reasoning, as the reply was cut off inside it."""
    text = raw or ""
    before, opened, rest = text.partition(OPEN)
    if not opened:
        return None, text
    inside, closed, after = rest.partition(CLOSE)
    return inside.strip() or (None if closed else ""), after.strip() if closed else ""


def without_prose(raw: str | None) -> str:
    """A reply that reasons in prose, by how it begins, reduced to its last valid object, or to the last balanced one, or to nothing; others stay."""
    text = (raw or "").strip()
    if not PROSE.match(text):
        return raw or ""
    pieces = all_balanced(text, "{", "}")
    return next((p for p in reversed(pieces) if _valid(p)), pieces[-1] if pieces else "")


def parse_reply(raw: str | None) -> dict:
    """reasoning, payload, json (the first balanced object of the payload, where it is valid) and problem."""
    if not raw:
        return {"reasoning": None, "payload": "", "json": None, "problem": "empty"}
    reasoning, payload = split_reasoning(raw)
    unclosed = OPEN in raw and CLOSE not in raw.partition(OPEN)[2]
    span = balanced(payload) if payload.find("{") >= 0 else None
    # only the first opening brace counts: one that stays open leaves no object
    found = payload[span[0] : span[1]] if span and span[0] == payload.find("{") else None
    problem = "unclosed" if unclosed else "no_object" if found is None else None if _valid(found) else "invalid"
    return {"reasoning": reasoning, "payload": payload, "json": found if problem is None else None, "problem": problem}


def _batched(fn: Callable[[str | None], object], kind: pa.DataType, ddl: str) -> Callable[[Column], Column]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([fn(x) for x in b.to_pylist()], kind)

    return F.arrow_udf(run, ddl)


def replies(raw: Column) -> Column:
    """struct<state, json> of tolerant JSON replies; a null reply is empty."""
    kind = pa.struct([("state", pa.string()), ("json", pa.string())])
    return _batched(lambda x: dict(zip(("state", "json"), reply_state(x), strict=True)), kind, "struct<state:string,json:string>")(raw)


def reasoned(raw: Column) -> Column:
    """struct<reasoning, payload, json, problem> of replies with a reasoning block."""
    kind = pa.struct([(c, pa.string()) for c in ("reasoning", "payload", "json", "problem")])
    return _batched(parse_reply, kind, "struct<reasoning:string,payload:string,json:string,problem:string>")(raw)


def last_object(raw: Column) -> Column:
    return _batched(last_json, pa.string(), "string")(raw)


def last_array(raw: Column) -> Column:
    return _batched(lambda x: last_json(x, "[", "]"), pa.string(), "string")(raw)


def plain_answers(raw: Column) -> Column:
    return _batched(without_prose, pa.string(), "string")(raw)


def accepted_concepts(rows: DataFrame, user: str | None, collection: str, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Accepted concepts of a user and collection whose payload parses, in order of creation, and the others with their payload.

    rows: id, user_id, collection_name, accepted, created_at and the payload as JSON text.
    """
    mine = rows.filter(F.col("accepted") & (F.col("collection_name") == collection))
    mine = mine if user is None else mine.filter(F.col("user_id") == user)
    parsed = mine.withColumn("delta", F.expr(f"try_parse_json(`{payload}`)"))
    return parsed.filter("delta IS NOT NULL").orderBy("created_at", "id"), parsed.filter("delta IS NULL").select("id", payload)


def concept_of(point: Column) -> Column:
    """struct<essence, domain, proof, cipher, applicability, chapter_context, tags, book_title> of a stored point's JSON, older field names included.

    Null where essence or domain is missing. Tags come from a bar-separated text, else from a JSON array in a text, else from an array.
    """
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(point, f"$.{n}"), F.lit("")) for n in names])
    trimmed = lambda *names: F.trim(F.coalesce(*[F.get_json_object(point, f"$.{n}") for n in names]))
    essence, domain = trimmed("essence", "principle"), trimmed("domain")
    csv, text, plain = get("tagsCsv"), F.get_json_object(point, "$.tagsJson"), F.get_json_object(point, "$.tags")
    some = lambda a: F.filter(a, lambda x: F.length(x) > 0)
    none = F.array().cast("array<string>")
    listed = lambda t: F.coalesce(some(F.from_json(t, "array<string>")), none)
    tags = F.when(csv.isNotNull(), some(F.transform(F.split(csv, r"\|"), lambda x: F.trim(x)))).when(text.isNotNull(), listed(text)).otherwise(listed(plain))
    fields = {"essence": essence, "domain": domain, "proof": get("proof", "explanation"), "cipher": get("cipher"), "applicability": get("applicability"), "chapter_context": get("chapterContext"), "tags": tags, "book_title": get("bookTitle", "book_title")}
    return F.when((F.length(essence) > 0) & (F.length(domain) > 0), F.struct(*[c.alias(n) for n, c in fields.items()]))


def text_meta(raw: Column) -> Column:
    """struct<title, author, year, language, publisher> of a reply that describes a text; blank fields are null, no field at all is null.

    The year lies between 1000 and 2100 and may be a number or a text that begins with one; the language has two or three letters.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*\z", ""))
    text = lambda n: F.nullif(F.trim(F.get_json_object(plain, f"$.{n}")), F.lit(""))
    number = F.nullif(F.regexp_extract(F.trim(F.get_json_object(plain, "$.year")), r"^(-?[0-9]{1,9})", 1), F.lit("")).cast("int")
    year = F.when((number > 1000) & (number < 2100), number)
    language = F.when(text("language").rlike("(?i)^[a-z]{2,3}$"), F.lower(text("language")))
    fields = {"title": text("title"), "author": text("author"), "year": year, "language": language, "publisher": text("publisher")}
    return F.when(F.coalesce(*[c.cast("string") for c in fields.values()]).isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def jsonl_head(lines: DataFrame, n: int) -> DataFrame:
    """line_no, line, parsed (null where a line is no JSON) and truncated of the first n (1 to 200) lines that are not blank.

    lines: line_no and line, by whose order the head is taken. truncated tells that there are more lines than are shown.
    """
    n = max(1, min(200, n))
    some = lines.filter(F.length(F.trim("line")) > 0)
    head = some.orderBy("line_no").limit(n)
    more = lines.agg(F.count("*").alias("all"))  # one row
    return head.crossJoin(more).select("line_no", "line", F.expr("to_json(try_parse_json(line))").alias("parsed"), (F.col("all") > n).alias("truncated"))
