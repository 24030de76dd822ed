"""Training exports: JSONL, ShareGPT and ChatML renderings, template dialogues, seeded splits, validation of knowledge atoms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import ASCII_BOUNDARY


def chatml(messages: Column) -> Column:
    """<|im_start|>role\\ncontent<|im_end|> per message, joined by line ends; null contents are empty."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit("<|im_end|>"))), "\n")


def sharegpt_role(role: Column) -> Column:
    return F.when(role == "user", "human").when(role == "assistant", "gpt").when(role == "system", "system").otherwise("human")


def chatml_role(role: Column) -> Column:
    return F.when(role == "human", "user").when(role == "gpt", "assistant").when(role == "system", "system").otherwise("user")


def to_sharegpt(lines: DataFrame, messages: str = "messages") -> DataFrame:
    turns = F.transform(messages, lambda m: F.struct(sharegpt_role(m["role"]).alias("from"), m["content"].alias("value")))
    return lines.withColumn("conversations", turns).drop(messages)


def to_jsonl(df: DataFrame, path: str, order: str | None = None) -> None:
    """One JSON object a line; with an order, the rows are written in it by range partitions, readable in file order."""
    rows = df if order is None else df.repartitionByRange(order).sortWithinPartitions(order)
    rows.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("error").text(path)


def hash_split(key: Column, seed: int, ratio: float) -> Column:
    """train or val by a stable hash of the key: the same for the same seed wherever and however often it runs."""
    h = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("#", F.lit(str(seed)), key.cast("string")), 256), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000))
    return F.when(h < int(ratio * 1_000_000), "train").otherwise("val")


def _mixed_hash(key: str) -> int:
    """32-bit multiply-and-rotate hash of a string's UTF-16 units."""
    units = np.frombuffer(key.encode("utf-16-le", "surrogatepass"), np.uint16).tolist()
    mask = 0xFFFFFFFF
    h = 1779033703 ^ len(units)
    for u in units:
        h = ((h ^ u) * 3432918353) & mask
        h = ((h << 13) | (h >> 19)) & mask
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        h = ((h ^ (h >> shift)) * factor) & mask
    return h ^ (h >> 16)


def split_bucket(concept: Column, pair: Column, seed: int, ratio: float) -> Column:
    """train or val for a pair of a concept, by a 32-bit hash of "seed|concept|pair" against the ratio; a null concept has no split."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for concepts, pairs in batches:
            out = [None if c is None or p is None else "train" if _mixed_hash(f"{seed & 0xFFFFFFFF}|{c}|{p}") / 4294967296 < ratio else "val" for c, p in zip(concepts.to_pylist(), pairs.to_pylist(), strict=True)]
            yield pa.array(out, pa.string())

    return F.arrow_udf(run, "string")(concept.cast("string"), pair.cast("int"))


def seeded_shuffle(items: list, seed: int) -> list:
    """Fisher-Yates with the 32-bit Mulberry generator, for small lists in order."""
    out, s = list(items), seed & 0xFFFFFFFF
    for i in range(len(out) - 1, 0, -1):
        s = (s + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((s ^ (s >> 15)) * (s | 1)) & 0xFFFFFFFF
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
        j = int(((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296 * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


# The marks an atom may carry, and verbs that say nothing as a predicate.
MARKS = ("authorship", "specialization", "revision", "causality")
COPULA = r"(?i)^(?:is|was|are|were|has|have|had|be|been|will|would|do|does|did)(?:_(?:a|an|the))?\z"


def atom_issues(atom: Column) -> Column:
    """Names of the rules that a knowledge atom breaks, in order; an empty array is a valid atom.

    atom: struct of domain, chapter_context, essence, cipher, proof, applicability, flags, tags (arrays of strings) and relations (array of
    struct<subject, predicate, object>). Null fields break their rule; a null applicability counts as empty.
    """
    size = lambda f, low, high: F.char_length(atom[f]).between(low, high)
    flags, tags, relations = atom["flags"], atom["tags"], atom["relations"]
    part = lambda r, f, low, high: F.coalesce(F.char_length(r[f]).between(low, high), F.lit(False))
    rules = {
        "domain": size("domain", 2, 60),
        "chapter_context": size("chapter_context", 10, 300),
        "essence": size("essence", 30, 800),
        "cipher": size("cipher", 5, 500),
        "proof": size("proof", 10, 800),
        "applicability": F.char_length(F.coalesce(atom["applicability"], F.lit(""))) <= 500,
        "flags": F.size(flags).between(2, 4) & (F.size(F.array_distinct(flags)) == F.size(flags)) & F.forall(flags, lambda x: F.coalesce(x.isin(*MARKS), F.lit(False))),
        "tags": F.size(tags).between(1, 10) & F.forall(tags, lambda x: F.coalesce(F.char_length(x).between(1, 40), F.lit(False))),
        "relations": F.size(relations).between(1, 8) & F.forall(relations, lambda r: part(r, "subject", 2, 120) & part(r, "predicate", 3, 60) & part(r, "object", 2, 120)),
        "predicate": ~F.exists(F.coalesce(relations, F.array().cast("array<struct<subject:string,predicate:string,object:string>>")), lambda r: F.coalesce(F.trim(r["predicate"]).rlike(COPULA), F.lit(False))),
    }
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def evaluation_issues(e: DataFrame) -> Column:
    """Names of the rules that an evaluation row breaks: names given, a year of 1400..2100 or none, 8 to 12 tags, scores of 0..100, a reason of 30 characters."""
    score = lambda c: F.coalesce(F.col(c).between(0, 100), F.lit(False))
    rules = {c: F.coalesce(F.char_length(c) >= 1, F.lit(False)) for c in ("title_ru", "author_ru", "title_en", "author_en", "domain")}
    rules |= {"year": F.col("year").isNull() | F.col("year").between(1400, 2100), "tags": F.coalesce(F.size("tags").between(8, 12), F.lit(False)), "is_fiction_or_water": F.col("is_fiction_or_water").isNotNull()}
    rules |= {c: score(c) for c in ("conceptual_density", "originality", "quality_score")}
    if "verdict_reason" in e.columns:
        rules["verdict_reason"] = F.coalesce(F.char_length("verdict_reason") >= 30, F.lit(False))
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


# Titles of sections that hold no content, how contents lists begin, and words of texts about the book itself.
NO_CONTENT = r"(?iu)^(?:contents|table\s+of\s+contents|toc|index|foreword|preface|isbn\b.*|issn\b.*|conventions\s+used\s+in\s+this\s+book|introduction\s+to\s+the\s+\w+\s+edition|bibliography|references|acknowledg(?:e)?ments|about\s+(?:the\s+)?(?:authors?|technical\s+reviewers?|reviewers?)|copyright|credits|содержание|оглавление|краткое\s+содержание|указатель|предисловие|предисловие\s+редакторской\s+группы|литература|список\s+литературы|библиография|благодарности|об\s+авторах?|об\s+авторе|копирайт)\z"
CONTENTS = r"(?iu)^(?:contents|table\s+of\s+contents|содержание|оглавление)" + ASCII_BOUNDARY
META = ASCII_BOUNDARY + r"(?:table of contents|bibliographic|book endorsement|endorsements|marketing material|promotional|publisher blurb|credits|copyright|about the author|about the reviewer|structural metadata|оглавление|содержание|краткое содержание|библиограф|рекламн|аннотац|об авторах|об авторе)" + ASCII_BOUNDARY
DOMAINS = ("ui", "web", "mobile", "ux", "perf", "arch", "copy", "seo", "research", "data", "security", "devops", "ai", "business", "science", "psychology", "philosophy", "engineering", "medicine", "economics", "other")


def no_content(title: Column) -> Column:
    """Whether a section's title says that it holds no content; marks of markdown around it are left out. Null and empty titles do not."""
    t = F.trim(F.regexp_replace(F.regexp_replace(title, r"[#*_`~]", " "), r"\s+", " "))
    return F.coalesce((t != "") & (t.rlike(NO_CONTENT) | (t.rlike(CONTENTS) & (F.char_length(t) < 80))), F.lit(False))


def about_the_book(*fields: Column) -> Column:
    """Whether the fields together speak of the book itself (contents, credits, blurbs) and not of its matter."""
    return F.lower(F.concat_ws(" ", *fields)).rlike(META)


# Questions and the system text of template dialogues.
QUESTIONS = (
    "Сформулируй ключевой принцип одним-двумя предложениями.", "В чём суть? Дай конкретно, без воды.", "Объясни главную идею профессионалу в этой области.",
    "Назови основной принцип и кратко его обоснуй.", "Дай рабочую формулировку, которую можно применять.",
)
SYSTEM = ("Ты эксперт в области: ", ". Отвечай по существу, без украшений.")
PROOF, FORMULA, USE = "Обоснование: ", "Формула: ", "Применение: "


def template_dialogues(concepts: DataFrame, pairs: int) -> DataFrame:
    """concept_id, depth, system, question and answer: one to five dialogues a concept, of growing detail.

    concepts: id, domain, essence, proof, cipher, applicability. The first answer is the essence; from the second on the proof follows, or the
    formula where there is none, from the third on the use. Concepts with nothing to answer give no dialogue.
    """
    filled = lambda c: F.when(F.char_length(c) > 0, F.col(c))
    n = max(1, min(len(QUESTIONS), pairs))
    rows = concepts.select("*", F.posexplode(F.array(*[F.lit(q) for q in QUESTIONS[:n]])).alias("at", "question"))
    more = F.coalesce(F.concat(F.lit(PROOF), filled("proof")), F.concat(F.lit(FORMULA), filled("cipher")))
    answer = F.trim(F.concat_ws("\n\n", filled("essence"), F.when(F.col("at") >= 1, more), F.when(F.col("at") >= 2, F.concat(F.lit(USE), filled("applicability")))))
    system = F.concat(F.lit(SYSTEM[0]), F.coalesce("domain", F.lit("")), F.lit(SYSTEM[1]))
    return rows.select(F.col("id").alias("concept_id"), (F.col("at") + 1).alias("depth"), system.alias("system"), "question", answer.alias("answer")).filter(F.char_length("answer") > 0)


def tier_lines(concepts: DataFrame) -> DataFrame:
    """Three lines a concept, one for each tier of its question-answer pairs: conversations and metadata.

    concepts: concept_id, book_id, collection_name, created_at, domain, flags and t1, t2, t3 (struct<question, answer>); a null pair gives no line.
    """
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.col(t).alias("qa")) for t in ("t1", "t2", "t3")])
    rows = concepts.select("*", F.explode(tiers).alias("x")).filter(F.col("x.qa").isNotNull())
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    talk = F.array(turn("system", F.concat(F.lit("You are an expert in "), F.coalesce("domain", F.lit("")), F.lit("."))), turn("human", F.col("x.qa.question")), turn("gpt", F.col("x.qa.answer")))
    meta = F.struct("concept_id", "book_id", "collection_name", "created_at", "domain", "flags", F.col("x.tier").alias("tier"))
    return rows.select(talk.alias("conversations"), meta.alias("metadata"))


def export_splits(dialogues: DataFrame, path: str, seed: int = 42, ratio: float = 0.9) -> dict[str, int]:
    """Dialogues as ChatML lines under split=train and split=val in JSON, and the counts of both.

    The split of a dialogue follows its concept and depth alone, so it is the same in every run.
    """
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), F.col(what).alias("content"))
    rows = dialogues.select(split_bucket(F.col("concept_id"), F.col("depth"), seed, ratio).alias("split"), F.array(turn("system", "system"), turn("user", "question"), turn("assistant", "answer")).alias("messages"), F.struct("concept_id", "depth").alias("meta"))
    rows.write.partitionBy("split").mode("error").json(path)
    counts = dialogues.sparkSession.read.json(path).groupBy("split").count().collect()  # two rows
    return {r["split"]: r["count"] for r in counts}


def markdown_of(title: Column, author: Column, year: Column, body: Column) -> Column:
    """A front matter of the given fields, nulls left out and quotes escaped, and the body under its title."""
    esc = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    field = lambda n, c: F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c))
    return F.concat_ws("\n", F.lit("---"), field("title", esc(title)), field("author", esc(author)), field("year", year.cast("string")), F.lit("---"), F.lit(""), F.concat(F.lit("# "), title), F.lit(""), body)
