"""Seams for models (embedder, completion) with deterministic stand-ins, and the operators that need them: drift boundaries, semantic
chunks, semantic duplicates, chapter summaries, uniqueness."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.chunking import BLOCK_HEADING, BLOCK_RULE
from folioflow.operators.dedup import components
from folioflow.operators.vectors import dot, nearest
from folioflow.session import require


class Embedder(Protocol):
    """Unit vectors of texts, one row each; called with whole batches inside tasks, so it must pickle."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashedEmbedder:
    """A stand-in without a model: words hashed into `size` places with a sign, normalised; equal bags of words give equal vectors."""

    def __init__(self, size: int = 384, prefix: str = "passage: ") -> None:
        self.size, self.prefix = size, prefix

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(w.encode())
                row[h % self.size] += 1.0 if h >> 31 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Provider(Protocol):
    """Completions of prompts, one each; None where the model gives nothing. Called with whole batches inside tasks."""

    def __call__(self, prompts: list[str]) -> list[str | None]: ...


def echo_provider(prompts: list[str]) -> list[str | None]:
    """A stand-in: the last line of each prompt that is not blank."""
    return [next((x for x in reversed(p.splitlines()) if x.strip()), None) for p in prompts]


def embedded(text: Column, embedder: Embedder) -> Column:
    """Vectors of texts; a null text has none."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts = b.to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            vectors = embedder([texts[i] for i in some]) if some else np.zeros((0, 0))
            out: list = [None] * len(texts)
            for i, v in zip(some, vectors.tolist(), strict=True):
                out[i] = v
            yield pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>")(text)


def completed(prompt: Column, provider: Provider) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(provider([p or "" for p in b.to_pylist()]), pa.string())

    return F.arrow_udf(run, "string")(prompt)


def concept_text(c: DataFrame) -> Column:
    """What is embedded of a concept: its named fields, a line each; null fields are empty."""
    field = lambda n, v: F.concat(F.lit(f"{n}: "), F.coalesce(v, F.lit("")))
    return F.concat_ws("\n", field("domain", c["domain"]), field("essence", c["essence"]), field("cipher", c["cipher"]), field("tags", F.array_join(c["tags"], ", ")), field("proof", c["proof"]))


# --- semantic chunker

SAFE, LEAST, HARD, DRIFT, MOST_PARAGRAPHS = 1500, 300, 2500, 0.45, 800


def drift_boundaries(paragraphs: DataFrame, key: str, embedder: Embedder, threshold: float = DRIFT, most: int = MOST_PARAGRAPHS) -> DataFrame:
    """key and position of paragraphs behind which the subject shifts: their vector is less than threshold like the next one's.

    Texts of fewer than three paragraphs have no boundary, and neither have those of more than `most`, a parameter of the
    detector. paragraphs: key, position, paragraph.
    """
    w = Window.partitionBy(key).orderBy("position")
    sized = paragraphs.withColumn("__n", F.count("*").over(Window.partitionBy(key))).filter(F.col("__n").between(3, most))
    v = sized.withColumn("__v", embedded(F.substring("paragraph", 1, 500), embedder)).withColumn("__next", F.lead("__v").over(w))
    return v.filter(F.col("__next").isNotNull() & (dot(F.col("__v"), F.col("__next")) < threshold)).select(key, "position")


def _words(paragraphs: list[str]) -> int:
    return sum(len(p.split()) for p in paragraphs)


def _titled_blocks(paragraphs: list[str], title: str) -> list[tuple[str, list[str]]]:
    """Blocks under their headings; headings and rules are no part of a block."""
    blocks: list[tuple[str, list[str]]] = [(title, [])]
    for p in filter(None, (x.strip() for x in paragraphs)):
        if BLOCK_HEADING.match(p) and len(p.split()) < 15:
            blocks.append((p, []))
        elif BLOCK_RULE.fullmatch(p):
            blocks.append((blocks[-1][0], []))
        else:
            blocks[-1][1].append(p)
    return [b for b in blocks if b[1]] or [(title, [p for p in paragraphs if p.strip()])]


def _shifts(paragraphs: list[str], embedder: Embedder, threshold: float, most: int) -> set[int]:
    if not 3 <= len(paragraphs) <= most:
        return set()
    v = embedder([p[:500] for p in paragraphs])
    return set(np.flatnonzero((v[:-1] * v[1:]).sum(1) < threshold).tolist())


def semantic_chunks_of(paragraphs: list[str] | None, title: str | None, embedder: Embedder, *, safe: int = SAFE, least: int = LEAST, hard: int = HARD, threshold: float = DRIFT, most: int = MOST_PARAGRAPHS, overlap: int = 1) -> list[dict]:
    """Chunks of a chapter: heading, text, part_n, part_of, overlap (the last paragraphs of the chunk before, if over 20 characters).

    Blocks over `safe` words are cut where the subject shifts and at `hard` words; chunks under `least` words grow by the
    next ones, and what stays under it is left out unless nothing else is there: then the largest is kept.
    """
    pieces: list[tuple[str, list[str]]] = []
    for heading, block in _titled_blocks(paragraphs or [], title or ""):
        if _words(block) <= safe:
            pieces.append((heading, block))
            continue
        cuts, now = _shifts(block, embedder, threshold, most), []
        for i, p in enumerate(block):
            now.append(p)
            if i in cuts or _words(now) >= hard:
                pieces.append((heading, now))
                now = []
        if now:
            pieces.append((heading, now))
    grown: list[tuple[str, list[str]]] = []
    full = True  # whether the last one takes no more
    for heading, block in pieces:
        if full or (_words(grown[-1][1]) >= least and _words(grown[-1][1]) + _words(block) > safe):
            grown.append((heading, list(block)))
        else:
            grown[-1][1].extend(block)
        full = _words(grown[-1][1]) >= least
    grown = [g for g in grown if g[1]]
    kept = [g for g in grown if _words(g[1]) >= least] or sorted(grown, key=lambda g: -_words(g[1]))[:1]
    out: list[dict] = []
    for i, (heading, block) in enumerate(kept, 1):
        hook = "\n\n".join(kept[i - 2][1][-overlap:]).strip() if i > 1 and overlap > 0 else ""
        out.append({"heading": heading, "text": "\n\n".join(block).strip(), "part_n": i, "part_of": len(kept), "overlap": hook if len(hook) > 20 else None})
    return out


_CHUNK = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string()), ("part_n", pa.int32()), ("part_of", pa.int32()), ("overlap", pa.string())]))


def semantic_chunks(chapters: DataFrame, key: str, embedder: Embedder, **sizes) -> DataFrame:  # noqa: ANN003
    """key, section_order and the chunks of chapters (key, section_order, title, paragraphs); chapters without paragraphs give none."""
    require(chapters, key, "section_order", "title", "paragraphs")

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ps, titles in batches:
            yield pa.array([semantic_chunks_of(p, t, embedder, **sizes) for p, t in zip(ps.to_pylist(), titles.to_pylist(), strict=True)], _CHUNK)

    cut = F.arrow_udf(run, "array<struct<heading:string,text:string,part_n:int,part_of:int,overlap:string>>")
    return chapters.select(key, "section_order", F.inline(cut("paragraphs", "title")))


# --- semantic duplicates and uniqueness


def new_concepts(fresh: DataFrame, stored: DataFrame, threshold: float = 0.93, *, key: str = "id", vector: str = "vector", order: str = "created_at") -> DataFrame:
    """Fresh concepts that resemble no stored one and no kept fresh one before them by threshold or more.

    Fresh rows are compared with stored ones exactly, in rounds; among themselves by linked groups, each folded in order (ties by
    key), as keeping one depends only on those it resembles. Equal keys count as the same concept.
    """
    kind = dict(fresh.dtypes)[key]
    known = nearest(fresh, stored, 1, key=key, vector=vector).filter(F.col("sim") >= threshold).select(F.col("query").alias(key))
    left = fresh.join(known, key, "left_anti")
    k = 16
    while True:
        # all resembling pairs: the k nearest are enough as soon as the k-th is below the threshold for every row
        near = nearest(left, left, k, key=key, vector=vector).filter(F.col("sim") >= threshold)
        full = near.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") == k)
        if full.isEmpty():
            break
        k *= 4
    place = left.select(F.col(key).alias("node"), F.col(order).alias("at"))
    a, b = place.select(F.col("node").alias("query"), F.struct("at", "node").alias("a")), place.select(F.col("node").alias("neighbour"), F.struct("at", "node").alias("b"))
    pairs = near.join(a, "query").join(b, "neighbour").filter("a < b").select(F.lit("").alias("tier"), F.col("query").alias("a"), F.col("neighbour").alias("b"), F.col("a.at").alias("at_a"), F.col("b.at").alias("at_b"))
    roots = components(pairs.select("tier", "a", "b"))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        fallen: set = set()
        for x, y in rows.sort_values(["at_b", "b", "at_a", "a"])[["a", "b"]].itertuples(index=False):
            if x not in fallen:
                fallen.add(y)
        return pd.DataFrame({key: list(fallen)})

    fallen = pairs.join(roots.select(F.col("node").alias("a"), "root"), "a").groupBy("root").applyInPandas(fold, f"{key} {kind}")
    return left.join(fallen, key, "left_anti")


def uniqueness(bands: DataFrame, group: str) -> DataFrame:
    """Per group the ideas, those that are novel, and the score: novel in hundredths, null under three ideas. bands: group, band."""
    got = bands.groupBy(group).agg(F.count("*").alias("ideas"), F.count_if(F.col("band") == "novel").alias("novel"))
    return got.withColumn("score", F.when(F.col("ideas") >= 3, F.floor(100 * F.col("novel") / F.col("ideas") + 0.5).cast("int")))


# --- chapter summaries


def summary_prompts(units: DataFrame, most: int = 12, cut: int = 240) -> DataFrame:
    """unit columns, anchor and prompt: the first essences of a chapter, numbered and cut; a chapter without essences has an anchor alone.

    units: path_titles and essences (array, in order) beside any other columns.
    """
    crumb = F.coalesce(F.nullif(F.array_join("path_titles", " > "), F.lit("")), F.lit("Body"))
    listed = F.transform(F.slice("essences", 1, most), lambda e, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.substring(e, 1, cut)))
    prompt = F.concat(F.lit("Breadcrumb: "), crumb, F.lit("\n\nEssences:\n"), F.array_join(listed, "\n"))
    none = F.coalesce(F.size("essences"), F.lit(0)) <= 0
    return units.withColumns({"anchor": F.when(none, F.concat(F.lit("Chapter: "), crumb)), "prompt": F.when(~none, prompt)})


def summaries(units: DataFrame, provider: Provider, most: int = 1200) -> DataFrame:
    """units with summary: the provider's text without fences and quotes, cut to `most`; the anchor where there are no essences; null for none."""
    p = summary_prompts(units)
    said = F.trim(completed(F.coalesce("prompt", F.lit("")), provider))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, "^[\"'`]+|[\"'`]+\\z", ""), r"(?i)^```[a-z]*\s*", ""), r"\s*```\s*\z", "")
    text = F.when(F.lower(said).isin("", "null"), None).otherwise(F.nullif(F.substring(F.trim(plain), 1, most), F.lit("")))
    return p.withColumn("summary", F.coalesce("anchor", text)).drop("prompt", "anchor")


def evaluated(books: DataFrame, provider: Provider, prompt: Column, check: Callable[[Column], Column]) -> DataFrame:
    """Books with reply and valid: a reply that check() refuses is asked for once more with the refusal in the prompt.

    Each round is one pass in batches; the second asks only for what the first refused.
    """
    first = books.withColumn("reply", completed(prompt, provider))
    again = F.when(~F.coalesce(check(F.col("reply")), F.lit(False)), F.concat(prompt, F.lit("\nThe reply was not valid. Give valid JSON only.")))
    second = first.withColumn("__again", again).withColumn("__second", completed(F.coalesce("__again", F.lit("")), provider))
    reply = F.when(F.col("__again").isNotNull(), F.col("__second")).otherwise(F.col("reply"))
    return second.withColumn("reply", reply).withColumn("valid", F.coalesce(check(F.col("reply")), F.lit(False))).drop("__again", "__second")
