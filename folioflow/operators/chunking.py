"""Structure: markdown sections, extraction units, section-aware and character chunks, sibling links, part numbers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTION_DDL = "array<struct<level:int,title:string,path_titles:array<string>,section_order:int,paragraphs:array<string>>>"


def markdown_sections(text: str | None) -> list[tuple[int, str | None, list[str], int, list[str]]]:
    """Sections of a markdown text: heading level (0 before the first heading), title, breadcrumb, order, paragraphs.

    A front matter is left out, a blank line ends a paragraph, lines of a paragraph are joined by blanks, a heading
    without a body is kept, and a text without headings is one section of level 0.
    """
    body = re.sub(r"\A---\r?\n.*?\r?\n---\r?\n", "", text or "", flags=re.S)
    sections: list[list] = []
    path: list[str] = []
    current: list = [0, None, [], []]
    lines: list[str] = []

    def close() -> None:
        if lines:
            current[3].append(" ".join(lines))
            lines.clear()

    for line in [*body.splitlines(), ""]:
        m = re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if m:
            close()
            if current[0] or current[3]:
                sections.append(current)
            level = len(m[1])
            path = [*path[: level - 1], m[2]]
            current = [level, m[2], list(path), []]
        elif line.strip():
            lines.append(line.strip())
        else:
            close()
    if current[0] or current[3]:
        sections.append(current)
    return [(lv, t, p, i, ps) for i, (lv, t, p, ps) in enumerate(sections, 1)]


def sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    fields = ("level", "title", "path_titles", "section_order", "paragraphs")
    kind = pa.list_(pa.struct([("level", pa.int32()), ("title", pa.string()), ("path_titles", pa.list_(pa.string())), ("section_order", pa.int32()), ("paragraphs", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([[dict(zip(fields, x, strict=True)) for x in markdown_sections(t)] for t in b.to_pylist()], kind)

    return documents.select(key, F.explode(F.arrow_udf(run, SECTION_DDL)(F.col(text))).alias("s")).select(key, "s.*")


def units(sections_: DataFrame, key: str) -> DataFrame:
    """The unit of every section: a new one starts at level 2 and above; deeper sections before the first belong to unit 0."""
    w = Window.partitionBy(key).orderBy("section_order").rowsBetween(Window.unboundedPreceding, 0)
    return sections_.withColumn("unit", F.sum((F.col("level") <= 2).cast("int")).over(w))


# Lines that open a block (headings of fewer than 15 words), and lines that only part blocks.
BLOCK_HEADING = re.compile(r"(?:#{1,4}\s|глава\s|раздел\s|часть\s|chapter\s|section\s|part\s)", re.I)
BLOCK_RULE = re.compile(r"(?:\*{3,}|_{3,}|-{3,}|={3,})")


def heading_blocks(paragraphs: list[str]) -> list[list[str]]:
    """Paragraphs in blocks: a heading opens one and stays its first paragraph, rules and blank paragraphs part them and are dropped."""
    blocks: list[list[str]] = [[]]
    for p in (x.strip() for x in paragraphs):
        opens = bool(BLOCK_HEADING.match(p)) and len(p.split()) < 15
        parts = not p or bool(BLOCK_RULE.fullmatch(p))
        if (opens or parts) and blocks[-1]:
            blocks.append([])
        if not parts:
            blocks[-1].append(p)
    return [b for b in blocks if b]


def _filled(paragraphs: list[str], target: int) -> list[list[str]]:
    """A block in pieces of whole paragraphs that hold no more than target words, where a paragraph does not alone."""
    out: list[list[str]] = []
    room = 0
    for p in paragraphs:
        n = len(p.split())
        if not out or n > room:
            out.append([])
            room = target
        out[-1].append(p)
        room -= n
    return out


def pack_paragraphs(paragraphs: list[str] | None, target: int = 1000, most: int = 1500, least: int = 300, overlap: int = 1) -> list[str]:
    """Chunks of whole paragraphs: one where the section has at most `most` words.

    Else blocks (heading_blocks) are put together up to `most` and closed from `target` on, a block over `most` is
    filled up to target by itself, every chunk under `least` words joins the one before it, and each chunk repeats the last `overlap`
    paragraphs of the one before. Null and empty sections give no chunk.
    """
    ps = [p for p in paragraphs or [] if p.strip()]
    size = lambda group: sum(len(p.split()) for p in group)
    if size(ps) <= most:
        return ["\n\n".join(ps)] if ps else []
    packs: list[list[str]] = []
    open_ = False  # whether the last pack takes more blocks
    for block in heading_blocks(ps):
        if size(block) > most:
            packs += _filled(block, target)
            open_ = False
            continue
        if open_ and size(packs[-1]) + size(block) <= most:
            packs[-1] = packs[-1] + block
        else:
            packs.append(block)
        open_ = size(packs[-1]) < target
    merged: list[list[str]] = []
    for pack in packs:
        if merged and size(pack) < least:
            merged[-1] = merged[-1] + pack
        else:
            merged.append(pack)
    before = [[], *merged[:-1]]
    return ["\n\n".join((b[-overlap:] if overlap else []) + m) for b, m in zip(before, merged, strict=True)]


def section_chunks(sections_: DataFrame, key: str, **sizes: int) -> DataFrame:
    """Chunks with part_n and part_of; no chunk crosses a section."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([pack_paragraphs(ps, **sizes) for ps in b.to_pylist()], pa.list_(pa.string()))

    rows = sections_.withColumn("parts", F.arrow_udf(run, "array<string>")("paragraphs"))
    return rows.select(key, "section_order", "level", "path_titles", F.posexplode("parts").alias("i", "text"), F.size("parts").alias("part_of")).withColumn("part_n", F.col("i") + 1).drop("i")


def char_chunks(text: str | None, target: int = 900, most: int = 1600, least: int = 280) -> list[str]:
    """Chunks of paragraphs by characters: flush at target, never above most, a small rest joins the one before."""
    out: list[str] = []
    now = ""
    for p in (q.strip() for q in re.split(r"\n\s*\n|\n", text or "")):
        while len(p) > most:
            cut = max(p.rfind(". ", 0, most), p.rfind(" ", 0, most)) + 1 or most
            if now:
                out.append(now)
                now = ""
            out.append(p[:cut].strip())
            p = p[cut:].strip()
        if not p:
            continue
        if now and (len(now) >= target or len(now) + 1 + len(p) > most):
            out.append(now)
            now = p
        else:
            now = f"{now}\n{p}" if now else p
    if now:
        if out and len(now) < least and len(out[-1]) + 1 + len(now) <= most:
            out[-1] += "\n" + now
        else:
            out.append(now)
    return out


def char_chunks_of(text: Column) -> Column:
    """char_chunks of a column of texts, in batches."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([char_chunks(t) for t in b.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(text)


def chunk_id(path: str, chapter: int, index: int, text: str) -> str:
    h = hashlib.sha1(f"{path}|{chapter}|{index}|{text[:64]}".encode(), usedforsecurity=False).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def sibling_links(chunks: DataFrame) -> DataFrame:
    """prev and next row inside a section by part_n, nulls at the ends."""
    w = Window.partitionBy("book_id", "level", "section_order").orderBy("part_n", "vec_rowid")
    return chunks.select("vec_rowid", F.lag("vec_rowid").over(w).alias("prev_rowid"), F.lead("vec_rowid").over(w).alias("next_rowid"))


def nodal_chapters(words: DataFrame) -> DataFrame:
    """The longest chapters of every book but its first and last: a quarter of all, three to five; books of two or fewer have none.

    words: book_id, section_order, words; of equal lengths the earlier chapter.
    """
    w = Window.partitionBy("book_id")
    k = words.withColumns({"k": F.count("*").over(w), "a": F.min("section_order").over(w), "z": F.max("section_order").over(w)})
    inner = k.filter((F.col("k") > 2) & (F.col("section_order") != F.col("a")) & (F.col("section_order") != F.col("z")))
    place = F.row_number().over(w.orderBy(F.desc("words"), "section_order"))
    return inner.withColumn("r", place).filter(F.col("r") <= F.least(F.lit(5), F.greatest(F.lit(3), F.floor(F.col("k") / 4)))).select("book_id", "section_order", "words")


def part_numbers(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("book_id", "level", "section_order")
    return chunks.select("vec_rowid", F.row_number().over(w.orderBy("part_n", "vec_rowid")).alias("n"), F.count("*").over(w).alias("of"))


def token_windows(ids: list[int], most: int, overlap: int) -> list[list[int]]:
    """Windows of at most `most` ids, each starting most - overlap after the one before."""
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be smaller than the window")
    step = most - overlap
    return [ids[i : i + most] for i in range(0, max(1, len(ids) - overlap), step)]
