"""Choosing files before they are parsed: candidates by path and size, bundles and their main book, HTML books in many files, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import normalized, token_set, token_similarity
from folioflow.operators.dedup import format_priority
from folioflow.session import require

# Path segments and base names of files beside books, and patterns of such names.
NOISE_SEGMENTS = ("_vti_cnf", "assets", "asset", "textures", "texture", "images", "image", "img", "thumbnails", "thumbnail", "thumbs", "thumb", "css", "js", "code", "codes", "examples", "example", "samples", "sample", "extras", "extra", "ftp", "vendor", "node_modules", "__macosx")
NOISE_NAMES = ("readme", "license", "changelog", "changes", "contents", "content", "toc", "index", "cover", "front", "back", "_downloaded", "-")
HTML_SEGMENTS = ("html", "index", "_vti_cnf")
FORUM, COURSE = r"^forum[_-]?[0-9]+\z", r"(?iu)(?:stepik|beegeek|coursera|udemy|курс|урок|lesson)"
COMPANION = r"^(?:chap[0-9]+|chapter[0-9]+|part[0-9]+|listings?|task_?[0-9]+|exercise_?[0-9]+|src|lib|pkg|cmd|internal)\z"
COMMON_NOISE = r"(?i)(?:readme|license|changelog|contents?|toc|cover|front|back|thumbnail|thumb)"
LESSON_NAMES = r"(?iu)(?:stepik|solution|answers?|решени[ея]|урок|lesson|шаг\s*[0-9]+)"
PAGE_NAMES = r"(?iu)(?:chapter|part\s*[0-9]+|ch[0-9]{1,3}|idx[_-]?[0-9]+|page\s*[0-9]+|lesson|урок|stepik|шаг\s*[0-9]+)"
LEAST_TEXT, LEAST_HTML = 10_240, 64 * 1024


def extension(path: Column) -> Column:
    """Extension of a path in small letters, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)\z", 1))


def candidates(files: DataFrame) -> DataFrame:
    """files with candidate: whether a path may be a book, by its segments, name and size.

    files: path (relative, parts by slashes) and size. Segments and names of material beside books rule a file out; texts need
    10 KiB and no lesson's name; single HTML files need 64 KiB, three segments at most and a name like their folder's.
    """
    require(files, "path", "size")
    low = F.lower("path")
    segments = F.filter(F.split(low, r"[\\/]+"), lambda x: x != "")
    ext = extension(F.col("path"))
    base = F.regexp_replace(F.element_at(segments, -1), r"\.[^.]*\z", "")
    folders = F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
    parent = F.coalesce(F.get(segments, F.size(segments) - 2), F.lit(""))
    some = lambda array, test: F.exists(array, test)
    noise = some(segments, lambda x: x.rlike(FORUM) | x.rlike(COURSE) | x.isin(*NOISE_SEGMENTS)) | some(folders, lambda x: x.rlike(COMPANION)) | base.isin(*NOISE_NAMES) | F.element_at(segments, -1).isin(*NOISE_NAMES) | base.rlike(COMMON_NOISE)
    like = token_similarity(token_set(base), token_set(parent))
    text = (F.col("size") >= LEAST_TEXT) & ~base.rlike(LESSON_NAMES)
    html = ~some(segments, lambda x: x.isin(*HTML_SEGMENTS)) & ~base.rlike(PAGE_NAMES) & (F.size(segments) <= 3) & (F.col("size") >= LEAST_HTML) & ((parent == "") | (like >= 0.45))
    lesson = ext.isin("pdf", "doc", "docx", "rtf") & base.rlike(LESSON_NAMES)
    return files.withColumn("candidate", F.coalesce(~noise & F.when(ext == "txt", text).when(ext.isin("html", "htm"), html).otherwise(~lesson), F.lit(False)))


def natural_key(name: Column) -> Column:
    """A key by which names sort with their numbers as numbers: every run of digits is filled to 20 places."""
    padded = F.regexp_replace(F.regexp_replace(name, "([0-9]+)", "00000000000000000000$1"), "0*([0-9]{20})(?![0-9])", "$1")
    return padded


def main_books(files: DataFrame) -> DataFrame:
    """folder and path of each bundle's main book: the best format, then the largest, then the first path. files: folder, path, size."""
    require(files, "folder", "path", "size")
    order = F.struct((-format_priority(extension(F.col("path")))).alias("p"), (-F.col("size")).alias("s"), "path")
    books = files.filter(format_priority(extension(F.col("path"))) >= 0)
    return books.groupBy("folder").agg(F.min(order).alias("o")).select("folder", F.col("o.path").alias("path"))


# Kinds of files in a bundle, by extension.
KINDS = {
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "webp", "svg", "tif", "tiff"), "code": ("py", "js", "ts", "java", "c", "cpp", "h", "cs", "go", "rs", "rb", "php", "sh", "sql", "ipynb"),
    "archive": ("zip", "rar", "7z", "tar", "gz", "iso"), "metadata": ("opf", "nfo", "url", "ini", "log"), "html-site": ("html", "htm"),
}


def kind_of(path: Column) -> Column:
    """Kind of a file in a bundle by its extension: book, image, code, archive, metadata, html-site or unknown. HTML pages are no books there."""
    ext = extension(path)
    out = F.when(ext.isin(*KINDS["metadata"]), "metadata").when(ext.isin(*KINDS["html-site"]), "html-site").when(ext.isin("tif", "tiff"), "image").when(format_priority(ext) >= 0, "book")
    for kind in ("image", "code", "archive"):
        out = out.when(ext.isin(*KINDS[kind]), kind)
    return out.otherwise("unknown")


def bundle_markdown(files: DataFrame) -> DataFrame:
    """folder and markdown of a bundle: its main book, then the other files by kind, in order of path."""
    main = main_books(files).withColumnRenamed("path", "main")
    rest = files.join(main, "folder", "left").filter(F.col("main").isNull() | (F.col("path") != F.col("main"))).select("folder", kind_of(F.col("path")).alias("kind"), "path")
    listed = rest.groupBy("folder", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: F.concat(F.lit("- "), p)), "\n").alias("xs"))
    zones = listed.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "xs"))), lambda z: F.concat(F.lit("## "), z["kind"], F.lit("\n"), z["xs"])), "\n\n").alias("body"))
    out = files.select("folder").distinct().join(main, "folder", "left").join(zones, "folder", "left")
    return out.select("folder", F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("main", F.col("folder"))), "body").alias("markdown"))


def html_books(pages: DataFrame, least: int = 10) -> DataFrame:
    """folder, place and path of the pages of books kept as many HTML files: folders with `least` pages or more.

    Where the folder has an entry page, pages it links to come first, in the order of its links; all others follow by
    natural order of their names. pages: folder, name, content (text).
    """
    require(pages, "folder", "name", "content")
    html = pages.filter(F.lower("name").rlike(r"\.html?\z"))
    many = html.groupBy("folder").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("folder")
    mine = html.join(many, "folder")
    entry = mine.filter(F.lower("name").rlike(r"^(?:index|toc|main|start|home)\.html?\z")).groupBy("folder").agg(F.min_by("content", "name").alias("content"))
    links = entry.select("folder", F.posexplode(F.regexp_extract_all("content", F.lit(r"(?i)href\s*=\s*[\"']([^\"'#?]+)"), 1)).alias("link", "name")).groupBy("folder", "name").agg(F.min("link").alias("link"))
    placed = mine.select("folder", "name").join(links, ["folder", "name"], "left")
    order = Window.partitionBy("folder").orderBy(F.asc_nulls_last("link"), natural_key(F.col("name")), "name")
    return placed.select("folder", (F.row_number().over(order)).alias("place"), "name")


# Bounds of an archive (bytes unpacked, files, unpacked bytes per packed one).
MOST_BYTES, MOST_FILES, MOST_RATIO = 5 << 30, 5_000, 100


def unzip(archives: DataFrame, most_bytes: int = MOST_BYTES, most_files: int = MOST_FILES, most_ratio: float = MOST_RATIO) -> DataFrame:
    """archive, path, size, content and problem of the files in ZIP archives (path, content).

    Archives over a bound give one row with the problem ('bytes', 'files', 'ratio') and nothing is unpacked; what is no
    archive gives 'invalid'. Members with a path that leaves the archive are left out. Files are given one by one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = lambda **x: pd.DataFrame([{"archive": None, "path": None, "size": None, "content": None, "problem": None} | x])
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(data))
                except (zipfile.BadZipFile, TypeError):
                    yield row(archive=name, problem="invalid")
                    continue
                infos = [i for i in z.infolist() if not i.is_dir()]
                size = sum(i.file_size for i in infos)
                bad = "files" if len(infos) > most_files else "bytes" if size > most_bytes else "ratio" if size > most_ratio * max(1, len(data)) else None
                if bad:
                    yield row(archive=name, problem=bad)
                    continue
                for i in infos:
                    if not i.filename.startswith("/") and ".." not in i.filename.split("/"):
                        yield row(archive=name, path=i.filename, size=i.file_size, content=z.read(i))

    return archives.select("path", "content").mapInPandas(run, "archive string, path string, size bigint, content binary, problem string")


# What file names may not hold, and names that stand for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))


def path_segment(raw: Column, most: int = 50) -> Column:
    """A text as a path segment: composed, without forbidden and control characters, blanks as underscores, `most` characters; never empty."""
    s = F.regexp_replace(normalized(raw, "NFC"), r"[<>:\"/\\|?*\x00-\x1f\x7f]", "")
    s = F.trim(F.replace(s, F.lit(".."), F.lit(".")))
    s = F.regexp_replace(F.trim(F.regexp_replace(s, r"^\.+|\.+\z", "")), r"\s+", "_")
    s = F.when(s == "", "_unnamed").otherwise(s)
    s = F.when(F.upper(F.regexp_replace(s, r"\.[^.]+\z", "")).isin(*RESERVED), F.concat(F.lit("_"), s)).otherwise(s)
    return F.when(F.char_length(s) > most, F.coalesce(F.nullif(F.regexp_replace(F.substring(s, 1, most), r"_+\z", ""), F.lit("")), F.lit("_unnamed"))).otherwise(s)
