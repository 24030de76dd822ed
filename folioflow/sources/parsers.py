"""Book files to sections: text decoding, magic bytes, and parsers for TXT, HTML, FB2, EPUB, DOCX, ODT, RTF and PalmDoc.

binaryFile rows go through one Arrow function that picks the parser by extension; every parser is plain Python on bytes.
"""

from __future__ import annotations

import html
import io
import re
import struct
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


Section = tuple[int, str | None, list[str]]
PARSED_DDL = "struct<title:string,author:string,language:string,sections:array<struct<level:int,title:string,paragraphs:array<string>>>,warning:string>"

# Signatures of file kinds.
MAGIC = {"pdf": b"%PDF-", "zip": b"PK\x03\x04", "djvu": b"AT&TFORM", "rtf": b"{\\rtf", "ole": b"\xd0\xcf\x11\xe0", "7z": b"7z\xbc\xaf\x27\x1c", "rar": b"Rar!", "png": b"\x89PNG", "jpeg": b"\xff\xd8\xff", "gzip": b"\x1f\x8b", "chm": b"ITSF"}
# Which signature an extension needs.
EXPECTED = {"pdf": "pdf", "epub": "zip", "docx": "zip", "odt": "zip", "cbz": "zip", "djvu": "djvu", "rtf": "rtf", "doc": "ole", "chm": "chm", "7z": "7z", "rar": "rar"}
#: Limits of an archive: bytes in all, files, and times its own size.
ARCHIVE_BYTES, ARCHIVE_FILES, ARCHIVE_RATIO = 5 << 30, 5000, 100


def kind_of(head: bytes) -> str | None:
    return next((k for k, m in MAGIC.items() if head.startswith(m)), None)


def kind_column(content: Column) -> Column:
    """Kind by signature as a CASE over the first bytes, inside the JVM."""
    first = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for k, m in reversed(MAGIC.items()):
        out = F.when(first.startswith(m.hex().upper()), F.lit(k)).otherwise(out)
    return out


def extension_agrees(extension: Column, content: Column) -> Column:
    want = F.lit(None).cast("string")
    for e, k in EXPECTED.items():
        want = F.when(F.lower(extension) == e, F.lit(k)).otherwise(want)
    return want.isNull() | (want == F.coalesce(kind_column(content), F.lit("")))


def uniform(data: bytes, sample: int = 4096) -> bool:
    """Whether a file is padding: four samples each hold at most two different bytes and begin with the same one."""
    if len(data) < 4 * sample:
        return False
    parts = [data[at : at + sample] for at in (0, len(data) // 4, 3 * len(data) // 4, len(data) - sample)]
    return all(len(set(p)) <= 2 for p in parts) and len({p[0] for p in parts}) == 1


def decode(data: bytes, hint: str | None = None) -> str:
    """Byte-order mark, then a declaration, then strict UTF-8, then the hint, then the likelier of cp1251, koi8-r and cp1252."""
    for mark, cs in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(cs, "replace")
    m = re.search(rb"(?:encoding|charset)\s*=\s*[\"']?([\w-]+)", data[:1024], re.I)
    for cs in (m[1].decode("ascii") if m else None, "utf-8", hint):
        if cs:
            try:
                return data.decode(cs)
            except (UnicodeDecodeError, LookupError):
                continue
    texts = [data.decode(cs, "replace") for cs in ("cp1251", "koi8-r", "cp1252")]
    cyrillic = lambda t: sum("а" <= c <= "я" for c in t) - sum("А" <= c <= "Я" for c in t)
    high = sum(b >= 0x80 for b in data)
    return max(texts[:2], key=cyrillic) if high * 4 > len(data) else texts[2]


def looks_like_heading(line: str) -> bool:
    s = line.strip()
    if not 3 <= len(s) <= 80 or s[-1] in ".,;:!?":
        return False
    words = [w for w in s.split() if len(w) > 3]
    titled = bool(words) and sum(w[0].isupper() for w in words) * 10 >= 6 * len(words)
    return bool(re.match(r"(?i)(?:chapter|part|section|глава|часть|раздел|kapitel|chapitre)\s|\d+(?:\.\d+)*\.?\s+\S", s)) or s.isupper() or titled


def parse_txt(data: bytes) -> dict:
    sections: list[Section] = []
    title: str | None = None
    paragraphs: list[str] = []
    for block in re.split(r"\r?\n\s*\r?\n", decode(data)):
        lines = [x.strip() for x in block.splitlines() if x.strip()]
        if len(lines) == 1 and looks_like_heading(lines[0]):
            if paragraphs or title:
                sections.append((1, title, paragraphs))
            title, paragraphs = lines[0], []
        elif lines:
            paragraphs.append(" ".join(lines))
    if paragraphs or title:
        sections.append((1, title, paragraphs))
    return {"sections": merged_headings(sections)}


def merged_headings(sections: list[Section]) -> list[Section]:
    """Sections without text give their titles to the next one with text, or at the end to the last one."""
    out: list[Section] = []
    waiting: list[str] = []
    for level, title, paragraphs in sections:
        if paragraphs:
            names = [t for t in (*waiting, title) if t]
            out.append((level, " / ".join(names) or None, paragraphs))
            waiting = []
        elif title:
            waiting.append(title)
    if waiting and out:
        level, title, paragraphs = out[-1]
        out[-1] = (level, " / ".join([*([title] if title else []), *waiting]), paragraphs)
    return out or ([(1, " / ".join(waiting), [])] if waiting else [])


def strip_tags(markup: str) -> str:
    t = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", markup)
    t = re.sub(r"(?i)<br\s*/?>", "\n", t)
    return re.sub(r"[ \t\xa0]+", " ", html.unescape(re.sub(r"<[^>]*>", "", t))).strip()


def parse_html(data: bytes) -> dict:
    t = decode(data)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", t)
    body = re.search(r"(?is)<body[^>]*>(.*)</body>", t)
    sections: list[Section] = []
    now: list = [1, None, []]
    for m in re.finditer(r"(?is)<(h[1-6]|p|li|blockquote|pre|td)\b[^>]*>(.*?)(?=</\1>|<(?:h[1-6]|p|li|blockquote|pre|td)\b|\Z)", body[1] if body else t):
        text = strip_tags(m[2])
        if not text:
            continue
        if m[1].lower()[0] == "h":
            if now[1] or now[2]:
                sections.append(tuple(now))
            now = [min(int(m[1][1]), 3), text, []]
        else:
            now[2].append(text)
    if now[1] or now[2]:
        sections.append(tuple(now))
    if not sections and len(plain := strip_tags(body[1] if body else t)) > 50:
        sections = [(1, None, [plain])]
    return {"title": strip_tags(title[1]) if title else None, "sections": sections}


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _text(e: ElementTree.Element) -> str:
    return re.sub(r"\s+", " ", "".join(e.itertext())).strip()


def parse_fb2(data: bytes) -> dict:
    root = ElementTree.fromstring(data)
    find = lambda name: next((e for e in root.iter() if _name(e) == name), None)
    author = find("author")
    title, lang = find("book-title"), find("lang")
    sections: list[Section] = []

    def walk(e: ElementTree.Element, level: int) -> None:
        head = next((_text(c) for c in e if _name(c) == "title"), None)
        ps = [_text(c) for c in e if _name(c) in ("p", "subtitle", "cite", "poem")]
        if head or ps:
            sections.append((min(level, 3), head, [p for p in ps if p]))
        for c in e:
            if _name(c) == "section":
                walk(c, level + 1)

    for b in root.iter():
        if _name(b) == "body":
            walk(b, 1)
    who = " ".join(_text(c) for c in author if _name(c) in ("first-name", "middle-name", "last-name")) if author is not None else None
    return {"title": _text(title) if title is not None else None, "author": who or None, "language": _text(lang) if lang is not None else None, "sections": sections}


def _members(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    total = sum(i.file_size for i in infos)
    if len(infos) > ARCHIVE_FILES or total > ARCHIVE_BYTES or total > ARCHIVE_RATIO * max(len(data), 1 << 16):
        raise ValueError("archive beyond its limits")
    return z


def parse_epub(data: bytes) -> dict:
    z = _members(data)
    container = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.attrib["full-path"] for e in container.iter() if _name(e) == "rootfile")
    package = ElementTree.fromstring(z.read(opf))
    base = opf.rpartition("/")[0]
    get = lambda n: next((_text(e) for e in package.iter() if _name(e) == n), None)
    items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if _name(e) == "item"}
    sections: list[Section] = []
    for ref in (e.attrib["idref"] for e in package.iter() if _name(e) == "itemref"):
        path = f"{base}/{items[ref]}" if base else items[ref]
        if path in z.namelist():
            sections += parse_html(z.read(path))["sections"]
    return {"title": get("title"), "author": get("creator"), "language": get("language"), "sections": sections}


def _styled(paragraphs: list[tuple[int, str]]) -> list[Section]:
    out: list[Section] = []
    now: list = [1, None, []]
    for level, t in paragraphs:
        if level:
            if now[1] or now[2]:
                out.append(tuple(now))
            now = [min(level, 3), t, []]
        elif t:
            now[2].append(t)
    if now[1] or now[2]:
        out.append(tuple(now))
    return out


def parse_docx(data: bytes) -> dict:
    root = ElementTree.fromstring(_members(data).read("word/document.xml"))
    ps = []
    for p in (e for e in root.iter() if _name(e) == "p"):
        style = next((v for e in p.iter() if _name(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "")
        m = re.match(r"(?i)heading\s*(\d)", style)
        ps.append((int(m[1]) if m else 0, _text(p)))
    return {"sections": _styled(ps)}


def parse_odt(data: bytes) -> dict:
    root = ElementTree.fromstring(_members(data).read("content.xml"))
    ps = [(int(next((v for k, v in e.attrib.items() if k.endswith("outline-level")), 1)) if _name(e) == "h" else 0, _text(e)) for e in root.iter() if _name(e) in ("h", "p")]
    return {"sections": _styled(ps)}


def parse_rtf(data: bytes) -> dict:
    t = data.decode("latin-1")
    cs = re.search(r"\\ansicpg(\d+)", t)
    charset = f"cp{cs[1]}" if cs else "cp1252"
    t = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{[^{}]*\})*\}", "", t)
    t = re.sub(r"\\u(-?\d+)\s?\??", lambda m: f"&#{int(m[1]) % 65536};", t)
    t = re.sub(r"(?:\\'[0-9a-fA-F]{2})+", lambda m: html.escape(bytes.fromhex(m[0].replace("\\'", "")).decode(charset, "replace")), t)
    t = re.sub(r"\\(?:par|line)\b ?", "\n", t)
    t = html.unescape(re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", t))
    return {"sections": [(1, None, [x.strip() for x in t.splitlines() if x.strip()])]}


def palm_decompress(data: bytes) -> bytes:
    """PalmDoc's byte-pair scheme: literals, runs, back references of 3 to 10 bytes, and blank plus character."""
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = (c << 8 | data[i]) & 0x3FFF
            i += 1
            distance, length = pair >> 3, (pair & 7) + 3
            for _ in range(length):
                out.append(out[-distance] if 0 < distance <= len(out) else 0x20)
    return bytes(out)


def parse_palm(data: bytes) -> dict:
    n = struct.unpack(">H", data[76:78])[0]
    starts = [struct.unpack(">I", data[78 + 8 * i : 82 + 8 * i])[0] for i in range(n)] + [len(data)]
    head = data[starts[0] : starts[1]]
    kind, _, _, records = struct.unpack(">HHIH", head[:10])
    charset = "utf-8" if head[16:20] == b"MOBI" and struct.unpack(">I", head[28:32])[0] == 65001 else "cp1252"
    if kind not in (1, 2):
        raise ValueError("compression that can't be read")
    raw = b"".join((palm_decompress if kind == 2 else bytes)(data[starts[i] : starts[i + 1]]) for i in range(1, min(records, n - 1) + 1))
    parsed = parse_html(raw.decode(charset, "replace").encode())
    return {"title": data[:32].split(b"\0")[0].decode("latin-1"), "sections": parsed["sections"]}


PARSERS = {"txt": parse_txt, "html": parse_html, "htm": parse_html, "xhtml": parse_html, "fb2": parse_fb2, "epub": parse_epub, "docx": parse_docx, "odt": parse_odt, "rtf": parse_rtf, "mobi": parse_palm, "prc": parse_palm, "azw": parse_palm, "pdb": parse_palm}


def parse(data: bytes | None, extension: str | None) -> dict:
    """A parsed book; a file that can't be read gives no sections and says why."""
    empty = {"title": None, "author": None, "language": None, "sections": [], "warning": None}
    fn = PARSERS.get((extension or "").lower())
    if not data or fn is None:
        return empty | {"warning": "empty file" if fn else "no parser"}
    try:
        return empty | fn(data)
    except Exception as e:  # noqa: BLE001  (any damage in a file is that file's warning)
        return empty | {"warning": f"{type(e).__name__}: {e}"[:200]}


def read_books(spark: SparkSession, path: str, least_bytes: int = 0) -> DataFrame:
    """path, length and the parsed book of every supported file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = files.filter(ext.isin(*PARSERS) & (F.col("length") >= least_bytes))
    run = F.udf(lambda d, e: parse(bytes(d) if d is not None else None, e), PARSED_DDL, useArrow=True)
    return known.select("path", "length", run("content", ext).alias("book"))


def front_matter(text: str | None) -> dict[str, str]:
    """Keys of a front matter between --- lines; quotes and escapes are undone, nested values are left out."""
    m = re.match(r"---\r?\n(.*?)\r?\n---", text or "", re.S)
    out = {}
    for line in (m[1] if m else "").splitlines():
        k = re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line)
        if k and k[2]:
            v = k[2].strip()
            out[k[1]] = re.sub(r"\\(.)", r"\1", v[1:-1]) if len(v) > 1 and v[0] == v[-1] == '"' else v
    return out


_FILE = (r"^(?P<author>[^-–—]+?)\s+[-–—]\s+(?P<title>.+?)\s*\((?P<year>(?:1[5-9]|20)\d\d)\)$", r"^(?P<author>[^-–—]+?)\s+[-–—]\s+(?P<year>(?:1[5-9]|20)\d\d)\s+[-–—]\s+(?P<title>.+)$", r"^(?P<title>.+?)\s*\((?P<author>[^()]+?),\s*(?P<year>(?:1[5-9]|20)\d\d)\)$", r"^(?P<author>[^-–—]+?)\s+[-–—]\s+(?P<title>.+)$", r"^(?P<title>.+?)\s*\((?P<year>(?:1[5-9]|20)\d\d)\)$")


def file_name_fields(path: str) -> dict[str, str]:
    """author, title and year as a file's name gives them; the first form that fits counts."""
    stem = re.sub(r"[_]+", " ", path.rsplit("/", 1)[-1].rpartition(".")[0] or path).strip()
    for p in _FILE:
        if m := re.match(p, stem):
            return {k: v.strip() for k, v in m.groupdict().items()}
    return {"title": stem}
