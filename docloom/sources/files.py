"""File sources: dispatch by extension, charset, text, delimited, JSON, HTML, Markdown, mail and office containers.

Bytes come from Spark's ``binaryFile`` source; parsers run on Arrow batches of (path, content) and give rows of
(path, section_no, kind, text). Formats that need models (scanned pages, images, sound) take an injected function.
"""

from __future__ import annotations

import email
import email.policy
import html
import io
import json
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extension patterns by format, tried in order.
FORMATS = [
    ("docx", r"(?i)\.docx$"), ("pdf", r"(?i)\.pdf$"), ("xlsx", r"(?i)\.xlsx?$"), ("pptx", r"(?i)\.pptx?$"), ("csv", r"(?i)\.(csv|tsv)$"), ("markdown", r"(?i)\.(md|markdown|mdx)$"), ("html", r"(?i)\.html?$"),
    ("json", r"(?i)\.(json|jsonl|ldjson)$"), ("eml", r"(?i)\.eml$"), ("image", r"(?i)\.(png|jpe?g|gif|bmp|webp|tiff?)$"), ("audio", r"(?i)\.(mp3|wav|flac|ogg|m4a)$"), ("text", r"(?i)\.(txt|py|js|java|c|cpp|h|php|go|ts|sh|cs|kt|sql)$"),
]
CODECS = ["utf-8", "gb18030", "utf-16", "big5", "shift_jis", "euc-kr", "cp1252", "latin-1"]


def format_of(path: Column | str) -> Column:
    """Format name of a path by its extension; null where none is known."""
    p = F.col(path) if isinstance(path, str) else path
    out = None
    for name, pattern in FORMATS:
        out = F.when(p.rlike(pattern), name) if out is None else out.when(p.rlike(pattern), name)
    return out


def decode(raw: bytes) -> str:
    """Text of bytes in an unknown charset: byte-order marks first, then the first codec that decodes."""
    if raw[:3] == b"\xef\xbb\xbf":
        return raw[3:].decode("utf-8", "replace")
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for c in CODECS:
        if c == "utf-16":
            continue
        try:
            return raw.decode(c)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def html_text(text: Column | str) -> Column:
    """Readable lines of HTML: title first, scripts and styles dropped, block ends as line breaks, entities resolved."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.regexp_replace(t, r"(?is)<(script|style|head)\b.*?</\1>", "")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/table|/td)[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for name, value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


MD_TABLE = r"(?m)^(?:\|[^\n]*\|[ \t]*(?:\n|$)){2,}"
HTML_TABLE = r"(?is)<table\b.*?</table>"


def markdown_tables(text: Column | str) -> tuple[Column, Column]:
    """(tables, remainder): bordered and HTML tables, and the text without them."""
    t = F.col(text) if isinstance(text, str) else text
    found = F.concat(F.regexp_extract_all(t, F.lit(MD_TABLE), F.lit(0)), F.regexp_extract_all(t, F.lit(HTML_TABLE), F.lit(0)))
    return found, F.regexp_replace(F.regexp_replace(t, MD_TABLE, "\n"), HTML_TABLE, "\n")


def image_urls(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(t, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def is_jsonl(text: Column | str, share: float = 0.8, look: int = 10) -> Column:
    """The whole is no JSON value, and of its first non-blank lines at least ``share`` are."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.slice(F.filter(F.split(t, "\n"), lambda x: F.trim(x) != ""), 1, look)
    good = F.size(F.filter(lines, lambda x: F.try_parse_json(x).isNotNull()))
    # the parser stops after a first complete value, so several lines that begin with one are no single document
    whole = F.try_parse_json(t).isNotNull() & ((F.size(lines) <= 1) | F.try_parse_json(F.get(lines, F.lit(0))).isNull())
    return ~whole & (F.size(lines) > 0) & (good >= share * F.size(lines))


def split_json(value, most: int = 2000, least: int | None = None) -> list:
    """Nested JSON dealt into objects of about ``most`` characters, keeping key paths and order; lists become index maps.

    Sizes are reckoned once, from the leaves up. The largest parts that fit are the units; they fill objects in order, and an object is
    closed by the first unit that does not fit once it has ``least`` characters.
    """
    least = max(most - 200, 50) if least is None else least
    width = lambda v: len(json.dumps(v, ensure_ascii=False))

    def sized(v) -> tuple:
        """(size, value, children or None); children are (key, node)."""
        pairs = list(v.items()) if isinstance(v, dict) else [(str(i), x) for i, x in enumerate(v)] if isinstance(v, list) else None
        if not pairs:
            return (2, {}, None) if pairs == [] else (width(v), v, None)
        nodes = [(k, sized(x)) for k, x in pairs]
        return 2 + sum(width(k) + 4 + n[0] for k, n in nodes), {k: n[1] for k, n in nodes}, nodes

    units, todo = [], [((), sized(value))]
    while todo:
        path, (size, plain, nodes) = todo.pop()
        if nodes and (size > most or not path):
            todo.extend(((*path, k), n) for k, n in reversed(nodes))
        elif path or nodes is None and plain != {}:
            units.append((path or ("value",), plain, size + sum(width(k) + 4 for k in path)))
    filled, out = 0, [{}]
    for path, plain, size in units:
        if filled + size > most and filled >= least:
            out.append({})
            filled = 0
        at = out[-1]
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = plain
        filled += size
    return [c for c in out if c]


def mail_parts(raw: bytes) -> list[tuple[str, str]]:
    """(kind, text) of a mail: headers, text parts, HTML parts as text, names of attachments."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    out = [("header", f"{k}: {v}") for k, v in m.items()]
    for part in m.walk():
        if part.is_multipart():
            continue
        if part.get_filename():
            out.append(("attachment", part.get_filename()))
        elif part.get_content_type() == "text/plain":
            out.append(("text", part.get_content().strip()))
        elif part.get_content_type() == "text/html":
            out.append(("text", html.unescape(re.sub(r"(?s)<[^>]+>", " ", part.get_content())).strip()))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def docx_parts(raw: bytes) -> list[tuple[str, str]]:
    """Paragraphs with their style, and tables as 'header: value' lines, in document order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")
    out = []
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            if text(e).strip():
                out.append((style.get(f"{_W}val", "paragraph") if style is not None else "paragraph", text(e)))
        elif e.tag == f"{_W}tbl":
            rows = [[text(c).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            for r in rows[1:] or rows:
                out.append(("table", "; ".join(f"{h}: {v}" if h else v for h, v in zip(rows[0], r) if v)))
    return out


def xlsx_rows(raw: bytes) -> list[tuple[str, str]]:
    """(sheet, 'header: value; ...') for every row below the first of each sheet."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    out = []
    for name in sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", n)):
        head: dict[str, str] | None = None
        for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
            cells = {}
            for c in row.iter(f"{_S}c"):
                v = c.find(f"{_S}v")
                value = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                cells[re.sub(r"\d", "", c.get("r", ""))] = shared[int(value)] if c.get("t") == "s" and value else value
            if head is None:
                head = cells
            elif any(cells.values()):
                out.append((name, "; ".join(f"{head.get(k) or k}: {v}" for k, v in cells.items() if v)))
    return out


def pptx_slides(raw: bytes) -> list[tuple[str, str]]:
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    return [("slide", "\n".join(t for t in ("".join(x.text or "" for x in p.iter(f"{_A}t")) for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p")) if t.strip())) for n in names]


def json_parts(raw: bytes) -> list[tuple[str, str]]:
    text = decode(raw)
    try:
        values = [json.loads(text)]
    except ValueError:
        values = []
        for line in text.split("\n"):
            try:
                values.append(json.loads(line))
            except ValueError:
                continue
    return [("json", json.dumps(c, ensure_ascii=False)) for v in values for c in split_json(v)]


PARSERS: dict[str, Callable[[bytes], list[tuple[str, str]]]] = {"docx": docx_parts, "xlsx": xlsx_rows, "pptx": pptx_slides, "eml": mail_parts, "json": json_parts}


def parse(files: DataFrame, hooks: dict[str, Callable[[bytes], list[tuple[str, str]]]] | None = None) -> DataFrame:
    """files (path, content) -> (path, section_no, kind, text). ``hooks`` parse formats that need a model (pdf, image, audio).

    Files that cannot be parsed give one row of kind 'error' with the reason; unknown extensions are read as text.
    """
    parsers = {**PARSERS, **(hooks or {})}

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind = next((n for n, p in FORMATS if re.search(p, path)), "text")
                try:
                    parts = parsers[kind](raw or b"") if kind in parsers else [("line", x) for x in decode(raw or b"").split("\n")]
                except Exception as e:
                    parts = [("error", f"{type(e).__name__}: {e}")]
                for i, (k, t) in enumerate(parts):
                    for col, v in zip(cols, (path, i, k, t)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["path", "section_no", "kind", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, section_no int, kind string, text string")


def row_counts(files: DataFrame) -> DataFrame:
    """(path, n_rows): rows of spreadsheets over all sheets, lines of anything else; -1 where a file cannot be read."""

    def run(batches):
        for b in batches:
            n = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    z = zipfile.ZipFile(io.BytesIO(raw)) if re.search(r"(?i)\.xlsx?$", path) else None
                    n.append(len((decode(raw or b"")).split("\n")) if z is None else sum(sum(1 for _ in ElementTree.fromstring(z.read(s)).iter(f"{_S}row")) for s in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml$", s)))
                except Exception:
                    n.append(-1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["path", "n_rows"])

    return files.select("path", "content").mapInArrow(run, "path string, n_rows bigint")


def read_files(spark: SparkSession, path: str, glob: str = "*", **hooks) -> DataFrame:
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path), hooks or None)


def read_delimited(spark: SparkSession, path: str, schema: str, separator: str = "\t") -> DataFrame:
    """Header line, rows of another width dropped."""
    return spark.read.csv(path, sep=separator, header=True, schema=schema, mode="DROPMALFORMED")


def web_hits(df: DataFrame, content: str, score: str, most: int = 10_000) -> DataFrame:
    """Web results as chunks: inline images dropped, cut to ``most`` characters, id by hash, score 1 where missing."""
    text = F.substring(F.regexp_replace(content, r"!?\[[^\]]*\]\(data:[^)]*\)", ""), 1, most)
    return df.withColumn(content, text).withColumn("chunk_id", F.md5(content)).withColumn(score, F.coalesce(F.col(score), F.lit(1.0)))


def marco_passages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages, relevance) of rows (query_id, query, passages struct of is_selected[] and passage_text[])."""
    rows = df.select("query_id", "query", F.explode(F.arrays_zip("passages.is_selected", "passages.passage_text")).alias("p")).select("query_id", F.md5("p.passage_text").alias("doc_id"), F.col("p.passage_text").alias("text"), F.col("p.is_selected").alias("rel"))
    return rows.select("doc_id", "text").distinct(), rows.where("rel > 0").select("query_id", "doc_id").distinct()
