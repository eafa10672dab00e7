"""Archives and office files from their bytes: entries of zip files with sizes, documents as Markdown."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from .tables import table

# The namespace of word-processing documents, and the parts of a minimal one.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Bytes that one entry may unfold to; beyond, it is listed but not read.
MOST = 64 << 20


def pack(files: dict[str, bytes]) -> bytes:
    """A zip archive of the files; the same bytes for the same files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(files.items()):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def entries(data: bytes | None) -> list[tuple[str, int, int]]:
    """(name, size, packed size) of an archive's files; none for what is no archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            return [(i.filename, i.file_size, i.compress_size) for i in z.infolist() if not i.is_dir()]
    except zipfile.BadZipFile:
        return []


def unpack(data: bytes) -> dict[str, bytes]:
    """The files of an archive by name; absolute names, names that lead outside, and files over MOST bytes are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {i.filename: z.read(i) for i in z.infolist() if not i.is_dir() and i.file_size <= MOST and not i.filename.startswith("/") and ".." not in i.filename.split("/")}


def _text(node: ElementTree.Element) -> str:
    out = []
    for run in node.iter(f"{_W}r"):
        words = "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in run if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        marks = run.find(f"{_W}rPr")
        if words.strip() and marks is not None:
            words = f"**{words}**" if marks.find(f"{_W}b") is not None else f"*{words}*" if marks.find(f"{_W}i") is not None else words
        out.append(words)
    return "".join(out).strip()


def docx_to_markdown(data: bytes | None) -> str | None:
    """Headings, lists, bold and italic runs, and tables (first row as head) of a document; null for what is none."""
    try:
        root = ElementTree.fromstring(unpack(data or b"")["word/document.xml"])
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    out = []
    for node in root.find(f"{_W}body") or ():
        if node.tag == f"{_W}tbl":
            rows = [[_text(c).replace("|", "\\|").replace("\n", " ") for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            lines = [f"| {' | '.join(r)} |" for r in rows]
            out.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]) if rows else "")
        elif node.tag == f"{_W}p":
            marks = node.find(f"{_W}pPr")
            style = marks.find(f"{_W}pStyle") if marks is not None else None
            name = style.get(f"{_W}val", "") if style is not None else ""
            listed = marks is not None and marks.find(f"{_W}numPr") is not None
            head = "#" * min(6, int(name[7:])) + " " if name.startswith("Heading") and name[7:].isdigit() else "# " if name == "Title" else "- " if listed else ""
            out.append(head + _text(node) if _text(node) else "")
    return "\n\n".join(x for x in out if x)


def zip_entries(files: DataFrame) -> DataFrame:
    """(path, name, size, packed) of the archives among files (path, content), as the binaryFile source gives them."""
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(p, *e) for p, c in zip(pdf["path"], pdf["content"]) for e in entries(c)], columns=["path", "name", "size", "packed"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, size long, packed long")


def _made(spark: SparkSession, sf_dir: str, build, schema: str) -> DataFrame:
    ship(spark)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"path": pdf["item_id"].astype(str), "content": [build(i, t) for i, t in zip(pdf["item_id"], pdf["text"])]})

    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(run, schema)


def q_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of each passage and its first 10 bytes, listed; every seventh is no archive."""
    files = _made(spark, sf_dir, lambda i, t: b"no archive" if i % 7 == 0 else pack({"all.txt": t.encode(), "head/ten.txt": t.encode()[:10]}), "path string, content binary")
    return zip_entries(files).select(F.col("path").cast("long").alias("item_id"), "name", "size")


def _document(i: int, text: str) -> bytes:
    w = _W[1:-1]
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    p = lambda s, style="": f"<w:p>{style}<w:r><w:t>{esc(s)}</w:t></w:r></w:p>"
    head = '<w:pPr><w:pStyle w:val="Heading2"/></w:pPr>'
    cells = "".join(f"<w:tr><w:tc>{p(a)}</w:tc><w:tc>{p(b)}</w:tc></w:tr>" for a, b in (("k", "v"), ("n", str(len(text)))))
    words = " ".join(text.split())
    return pack({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{p(f"No {i}", head)}{p(words)}<w:tbl>{cells}</w:tbl></w:body></w:document>'.encode()})


def q_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage as an office document, read as Markdown."""
    read = F.pandas_udf(lambda s: s.map(docx_to_markdown), "string")
    return _made(spark, sf_dir, _document, "path string, content binary").select(F.col("path").cast("long").alias("item_id"), F.md5(read("content").cast("binary")).alias("digest"))


QUERIES = {"a21_zip_entries": q_zip, "a20_docx_to_markdown": q_docx}
ORACLES = {
    "a21_zip_entries": "SELECT item_id, 'all.txt' AS name, strlen(text) AS size FROM benchmark WHERE item_id % 7 <> 0 UNION ALL SELECT item_id, 'head/ten.txt', least(10, strlen(text)) FROM benchmark WHERE item_id % 7 <> 0",
    "a20_docx_to_markdown": r"SELECT item_id, md5('## No ' || item_id || chr(10) || chr(10) || trim(regexp_replace(text, '\s+', ' ', 'g')) || chr(10) || chr(10) || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| n | ' || length(text) || ' |') AS digest FROM benchmark",
}
