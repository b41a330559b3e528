"""Text of office files, which are zipped XML: documents, slides, sheets, open documents and books."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Parts = list[tuple[str, str]]  # part (sheet, slide, chapter) and text


def local(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def paragraphs(raw: bytes, block: str = "p", leaf: str = "t") -> list[str]:
    """The text of each block element; tabs and breaks within are blanks."""
    out = []
    for node in (x for x in ElementTree.fromstring(raw).iter() if local(x) == block):
        text = "".join(" " if local(x) in ("tab", "br") else (x.text or "") if local(x) == leaf else "" for x in node.iter())
        if text := re.sub(r"\s+", " ", text).strip():
            out.append(text)
    return out


def numbered(names: list[str], pattern: str) -> list[str]:
    """The names that match, by the number in them."""
    return sorted((n for n in names if re.fullmatch(pattern, n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))


def docx(book: zipfile.ZipFile) -> Parts:
    return [("", "\n".join(paragraphs(book.read("word/document.xml"))))]


def pptx(book: zipfile.ZipFile) -> Parts:
    return [(f"slide {i + 1}", "\n".join(paragraphs(book.read(n)))) for i, n in enumerate(numbered(book.namelist(), r"ppt/slides/slide\d+\.xml"))]


def opened(book: zipfile.ZipFile) -> Parts:
    """Open documents: headings and paragraphs in order."""
    out = []
    for node in ElementTree.fromstring(book.read("content.xml")).iter():
        if local(node) in ("p", "h"):
            text = re.sub(r"\s+", " ", " ".join(t for t in node.itertext() if t)).strip()
            if text:
                out.append(text)
    return [("", "\n".join(out))]


def epub(book: zipfile.ZipFile) -> Parts:
    """Chapters in the order of the book's spine."""
    box = ElementTree.fromstring(book.read("META-INF/container.xml"))
    root = next(x.attrib["full-path"] for x in box.iter() if local(x) == "rootfile")
    package = list(ElementTree.fromstring(book.read(root)).iter())
    files = {x.attrib["id"]: x.attrib["href"] for x in package if local(x) == "item"}
    out = []
    for i, ref in enumerate(x.attrib["idref"] for x in package if local(x) == "itemref"):
        raw = book.read(posixpath.normpath(posixpath.join(posixpath.dirname(root), files[ref]))).decode("utf-8", "replace")
        raw = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>", " ", raw)
        text = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)</(p|h[1-6]|li|div)>", "\n", raw))
        out.append((f"chapter {i + 1}", "\n".join(line for x in text.split("\n") if (line := re.sub(r"\s+", " ", x).strip()))))
    return out


def sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, list[list[str | None]]]]:
    """Name and rows of cells of each sheet; shared strings are looked up, gaps are null."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(si) == "si"]
    names = [x.attrib["name"] for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(x) == "sheet"]
    for name, path in zip(names, numbered(book.namelist(), r"xl/worksheets/sheet\d+\.xml")):
        rows = []
        for row in (x for x in ElementTree.fromstring(book.read(path)).iter() if local(x) == "row"):
            cells: list[str | None] = []
            for c in row:
                letters = re.match("[A-Z]*", c.attrib.get("r", ""))[0]
                at = 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                cells += [None] * ((at or len(cells) + 1) - 1 - len(cells))
                text = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                cells.append(shared[int(text)] if c.attrib.get("t") == "s" and text else text or None)
            rows.append(cells)
        yield name, rows


def xlsx(book: zipfile.ZipFile) -> Parts:
    """A sentence `head: value, ...` for each row but the first, which has the heads; a column without one is `col` and its number from 0."""
    out = []
    for name, rows in sheets(book):
        heads = rows[0] if rows else []
        for row in rows[1:]:
            said = [f"{(heads[j] if j < len(heads) else None) or f'col{j}'}: {v}" for j, v in enumerate(row) if v is not None and v.strip()]
            if said:
                out.append((name, ", ".join(said)))
    return out


FORMATS: dict[str, Callable[[zipfile.ZipFile], Parts]] = {".docx": docx, ".pptx": pptx, ".xlsx": xlsx, ".odt": opened, ".odp": opened, ".epub": epub}


def office_parts(name: str, raw: bytes) -> Parts:
    """A file that is damaged, or of another kind than its name says, has no parts."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as book:
            return FORMATS[name[name.rfind(".") :].lower()](book)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, IndexError, ValueError):
        return []


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """path, part, seq, text: a row for each document, slide, chapter, or row of a sheet. Files are read an Arrow batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, part, seq, text) for p, raw in zip(pdf["path"], pdf["content"]) for seq, (part, text) in enumerate(office_parts(p, bytes(raw)))]
            yield pd.DataFrame(rows, columns=["path", "part", "seq", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = F.concat(F.lit("."), F.lower(F.element_at(F.split("path", r"\."), -1))).isin(*FORMATS)
    return files.where(known).select("path", "content").mapInPandas(run, "path string, part string, seq int, text string")


def read_scratchpads(spark: SparkSession, path: str) -> DataFrame:
    """session, started, ended, notes of sessions that have ended, from JSON files; those that cannot be read are passed over."""
    schema = "session string, started string, ended string, notes array<string>, _bad string"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and ended is not null").select("session", "started", "ended", "notes")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph store; edges without both ends go."""
    nodes, edges = (spark.read.parquet(f"{folder}/{t}") for t in ("nodes", "edges"))
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)
