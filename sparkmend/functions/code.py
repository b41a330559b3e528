"""Code in texts: is it code, its symbols, its comments that give reasons, identifiers."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = r"\b(def|class|return|import|from|if|else|for|while|function|const|let|var|public|private|static|void|int|try|except|catch|new)\b"
# One pattern for each kind of definition, over languages that name it alike.
DEFINITIONS = (
    ("function", re.compile(r"^\s*(?:pub\s+|export\s+|async\s+|static\s+)*(?:def|fn|func|function|sub|proc)\s+([A-Za-z_]\w*)")),
    ("class", re.compile(r"^\s*(?:pub\s+|export\s+|abstract\s+|public\s+|final\s+)*(?:class|struct|trait|interface|enum|module)\s+([A-Za-z_]\w*)")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\(?[^=]*=>")),
)
REASON = re.compile(r"(?:#|//|--|/\*)\s*(NOTE|WHY|TODO|FIXME|HACK)\b[:\s]*(.{8,})")
SYMBOLS = "path string, symbol string, kind string, lineno int, text string"


def is_code(text: Column) -> Column:
    """Many lines with keywords, or many symbols and indented lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    n = F.greatest(F.size(lines), F.lit(1))
    hits = F.size(F.filter(lines, lambda x: x.rlike(KEYWORDS))) / n
    marks = F.length(F.regexp_replace(text, r"[^{}()\[\];=<>:+*/&|!]", "")) / F.greatest(F.length(text), F.lit(1))
    indented = F.size(F.filter(lines, lambda x: x.rlike(r"^(\t| {2,})\S"))) / n
    return F.coalesce((hits > 0.25) & (marks > 0.02) | (marks > 0.12) & (indented > 0.3), F.lit(False))


def identifiers(text: Column, k: int = 8) -> Column:
    """Names defined or called, longer than three letters, not private; sorted, the first k."""
    names = F.regexp_extract_all(text, F.lit(r"\b(?:def\s+|class\s+)?([A-Za-z]\w{3,})\s*\("), F.lit(1))
    return F.slice(F.array_sort(F.array_distinct(names)), 1, k)


def file_symbols(path: str, text: str, longest: int = 2500) -> list[tuple[str, str, str, int, str]]:
    """Definitions and reasons of one file; Python by its syntax tree, others by patterns."""
    out, lines = [], text.split("\n")
    if path.endswith(".py"):
        try:
            for node in ast.walk(ast.parse(text)):
                if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    body = "\n".join(lines[node.lineno - 1 : node.end_lineno])[:longest]
                    out.append((path, node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, body))
        except (SyntaxError, ValueError, RecursionError):
            out = []
    if not out:
        for i, line in enumerate(lines, 1):
            for kind, pattern in DEFINITIONS:
                if m := pattern.match(line):
                    out.append((path, m[1], kind, i, "\n".join(lines[i - 1 : i + 20])[:longest]))
                    break
    out += [(path, m[1].upper(), "reason", i, m[2].strip()) for i, line in enumerate(lines, 1) if (m := REASON.search(line))]
    return out


def symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [s for p, t in zip(pdf["path"], pdf["text"]) for s in file_symbols(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", "symbol", "kind", "lineno", "text"])

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, SYMBOLS)


def segments(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, seq, kind, text: fenced blocks are code, the rest is prose; in order, empty ones left out."""
    parts = F.split(text, "```")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("seq", "__p"))
    kind = F.when(F.col("seq") % 2 == 1, "code").otherwise("prose")
    body = F.trim(F.when(F.col("seq") % 2 == 1, F.regexp_replace("__p", r"^[A-Za-z0-9_+-]*\n", "")).otherwise(F.col("__p")))
    return rows.select("doc_id", "seq", kind.alias("kind"), body.alias("text")).where("text <> ''")
