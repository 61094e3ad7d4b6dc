"""Source files to chunks: Python by its syntax tree, JavaScript by its tokens, anything else in line windows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.javascript import Source

WINDOW, OVERLAP = 80, 12
CHUNK = "path string, language string, chunk_type string, symbol string, parent_symbol string, start_line int, end_line int, text string, imports array<string>, exports array<string>, calls array<struct<name:string,raw:string,line:int,column:int>>, referenced_identifiers array<string>"


def windows(docs: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """docs (id, text) to (id, symbol, start_line, end_line, text), native line windows that end with the text."""
    step = max(1, size - overlap)
    lines = F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1)
    rows = docs.select("id", lines.alias("lines")).withColumn("n", F.size("lines"))
    last = (F.ceil(F.greatest(F.lit(0), F.col("n") - size) / F.lit(step)) * step).cast("int")
    rows = rows.select("id", "lines", "n", F.posexplode(F.sequence(F.lit(0), last, F.lit(step))).alias("k", "at"))
    end = F.least(F.col("at") + size, F.col("n")).cast("int")
    return rows.select("id", F.format_string("window_%04d", F.col("k") + 1).alias("symbol"), (F.col("at") + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", F.col("at") + 1, F.lit(size)), "\n").alias("text"))


def python_chunks(source: str) -> list[tuple]:
    """(type, symbol, parent, first line, last line, text) of leading imports, functions, classes and methods."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines = source.split("\n")
    cut = lambda a, b: "\n".join(lines[a - 1 : b])
    out, imports = [], []
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            imports.append(node)
        elif not (isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)):
            break
    if imports:
        a, b = imports[0].lineno, imports[-1].end_lineno
        out.append(("imports", "<module_imports>", None, a, b, cut(a, b)))
    name = {ast.FunctionDef: "", ast.AsyncFunctionDef: "async_"}
    for node in tree.body:
        if type(node) in name:
            out.append((name[type(node)] + "function", node.name, None, node.lineno, node.end_lineno, cut(node.lineno, node.end_lineno)))
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if type(m) in name]
            hidden = {i for m in methods for i in range(m.lineno + 1, m.end_lineno + 1)}
            body = "\n".join(lines[i - 1] for i in range(node.lineno, node.end_lineno + 1) if i not in hidden)
            out.append(("class", node.name, None, node.lineno, node.end_lineno, body))
            out += [(name[type(m)] + "method", f"{node.name}.{m.name}", node.name, m.lineno, m.end_lineno, cut(m.lineno, m.end_lineno)) for m in methods]
    return out


def window_chunks(source: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple]:
    lines = source.split("\n")
    if lines and not lines[-1]:
        lines.pop()
    out, at = [], 0
    while at < len(lines):
        end = min(at + size, len(lines))
        out.append(("window", f"window_{len(out) + 1:04d}", None, at + 1, end, "\n".join(lines[at:end])))
        if end == len(lines):
            break
        at += max(1, size - overlap)
    return out


def javascript_chunks(source: str) -> list[tuple]:
    """(type, symbol, parent, first line, last line, text, imports, exports, calls, identifiers) of each entity."""
    file = Source(source)
    imports, exports = file.statements("import"), file.statements("export")
    return [(*e[:6], imports, exports, [(name, name, line, column) for name, line, column in e.calls], e.identifiers) for e in file.entities()]


def chunk_files(files: DataFrame) -> DataFrame:
    """files (path, language, text) to chunks; a file that its parser finds nothing in is cut into windows.

    imports, exports, calls and referenced_identifiers are those of JavaScript and TypeScript, null for others.
    """
    none = (None,) * 4

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, text in zip(frame.path, frame.language, frame.text.fillna(""), strict=True):
                found = []
                if language == "python":
                    found = [(*c, *none) for c in python_chunks(text)]
                elif str(language).startswith(("javascript", "typescript")):
                    found = javascript_chunks(text)
                rows += [(path, language, *c) for c in found or [(*w, *none) for w in window_chunks(text)]]
            yield pd.DataFrame(rows, columns=["path", "language", "chunk_type", "symbol", "parent_symbol", "start_line", "end_line", "text", "imports", "exports", "calls", "referenced_identifiers"])

    return files.select("path", "language", "text").mapInPandas(run, CHUNK)
