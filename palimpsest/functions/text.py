"""Column functions over text: identities, normalisation, tokens, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\t\f\x0B\x1C-\x1F \x85\p{Z}]"
# Token patterns, and what stands before texts that are encoded.
BASIC = r"[A-Za-z0-9_]+"
CODE = r"[A-Za-z_][A-Za-z0-9_]*|\d+|==|!=|<=|>=|[-+*/%]=?|[(){}\[\].,:]"

QUERY_PROMPT = "Find the most relevant code snippet given the following query:\n"
DOCUMENT_PROMPT = "Candidate code snippet:\n"


def normalize(text: Column) -> Column:
    """LF line ends, no blanks at line ends, no blank lines at either end, one final newline unless empty."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, _BLANK + r"+(?=\n|\z)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\A\n+", ""), r"\n+\z", "")
    return F.when(t == "", t).otherwise(F.concat(t, F.lit("\n")))


def content_id(language: Column, text: Column) -> Column:
    return F.sha2(F.concat(language, F.lit("\n"), text), 256)


def version_id(repo: Column, commit: Column, path: Column, kind: Column, symbol: Column, start: Column, end: Column, content: Column) -> Column:
    where = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return F.sha2(F.concat_ws(":", repo, commit, path, kind, F.coalesce(symbol, F.lit("<anonymous>")), where, content), 256)


def occurrence_key(path: Column, kind: Column, symbol: Column) -> Column:
    return F.concat_ws(":", path, kind, F.coalesce(symbol, F.lit("<anonymous>")))


def preview(text: Column, most: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def line_count(text: Column) -> Column:
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, "\n", -1)))


def tokens(text: Column, pattern: str = BASIC) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lower)


def tokens_split(text: Column) -> Column:
    """Code tokens, each followed by its parts between underscores that differ from it."""
    parts = lambda t: F.filter(F.split(t, "_"), lambda p: (p != "") & (p != t))
    return F.flatten(F.transform(tokens(text, CODE), lambda t: F.concat(F.array(t), parts(t))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(part * 100.0 / F.nullif(whole, F.lit(0)), F.lit(0.0))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def row_text(title: Column, text: Column, strip: bool = True) -> Column:
    """Title and text on lines of their own, as an encoder reads them; ranking by terms takes them unstripped."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.regexp_replace(both, r"(?U)\A\s+|\s+\z", "") if strip else both


def query_prompt(text: Column) -> Column:
    return F.concat(F.lit(QUERY_PROMPT), text)


def document_prompt(text: Column) -> Column:
    return F.concat(F.lit(DOCUMENT_PROMPT), text)


def cache_key(text: Column) -> Column:
    """A question without case and spacing, for caches that may take such questions as one."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
