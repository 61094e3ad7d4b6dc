"""Rules that route a question: its type, its terms, and an order of two calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP = (
    "where", "which", "what", "when", "how", "does", "used", "usage", "referenced", "references",
    "files", "functions", "function", "class", "classes", "call", "calls", "before", "after",
    "the", "this", "that", "with", "from", "code", "snippet", "source", "handled", "created",
)
USAGE = (" used", " usages", " referenced", " references", " call ", " calls ", " callers", " where is")
MIXED = (" before ", " after ", " deeplink", "endpoint", "event handler")
IDENTIFIER = r"(?U)\b[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?\b"
ORDER = r"(?iU)\b(?:call|calls|invoke|invokes|run|runs|happen|happens)\s+([A-Za-z_$][\w$]*)\s+(?:before|then|prior to)\s+([A-Za-z_$][\w$]*)"
BEFORE = r"(?iU)\b([A-Za-z_$][\w$]*)\s+before\s+([A-Za-z_$][\w$]*)\b"


def terms(query: Column) -> Column:
    """At most ten identifiers, a dotted one followed by its last part, in order of appearance, without stop words."""
    found = F.filter(F.regexp_extract_all(query, F.lit(IDENTIFIER), F.lit(0)), lambda t: ~F.lower(t).isin(*STOP))
    both = F.flatten(F.transform(found, lambda t: F.array(t, F.element_at(F.split(t, r"\."), -1))))
    return F.slice(F.array_distinct(both), 1, 10)


def order_pair(query: Column) -> Column:
    pair = lambda p: F.array(F.regexp_extract(query, p, 1), F.regexp_extract(query, p, 2))
    return F.when(query.rlike(ORDER), pair(ORDER)).when(query.rlike(BEFORE), pair(BEFORE))


def query_type(query: Column) -> Column:
    low = F.lower(F.trim(query))
    has = lambda marks: F.array_contains(F.array(*[F.contains(low, F.lit(m)) for m in marks]), True)
    known = F.size(terms(F.trim(query)))
    return (
        F.when(order_pair(F.trim(query)).isNotNull(), F.when(known <= 4, "structural").otherwise("mixed"))
        .when(has(USAGE) & (known > 0), "usage")
        .when((known > 0) & has(MIXED), "mixed")
        .otherwise("semantic")
    )
