"""Fielded Boolean search with weighted ranking, exact totals and top-k.

Documents are normalized once (``prepare``); a query becomes one native predicate, one score
and one list of matched fields, so a search is a scan, a filter, a projection and
``TakeOrderedAndProject``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions.query import FIELDS, Both, Near, Not, Options, Query, Term, parse

# Weights of a match by field (plain or prefix term, phrase), of citation matches
# and of documents that are not in force.
WEIGHTS = {"heading": (34, 44), "body": (12, 20), "history": (9, 16), "annotations": (8, 14)}
CITATION_EXACT, CITATION_PREFIX, CITATION_MATCH, NOT_ACTIVE = 120, 55, 30, -0.25


def fields_of(options: Options) -> tuple[str, ...]:
    return {"all": FIELDS, "statute": FIELDS[:3]}.get(options.field, (options.field,))


def prepare(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``docs`` with normalized text (``n_*``) and token strings (``t_*``) of the fields.

    Expects ``citation, citations, heading, text`` and, for those fields, ``history`` and
    ``annotations`` arrays. Null fields read as empty.
    """
    source = {
        "citation": F.array_join(F.coalesce("citations", F.array().cast("array<string>")), " "),
        "heading": F.col("heading"),
        "body": F.col("text"),
        "history": F.array_join("history", " ") if "history" in docs.columns else F.lit(""),
        "annotations": F.array_join("annotations", " ") if "annotations" in docs.columns else F.lit(""),
    }
    d = docs.withColumns({f"n_{f}": tx.normalize_text(source[f]) for f in fields})
    return d.withColumns({f"t_{f}": tx.token_string(F.col(f"n_{f}")) for f in fields})


def term_in(term: Term, field: str) -> Column:
    if term.kind == "phrase":
        return F.contains(F.col(f"n_{field}"), F.lit(term.value))
    if not term.tokens:
        return F.lit(False)
    end = "" if term.kind == "prefix" else " "
    return F.contains(F.col(f"t_{field}"), F.lit(f" {' '.join(term.tokens)}{end}"))


def near_in(node: Near, field: str) -> Column:
    """Both terms start within ``distance`` words; either order, positions of first words."""
    if not node.left.tokens or not node.right.tokens:
        return F.lit(False)

    def at(term: Term) -> str:
        return "(?= " + " ".join(map(re.escape, term.tokens)) + ("" if term.kind == "prefix" else " ") + ")"

    a, b, gap = at(node.left), at(node.right), rf"(?: \S+){{0,{node.distance}}}"
    return F.col(f"t_{field}").rlike(f"{a}{gap}{b}|{b}{gap}{a}")


def predicate(node, fields: tuple[str, ...]) -> Column:
    if isinstance(node, Term):
        return reduce(Column.__or__, (term_in(node, f) for f in fields))
    if isinstance(node, Near):
        return reduce(Column.__or__, (near_in(node, f) for f in fields))
    if isinstance(node, Not):
        return ~predicate(node.child, fields)
    left, right = predicate(node.left, fields), predicate(node.right, fields)
    return left & right if isinstance(node, Both) else left | right


def _starts(value: str):
    return lambda c: F.startswith(c, F.lit(value))


def score(query: Query, fields: tuple[str, ...]) -> Column:
    """What the terms give; the status counts later."""
    total = F.lit(1.0)
    for term in query.positives:
        if "citation" in fields:
            values = F.transform(F.coalesce("citations", F.array().cast("array<string>")), lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}-]+", " ")))
            exact = (F.trim(F.regexp_replace(F.lower(F.coalesce("citation", F.lit(""))), r"[^\p{L}\p{N}-]+", " ")) == term.value) | F.array_contains(values, term.value)
            prefix = F.exists(values, _starts(term.value)) if term.kind == "prefix" else F.lit(False)
            total = total + F.when(exact, CITATION_EXACT).when(prefix, CITATION_PREFIX).when(term_in(term, "citation"), CITATION_MATCH).otherwise(0)
        for field, (plain, phrase) in WEIGHTS.items():
            if field in fields:
                total = total + F.when(term_in(term, field), phrase if term.kind == "phrase" else plain).otherwise(0)
    return total


def matched_fields(query: Query, fields: tuple[str, ...]) -> Column:
    """Selected fields, in order, where any positive term stands."""
    marks = [F.when(reduce(Column.__or__, (term_in(t, f) for t in query.positives), F.lit(False)), F.lit(f)) for f in fields]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def attribute_filter(docs: DataFrame, options: Options) -> DataFrame:
    if options.chapter:
        docs = docs.where((F.col("chapter_id") == options.chapter) | (F.col("chapter_number") == options.chapter))
    if options.supplement:
        docs = docs.where(F.col("supplement_year").isNotNull() if options.supplement == "updated" else F.col("supplement_year").isNull())
    return docs


def compile_query(text: str, options: Options) -> Query:
    """Reads query and search-within before anything is planned."""
    query = parse(text)
    return query.within(parse(options.within)) if options.within else query


Enrich = Callable[[DataFrame], DataFrame]


def matches(docs: DataFrame, text: str, options: Options = Options(), enrich: Enrich | None = None) -> DataFrame:
    """All matching documents with ``score`` and ``matched_fields``.

    ``enrich`` adds columns that only matches need (``status``, say): what it joins meets the
    matches, not the corpus.
    """
    options = options.normalized()
    query, fields = compile_query(text, options), fields_of(options)
    given = {f"{p}_{f}" for p in "nt" for f in fields} - set(docs.columns)
    d = prepare(attribute_filter(docs, options), fields).where(predicate(query.root, fields))
    d = d.withColumns({"matched_fields": matched_fields(query, fields), "score": score(query, fields)}).drop(*given)
    d = enrich(d) if enrich else d
    if options.status:
        d = d.where(F.col("status") == options.status)
    return d.withColumn("score", F.col("score") + F.when(F.col("status") != "active", NOT_ACTIVE).otherwise(0))


def order(sort: str = "relevance") -> list[Column]:
    """Relevance: score first; citation: natural order first. Ties end in the id."""
    tail = [tx.natural_key(F.coalesce(F.col("citation"), F.get("citations", F.lit(0)))), tx.natural_key(F.col("title_number")), tx.natural_key(F.col("chapter_number")), F.col("id")]
    return [*tail, F.desc("score")] if sort == "citation" else [F.desc("score"), *tail]


def search(docs: DataFrame, text: str, options: Options = Options(), limit: int = 50, enrich: Enrich | None = None) -> DataFrame:
    """The first ``limit`` results (the result page is a top-k report)."""
    options = options.normalized()
    return matches(docs, text, options, enrich).orderBy(*order(options.sort)).limit(limit)


def page(docs: DataFrame, text: str, options: Options = Options(), number: int = 1, size: int = 50, enrich: Enrich | None = None) -> DataFrame:
    """One page of the results, the first is 1."""
    options = options.normalized()
    return matches(docs, text, options, enrich).orderBy(*order(options.sort)).offset((number - 1) * size).limit(size)


def visible(sections: DataFrame, hide_repealed: bool, selected: str | None = None) -> DataFrame:
    """Sections for navigation: repealed ones may be hidden but for the selected one."""
    if not hide_repealed:
        return sections
    return sections.where((F.col("status") != "repealed") | (F.col("id") == F.lit(selected).cast("string")).eqNullSafe(F.lit(True)))


def total_matches(docs: DataFrame, text: str, options: Options = Options(), enrich: Enrich | None = None) -> DataFrame:
    """How many match; without a status to filter by, nothing is joined for it."""
    if not options.normalized().status:
        enrich = lambda d: d.withColumn("status", F.lit("active"))
    return matches(docs, text, options, enrich).agg(F.count("*").alias("total_matches"))


def merge_results(*batches: DataFrame, limit: int = 50, sort: str = "relevance") -> DataFrame:
    """Top-k of top-k results of parts; associative."""
    return reduce(DataFrame.unionByName, batches).orderBy(*order(sort)).limit(limit)


def with_auxiliary(docs: DataFrame, aux: DataFrame, options: Options) -> DataFrame:
    """History and annotations joined on demand: only a query on those fields pays for it."""
    if options.field not in ("all", "history", "annotations"):
        return docs
    return docs.join(aux, ["title_number", "id"], "left")


def highlight_terms(text: str, within: str | None = None) -> list[str]:
    """Distinct positive terms, longest first; none if the query cannot be read."""
    try:
        found = [t.value for q in (text, within) if q for t in parse(q).positives]
    except ValueError:
        return []
    return sorted(dict.fromkeys(found), key=len, reverse=True)


def highlighted(c: Column, terms: list[str]) -> Column:
    """Escaped text with ``<mark>`` around the terms: split first, escape each part."""
    if not terms:
        return tx.escape_html(c)
    pattern = "(?iu)(" + "|".join(map(tx.quote_pattern, terms)) + ")"
    marked = F.regexp_replace(F.coalesce(c, F.lit("")), pattern, "\x02$1\x03")
    return F.replace(F.replace(tx.escape_html(marked), F.lit("\x02"), F.lit("<mark>")), F.lit("\x03"), F.lit("</mark>"))


def excerpt(c: Column, terms: list[str], length: int = 240, context: int = 60) -> Column:
    """A window around the first match, cut at spaces, with ellipses, highlighted."""
    c = F.coalesce(c, F.lit(""))
    size = F.length(c)
    pattern = "(?iu)(" + "|".join(map(tx.quote_pattern, terms)) + ")" if terms else "(?!)"
    first = F.when(c.rlike(pattern), F.length(F.get(F.split(c, pattern, 2), F.lit(0)))).otherwise(-1)
    start = F.when(first > context, first - context).otherwise(0)
    end = F.least(size, start + length)
    start = F.when(end == size, F.greatest(F.lit(0), end - length)).otherwise(start)
    space = F.position(F.lit(" "), c, start + 1) - 1
    start = F.when((start > 0) & (space >= 0) & (space < first), space + 1).otherwise(start)
    head = F.substring(c, F.lit(1), end + 1)
    back = F.length(head) - F.position(F.lit(" "), F.reverse(head))
    end = F.when((end < size) & F.contains(head, F.lit(" ")) & (back > start), back).otherwise(end)
    cut = F.substring(c, start + 1, end - start)
    return F.concat(F.when(start > 0, "…").otherwise(""), highlighted(cut, terms), F.when(end < size, "…").otherwise(""))
