"""Printed schedules (word boxes with ``page, line, x0, x1, text``) to rows.

A schedule row starts at a citation on the left margin and takes all lines up to the next row
or category: gaps and islands by a running count over a document's lines. Amounts are placed by
the nearest column center, the first in a column stands. The fold of a document's lines runs in
one window per ``source``, so documents are worked on side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import clean_citation, stable_id, to_cents
from lexweave.operators.folds import nearest_center
from lexweave.operators.links import resolve

# The printed layout and its patterns.
STATUTE = r"^(\d+[a-z]{0,2}-\d+[a-z]{0,3})\S*$"
PUBLIC_ACT = r"^PA(\d+-\d+)\S*$"
AMOUNT = r"^\d{1,3}(?:,\d{3})*\.\d{2}$"
CITATION = r"\d+[a-z]{0,3}-\d+[a-z]{0,3}"
SQUASHED = r"^((?:PA)?\d+[a-z]{0,2}-\d+[a-z]{0,3})(\(\S*)$"
OFFENSE = r"(1st|2nd|3rd|\d+th)$"
VIOLATION = r"^Violation of ((?:PA)?\d+[a-z]{0,2}-\d+[a-z]{0,3}(?:\([a-z0-9]+\))*) \((\d+)(?:st|nd|rd|th) offense\)"
REFERENCE = r"(?i)(?<![\w-])(\d+[a-z]{0,3}-\d+[a-z]{0,3}(?:\s*\([a-z0-9]+\))*)"
COLUMNS = ("total_due", "fine", "fee", "z_fee", "cost", "surcharge", "stf", "bipsa", "mf", "plus")
CENTERS = (452, 479, 516, 549, 590, 631, 664, 701, 733, 760)
HEADS = ("DUE", "FINE", "FEE", "FEE", "COST", "CHARGE", "STF", "BIPSA", "MF", "PLUS")
AMOUNT_X, ROW_X, CATEGORY_X = 410, 60, 40
RULE_X, RULE_TOP, RULE_BOTTOM = (100, 265, 570), 135, 550


def join_text(parts: Column, keep_digit_hyphen: bool = False) -> Column:
    """Wrapped lines as one text: a hyphen before a small letter goes, others stay.

    With ``keep_digit_hyphen`` a hyphen after a digit is part of a citation and what follows
    joins it without a space.
    """

    def step(text: Column, more: Column) -> Column:
        plain = F.trim(F.concat(text, F.lit(" "), more))
        out = F.when(more == "", text).when(text == "", more)
        if keep_digit_hyphen:
            out = out.when(text.rlike(r"\d-$"), F.concat(text, more))
        return out.when(text.endswith("-") & more.rlike("^[a-z]"), F.concat(F.regexp_replace(text, "-$", ""), more)).otherwise(plain)

    return F.aggregate(parts, F.lit("").cast("string"), lambda s, x: step(s, F.trim(F.coalesce(x, F.lit("")))))


def fix_citation(token: Column) -> Column:
    """A squashed citation inside a description, with its parentheses and offense again; a
    token whose parentheses balance, or that is no citation, stays."""
    body = F.regexp_replace(token, "[.,;:]+$", "")
    punctuation = F.substring(token, F.length(body) + 1, F.length(token))
    base, rest = F.regexp_extract(body, SQUASHED, 1), F.regexp_extract(body, SQUASHED, 2)
    bare = F.regexp_replace(rest, r"\*+$", "")
    ordinal = F.regexp_extract(bare, OFFENSE, 1)
    groups = F.regexp_extract_all(F.regexp_replace(bare, OFFENSE, ""), F.lit("[A-Za-z]+|[0-9]+"), 0)
    fixed = F.concat(
        base, F.array_join(F.transform(groups, lambda g: F.concat(F.lit("("), g, F.lit(")"))), ""), F.when(rest.endswith("*"), "*").otherwise(""),
        F.when(ordinal != "", F.concat(F.lit(" ("), ordinal, F.lit(" offense)"))).otherwise(""), punctuation,
    )
    balanced = F.regexp_count(rest, F.lit(r"\(")) == F.regexp_count(rest, F.lit(r"\)"))
    return F.when((base == "") | balanced, token).otherwise(fixed)


def polish(description: Column) -> Column:
    words = F.filter(F.split(description, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, fix_citation), " ")


def zone_citation(citation: Column, description: Column) -> Column:
    """A citation without the offense ordinal that was read as a subdivision: only where the
    description cites the row with the same ordinal."""
    cited, n = F.regexp_extract(description, VIOLATION, 1), F.regexp_extract(description, VIOLATION, 2)
    return F.when((cited != "") & (citation == F.concat(cited, F.lit("("), n, F.lit(")"))), cited).otherwise(citation)


def references(text: Column) -> Column:
    """``display, section_key`` of the citations in a text: each once, in order."""
    shown = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(REFERENCE), 1), lambda x: F.regexp_replace(x, r"\s+", ""))
    kept = F.filter(shown, lambda x, i: ~F.exists(F.slice(shown, 1, i), lambda y: F.lower(y) == F.lower(x)))
    return F.transform(kept, lambda x: F.struct(x.alias("display"), F.lower(F.regexp_extract(x, f"(?i)^{CITATION}", 0)).alias("section_key")))


def line_rows(words: DataFrame) -> DataFrame:
    """``source, page, line, words`` (by x), the text and the left and right parts of a line."""
    g = words.groupBy("source", "page", "line").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("words"))
    said = lambda c: F.array_join(F.transform(c, lambda w: w["text"]), " ")
    left, right = F.filter("words", lambda w: w["x0"] < AMOUNT_X), F.filter("words", lambda w: w["x0"] >= AMOUNT_X)
    return g.select("source", "page", "line", "words", said(F.col("words")).alias("text"), left.alias("left"), right.alias("right"))


def head_centers(words: Column) -> Column:
    """Centers of the amount columns from a line of column heads; null if the line lacks one.

    The heads are sought in their order, each after the one before it.
    """
    heads = F.array(*map(F.lit, HEADS))
    start = F.array().cast("array<double>")
    found = F.aggregate(words, start, lambda s, w: F.when(w["text"] == F.get(heads, F.size(s)), F.concat(s, F.array((w["x0"] + w["x1"]) / 2))).otherwise(s))
    names = F.transform(words, lambda w: w["text"])
    return F.when(F.array_contains(names, "STAT") & F.array_contains(names, "FINE") & (F.size(found) == len(HEADS)), found)


def schedule_rows(words: DataFrame, centers: tuple[float, ...] = CENTERS) -> DataFrame:
    """Rows of a printed schedule, one per citation, in order (``source, nth``).

    A page's own column heads say where its amounts stand, else ``centers``. Heads, page
    numbers and what follows the alphabetical listing or the start of chart B are no rows; a line of
    capitals at the margin is the category of the rows after it; other lines belong to the row
    above. A star on the citation marks later offenses.
    """
    d = line_rows(words).withColumn("centers", head_centers(F.col("words")))
    order = Window.partitionBy("source").orderBy("page", "line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first = F.get("words", F.lit(0))
    qualifier = r"\s*-\s*Numerical Order\s*$"
    letters = F.regexp_replace(F.regexp_replace("text", qualifier, ""), "[^A-Za-z]", "")
    chart = (F.col("line") < 2) & (first["text"] == "CHART") & F.exists("words", lambda w: w["text"] == "B")
    ended = F.col("text").rlike(r"-\s*Alphabetical Order\s*$") | chart
    d = d.withColumns({"ended": F.max(ended.cast("int")).over(upto), "spots": F.min_by("centers", F.when(F.col("centers").isNotNull(), F.col("line"))).over(Window.partitionBy("source", "page"))}).where("ended = 0").drop("centers")
    skip = F.col("text").rlike("^(?:TOTAL|STAT NO|INFRACTIONS/VIOLATIONS)") | ((F.size("words") == 1) & F.col("text").rlike(r"^\d{1,3}$"))
    d = d.where(~skip).withColumns(
        {
            "starts": (first["x0"] <= ROW_X) & (first["text"].rlike(STATUTE) | first["text"].rlike(PUBLIC_ACT)),
            "heads": ~first["text"].rlike(STATUTE) & (first["x0"] <= CATEGORY_X) & (letters != "") & (F.upper(letters) == letters) & (F.size("right") == 0),
        }
    )
    d = d.withColumn("heads", F.col("heads") & ~F.col("starts"))
    d = d.withColumns(
        {
            "category": F.last(F.when(F.col("heads"), F.trim(F.regexp_replace("text", qualifier, ""))), ignorenulls=True).over(upto),
            "nth": F.sum(F.col("starts").cast("long")).over(upto),
            # a category closes the row above it
            "block": F.sum((F.col("starts") | F.col("heads")).cast("long")).over(upto),
        }
    ).where(~F.col("heads"))
    open_ = Window.partitionBy("source", "block")
    d = d.withColumn("open", F.max(F.col("starts")).over(open_)).where("open")
    spots = F.coalesce("spots", F.array(*(F.lit(float(c)) for c in centers)))
    said = F.when(F.col("starts"), F.slice("left", 2, F.greatest(F.size("left"), F.lit(1)))).otherwise(F.col("left"))
    line = F.struct(
        "page", "line", F.array_join(F.transform(said, lambda w: w["text"]), " ").alias("said"), F.when(F.col("starts"), first["text"]).alias("stat_no"),
        F.transform("right", lambda w: F.struct(w["text"].alias("text"), nearest_center((w["x0"] + w["x1"]) / 2, spots).alias("col"))).alias("right"), F.col("category").alias("category"),
    )
    g = d.groupBy("source", "nth").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    head, right = F.get("lines", F.lit(0)), F.flatten(F.transform("lines", lambda x: x["right"]))
    paid = F.transform(F.filter(right, lambda w: w["text"].rlike(AMOUNT)), lambda w: F.struct(w["col"], F.replace(w["text"], F.lit(",")).cast("decimal(12,2)").alias("value")))
    g = g.withColumns({"paid": paid, "stat_no": head["stat_no"], "raw": join_text(F.transform("lines", lambda x: x["said"]))})
    amount = lambda i: F.get(F.filter("paid", lambda p: p["col"] == i), F.lit(0))["value"]
    act = F.regexp_extract("stat_no", PUBLIC_ACT, 1)
    base = F.lower(F.regexp_extract("stat_no", STATUTE, 1))
    citation = F.when(act != "", F.concat(F.lit("PA "), clean_citation(F.substring(F.col("stat_no"), 3, 1000), act))).otherwise(clean_citation(F.col("stat_no"), base))
    description = polish(F.col("raw"))
    return g.select(
        "source", "nth", "stat_no", zone_citation(citation, description).alias("citation"), F.when(act != "", F.concat(F.lit("pa"), act)).otherwise(base).alias("section_key"),
        description.alias("description"), head["category"].alias("category"), F.contains("stat_no", F.lit("*")).alias("subsequent"), head["page"].alias("page"),
        F.struct(*(amount(i).alias(n) for i, n in enumerate(COLUMNS))).alias("amounts"),
        F.nullif(F.array_join(F.transform(F.filter(right, lambda w: ~w["text"].rlike(AMOUNT) & (F.length(w["text"]) > 1)), lambda w: w["text"]), " "), F.lit("")).alias("note"),
    )


def chart_b(words: DataFrame) -> DataFrame:
    """Words of the pages from the first that is headed CHART B, with the table's ``revision``
    (the last that a head names). ``words`` needs ``top``."""
    head = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))), 1, 30), lambda w: w["text"]), " ")
    pages = words.groupBy("source", "page").agg(head.alias("head")).where(F.contains("head", F.lit("CHART B")))
    named = F.nullif(F.trim(F.regexp_extract("head", r"(?i)Rev\.\s*([^)]*)", 1)), F.lit(""))
    start = pages.groupBy("source").agg(F.min("page").alias("start"), F.max_by(named, F.when(named.isNotNull(), F.col("page"))).alias("revision"))
    return words.join(start, "source").where(F.col("page") >= F.col("start")).drop("start")


def canonical_rows(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Schedule rows with stable id, amounts in cents and what their citation resolves to."""
    d = resolve(rows, places, "section_key", "citation")
    cents = F.struct(*(to_cents(F.col(f"amounts.{n}")).alias(n) for n in sorted(COLUMNS)))
    return d.select(
        stable_id(F.lit("infraction"), F.col("stat_no"), F.col("description")).alias("id"), F.col("stat_no").alias("printedCitation"), "citation", F.col("section_key").alias("sectionCitation"),
        "description", "category", "subsequent", "page", cents.alias("amounts"), "note", "status", "to_title_number", "to_chapter_number", "to_id",
    )


def fee_rules(words: DataFrame) -> DataFrame:
    """Rules of the fee table, whose columns run over pages: ``source, nth, authority, ...``.

    A line whose first column is a citation starts a rule; the other columns are joined down to
    the next. ``words`` needs ``top``; heads and feet of pages do not count.
    """
    edge = [*RULE_X, 1e9]
    names = ("description", "affected_text", "comments")
    body = words.where(F.col("top").between(RULE_TOP, RULE_BOTTOM))
    column = F.when(F.col("x0") < edge[0], 0).when(F.col("x0") < edge[1], 1).when(F.col("x0") < edge[2], 2).otherwise(3)
    text = lambda i: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("c") == i, F.struct("x0", "text")))), lambda w: w["text"]), " ")
    lines = body.withColumn("c", column).groupBy("source", "page", "line").agg(text(0).alias("statute"), *(text(i + 1).alias(n) for i, n in enumerate(names)))
    starts = F.col("statute").rlike(rf"(?i)^{CITATION}(?:\([a-z0-9]+\))*$")
    upto = Window.partitionBy("source").orderBy("page", "line").rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumns({"starts": starts, "nth": F.sum(starts.cast("long")).over(upto)}).where("nth > 0")
    g = d.groupBy("source", "nth").agg(F.sort_array(F.collect_list(F.struct("page", "line", "statute", *names, "starts"))).alias("x"))
    said = lambda n: join_text(F.transform("x", lambda y: y[n]), True).alias(n)
    filled = F.filter("x", lambda y: y["starts"] | (F.concat(*(y[n] for n in names)) != ""))
    g = g.select("source", "nth", F.get("x", F.lit(0))["statute"].alias("authority"), *map(said, names), F.array_distinct(F.transform(filled, lambda y: y["page"])).alias("pages"))
    return g.withColumns({"section_key": F.lower(F.regexp_extract("authority", f"(?i)^{CITATION}", 0)), "affected": references(F.col("affected_text"))})

