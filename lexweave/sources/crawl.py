"""Crawled pages to titles, chapters and sections: rows of ``sources.html.parse_pages`` and whole crawls.

A page is known by its url; every rule is a column expression, ordering inside a page is the
row's ordinal, and "first wins" is a window over the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.sources.html import page_anchors, parse_pages, section_content

# The shapes of section keys, of page names and of the note of a former chapter.
KEY = r"\d+[a-z]*-\d+[a-z]*(?:-\d+[a-z]*)?"
TITLE_PAGE = r"(?i)\btitle_(\d+[a-z]?)\b"
CHAPTER_PAGE = r"(?i)\bchap_(\d+[a-z]*)\b"
ARTICLE_PAGE = r"(?i)\bart_(\d+[a-z]?)\b"
FORMER_CHAPTER = r"(?i)\bformerly published as chapter\s+(\d+[a-z]*)\b"


def title_key(c: Column) -> Column:
    """Number padded to two digits with its letter; anything else as it stands."""
    k = F.lower(F.trim(c))
    digits = F.regexp_extract(k, r"^(\d+)([a-z]?)$", 1)
    return F.when(digits == "", k).otherwise(F.concat(F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits), F.regexp_extract(k, r"^(\d+)([a-z]?)$", 2)))


def key_title(c: Column) -> Column:
    """The title that a section key belongs to."""
    return F.when(c.rlike(r"^\d+[a-z]*-"), F.concat(F.lpad(F.regexp_extract(c, r"^(\d+)", 1), 2, "0"), F.regexp_extract(c, r"^\d+([a-z]*)-", 1))).otherwise(F.lit(""))


def absolute(page: Column, href: Column) -> Column:
    """An address relative to its page; absolute ones and bare fragments are covered."""
    h = F.trim(href)
    base = F.regexp_replace(F.substring_index(page, "#", 1), r"[^/]*$", "")
    root = F.regexp_extract(page, r"^([a-z][a-z0-9+.-]*://[^/]*)", 1)
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(page, r"^([a-z][a-z0-9+.-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("#") | (h == ""), F.concat(F.substring_index(page, "#", 1), h))
        .otherwise(F.regexp_replace(F.concat(base, h), r"/\./|/[^/]+/\.\./", "/"))
    )


def page_links(rows: DataFrame, pages: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """``key, page_url, ordinal, text, href`` with absolute addresses.

    Rows that were parsed with their ``url`` need no ``pages``. Others are joined to them, sorted:
    Spark takes parsed rows to be no larger than the columns their pages are made from, and would
    broadcast them through the driver.
    """
    links = rows.where("kind = 'link'").where(F.col("key").isNotNull())
    if "page_url" not in rows.columns:
        links = links.hint("merge").join(pages.select(F.col(key).alias("key"), F.col(url).alias("page_url")), "key")
    return links.select("key", "page_url", "ordinal", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"), absolute(F.col("page_url"), F.col("href")).alias("href"))


def crawl_order(key: Column) -> list[Column]:
    """Titles and chapters in order: by number, length of the suffix, suffix, key."""
    number = F.regexp_extract(key, r"^(?:art_)?0*(\d+)", 1).try_cast("bigint")
    suffix = F.regexp_extract(key, r"^(?:art_)?0*\d+([a-z]*)$", 1)
    return [F.coalesce(number, F.lit(0)), F.length(suffix), suffix, key]


def contents(links: DataFrame, kind: str) -> DataFrame:
    """Title or chapter links of contents pages: ``page_url, key, label, name, url``, sorted.

    An address may have several links: the last text that starts like a label is the label, the
    others are joined to the name.
    """
    if kind == "title":
        found, primary = F.regexp_extract("url", TITLE_PAGE, 1), r"(?i)^Title\s+\d"
        ident, fallback = title_key(found), F.concat(F.lit("Title "), title_key(found))
    else:
        chapter, article = F.lower(F.regexp_extract("url", CHAPTER_PAGE, 1)), F.lower(F.regexp_extract("url", ARTICLE_PAGE, 1))
        found, primary = F.concat(chapter, article), r"(?i)^(?:Chapter|Article)\s+\d"
        ident = F.when(chapter != "", chapter).otherwise(F.concat(F.lit("art_"), article))
        fallback = F.when(chapter != "", F.concat(F.lit("Chapter "), chapter)).otherwise(F.concat(F.lit("Article "), F.regexp_replace(article, "^0+", "")))
    d = links.withColumnRenamed("href", "url").where(found != "").where("text <> ''")
    label = F.col("text").rlike(primary)
    g = d.groupBy("page_url", "url").agg(
        F.max_by(F.when(label, F.col("text")), F.when(label, F.col("ordinal"))).alias("primary"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~label, F.struct("ordinal", "text")))), lambda x: x["text"]), " ").alias("name"),
    )
    out = g.select("page_url", ident.alias("key"), F.coalesce("primary", fallback).alias("label"), "name", "url")
    return out.orderBy("page_url", *crawl_order(F.col("key")))


def group_keys(expression: Column) -> Column:
    """Section keys of an expression; two joined by "to" are the range between them.

    An ordered fold over the key tokens and the words between them: ``to`` after a key waits
    for the next one, which closes the range and cannot open another.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(expression, F.lit(""))), F.lit(f"{KEY}|(?<![a-z0-9])to(?![a-z0-9])"), 0)
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("keys"), F.lit(None).cast("string").alias("open"), F.lit(False).alias("to"))

    def step(s: Column, t: Column) -> Column:
        word = t == "to"
        closes = ~word & s["to"] & s["open"].isNotNull()
        keys = F.when(closes, F.concat(F.slice(s["keys"], 1, F.size(s["keys"]) - 1), tx.expand_range(s["open"], t))).when(word, s["keys"]).otherwise(F.concat(s["keys"], F.array(t)))
        kept = F.when(word, s["open"]).when(closes, F.lit(None).cast("string")).otherwise(t)
        return F.struct(keys.alias("keys"), kept.alias("open"), word.alias("to"))

    return F.array_distinct(F.aggregate(tokens, start, step, lambda s: s["keys"]))


def grouped_section_keys(fragment: Column, label: Column) -> Column:
    """Keys of a grouped link, from its heading if that names more than its fragment."""
    own = group_keys(F.regexp_replace(F.regexp_extract(F.regexp_replace(fragment, "^#", ""), r"(?i)^secs?_(.+)$", 1), "_", " "))
    heading = F.regexp_replace(F.coalesce(label, F.lit("")), r"(?i)\([^)]*Formerly\s+Secs?\.[^)]*\)", "")
    named = group_keys(F.substring_index(F.regexp_replace(heading, r"(?i)^\s*Secs?\.\s*", ""), ".", 1))
    return F.when(F.size(named) > F.size(own), named).otherwise(own)


def section_links(links: DataFrame, title: Column | None = None) -> DataFrame:
    """Links of a chapter page to its own anchors, one row per section or group.

    The key in the visible heading wins over the fragment's, which is kept beside it; what
    disagrees is a warning. A key of another title needs a heading that says so. The first
    link of a key (or of a group's address) counts.
    """
    own = F.substring_index("href", "#", 1) == F.substring_index("page_url", "#", 1)
    d = links.where(own & F.col("href").contains("#")).withColumn("fragment", F.coalesce(F.try_url_decode(F.substring_index("href", "#", -1)), F.lit("")))
    d = d.where(F.lower("fragment").startswith("sec"))
    d = d.withColumns(
        {
            "heading_key": F.lower(F.regexp_extract("text", rf"(?i)^\s*Sec\.\s*({KEY})\s*\.", 1)),
            "fragment_key": F.lower(F.regexp_extract("fragment", rf"(?i)^sec[_-]?({KEY})$", 1)),
            "bare_key": F.lower(F.regexp_extract("text", rf"(?i)^\s*({KEY})\s*\.?\s*$", 1)),
            "expected": title_key(title) if title is not None else F.lit(""),
        }
    )
    none = F.lit("")
    d = d.withColumn("section_key", F.coalesce(F.nullif("heading_key", none), F.nullif("fragment_key", none), F.col("bare_key")))
    keyed, headed = F.col("section_key") != "", F.col("heading_key") != ""
    strange = keyed & (F.col("expected") != "") & (key_title(F.col("section_key")) != F.col("expected"))
    looks_grouped = F.lower("fragment").startswith("secs_") | F.col("text").rlike(r"(?i)^Secs\.\s") | F.col("text").rlike(r"(?i)^Sec\.\s.*\b(?:and|to)\b")
    d = d.where(F.when(keyed, headed | ~strange).otherwise(looks_grouped))
    first = Window.partitionBy("key", F.when(keyed, F.col("section_key")).otherwise(F.col("href"))).orderBy("ordinal")
    d = d.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    empty = F.array().cast("array<string>")
    d = d.withColumn("section_keys", F.when(keyed, empty).otherwise(grouped_section_keys(F.col("fragment"), F.col("text"))))
    outside = F.sort_array(F.array_distinct(F.filter(F.transform("section_keys", key_title), lambda t: (F.col("expected") != "") & (t != F.col("expected")))))
    say = lambda when, *parts: F.when(when, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    differ = headed & (F.col("fragment_key") != "") & (F.col("heading_key") != F.col("fragment_key"))
    warnings = F.array(
        say(differ, "the fragment names ", F.col("fragment_key"), ", the heading ", F.col("heading_key"), ", which counts"),
        say(headed & (F.col("fragment_key") == ""), "the fragment #", F.col("fragment"), " has no key of its own, the heading's ", F.col("heading_key"), " counts"),
        say(strange, F.col("section_key"), " is a section of title ", F.coalesce(F.nullif(key_title(F.col("section_key")), none), F.lit("?")), ", listed in title ", F.col("expected")),
        say(F.size(outside) > 0, "the group reaches out of title ", F.col("expected"), " to ", F.array_join(outside, ", ")),
        say(~keyed & (F.size("section_keys") == 0), "no keys in the group fragment #", F.col("fragment")),
    )
    return d.select(
        "key", "ordinal", "section_key", F.col("text").alias("label"), F.col("href").alias("url"), (F.size("section_keys") > 0).alias("grouped"), "section_keys",
        F.when(differ, F.col("fragment_key")).alias("source_fragment_key"), F.nullif(F.array_join(F.filter(warnings, lambda w: w.isNotNull()), "; "), none).alias("identifier_warning"),
    )


def inline_chapters(pages: DataFrame, rows: DataFrame, found: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Title pages whose provisions stand on the page itself, as a former chapter: the page has
    section links and a note that names the chapter they were published in."""
    text = rows.where("kind = 'block'").withColumn("n", F.lower(F.regexp_extract("text", FORMER_CHAPTER, 1))).where("n <> ''")
    noted = text.groupBy("key").agg(F.min_by("n", "ordinal").alias("n")).join(found.select("key").distinct(), "key", "left_semi")
    d = noted.join(pages.select(F.col(key).alias("key"), F.substring_index(url, "#", 1).alias("url")), "key")
    shown = F.coalesce(F.nullif(F.regexp_replace("n", "^0+", ""), F.lit("")), F.lit("0"))
    return d.select(F.concat(F.lit("former-"), "n").alias("key"), F.concat(F.lit("Former Chapter "), shown).alias("label"), F.lit("Repealed and obsolete provisions").alias("name"), "url")


def _links(pages: DataFrame) -> DataFrame:
    return page_links(parse_pages(pages, url="url")).withColumn("page_url", tx.normalize_url(F.col("page_url")))


def _listed(links: DataFrame, kind: str) -> DataFrame:
    return contents(links.withColumn("href", tx.normalize_url(F.col("href"))), kind)


def _fetched(wanted: DataFrame, pages: DataFrame, url: str, identity: str) -> DataFrame:
    """``wanted`` with the ``page_id`` of its address; one that was not fetched raises."""
    known = pages.groupBy(tx.normalize_url(F.col("url")).alias(url)).agg(F.min("page_id").alias("page_id"))
    j = wanted.join(known, url, "left")
    missing = F.raise_error(F.concat(F.lit("page was not fetched: "), F.col(url))).cast("string")
    return j.withColumn(identity, F.when(F.col("page_id").isNull(), missing).otherwise(F.col(identity)))


def crawl(pages: DataFrame, titles_url: str, titles: list[str] | None = None) -> DataFrame:
    """The sections that fetched pages (``page_id, url, html``, from a replay, say) hold from the
    page of all titles down, with title and chapter: every level is a join by address.

    ``titles`` limits the crawl, and what it names has to be there. A listed page that was not
    fetched raises. A title page without chapters may be a former chapter itself.
    """
    t = _listed(_links(pages.where(tx.normalize_url(F.col("url")) == titles_url)), "title")
    t = t.select(F.col("key").alias("title_key"), F.col("label").alias("title_label"), F.col("name").alias("title_name"), F.col("url").alias("title_url"))
    if titles is not None:
        asked = pages.sparkSession.createDataFrame([(x,) for x in titles], "asked string").select(title_key(F.col("asked")).alias("asked")).distinct()
        absent = F.raise_error(F.concat(F.lit("title was not found: "), F.col("asked"))).cast("string")
        t = asked.join(t, F.col("asked") == F.col("title_key"), "left").withColumn("title_url", F.when(F.col("title_key").isNull(), absent).otherwise(F.col("title_url"))).drop("asked")
    t = _fetched(t, pages, "title_url", "title_key")
    own = pages.join(t.select("page_id").distinct(), "page_id", "left_semi")
    links = _links(own).join(t.select(F.col("page_id").alias("key"), "title_key"), "key")
    names = ["key", "label", "name", "url"]
    listed = _listed(links, "chapter")
    bare = own.join(listed.select(F.col("page_url").alias("u")).distinct(), tx.normalize_url(F.col("url")) == F.col("u"), "left_anti")
    former = inline_chapters(bare, parse_pages(bare), section_links(links, F.col("title_key"))).withColumn("page_url", F.col("url"))
    c = listed.select("page_url", *names).unionByName(former.select("page_url", *names))
    c = c.select(F.col("page_url").alias("title_url"), *(F.col(n).alias(f"chapter_{n}") for n in names))
    c = _fetched(c.join(t.drop("page_id"), "title_url"), pages, "chapter_url", "chapter_key")
    leaves = pages.join(c.select("page_id").distinct(), "page_id", "left_semi")
    of_title = c.select(F.col("page_id").alias("key"), "title_key").distinct()
    found = _links(leaves).join(of_title, "key")
    # a page that two titles list is read for each of them
    shown = section_content(section_links(found.withColumn("page", F.col("key")), F.col("title_key")), page_anchors(leaves))
    return c.withColumnRenamed("page_id", "key").join(shown, "key").drop("key")


def title_exports(sections: DataFrame) -> DataFrame:
    """Crawled sections as title exports (``sources.imports.RAW_TITLE``), one row a title.

    An annotation is marked first where it is the first of its section. Titles without sections
    give no row.
    """
    content = F.struct(
        F.col("body").alias("body_paragraphs"), "source", "history", F.transform("annotation", lambda x, i: F.struct((i == 0).alias("first"), x.alias("text"))).alias("annotations"),
        "text", F.nullif("status", F.lit("active")).alias("status"), "statuses",
    )
    one = F.struct(F.nullif("section_key", F.lit("")).alias("section_key"), "label", "url", "grouped", "section_keys", "source_fragment_key", "identifier_warning", content.alias("content"))
    title, chapter = ["title_key", "title_label", "title_name", "title_url"], ["chapter_key", "chapter_label", "chapter_name", "chapter_url"]
    in_order = lambda c: F.transform(F.array_sort(c), lambda x: x["x"])
    g = sections.groupBy(*title, *chapter).agg(in_order(F.collect_list(F.struct(F.col("ordinal").alias("at"), one.alias("x")))).alias("sections"))
    named = F.struct("chapter_key", F.col("chapter_label").alias("label"), F.col("chapter_name").alias("name"), F.col("chapter_url").alias("url"), "sections")
    place = F.struct(*(x.alias(f"o{i}") for i, x in enumerate(crawl_order(F.col("chapter_key")))))
    out = g.groupBy(*title).agg(in_order(F.collect_list(F.struct(place.alias("at"), named.alias("x")))).alias("chapters"))
    return out.select("title_key", F.col("title_label").alias("label"), F.col("title_name").alias("name"), F.col("title_url").alias("url"), F.lit(None).cast("int").alias("supplement_year"), "chapters")
