"""HTML pages to rows: blocks, links, anchored sections and their content, with the standard
library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import collapse_space, dedupe_consecutive, detect_status, status_of

_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li td th tr table ul ol article section header footer nav title br body head blockquote pre".split())


class _Rows(HTMLParser):
    """Collects text blocks with the block element, class and anchor they stand under."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.parts: list[str] = []
        self.tag, self.css, self.anchor, self.href, self.skip = "", "", "", None, 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.rows.append({"kind": "block", "tag": self.tag, "css": self.css, "anchor": self.anchor, "text": text, "href": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        if tag in ("script", "style"):
            self.skip += 1
        if tag in _BLOCKS:
            self._flush()
            self.tag, self.css = tag, given.get("class", "")
        name = given.get("id") or given.get("name", "")
        if name:
            self._flush()
            self.anchor = name
        if tag == "a" and "href" in given:
            self.href, self.link = given["href"], []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "a" and self.href is not None:
            self.rows.append({"kind": "link", "tag": "a", "css": "", "anchor": self.anchor, "text": " ".join("".join(self.link).split()), "href": self.href})
            self.href = None
        if tag in _BLOCKS:
            self._flush()
            self.tag, self.css = "", ""

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)
            if self.href is not None:
                self.link.append(data)


def html_rows(html: str | None) -> list[dict]:
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return [{**r, "ordinal": i} for i, r in enumerate(parser.rows)]


_NAMES = ("kind", "tag", "css", "anchor", "text", "href")
_ARROW = pa.schema([("key", pa.int64()), *((n, pa.string()) for n in _NAMES), ("ordinal", pa.int32())])


def parse_pages(pages: DataFrame, key: str = "page_id", html: str = "html", url: str | None = None) -> DataFrame:
    """One row per block or link of each page, in order; with ``url`` each has its page's as ``page_url``."""
    carried = ["page_url"] if url else []
    arrow = pa.schema([*_ARROW, *(pa.field(n, pa.string()) for n in carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: dict[str, list] = {n: [] for n in arrow.names}
            for k, page, *of_page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = html_rows(page)
                for n, v in zip(("key", *carried), (k, *of_page), strict=True):
                    columns[n] += [v] * len(found)
                for n in (*_NAMES, "ordinal"):
                    columns[n] += [r[n] for r in found]
            yield pa.RecordBatch.from_pydict(columns, schema=arrow)

    schema = "key bigint, kind string, tag string, css string, anchor string, text string, href string, ordinal int" + ", page_url string" * len(carried)
    return pages.select(F.col(key).cast("long").alias("key"), F.col(html).alias("html"), *(F.col(url).cast("string").alias(n) for n in carried)).mapInArrow(run, schema)


def merged_links(rows: DataFrame) -> DataFrame:
    """Links by page and address without fragment: texts in order, joined by spaces."""
    d = rows.where("kind = 'link'").withColumn("url", F.substring_index("href", "#", 1))
    g = d.groupBy("key", "url").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("x"))
    return g.select("key", "url", F.get("x", F.lit(0))["ordinal"].alias("first"), F.trim(F.array_join(F.transform("x", lambda y: y["text"]), " ")).alias("text"))


#: Class names of a provision's parts; anything else is body.
PARTS = {"source": "source-first|source", "history": "history-first|history", "annotation": "annotation-first|annotation"}
# Elements of a grouped provision's text, ones that end it, and the notes that
# stand for repealed provisions.
GROUP_TAGS, TABLE_TAGS = ("p", "li"), ("table", "tr", "td", "th")
REPEALED_NOTE = r"(?i)\bare repealed\b"
SECTION_FRAGMENT = r"(?i)#sec[_-]?([0-9]+[a-z]*-[0-9]+[a-z]*(?:-[0-9]+[a-z]*)?)"

_BLOCK = pa.struct([("tag", pa.string()), ("css", pa.string()), ("text", pa.string()), ("hrefs", pa.list_(pa.string()))])
_ANCHORS = pa.schema([("key", pa.int64()), ("anchor", pa.string()), ("first", pa.int32()), ("blocks", pa.list_(_BLOCK))])


def anchored_blocks(html: str | None) -> list[dict]:
    """Blocks from anchor to anchor, in order, each with the addresses it links to; the anchor
    before the first named element is empty."""
    out: list[dict] = []
    links: list[str] = []
    for r in html_rows(html):
        if r["kind"] == "link":
            links.append(r["href"])
            continue
        if not out or out[-1]["anchor"] != r["anchor"]:
            out.append({"anchor": r["anchor"], "first": r["ordinal"], "blocks": []})
        out[-1]["blocks"].append({"tag": r["tag"], "css": r["css"], "text": r["text"], "hrefs": links})
        links = []
    return out


def page_anchors(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page and anchor: ``key, anchor, first, blocks``. A page is read and cut in
    one place, so its parts are never shuffled together again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"key": k, **x} for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in anchored_blocks(page)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ANCHORS)

    schema = "key bigint, anchor string, first int, blocks array<struct<tag:string,css:string,text:string,hrefs:array<string>>>"
    return pages.select(F.col(key).cast("long").alias("key"), F.col(html).alias("html")).mapInArrow(run, schema)


def _part_of(css: Column) -> Column:
    part = F.lit("body")
    for name, pattern in PARTS.items():
        part = F.when(css.rlike(f"(^| )({pattern})( |$)"), name).otherwise(part)
    return part


def _texts(blocks: Column, part: str) -> Column:
    kept = F.filter(blocks, lambda b: (_part_of(b["css"]) == part) & (b["text"] != ""))
    return F.transform(kept, lambda b: b["text"])


def anchored_sections(anchors: DataFrame) -> DataFrame:
    """Body, source, history and annotation texts of each anchor; a repeat right after a text is
    a parsing artefact and goes."""
    named = anchors.where("anchor <> ''")
    return named.select("key", "anchor", "first", *(dedupe_consecutive(_texts(F.col("blocks"), p)).alias(p) for p in ("body", *PARTS)))


def without_label(blocks: Column, label: Column) -> Column:
    """Blocks whose first text no longer begins with the label."""
    label = collapse_space(label)
    rest = lambda t: F.when((label != "") & F.startswith(t, label), F.trim(F.substring(t, F.length(label) + 1, F.length(t)))).otherwise(t)
    return F.transform(blocks, lambda b, i: F.when(i == 0, b.withField("text", rest(b["text"]))).otherwise(b))


def repealed_notes(anchors: DataFrame) -> DataFrame:
    """``key, section_key, note``: paragraphs saying that what they link to is repealed; of
    several on a page the last."""
    b = anchors.select("key", "first", F.posexplode("blocks").alias("at", "b")).where((F.col("b.tag") == "p") & F.col("b.text").rlike(REPEALED_NOTE))
    links = b.select("key", "first", "at", F.explode("b.hrefs").alias("href"), F.col("b.text").alias("note"))
    links = links.withColumn("section_key", F.lower(F.regexp_extract("href", SECTION_FRAGMENT, 1))).where("section_key <> ''")
    return links.groupBy("key", "section_key").agg(F.max_by("note", F.struct("first", "at")).alias("note"))


def section_content(found: DataFrame, anchors: DataFrame) -> DataFrame:
    """The content of section links (``key, section_key, section_keys, label, url``): ``body,
    source, history, annotation, text, statuses, status``.

    A section's texts are those under its fragment. A group's are the paragraphs and items up
    to the next table. A section without text has the page's note that it is repealed, if there
    is one. Statuses are what label and text state; a fragment that is nowhere gives no text.
    """
    fragment = F.lower(F.coalesce(F.try_url_decode(F.substring_index("url", "#", -1)), F.lit("")))
    d = found.withColumn("__at", F.when(F.contains("url", F.lit("#")), fragment))
    here = anchors.where("anchor <> ''").groupBy("key", F.lower("anchor").alias("__at")).agg(F.min_by("blocks", "first").alias("blocks"))
    d = d.join(here, ["key", "__at"], "left").join(repealed_notes(anchors), ["key", "section_key"], "left")
    grouped = F.size(F.coalesce("section_keys", F.array().cast("array<string>"))) > 0
    blocks = F.coalesce("blocks", F.array().cast(here.schema["blocks"].dataType))
    table = F.array_position(F.transform(blocks, lambda b: b["tag"].isin(*TABLE_TAGS)), True)
    upto = F.when(table > 0, F.slice(blocks, 1, F.greatest(table - 1, F.lit(0)).cast("int"))).otherwise(blocks)
    upto = F.filter(upto, lambda b, i: (i == 0) | b["tag"].isin(*GROUP_TAGS))
    d = d.withColumn("blocks", without_label(F.when(grouped, upto).otherwise(blocks), F.col("label")))
    texts = {p: F.when(grouped, _texts(F.col("blocks"), p)).otherwise(dedupe_consecutive(_texts(F.col("blocks"), p))) for p in ("body", *PARTS)}
    d = d.withColumns(texts)
    noted = ~grouped & (F.size("body") == 0) & F.col("note").isNotNull()
    none = F.array().cast("array<string>")
    d = d.withColumns({"body": F.when(noted, F.array("note")).otherwise(F.col("body")), **{p: F.when(noted, none).otherwise(F.col(p)) for p in PARTS}})
    d = d.withColumn("text", F.trim(F.array_join("body", "\n\n")))
    d = d.withColumn("statuses", detect_status(F.col("label"), F.col("text")))
    status = F.when(F.size("statuses") > 0, status_of(F.col("statuses"))).when(noted, "repealed").otherwise("active")
    return d.withColumn("status", status).drop("blocks", "note", "__at")
