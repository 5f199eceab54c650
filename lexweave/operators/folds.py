"""Word boxes of laid-out pages to lines and rows: ordered folds, one page at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# X of the gutter between the two columns of an index page, where the columns
# begin, and the width of one indent level.
GUTTER, BASES, INDENT = 295.0, (123.0, 312.0), 9.0
#: Pages folded at a time.
PAGES = 256


def _line_starts(group: np.ndarray, top: np.ndarray, tolerance: float) -> np.ndarray:
    """Which words, sorted by group and top, begin a line: a line reaches ``tolerance`` below its
    first word. Words between two gaps above that are one line if all are within it of the
    first, else they are folded one by one."""
    starts = np.ones(len(top), bool)
    starts[1:] = (group[1:] != group[:-1]) | (top[1:] - top[:-1] > tolerance)
    first = np.flatnonzero(starts)
    last = np.append(first[1:], len(top))[: len(first)] - 1
    for i, j in zip(*(x[~(top[last] - top[first] <= tolerance)].tolist() for x in (first, last)), strict=True):
        at = top[i]
        for k in range(i + 1, j + 1):
            if top[k] - at > tolerance:
                starts[k], at = True, top[k]
    return starts


def _lines(batch: pa.RecordBatch, tolerance: float, gutter: float | None) -> pa.RecordBatch:
    """Lines of a batch of pages (``page, words``), all pages at once."""
    words = batch.column(1)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
    flat = words.flatten()
    x0, top = (flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("x0", "top"))
    group = np.repeat(np.arange(len(sizes)) * 2, sizes)
    if gutter is not None:
        group += ~(x0 < gutter)
    order = np.lexsort((x0, top, group))
    group = group[order]
    starts = _line_starts(group, top[order], tolerance)
    line = np.cumsum(starts)
    order = order[np.lexsort((x0[order], line))]  # from left to right, lines as they are
    at = np.flatnonzero(starts)
    group = group[at]
    number = np.arange(len(at)) - np.searchsorted(group, group)
    texts = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int32()), pc.fill_null(flat.field("text"), "").take(pa.array(order)))
    columns = [batch.column(0).take(pa.array(group // 2)), pa.array((group % 2).astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(x0[order[at]]), pc.binary_join(texts, " ")]
    return pa.RecordBatch.from_arrays(columns, names=["page", "col", "line", "x0", "text"])


def gathered(words: DataFrame) -> DataFrame:
    """``page, words``: the boxes of each page (``page, x0, top, text`` rows) as one list."""
    return words.groupBy("page").agg(F.collect_list(F.struct("x0", "top", "text")).alias("words"))


def _folded(words: DataFrame, tolerance: float, gutter: float | None) -> DataFrame:
    """``page, col, line, x0, text`` of word rows or of pages that hold their ``words``."""
    pages = words.select("page", "words") if "words" in words.columns else gathered(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, PAGES):
                yield _lines(b.slice(i, PAGES), tolerance, gutter)

    return pages.mapInArrow(run, f"page {pages.schema['page'].dataType.simpleString()}, col int, line int, x0 double, text string")


def visual_lines(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines of each page: a word within ``tolerance`` of the line's first word (not of the one
    before it) is on that line; words run from left to right.

    ``words`` has one row a word (``page, x0, top, text``), or one a page: ``page, words``, a list
    of structs of ``x0, top, text``, which needs no shuffle. A page is one list, so one page is
    one task: that is its limit. A page without words has no lines."""
    return _folded(words, tolerance, None).select("page", "line", "x0", "text")


def column_lines(words: DataFrame, tolerance: float = 2.5, bases: tuple[float, float] = BASES) -> DataFrame:
    """Reading order of two-column pages with an indent level per line (never below 0), counted
    from where the column's text begins. Rows as for ``visual_lines``."""
    lines = _folded(words, tolerance, GUTTER)
    base = F.when(F.col("col") == 0, bases[0]).otherwise(bases[1])
    return lines.select("page", "col", "line", "text", F.greatest(F.lit(0), F.rint((F.col("x0") - base) / INDENT)).cast("int").alias("level"))


def nearest_center(x: Column, centers: Column) -> Column:
    """Index of the nearest column center; ties go to the first."""
    return F.array_min(F.transform(centers, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i"))))["i"]


def carried(value: Column, by: list[str], order: list[str]) -> Column:
    """The last value that is not null, up to and with each row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def carry_category(lines: DataFrame, is_category: Column, *order: str) -> DataFrame:
    """Each line with the last category line before it, page by page."""
    return lines.withColumn("category", carried(F.when(is_category, F.col("text")), ["page"], list(order))).where(~is_category)
