"""Fixtures with every awkward case, and plain versions to compare with."""

from __future__ import annotations

import re

PROSE = "Over the hills and far away a quiet river ran, and people there lived as they always had. "
LONG = " ".join(f"word{i % 997} of{i % 89}" for i in range(12000))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, PROSE * 12, "en", "b", 1), (5, PROSE * 12, "en", "c", 1),
    (5, PROSE * 12, "en", "c", 1), (None, "no id " * 30, None, "d", 2), (None, None, None, None, None), (6, LONG, "en", "b", 3),
    (7, "MIT License\nGNU general public LICENSE, Apache license <|endoftext|> é漢字 \x00 \x01   x", "fr", "e", 9), (8, "x" * 5000, "de", "f", 1), (9, "a  b c\r\n", "de", "g", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows=ROWS):
    """The rows, with extra columns whose names operators could use themselves."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, SCHEMA)
    for name in ("fp", "body", "id", "pos", "words", "gone", "n_lines", "root", "key", "site", "length"):
        d = d.withColumn(name, F.lit("extra"))
    return d


def empty(spark):
    return documents(spark, ROWS[:1]).where("1 = 0")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
