"""Small reports as Markdown, and the binding of an edition to its base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_table(df: DataFrame, title: str, limit: int = 50) -> str:
    """The first ``limit`` rows of a report (a report shows samples, the table has all)."""
    rows = df.limit(limit).collect()
    text = lambda v: "" if v is None else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(text(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def binding_errors(editions: DataFrame, bases: DataFrame) -> DataFrame:
    """Editions whose recorded base (schema version, time, manifest hash) is not the base."""
    b = bases.select("base_id", *(F.col(c).alias(f"base_{c}") for c in ("schema_version", "generated_at", "manifest_sha256")))
    j = editions.join(b, "base_id", "left")
    wrong = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"base_{c}")), F.lit(c)) for c in ("schema_version", "generated_at", "manifest_sha256"))), lambda x: x.isNotNull())
    return j.select("edition", "base_id", wrong.alias("wrong")).where(F.size("wrong") > 0)
