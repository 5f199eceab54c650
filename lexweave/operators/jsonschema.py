"""JSON documents against a JSON Schema: nested objects and arrays, local references.

Flat tables are checked by ``validate.schema_errors``, which stays in Catalyst. A document of
any depth cannot be; it is checked here in Arrow batches, one document at a time.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "integer" if float(value).is_integer() else "number"
    return {type(None): "null", str: "string", list: "array", dict: "object"}[type(value)]


def _same(a, b) -> bool:
    """Equality that keeps true apart from 1."""
    return _kind(a) in ("boolean", "null", "string") and a == b and type(a) is type(b) or _kind(a) in ("integer", "number") and not isinstance(b, bool) and a == b


def _is_date_time(value: str) -> bool:
    if not re.search(r"(?:Z|[+-]\d\d:\d\d)$", value):
        return False
    try:
        datetime.datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


def _is_uri(value: str) -> bool:
    try:
        parts = urlsplit(value)
    except ValueError:
        return False
    return bool(parts.scheme and parts.hostname)


_FORMATS = {"date-time": _is_date_time, "uri": _is_uri}


def _target(root: dict, ref: str):
    """What a local reference names; None if it names nothing."""
    if not ref.startswith("#/"):
        raise ValueError(f"only local references are supported: {ref}")
    at = root
    for part in ref[2:].split("/"):
        at = at.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(at, dict) else None
    return at


def problems(value, rule: dict, root: dict, where: str = "$") -> Iterator[str]:
    """Errors of a value, outer ones first; a value of the wrong type is not looked into."""
    if "$ref" in rule:
        found = _target(root, rule["$ref"])
        if found is None:
            yield f"{where}: unresolved schema reference {rule['$ref']}"
        else:
            yield from problems(value, found, root, where)
        return
    kind = _kind(value)
    if "const" in rule and not _same(value, rule["const"]):
        yield f"{where}: must equal {json.dumps(rule['const'])}"
    if "enum" in rule and not any(_same(value, x) for x in rule["enum"]):
        yield f"{where}: must be one of {', '.join(map(str, rule['enum']))}"
    if "type" in rule:
        allowed = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
        if kind not in allowed and not (kind == "integer" and "number" in allowed):
            yield f"{where}: expected {' or '.join(allowed)}, received {kind}"
            return
    if kind == "string":
        if len(value) < rule.get("minLength", 0):
            yield f"{where}: is shorter than {rule['minLength']}"
        if "pattern" in rule and not re.search(rule["pattern"], value):
            yield f"{where}: does not match {rule['pattern']}"
        if not _FORMATS.get(rule.get("format"), lambda _: True)(value):
            yield f"{where}: is not a valid {rule['format']}"
    elif kind in ("integer", "number"):
        if value < rule.get("minimum", value):
            yield f"{where}: must be at least {rule['minimum']}"
    elif kind == "array":
        if len(value) < rule.get("minItems", 0):
            yield f"{where}: has fewer than {rule['minItems']} items"
        if rule.get("uniqueItems") and len({json.dumps(x) for x in value}) < len(value):
            yield f"{where}: contains duplicate items"
        for i, item in enumerate(value if "items" in rule else ()):
            yield from problems(item, rule["items"], root, f"{where}/{i}")
    elif kind == "object":
        known = rule.get("properties", {})
        yield from (f"{where}: missing required property {k}" for k in rule.get("required", ()) if k not in value)
        for k, v in value.items():
            if k in known:
                yield from problems(v, known[k], root, f"{where}/{k}")
            elif rule.get("additionalProperties") is False:
                yield f"{where}: unexpected property {k}"


def document_errors(document: Column, schema: str) -> Column:
    """Array of errors of a JSON text; null and unreadable text are one error each."""
    root = json.loads(schema)

    def one(text: str | None) -> list[str]:
        try:
            value = json.loads(text) if text is not None else None
        except ValueError:
            return ["$: is not JSON"]
        return ["$: is missing"] if text is None else list(problems(value, root, root))

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None)

    return run(document)


def invalid_documents(documents: DataFrame, path: str, body: str, schema: str) -> DataFrame:
    """``path, error``: a row per error."""
    found = documents.select(F.col(path).alias("path"), document_errors(F.col(body), schema).alias("e"))
    return found.select("path", F.explode("e").alias("error"))
