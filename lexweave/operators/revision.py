"""Token diff of two versions of a text (Myers), as an Arrow function and as plain Python."""

from __future__ import annotations

from array import array

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = regex.compile(r"\s+|[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]")
#: Edits up to which the shortest script is sought; beyond, the texts are replaced whole.
BUDGET = 2000


def _script(a: list[str], b: list[str], budget: int) -> list[tuple[str, str]] | None:
    """Greedy shortest edit script. A round of d edits moves d + 1 diagonals; what is kept of it
    are their ends as 32-bit numbers, half of the square of the edits in all."""
    n, m = len(a), len(b)
    rounds: list[array] = []
    before = array("i")
    for d in range(min(n + m, budget) + 1):
        now = array("i")
        for i, k in enumerate(range(-d, d + 1, 2)):
            down = before[i] if i < d else -1  # from diagonal k + 1: an insertion
            right = before[i - 1] + 1 if i else -1  # from diagonal k - 1: a deletion
            x = max(down, right) if d else 0
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            now.append(x)
            if x >= n and x - k >= m:
                return _walk([*rounds, now], a, b)
        rounds.append(now)
        before = now
    return None


def _walk(rounds: list[array], a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The script from the end back to the start: equal tokens down to where an edit led."""
    out, x, y = [], len(a), len(b)
    for d in range(len(rounds) - 1, 0, -1):
        before, i = rounds[d - 1], (x - y + d) // 2
        down = before[i] if i < d else -1
        right = before[i - 1] + 1 if i else -1
        start = max(down, right)
        while x > start:
            x, y = x - 1, y - 1
            out.append(("equal", a[x]))
        if right > down:
            x -= 1
            out.append(("delete", a[x]))
        else:
            y -= 1
            out.append(("insert", b[y]))
    out += [("equal", t) for t in reversed(a[:x])]
    return out[::-1]


def diff_texts(before: str | None, after: str | None, budget: int = BUDGET) -> list[dict]:
    """Segments ``type, text``: equal and deleted ones give the text before, equal and inserted
    ones the text after. Null reads as empty; equal neighbours are one segment."""
    a, b = _TOKENS.findall(before or ""), _TOKENS.findall(after or "")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    if head == len(a) == len(b):
        script = [("equal", t) for t in a]
    else:
        script = _script(a, b, budget)
        if script is None or not a or not b:
            script = [("delete", t) for t in a] + [("insert", t) for t in b]
    out: list[dict] = []
    for kind, text in script:
        if out and out[-1]["type"] == kind:
            out[-1]["text"] += text
        else:
            out.append({"type": kind, "text": text})
    return out


def diff_revision(before: Column, after: Column, budget: int = BUDGET) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([diff_texts(p, q, budget) for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(run, "array<struct<type:string,text:string>>")(before, after)
