"""The corpus pipeline against a plain version of its stages, one document at a time."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import regex

from lexweave.llm import queries, shingles
from tests.llm.helpers import ROWS, SCHEMA, documents, empty, words
from tests.llm.test_documents import _plain_em
from tests.llm.test_near_copies import plain_heads


def plain_votes(text):
    """Votes of the ten quality rules on a text."""
    t = text or ""
    w = words(t)
    n = max(1, len(w))
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    repeats = len({k for i, x in enumerate(triples) if often[x] > 1 for k in (i, i + 1, i + 2)}) / n
    lines = [x for x in t.split("\n") if words(x)]
    symbols, shouts, bangs = (len(regex.findall(p, t)) / n for p in (r"[#*$%&|<>]", r"\p{Lu}{2,}", "[!?]{2,}"))
    stops = len(regex.findall("[.!?。！？।؟]", t)) / n
    size = sum(map(len, w)) / n
    bad = [len(w) < 50, size < 1.8 or size > 40, symbols >= 0.25, shouts >= 0.4, bangs >= 0.25, repeats >= 0.4, len(lines) - len(set(lines)) >= max(3.0, n / 40)]
    good = [0.01 <= stops <= 0.5 and bangs < 0.1, len(set(w)) / n >= 0.25 * min(1.0, math.sqrt(2000 / n)) and symbols < 0.1, symbols < 0.1 and shouts < 0.2 and bangs < 0.1 and repeats < 0.3]
    return tuple(-1 if x else 0 for x in bad) + tuple(1 if x else 0 for x in good)


def plain_quality(rows):
    post = _plain_em([plain_votes(r[1]) for r in rows])
    return [r for r, p in zip(rows, post, strict=True) if p >= 0.5]


def plain_lines(rows, least=8):
    trimmed = lambda x: x.strip(" \t\n\x0b\x0c\r")
    sites, ids = defaultdict(set), defaultdict(set)
    for i, text, _, source, _ in rows:
        for x in (text or "").split("\n"):
            sites[trimmed(x)].add(source)
            ids[trimmed(x)].add(i)
    first = {x: min((i for i in ids[x] if i is not None), default=None) for x in sites if x and len(sites[x]) >= least}
    out = []
    for i, text, lang, source, n in rows:
        kept = None if text is None else "\n".join(x for x in text.split("\n") if trimmed(x) not in first or first[trimmed(x)] == i)
        gone = kept != text
        out.append((i, kept, lang, source, len(kept) if gone else n))
    return out


def plain_near(rows):
    """The row of each component with the least doc_id (nulls last), words' hash, text."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, shingles.node((r[1] or "").encode()), r[1] is not None, r[1] or ""))
    return [order[i] for i in plain_heads([r[1] for r in order])]


def plain_pieces(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    out = []
    for i, text, *_ in rows:
        ids, start = library.encode(text or "", add_special_tokens=False).ids + [0], 0
        for k, stop in enumerate(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)):
            out.append((i, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start = stop
    return out


def fixture_rows(spark, sf_dir):
    """The smallest table, with near copies on both sides of 0.8, a line that nine sites share and
    one that seven do, and the awkward rows."""
    r = random.Random(3)
    rows = [tuple(x) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = [x for x in rows if 80 <= len(words(x[1])) <= 300][:25]
    for k, (_, text, lang, _, _) in enumerate(long):
        w = text.split(" ")
        for i in r.sample(range(len(w)), 1 + k % 12):
            w[i] = f"changed{i}"
        rows.append((10_000 + k, " ".join(w), lang, f"new{k}", None))
    for k, (_, text, lang, _, _) in enumerate(long[:9]):
        rows.append((20_000 + k, f"All of this is on nine sites.\n{text[::-1]}\n" + (" And this on seven. \n" if k < 7 else ""), lang, f"site{k}", 1))
    return rows + list(ROWS)


def test_run_against_plain_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as c

    rows = fixture_rows(spark, sf_dir)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = c.run(spark, str(tmp_path)).collect()
    good = plain_quality(rows)
    clean = plain_lines(good)
    one = plain_near(clean)
    assert len(rows) > len(good) > len(one) and clean != good
    want = plain_pieces(one)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist() and sum(n for _, n in places) <= 2048
    assert len(held) <= 1.05 * sum(x[3] for x in want) / 2048 + 1


def test_stages_follow_each_other(spark, sf_dir):
    import corpus_pipeline as c
    from lexweave.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in c.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]
    packed = c.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == seen[-1]


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    import corpus_pipeline as c

    for make in (documents, empty):
        docs = make(spark)
        for _, stage in c.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.count()
