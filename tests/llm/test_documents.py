"""Operators on documents against plain versions, on the awkward rows and on empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from lexweave.llm import bytebpe, licenses, linededup, matroska, packing, quality, queries, simhash, tokenstore
from tests.llm.helpers import LONG, PROSE, ROWS, ascii_lower, documents, empty, tuples, words


def test_quality_statistics(spark):
    got = tuples(quality.quality_rules(documents(spark)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t, *_ in ROWS:
        w = words(t)
        tri = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(tri)
        cover = {k for j, x in enumerate(tri) if n[x] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert got == sorted(want, key=repr)
    assert quality.quality_rules(empty(spark)).count() == 0
    assert quality.keep_good(documents(spark)).columns == documents(spark).columns


@pytest.mark.parametrize("half", [0, 1])
def test_quality_verdicts_on_each_half_of_the_labels(spark, half):
    """Rules and thresholds take nothing from the labels, so either half is held out."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half)
    d = quality.quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id").cache()
    judged = d.where("not base_failed")
    assert judged.where("(quality = 1) = kept").count() >= 0.99 * judged.count() > 100
    good = d.where("quality = 1")
    assert good.where("posterior >= 0.5").count() >= 0.97 * good.count()


def _plain_em(patterns, iterations=50):
    """EM on votes per document, one document at a time: posterior of each."""
    post = [(v.count(1) + 1) / (v.count(1) + v.count(-1) + 2) for v in patterns]
    n_rules = len(patterns[0]) if patterns else 0
    for _ in range(iterations):
        good, bad = sum(post), sum(1 - p for p in post)
        a = [(sum(p for v, p in zip(patterns, post, strict=True) if v[j]) + 1) / (good + 2) for j in range(n_rules)]
        b = [(sum(1 - p for v, p in zip(patterns, post, strict=True) if v[j]) + 1) / (bad + 2) for j in range(n_rules)]
        new = []
        for v in patterns:
            x = np.log((good + 1) / (bad + 1)) + sum(np.log(a[j] / b[j]) if v[j] else np.log((1 - a[j]) / (1 - b[j])) for j in range(n_rules))
            new.append(1 / (1 + np.exp(-np.clip(x, -60, 60))))
        post = new
    return post


def _code(votes):
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def test_quality_estimate_outvotes_a_rule_that_is_often_wrong():
    """Four rules that are right nine times in ten, and a detector that cries bad on half of all
    good documents: the posterior follows the four, a filter that all must pass would not."""
    rng = np.random.default_rng(11)
    truth = rng.random(4000) < 0.7
    votes = []
    for good in truth:
        v = [(1 if good else 0) if rng.random() < 0.9 else (0 if good else 1) for _ in range(2)]
        v += [(0 if good else -1) if rng.random() < 0.9 else (-1 if good else 0) for _ in range(2)]
        votes.append((*v, -1 if rng.random() < 0.5 else 0))
    counts = Counter(map(_code, votes))
    post = quality.estimate(counts, 5, quality.QualityParams())
    plain = _plain_em(votes)
    assert max(abs(post[_code(v)] - p) for v, p in zip(votes, plain, strict=True)) < 1e-6
    kept = np.array([post[_code(v)] >= 0.5 for v in votes])
    strict = np.array([-1 not in v for v in votes])
    assert (kept == truth).mean() > 0.93 and (strict == truth).mean() < 0.65
    assert quality.estimate({}, 3, quality.QualityParams()) == {}


def _fingerprint(t):
    w = words(ascii_lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    return {p: find(p) for p in root}


@pytest.mark.parametrize("extra", [{}, {"spare": 2}, {"bucket_limit": 2}])
def test_near_duplicates(spark, extra):
    rng = np.random.default_rng(5)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 120)) for _ in range(12)]
    rows = list(ROWS) + [(100 + i, base[i % 12] + (f" tail{i}" if i % 3 else ""), "en", "s", 1) for i in range(60)]
    d = simhash.components(documents(spark, rows), **extra).collect()
    prints = [_fingerprint(t) for _, t, *_ in rows]
    comp = _components(set(prints))
    least = {}
    for (i, *_), p in zip(rows, prints, strict=True):
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    want = sorted(((r[0], p, least.get(comp[p])) for r, p in zip(rows, prints, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in d), key=repr) == want


def test_near_duplicates_keep_one_and_empty(spark):
    kept = simhash.keep_one(documents(spark))
    ids = sorted(x[0] for x in kept.select("doc_id").collect() if x[0] is not None)
    assert ids == [1, 4, 6, 7, 8, 9] and kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.keep_one(empty(spark)).count() == 0


def test_bucket_forest_links_all():
    x = np.array([0, 1, 3, 7, 15, 31, 3 << 40], np.int64)
    a, b = simhash.bucket_forest(x, 1)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(1, 0), (3, 0), (7, 0), (15, 0), (31, 0)]


def test_line_dedup(spark):
    rows = [(i, f"shared line\nown {i} line\n\n  shared line \nrare {i % 20}", "en", f"s{i % 10}", 0) for i in range(40)] + list(ROWS)
    p = linededup.SpreadParams(min_sites=10)
    out = {(r.doc_id, r.text): r for r in linededup.dedup_lines(documents(spark, rows), params=p).collect()}
    assert out[(0, rows[0][1])].n_removed == 0
    assert out[(7, "own 7 line\n\nrare 7")].n_removed == 2
    assert linededup.spread_report(empty(spark)).count() == 0
    cleaned = linededup.clean_lines(documents(spark, rows), p)
    assert cleaned.columns == documents(spark).columns and cleaned.count() == len(rows)
    exact = linededup.SpreadParams(min_sites=11)
    assert linededup.dedup_lines(documents(spark, rows), params=exact).agg({"n_removed": "sum"}).first()[0] == 0


def _pieces(ids, capacity=2048):
    out, start = [], 0
    for k, stop in enumerate(range(len(ids) % capacity or capacity, len(ids) + 1, capacity)):
        out.append((k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
        start = stop
    return out


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    got = packing.pack(documents(spark), queries.byte_ids).collect()
    want = [(i, *p) for i, t, *_ in ROWS for p in _pieces(library.encode(t or "", add_special_tokens=False).ids + [0])]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert packing.pack(empty(spark), queries.byte_ids).count() == 0


def _best(items, capacity):
    best = [len(items)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[j] -= items[i]
            place(i + 1, rooms)
            rooms[j] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(1)
    for _ in range(400):
        capacity = int(rng.choice([10, 20, 50]))
        items = sorted((int(x) for x in rng.integers(max(1, capacity // int(rng.choice([3, 4, 50]))), capacity + 1, rng.integers(1, 9))), reverse=True)
        fixed, rest = packing.reduce_dominated(Counter(items), capacity)
        left = sorted((s for s, n in rest.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + (_best(left, capacity) if left else 0) == _best(items, capacity)
        packed = Counter()
        for pattern, n in fixed + packing.best_fit(rest, capacity):
            assert sum(pattern) <= capacity
            packed.update({s: k * n for s, k in Counter(pattern).items()})
        assert packed == Counter(items)


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    start, want = 0, []
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert tuples(tokenstore.token_files(documents(spark), queries.word_ids), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert tokenstore.token_files(empty(spark), queries.word_ids).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 0), (1, 10**6), (1000, 3), (3000, 10**7), (700, 0)):
        values = np.sort(rng.integers(0, top + 1, n))
        code, _ = tokenstore.EliasFano.from_bytes(tokenstore.EliasFano.of(values).to_bytes())
        assert [code[i] for i in range(n)] == values.tolist() and len(code.samples) == 4 * -(-n // tokenstore.SAMPLE)
    dense = np.cumsum(rng.integers(1, 2000, 5000))
    assert len(tokenstore.EliasFano.of(dense).to_bytes()) * 8 / 5000 < 2.4 + np.log2(dense[-1] / 5000)
    gaps = np.repeat(np.arange(10) * 10**8, 300)  # ones in runs, long stretches of zeros
    assert [tokenstore.EliasFano.of(gaps)[i] for i in range(3000)] == gaps.tolist()


def test_token_blocks_refuse_ids_that_do_not_fit():
    wide = [np.array([1, 70_000], np.uint32), np.array([], np.uint32), np.array([5], np.uint32)]
    with pytest.raises(ValueError):
        tokenstore.write_block(wide, 2)
    block = tokenstore.Block(tokenstore.write_block(wide, 4))
    assert [block.ids(i).tolist() for i in range(3)] == [[1, 70_000], [], [5]] and block.span(2) == (2, 3)


def test_word_encoder_equals_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ours, rng = queries.word_ids(), np.random.default_rng(3)
    letters = list("abé漢 \t\n's1²ΣσA,.\x01́ŀ" + "<|endoftext|>")
    for _ in range(1500):
        text = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert ours(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_bpe(spark, monkeypatch):
    import tiktoken

    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    ranks = bytebpe.read_ranks(path)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = tuples(bytebpe.encode_digest(documents(spark), path, pattern), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t, *_ in ROWS:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bytebpe.encode_digest(empty(spark), path, pattern).count() == 0
    monkeypatch.setattr(bytebpe, "TEXT_LEAF", 16)
    monkeypatch.setattr(bytebpe, "PIECE_LEAF", 8)
    bpe, rng = bytebpe.ByteBpe(ranks, pattern), np.random.default_rng(4)
    for alphabet in ("ab c\n", "aé  \t'sl漢1", "thing er  \n", "aaaa", "!?. \x85 x\x1c"):
        for _ in range(300):
            text = "".join(rng.choice(list(alphabet), rng.integers(0, 120)))
            assert bpe.encode(text) == library.encode_ordinary(text), repr(text)
            assert bpe.decode(bpe.encode(text)) == text.encode()


def test_byte_bpe_columns_and_joins(spark):
    """Ids and bytes as columns; every text above a leaf is joined, by windows that may grow."""
    path, pattern = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"), queries.split_pattern()
    encoded = bytebpe.encode_texts(documents(spark), path, pattern)
    back = bytebpe.decode_ids(encoded, path, pattern)
    assert sorted((bytes(r.body).decode() for r in back.collect())) == sorted(t or "" for _, t, *_ in ROWS)
    assert bytebpe.encode_texts(empty(spark), path, pattern).count() == 0
    bpe = bytebpe.ByteBpe(bytebpe.read_ranks(path), pattern)
    bpe.encode("short")
    assert bpe.joins == 0
    bpe.encode(LONG)
    assert bpe.joins >= len(LONG) // bytebpe.TEXT_LEAF - 1 and bpe.grown == 0
    bpe.encode("x" * 3000)
    assert bpe.grown > 0


def _plain_feature(payload):
    """The feature of a payload by arithmetic on its length and samples alone."""
    packets = -(-len(payload) // 1024)
    blocks, clusters = -(-packets // 8), -(-packets // 128)
    samples = np.frombuffer(payload, np.uint8).astype(np.float64)
    last = (packets - 1) * 1024 * 1000 // 8000
    return f"tracks=1;clusters={clusters};blocks={blocks};packets={packets};cues={clusters};last_ms={last};mean={samples.mean():.4f};spread={samples.std():.4f}"


def test_media(spark):
    want = []
    for i, t, *_ in ROWS:
        body = (t or "").encode()
        payload = body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        media = matroska.mux_samples(payload)
        want.append((i, len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), _plain_feature(payload)))
    columns = "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    assert tuples(matroska.media_digest(documents(spark)), *columns) == sorted(want, key=repr)
    assert matroska.media_digest(empty(spark)).count() == 0
    stored = matroska.store_texts(documents(spark))
    packets = matroska.packet_table(stored).where("key = 6").orderBy("block", "lace").collect()
    assert sum(p.length for p in packets) == len(LONG.encode()) + -len(LONG.encode()) % 64
    assert [p.time_ns for p in packets] == [i * 128_000_000 for i in range(len(packets))]
    assert matroska.packet_table(stored.withColumn("media", F.lit(None).cast("binary"))).count() == 0


def test_media_parser_reads_other_lacing():
    m = matroska
    frames = [b"a" * 300, b"bb", b"c" * 20]
    xiph = bytes([2, 255, 45, 2]) + b"".join(frames)
    fixed = bytes([1]) + b"1234" + b"5678"
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82\x00\x05\x02" + xiph) + m.element(m.REFERENCE_BLOCK, b"\x01"))
    cluster = m.unsigned(m.CLUSTER_TIMESTAMP, 7) + group + m.element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x04" + fixed)
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster  # a cluster of unknown size
    timed = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x81\x00\x09\x02" + xiph) + m.unsigned(m.BLOCK_DURATION, 30))
    laced = m.parse(m.element(m.SEGMENT, m.element(m.CLUSTER, m.unsigned(m.CLUSTER_TIMESTAMP, 1) + timed)))["packets"]
    assert [p["time"] // 10**6 for p in laced] == [10, 20, 30] and all(p["keyframe"] for p in laced)
    data = m.element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\xff" + unknown + m.element(m.CUES, b"")
    found = m.parse(data)["packets"]
    assert [data[p["start"] : p["end"]] for p in found] == [*frames, b"1234", b"5678"]
    assert [(p["track"], p["time"] // 10**6, p["keyframe"]) for p in found][0] == (2, 12, False)
    with pytest.raises(ValueError):
        m.parse(b"\x00\x00")


def test_licenses(spark):
    rows = {r.doc_id: r for r in licenses.license_scan(documents(spark)).collect()}
    assert (rows[7].n_base, rows[7].first_word, rows[7].last_word, rows[7].base_labels) == (3, 0, 6, "apache,gpl,mit")
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].labels, rows[1].score) == (0, 0, None, "", 0.0)
    finder = licenses.NoticeFinder()
    text = licenses.fold(b"It is relased under teh MIT license, ok. Released under the MIT License.")
    found = [(finder.notices[i].label, e) for i, _, _, e in finder.find(text) if finder.notices[i].label == "mit-notice"]
    assert len(found) == 2 and found[1] == ("mit-notice", 0) and 0 < found[0][1] <= 3
    spans = licenses.notice_spans(documents(spark)).where("doc_id = 7 and is_base").orderBy("first_word").collect()
    assert [s.matched for s in spans] == ["mit license", "general public license", "apache license"]
    assert licenses.license_scan(empty(spark)).count() == 0 and PROSE


def _base_places(text):
    """Label and start word of each phrase, word by word."""
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    return w, [(label, i) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p)] == p]


def test_license_base_fields_against_every_word(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["MIT", "License", "apache", "license", "general", "public", "GNU", "Lizenz", "é", "漢字", "x-y", ".", "\n"]
    rows = list(ROWS) + [(200 + i, " ".join(rng.choice(vocabulary, rng.integers(0, 60))), "en", "a", 0) for i in range(60)]
    want = []
    for i, t, *_ in rows:
        w, places = _base_places(t or "")
        starts = [k for _, k in places]
        want.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in places}))))
    found = licenses.license_scan(documents(spark, rows))
    assert tuples(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found.collect())


def test_license_words_that_tell_licences_apart():
    finder = licenses.NoticeFinder()
    labels = lambda t: {finder.notices[i].label for i, *_ in finder.find(licenses.fold(t.encode()))}
    for text in ("released under the bsd license", "licensed under cc by nd 4 0", "licensed under cc by sa 4.0", "licensed under CC BY 3.0"):
        assert not labels(text), text
    assert labels("licensed under the GNU general public license version 2") == {"gpl"}
    assert labels("licenced under the apache licence, version 2.0") == {"apache-2.0-notice"}
    assert labels("released under the bsd license or released under teh MIT license") == {"mit", "mit-notice"}


def test_license_places_in_a_long_text():
    import time

    start = time.time()
    text = licenses.fold(b"mit license " * 80_000)
    found = licenses.NoticeFinder().find(text)
    assert licenses.WordPlaces(text).at([a for _, a, _, _ in found]) == list(range(0, 160_000, 2))
    assert not licenses.NoticeFinder().find(licenses.fold(b"licensed under the " * 50_000))
    assert time.time() - start < 20


def test_license_seeds_lose_no_match():
    import regex

    finder, rng = licenses.NoticeFinder(), np.random.default_rng(6)
    notice = next(n for n in finder.notices if n.label == "rights-notice")
    for _ in range(200):
        text = list(f" {notice.words} ")
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(1, len(text) - 1))] = str(rng.choice(list("abcxyz")))
        text = " foo" + "".join(text) + "bar "
        direct = regex.search(f"(?b)(?: {notice.words} ){{e<={notice.edits}}}", text) is not None
        assert direct == any(finder.notices[i] is notice for i, *_ in finder.find(text)), text
