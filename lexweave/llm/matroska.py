"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

The parser reads any Matroska or WebM byte string: variable-length ids and sizes, unknown-size
clusters, SimpleBlock and BlockGroup, all four lacing modes, cues. ``mux_samples`` writes the
lossless 8-bit store that the query uses: one PCM track, clusters of EBML-laced SimpleBlocks
and a cue for every cluster.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import map_rows, text_bytes

# Element ids of the Matroska specification (RFC 9559), with their length marker.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {INFO, TRACKS, CLUSTER, CUES, VOID, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

#: The store of the query: samples of one packet, packets of one laced block, blocks of one
#: cluster, padding unit. Powers of two; 8-bit mono PCM at 8 kHz, so 8 samples are 1 ms.
PACKET, LACE, BLOCKS, UNIT, RATE = 1024, 8, 16, 64, 8000


def vint(value: int, width: int = 0) -> bytes:
    """A data size as a variable-length integer; all ones is kept for the unknown size."""
    width = width or max(1, -(-(value + 2).bit_length() // 7))
    while value > (1 << 7 * width) - 2:
        width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """Value and next offset; the value is -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"variable-length integer at {at} is cut")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value ^= 1 << 7 * width
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace_ebml(frames: list[bytes]) -> bytes:
    """Lace header and frames: the first size, then signed differences, the last size implied."""
    out, last = bytearray([len(frames) - 1]), 0
    for i, f in enumerate(frames[:-1]):
        if not i:
            out += vint(len(f))
        else:
            d = len(f) - last
            width = 1
            while not -((1 << 7 * width - 1) - 1) <= d <= (1 << 7 * width - 1) - 1:
                width += 1
            out += vint(d + (1 << 7 * width - 1) - 1, width)
        last = len(f)
    return bytes(out) + b"".join(frames)


def mux_samples(samples: bytes) -> bytes:
    """One Matroska file with the bytes as unsigned 8-bit mono PCM; depends on the bytes alone."""
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_VERSION, 4) + unsigned(DOC_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"lexweave") + element(WRITING_APP, b"lexweave"))
    audio = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + unsigned(DEFAULT_DURATION, PACKET * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues = bytearray(info + tracks), bytearray()
    per_block, per_cluster = PACKET * LACE, PACKET * LACE * BLOCKS
    for start in range(0, len(samples), per_cluster):
        time = start * 1000 // RATE
        cues += element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, len(body))))
        blocks = [unsigned(CLUSTER_TIMESTAMP, time)]
        for at in range(start, min(start + per_cluster, len(samples)), per_block):
            frames = [samples[i : i + PACKET] for i in range(at, min(at + per_block, len(samples)), PACKET)]
            relative = struct.pack(">h", at * 1000 // RATE - time)
            if len(frames) == 1:
                blocks.append(element(SIMPLE_BLOCK, b"\x81" + relative + b"\x80" + frames[0]))
            else:
                blocks.append(element(SIMPLE_BLOCK, b"\x81" + relative + b"\x86" + lace_ebml(frames)))
        body += element(CLUSTER, b"".join(blocks))
    body += element(CUES, bytes(cues))
    return head + element(SEGMENT, bytes(body))


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """``(id, body start, body end)``; an unknown-size element ends where a top-level one starts."""
    while at < end:
        ident, body = read_vint(data, at, keep_marker=True)
        size, body = read_vint(data, body)
        stop = min(end, body + size) if size >= 0 else _unknown_end(data, ident, body, end)
        yield ident, body, stop
        at = stop


def _unknown_end(data: bytes, ident: int, at: int, end: int) -> int:
    if ident == SEGMENT:
        return end
    while at < end:
        child, body = read_vint(data, at, keep_marker=True)
        if child in _TOP:
            return at
        size, body = read_vint(data, body)
        at = body + max(size, 0)
    return end


def _lace(data: bytes, at: int, end: int, mode: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames."""
    if not mode:
        return [(at, end)]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == 1:  # Xiph: bytes of 255 and a rest
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif mode == 3:  # EBML: signed differences
        for i in range(count - 1):
            start = at
            value, at = read_vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (at - start) - 1) - 1))
    else:
        sizes = [(end - at) // count] * (count - 1)
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return [*out, (at, end)]


def parse(data: bytes) -> dict:
    """Tracks, packets and cues of a file.

    A packet is ``track, time (ns), cluster, block, lace, keyframe, start, end``; a cue is
    ``time, track, position`` with the position counted from the start of the file. A block's
    time is that of its first frame; the others follow by the track's default duration, else by
    an equal part of the block's own duration, else they have the block's time.
    """
    tracks, packets, cues, clusters = [], [], [], []
    scale, block_no = 1_000_000, 0
    for top, a, b in children(data, 0, len(data)):
        if top != SEGMENT:
            continue
        base = a
        for ident, c, d in children(data, a, b):
            if ident == INFO:
                scale = next((int.from_bytes(data[x:y], "big") for i, x, y in children(data, c, d) if i == TIMESTAMP_SCALE), scale)
            elif ident == TRACKS:
                tracks += [_track(data, x, y) for i, x, y in children(data, c, d) if i == TRACK_ENTRY]
            elif ident == CLUSTER:
                clusters.append(c)
                time = 0
                for i, x, y in children(data, c, d):
                    if i == CLUSTER_TIMESTAMP:
                        time = int.from_bytes(data[x:y], "big")
                    elif i in (SIMPLE_BLOCK, BLOCK_GROUP):
                        lasts = key_frame = None
                        if i == BLOCK_GROUP:
                            inner = {k: (p, q) for k, p, q in children(data, x, y)}
                            key_frame = REFERENCE_BLOCK not in inner
                            if BLOCK not in inner:
                                continue
                            lasts = int.from_bytes(data[slice(*inner[BLOCK_DURATION])], "big") if BLOCK_DURATION in inner else None
                            x, y = inner[BLOCK]
                        number, at = read_vint(data, x)
                        relative, flags = struct.unpack_from(">hB", data, at)
                        if key_frame is None:
                            key_frame = bool(flags & 0x80)
                        frames = _lace(data, at + 3, y, flags >> 1 & 3)
                        step = next((t["duration"] for t in tracks if t["number"] == number), 0) or (lasts * scale // len(frames) if lasts else 0)
                        start = (time + relative) * scale
                        for lace, (p, q) in enumerate(frames):
                            packets.append({"track": number, "time": start + lace * step, "cluster": len(clusters) - 1, "block": block_no, "lace": lace, "keyframe": key_frame, "start": p, "end": q})
                        block_no += 1
            elif ident == CUES:
                for i, x, y in children(data, c, d):
                    if i == CUE_POINT:
                        point = {k: (p, q) for k, p, q in children(data, x, y)}
                        place = {k: int.from_bytes(data[p:q], "big") for k, p, q in children(data, *point[CUE_TRACK_POSITIONS])}
                        cues.append({"time": int.from_bytes(data[slice(*point[CUE_TIME])], "big") * scale, "track": place[CUE_TRACK], "position": base + place[CUE_CLUSTER_POSITION]})
    return {"tracks": tracks, "packets": packets, "cues": cues, "clusters": len(clusters)}


def _track(data: bytes, at: int, end: int) -> dict:
    out = {"number": 0, "type": 0, "codec": "", "duration": 0}
    for i, x, y in children(data, at, end):
        if i == TRACK_NUMBER:
            out["number"] = int.from_bytes(data[x:y], "big")
        elif i == TRACK_TYPE:
            out["type"] = int.from_bytes(data[x:y], "big")
        elif i == DEFAULT_DURATION:
            out["duration"] = int.from_bytes(data[x:y], "big")
        elif i == CODEC_ID:
            out["codec"] = data[x:y].decode("ascii", "replace")
    return out


def packet_table(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per packet of a column of files: track, time, place in the file, byte range.

    Null or empty media and empty tables give no rows; a null key stays null; repeated rows
    give their packets again; other columns are not read; bytes that are not Matroska raise
    ``ValueError``.
    """

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        for r in batch:
            for p in parse(r["media"] or b"")["packets"]:
                yield {"key": r["key"], "track": p["track"], "time_ns": p["time"], "cluster": p["cluster"], "block": p["block"], "lace": p["lace"], "keyframe": p["keyframe"], "start": p["start"], "length": p["end"] - p["start"]}

    schema = "key bigint, track int, time_ns bigint, cluster int, block int, lace int, keyframe boolean, start bigint, length bigint"
    return map_rows(media.select(F.col(key).alias("key"), F.col(column).alias("media")), rows, schema)


def store_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each text as a Matroska file, zero-padded to the unit.

    Null and empty texts are one unit of zeros; a null doc_id stays null; repeated rows repeat;
    an empty table gives no rows; other columns are not read.
    """

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        for r in batch:
            yield {"doc_id": r["doc_id"], "n_bytes": len(r["body"]), "media": mux_samples(padded(r["body"]))}

    return map_rows(docs.select("doc_id", text_bytes().alias("body")), rows, "doc_id bigint, n_bytes bigint, media binary")


def padded(body: bytes) -> bytes:
    return body + bytes(max(UNIT, -(-len(body) // UNIT) * UNIT) - len(body))


def media_digest(docs: DataFrame) -> DataFrame:
    """One row per document about its text stored as a Matroska file and read back from it.

    The files are the column that ``store_texts`` makes; only those bytes are read. ``payload_*``
    and ``tail_crc32`` are over the packets that the parser finds, in order of block and lace;
    ``feature`` counts tracks, clusters, blocks, packets and cues and gives the last packet's
    time, mean and spread of the samples. Null texts are empty ones (64 zero samples); equal
    texts give equal values; a null doc_id stays null; repeated rows repeat; an empty table
    gives no rows; other columns are not read.
    """

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        for r in batch:
            yield {"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], **digest(r["media"])}

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return map_rows(store_texts(docs), rows, schema)


def digest(media: bytes) -> dict:
    """Digests and features of one stored file, from its own packet table."""
    found = parse(media)
    packets = found["packets"]
    payload = b"".join(media[p["start"] : p["end"]] for p in packets)
    ends = sum(media[c["position"] : c["position"] + 4] == CLUSTER.to_bytes(4, "big") for c in found["cues"])
    counts = _histogram(payload)
    n = max(1, len(payload))
    mean = sum(i * c for i, c in enumerate(counts)) / n
    spread = (sum(i * i * c for i, c in enumerate(counts)) / n - mean * mean) ** 0.5
    last = max((p["time"] for p in packets), default=0) // 1_000_000
    feature = f"tracks={len(found['tracks'])};clusters={found['clusters']};blocks={packets[-1]['block'] + 1 if packets else 0};packets={len(packets)};cues={ends};last_ms={last};mean={mean:.4f};spread={spread:.4f}"
    return {
        "payload_bytes": len(payload),
        "payload_sha256": hashlib.sha256(payload).hexdigest(),
        "tail_crc32": zlib.crc32(payload[-UNIT:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": feature,
    }


def _histogram(payload: bytes) -> list[int]:
    import numpy as np

    return np.bincount(np.frombuffer(payload, np.uint8), minlength=256).tolist()
