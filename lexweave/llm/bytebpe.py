"""Byte-level BPE encoding and decoding as a monoid over text, reduced along a tree.

A text is cut in halves down to leaves, leaves are encoded on their own, and neighbours are
joined again. Two facts make a join exact without looking at the whole of either side:

* *Sync points.* No match of the splitting pattern runs over a place where white space follows
  a character that is not white space: the pattern takes white space only at the start of a
  match or as a run of its own. Text on either side of such a place is encoded independently,
  so a join re-encodes a window around the boundary, and grows it until a sync point stands at
  each end (or the text ends there); tokens outside it are final.
* *Pair stability.* Inside one (long) match, a sequence of tokens is the encoding of its bytes
  exactly if each two neighbours are the encoding of their own concatenation: the first merge
  to run over a boundary would already run over it in the pair alone. A join re-encodes a
  window around the boundary and widens it until both of its seams are stable.

Decoding maps ids to bytes in leaves and concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import map_rows, text_bytes

#: Characters of a text leaf, bytes of a leaf within one match, ids of a decoding leaf, and
#: characters of the first window around a join (it doubles until its ends are certain).
TEXT_LEAF, PIECE_LEAF, ID_LEAF, FIRST_WINDOW = 256, 256, 256, 32
#: Pairs whose stability is remembered before the memory starts anew (speed only).
PAIR_MEMORY = 200_000
#: White space that ends a window; a subset of every engine's ``\s``, so a sync point is certain.
_SYNC = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n\r\t])")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ``token rank`` lines of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class ByteBpe:
    """Encoder and decoder for one rank table; see the module text for the method."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.core = tiktoken.Encoding("lexweave", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length_of = [len(x) for x in self.bytes_of]
        self.stable: dict[tuple[int, int], bool] = {}
        self.joins = self.grown = 0  # joins so far, and windows that had to grow

    # text level -------------------------------------------------------------------------
    def encode(self, text: str, leaf: int = 0) -> list[int]:
        """Ids of a whole text of any length; an empty text has none. The ids do not depend on
        ``leaf``, the characters up to which a text is not halved (``TEXT_LEAF``)."""
        return self._encode(text, 0, len(text), leaf or TEXT_LEAF)

    def _encode(self, text: str, start: int, end: int, leaf: int) -> list[int]:
        if end - start <= leaf:
            return self._pieces(text[start:end], leaf)
        cut = (start + end) // 2
        return self._join(text, start, cut, end, self._encode(text, start, cut, leaf), self._encode(text, cut, end, leaf), leaf)

    def _join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int], leaf: int) -> list[int]:
        """The ids of ``text[start:end]`` from those of its halves."""
        self.joins += 1
        a, b = self._window(text, start, cut, end)
        self._drop_tail(left, len(text[a:cut].encode()))
        head = self._head(right, len(text[cut:b].encode()))
        left += self._pieces(text[a:b], leaf)
        left += right[head:]
        return left

    def _window(self, text: str, start: int, cut: int, end: int) -> tuple[int, int]:
        """The window around ``cut`` outside which all ids of both halves are final: each side
        reaches out until it holds a sync point, the nearest one, or the text's own end."""
        a, b, width = None, None, FIRST_WINDOW
        while a is None or b is None:
            if a is None:
                low = max(start, cut - width)
                found = [m.start() for m in _SYNC.finditer(text, low, cut)]
                a = found[-1] if found and found[-1] > start else start if low == start else None
            if b is None:
                high = min(end, cut + width)
                found = next((m.start() for m in _SYNC.finditer(text, cut + 1, high)), None)
                b = found if found is not None else end if high == end else None
            if a is None or b is None:
                width *= 2
                self.grown += 1
        return a, b

    def _drop_tail(self, ids: list[int], size: int) -> None:
        while size > 0:
            size -= self.length_of[ids.pop()]

    def _head(self, ids: list[int], size: int) -> int:
        i = 0
        while size > 0:
            size -= self.length_of[ids[i]]
            i += 1
        return i

    def _pieces(self, text: str, leaf: int) -> list[int]:
        """Each match of the pattern on its own; in a long text also by the tree."""
        if len(text) <= leaf:
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for piece in self.split.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    # within one match -------------------------------------------------------------------
    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match given as bytes."""
        if not piece:
            return []
        if len(piece) <= PIECE_LEAF:
            return self.core._encode_single_piece(piece)
        cut = len(piece) // 2
        return self.join_pieces(self.encode_piece(piece[:cut]), self.encode_piece(piece[cut:]))

    def join_pieces(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's product: the encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return [*left, *right]
        i, j = len(left), 0
        window: list[int] = []
        if self._is_stable(left[-1], right[0]):
            return left + right
        step = 1
        while True:
            i, j = max(0, i - step), min(len(right), j + step)
            window = self.core._encode_single_piece(b"".join(self.bytes_of[x] for x in chain(left[i:], right[:j])))
            ok_left = i == 0 or self._is_stable(left[i - 1], window[0])
            ok_right = j == len(right) or self._is_stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[:i] + window + right[j:]
            step *= 2

    def _is_stable(self, a: int, b: int) -> bool:
        key = (a, b)
        if key not in self.stable:
            if len(self.stable) >= PAIR_MEMORY:
                self.stable.clear()
            self.stable[key] = self.core._encode_single_piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.stable[key]

    # decoding ---------------------------------------------------------------------------
    def decode(self, ids: Sequence[int]) -> bytes:
        """Bytes of ids: leaves are mapped, then neighbours are concatenated up the tree."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + ID_LEAF])) for i in range(0, len(ids), ID_LEAF)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>`` for every row: each whole text encoded (null: no ids)."""

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        bpe = ByteBpe(read_ranks(ranks_path), pattern)
        for r in batch:
            yield {"doc_id": r["doc_id"], "ids": bpe.encode(r["body"].decode("utf-8", "replace"))}

    return map_rows(docs.select("doc_id", text_bytes().alias("body")), rows, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, body binary``: the bytes of an ``ids`` column."""

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        bpe = ByteBpe(read_ranks(ranks_path), pattern)
        for r in batch:
            yield {"doc_id": r["doc_id"], "body": bpe.decode(r["ids"] or [])}

    return map_rows(encoded.select("doc_id", "ids"), rows, "doc_id bigint, body binary")


def encode_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Encoding and decoding run in one pass over Arrow batches; no shuffle. Null and empty texts
    have no ids (digests of nothing); repeated rows give repeated results; a null doc_id stays
    null; other columns are not read. Bytes that are not UTF-8 read as U+FFFD.
    """

    def rows(batch: Iterator[dict]) -> Iterator[dict]:
        bpe = ByteBpe(read_ranks(ranks_path), pattern)
        decimal = list(map(str, range(len(bpe.bytes_of))))
        for r in batch:
            ids = bpe.encode(r["body"].decode("utf-8", "replace"))
            yield {
                "doc_id": r["doc_id"],
                "n_tokens": len(ids),
                "ids_sha256": hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                "decoded_sha256": hashlib.sha256(bpe.decode(ids)).hexdigest(),
            }

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(docs.select("doc_id", text_bytes().alias("body")), rows, schema)
