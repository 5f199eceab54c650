"""Fast encoders for two public vocabularies, equal to the tokenizers library id for id.

A BPE vocabulary whose ids grow in order of merging gives the same result by ranks of
concatenated bytes as by its list of merges: the pair that made a token is how its bytes stand
on their own before that merge, so no other pair of neighbours can hold them. The rank encoder
is several times faster. Texts that name a special token go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from lexweave.llm.bytebpe import ByteBpe, read_ranks
from lexweave.llm.common import bound_batches, text_bytes

#: A quarter of the rows, and the bytes, of an output batch.
ROWS, OUT_BYTES = 256, 4_000_000
#: Characters that the byte-level encoder takes at a time; the ids are the same for any number.
LEAF = 4096

Encode = Callable[[str], list[int]]


def _library(json_path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    full = Tokenizer.from_file(json_path)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    return special, lambda text: full.encode(text, add_special_tokens=False).ids


@lru_cache(4)
def byte_encoder(json_path: str, ranks_path: str, pattern: str) -> Encode:
    """Byte-level BPE whose vocabulary is there in both formats."""
    special, library = _library(json_path)
    bpe = ByteBpe(read_ranks(ranks_path), pattern)
    return lambda text: library(text) if any(s in text for s in special) else bpe.encode(text, LEAF)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Ends a word inside the rank encoder; texts that hold it take the slower way.
_MARK = "\x01"
#: Texts whose characters need no Unicode tables: ASCII and the letters of Latin-1.
_SIMPLE = re.compile(r"[\t\n\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]*").fullmatch
_SIMPLE_WORDS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\xff]+").findall


@lru_cache(4)
def word_encoder(json_path: str) -> Encode:
    """Lower-casing BPE with word ends: composed, lower-cased words, white space dropped.

    A word's end is a byte of its own here that its last byte joins before all other merges,
    as the vocabulary's ids give single bytes and bytes with word ends the lowest ranks.
    """
    special, library = _library(json_path)
    with open(json_path, encoding="utf-8") as f:
        model = json.load(f)
    byte, end = _byte_of_char(), model["model"]["end_of_word_suffix"]
    names = {t["content"] for t in model["added_tokens"]}
    ranks, marked = {}, {}
    for token, rank in model["model"]["vocab"].items():
        if token not in names:
            body = bytes(byte[c] for c in token.removesuffix(end))
            ranks[body + b"\xff" * token.endswith(end)] = rank  # a byte that UTF-8 never has
            marked[body + _MARK.encode() * token.endswith(end)] = rank
    pattern = next(x["pattern"]["Regex"] for x in model["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
    words = regex.compile(pattern).findall
    exact = tiktoken.Encoding("word-ends", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    joined = tiktoken.Encoding("marked", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=marked, special_tokens={})

    def lower(text: str) -> str:
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no final sigma

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return library(text)
        found = _SIMPLE_WORDS(text.lower()) if _SIMPLE(text) else words(lower(unicodedata.normalize("NFC", text)))
        if _MARK in text:
            return list(chain.from_iterable(exact._encode_single_piece(w.encode() + b"\xff") for w in found))
        return joined.encode_ordinary(_MARK.join(found) + _MARK) if found else []

    return encode


def map_ids(docs: DataFrame, columns: list[str], encoder: Callable[[], Encode], rows: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """``mapInArrow`` over ``columns`` and each text's ids.

    ``rows`` gets an iterator of (values, unsigned 32-bit ids) and yields (dict, bytes of it);
    batches are cut by bytes, so that memory is bounded however long texts are.
    """
    bound_batches(docs.sparkSession)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = encoder()
        for b in batches:
            values = zip(*(b.column(i).to_pylist() for i in range(len(columns))), strict=True)
            for v, body in zip(values, b.column(len(columns)), strict=True):
                yield v, np.array(encode(body.as_py().decode("utf-8", "replace")), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size = [], 0
        for row, weight in rows(pairs(batches)):
            pending.append(row)
            size += weight
            if len(pending) >= 4 * ROWS or size >= OUT_BYTES:
                yield pa.RecordBatch.from_pylist(pending, schema=arrow)
                pending, size = [], 0
        if pending:
            yield pa.RecordBatch.from_pylist(pending, schema=arrow)

    return docs.select(*columns, text_bytes().alias("__ids_body")).mapInArrow(run, schema)
