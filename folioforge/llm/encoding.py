"""Token ids of whole texts by a public byte-level tokenizer (problem 7).

Encoding is a monoid: a text is halved until its parts are short, the parts are encoded, and neighbours are joined up the
tree. A join re-encodes a window around the seam that grows until it starts and ends at places where the pre-tokenizer must
cut whatever stands on either side, so the tokens outside cannot change.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioforge.runtime import ship, spread

#: Folder of the vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Parts up to this many characters are encoded at once.
LEAF = 1 << 14
#: First width of the window on either side of a seam.
WINDOW = 64
# The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def load(name: str, folder: str = TOKENIZERS):
    """The tokenizer of a rank file, loaded once a worker; it has no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1 << 16)
def _kind(char: str) -> str:
    if char.isspace():
        return "space"
    return {"L": "letter", "N": "number"}.get(unicodedata.category(char)[0], "mark")


def sure_cut(text: str, at: int) -> bool:
    """True if no pre-token can span this place, whatever precedes or follows the two characters around it.

    A pre-token holds letters, numbers or marks only, with at most one space in front; only an apostrophe may be followed by
    letters. So a change of kind cuts unless it starts at white space, which may lead the next pre-token, or at an apostrophe.
    """
    before, after = text[at - 1], text[at]
    return before != "'" and not before.isspace() and _kind(before) != _kind(after)


def join(encode, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
    """The encoding of two neighbouring texts put together, from their own encodings."""
    (a, a_ids), (b, b_ids) = left, right
    if not a or not b:
        return (a + b, a_ids + b_ids)
    start = _place(a, reversed(range(1, len(a))), 0)
    end = _place(b, range(1, len(b)), len(b))
    kept = len(a_ids) - len(encode(a[start:])) if start else 0
    dropped = len(encode(b[:end])) if end < len(b) else len(b_ids)
    return a + b, a_ids[:kept] + encode(a[start:] + b[:end]) + b_ids[dropped:]


def _place(text: str, places, otherwise: int) -> int:
    """The nearest sure cut at least WINDOW characters from the seam; the text's far end if there is none."""
    for walked, at in enumerate(places, 1):
        if walked >= WINDOW and sure_cut(text, at):
            return at
    return otherwise


def encode_tree(encode, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of one text: encode its halves, join them."""
    if len(text) <= leaf:
        return encode(text)
    parts = [text[k : k + leaf] for k in range(0, len(text), leaf)]
    nodes = [(part, encode(part)) for part in parts]
    while len(nodes) > 1:
        nodes = [join(encode, *nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0][1]


def encode_corpus(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens; null and empty texts have an empty list.

    A map over the scan: nothing is shuffled, the vocabulary is loaded once a worker.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(tokenizer, folder).encode_ordinary
        for batch in batches:
            ids = [np.array(encode_tree(encode, t), dtype=np.int32) if t else np.empty(0, np.int32) for t in batch["text"].to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have none."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(tokenizer, folder).encode_ordinary
        for batch in batches:
            sizes = [len(encode_tree(encode, t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return spread(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long")


def decode_tree(decode, ids: list[int], leaf: int = LEAF) -> bytes:
    """Bytes of a list of ids: those of its halves, put together up the tree."""
    if len(ids) <= leaf:
        return decode(ids)
    nodes = [decode(ids[k : k + leaf]) for k in range(0, len(ids), leaf)]
    while len(nodes) > 1:
        nodes = [b"".join(nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
    return nodes[0]


def decode_corpus(encoded: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) back from ids; a list without ids is the empty text, null ids are null."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load(tokenizer, folder).decode_bytes
        for batch in batches:
            texts = [None if x is None else decode_tree(decode, x).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
