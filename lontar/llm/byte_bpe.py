"""Byte-level BPE as a monoid: texts are encoded by halves and the halves joined.

`encode` halves a text until pieces are at most `LEAF` characters, encodes those, and joins
neighbours. At a join only a window around the seam is encoded again. It grows until both of
its ends are places where the tokens outside provably stay the same:

* a place between two characters is stable when every alternative of the split pattern must
  end a match there whatever surrounds it: a letter before a non-letter, a digit before a
  non-digit, or a symbol before white space or a digit. (Letters after a symbol may belong to a
  contraction, and white space looks ahead, so those places are not used.) No alternative that ends
  there looks beyond the next character, and for each of them the end of the text acts as that
  character does. Hence encode(text) = encode(text[:p]) + encode(text[p:]) at a stable p.

The window is at last the whole of both halves, which needs no proof. Decoding joins the bytes
of the halves up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from lontar.llm import textscan

LEAF = 8192
#: A place after which nothing before it can matter, and the reverse; see above.
STABLE = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=[^\s\p{L}\p{N}])(?=[\s\p{N}])")


def possessive(pattern: str) -> str:
    """The same matches without useless backtracking: the runs that end an alternative keep what they took."""
    for run in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+"):
        pattern = pattern.replace(f"{run}|", f"{run}+|")
    return pattern


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a rank file; one for each Python process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=possessive(pattern), mergeable_ranks=ranks, special_tokens={})


def _cut_before(text: str, low: int, seam: int) -> int:
    """The last stable place in (low, seam) before the window's reach ends; low if there is none."""
    reach = 32
    while True:
        start = max(low, seam - reach)
        # The characters at both sides of a place must lie in the left half.
        found = [m.start() for m in STABLE.finditer(text, start, seam) if low < m.start() < seam]
        if found:
            return found[-1]
        if start == low:
            return low
        reach *= 4


def _cut_after(text: str, seam: int, high: int) -> int:
    """The first stable place in (seam, high); high if there is none."""
    reach = 32
    while True:
        end = min(high, seam + reach)
        found = next((m.start() for m in STABLE.finditer(text, seam, end) if seam < m.start() < high), None)
        if found is not None:
            return found
        if end == high:
            return high
        reach *= 4


def encode(text: str, coder: tiktoken.Encoding, leaf: int = LEAF) -> list[int]:
    """Ids of the whole text, without special tokens, as one pass over it would give them."""

    def tree(a: int, b: int) -> list[int]:
        if b - a <= leaf:
            return coder.encode_ordinary(text[a:b])
        seam = (a + b) // 2
        left, right = tree(a, seam), tree(seam, b)
        p, q = _cut_before(text, a, seam), _cut_after(text, seam, b)
        drop_left = len(coder.encode_ordinary(text[p:seam]))
        drop_right = len(coder.encode_ordinary(text[seam:q]))
        left[len(left) - drop_left :] = coder.encode_ordinary(text[p:q])
        left += right[drop_right:]
        return left

    return tree(0, len(text))


def decode(ids: list[int], coder: tiktoken.Encoding, leaf: int = LEAF) -> bytes:
    """The bytes of the ids, joined up the tree."""

    def tree(a: int, b: int) -> bytes:
        if b - a <= leaf:
            return coder.decode_bytes(ids[a:b])
        return tree(a, (a + b) // 2) + tree((a + b) // 2, b)

    return tree(0, len(ids))


def encode_column(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", keep: list[str] | None = None, keep_ids: bool = True) -> DataFrame:
    """`docs` (or its columns `keep`) with n_tokens, ids_sha256, decoded_sha256 and, if `keep_ids`, the array ids.

    One narrow pass. Null text is an empty text: no tokens, digests of nothing. `rank_file` must
    be readable on every executor. Surrogates cannot occur in a Spark string.
    """
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    own = [c for c in (docs.columns if keep is None else keep) if c not in made]
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*own, text_col])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(rank_file, pattern)
        for whole in batches:
            for batch in textscan.pieces(whole, text_col):
                count, id_hash, byte_hash, all_ids = [], [], [], []
                for text in batch.column(text_col).to_pylist():
                    ids = encode(text or "", coder)
                    packed = np.array(ids, "<u4")
                    count.append(len(ids))
                    id_hash.append(hashlib.sha256(packed.tobytes()).hexdigest())
                    byte_hash.append(hashlib.sha256(decode(ids, coder)).hexdigest())
                    if keep_ids:
                        all_ids.append(packed.astype(np.int32))
                out = [pa.array(count, pa.int64()), pa.array(id_hash, pa.string()), pa.array(byte_hash, pa.string())] + [pa.array(all_ids, pa.list_(pa.int32()))] * keep_ids
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *out], names=[*own, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in own]).schema]
    return source.mapInArrow(run, ", ".join([*fields, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids]))
