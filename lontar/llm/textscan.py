"""Words of many texts at once, in numpy over Arrow's own buffers.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which for UTF-8 is the pattern
[^\\x20\\x09-\\x0D]+. Texts are read whole; the bytes are worked through in blocks that end
between words, so memory does not follow the length of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_LETTER = np.ones(256, bool)  # letters, digits and all of UTF-8 beyond ASCII make up the words here
NOT_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.default_rng(20260903).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 2 * BLOCK:
            return made
        _powers[size] = made
    return _powers[size]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text at most; a longer text stands alone. What earlier batches took is given back first."""
    pa.default_memory_pool().release_unused()
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _hash_block(data: np.ndarray, firsts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one block; firsts: where a text begins in it."""
    inside = ~space[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[firsts[firsts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _power_table(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_CODES[data] * up[: len(data)], out=total[1:])
    size = (ends - starts).astype(np.uint64)
    hashes = mix((total[ends] - total[starts]) * down[starts] + size * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONG_WORD):  # a polynomial alone can be fooled by long words
        hashes[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return starts, ends, hashes


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, keep_spans: bool = False, space: np.ndarray = SPACE):
    """(text index, hash) of every word in order, and its byte span if asked for.

    lower: A-Z only. space: the bytes between words.
    """
    found_at, found_hash, found_start, found_end = [], [], [], []
    heads = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]]) if len(offsets) > 1 else np.empty(0, np.int64)
    at, n = 0, len(data)
    while at < n:
        end = min(at + BLOCK, n)
        while end < n and not space[data[end]] and not _is_head(heads, end):
            gaps = np.flatnonzero(space[data[end : end + 65536]])
            head = heads[np.searchsorted(heads, end) : np.searchsorted(heads, end) + 1]
            ahead = end + (int(gaps[0]) if len(gaps) else min(65536, n - end))
            end = min(ahead, int(head[0])) if len(head) else ahead
        block = data[at:end]
        firsts = heads[np.searchsorted(heads, at) : np.searchsorted(heads, end)] - at
        starts, ends, hashes = _hash_block(LOWER[block] if lower else block, firsts, space)
        found_at.append(np.searchsorted(offsets, starts + at, "right") - 1)
        found_hash.append(hashes)
        if keep_spans:
            found_start.append(starts + at)
            found_end.append(ends + at)
        at = end
    join = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
    out = join(found_at, np.int64), join(found_hash, np.uint64)
    return (*out, join(found_start, np.int64), join(found_end, np.int64)) if keep_spans else out


def _is_head(heads: np.ndarray, at: int) -> bool:
    i = np.searchsorted(heads, at)
    return i < len(heads) and heads[i] == at


_SALTS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def windows(text: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word index) and hash of each run of `width` words inside one text."""
    if len(hashes) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :])
    total = np.zeros(len(inside), np.uint64)
    for k in range(width):
        total += hashes[inside + k] * _SALTS[k]
    return inside, mix(total + np.uint64(width))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle) of the distinct shingles of every text, sorted; A-Z are lower-cased.

    A text with fewer words than `width`, but one at least, has its whole sequence as one shingle.
    """
    text, hashes = words(data, offsets, lower=True)
    first, shingle = windows(text, hashes, width)
    where = text[first]
    count = np.bincount(text, minlength=len(offsets) - 1)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        begin = np.searchsorted(text, few)
        extra = np.zeros(len(few), np.uint64)
        for k in range(width - 1):
            has = count[few] > k
            extra[has] += hashes[begin[has] + k] * _SALTS[32 + k]
        where = np.concatenate([where, few])
        shingle = np.concatenate([shingle, mix(extra + count[few].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))])
    order = np.lexsort((shingle, where))
    where, shingle = where[order], shingle[order]
    if len(where):
        new = np.empty(len(where), bool)
        new[0] = True
        new[1:] = (where[1:] != where[:-1]) | (shingle[1:] != shingle[:-1])
        where, shingle = where[new], shingle[new]
    return where, shingle
