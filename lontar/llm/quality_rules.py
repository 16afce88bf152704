"""Quality rules: compression bands and the base rules of repetition and length.

zstandard is run over the whole text and over fixed chunks of it. The ratio is compressed
bytes over bytes; what it is for ordinary prose depends on length, so the band does as well:
text below the band repeats itself, text above it is incompressible (keys, encoded data).

Null text is an empty text: no words, so base_failed and not kept. Equal texts get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from lontar.llm import textscan


@dataclass(frozen=True)
class Bands:
    """upper: (bytes below which it holds, lowest ratio, highest ratio), in order; the last has no end.

    Short texts carry the frame and no history, so they compress worse and may reach a ratio above 1. The highest
    ratios stand a little above those of the labelled good texts (below 256 bytes, of their beginnings).
    Chunks are judged alike, each by its own length; more than `bad_chunks` of the bytes in chunks outside rejects the text.
    """

    level: int = 3
    chunk: int = 4096
    limits: tuple[tuple[float, float, float], ...] = (
        (128, 0.42, 1.10),
        (160, 0.42, 0.99),
        (192, 0.42, 0.96),
        (256, 0.42, 0.88),
        (362, 0.40, 0.83),
        (512, 0.40, 0.76),
        (724, 0.38, 0.72),
        (1024, 0.38, 0.66),
        (1448, 0.35, 0.61),
        (2048, 0.35, 0.575),
        (2400, 0.33, 0.535),
        (2896, 0.33, 0.52),
        (4096, 0.33, 0.515),
        (8192, 0.30, 0.50),
        (16384, 0.30, 0.475),
        (float("inf"), 0.27, 0.45),
    )
    bad_chunks: float = 0.02

    def band(self, size: int) -> tuple[float, float]:
        return next((low, high) for end, low, high in self.limits if size < end)


def _per_text(where: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(where, minlength=n).astype(np.int64)


def _repeats(where: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: whether its (where, key) occurs again, and whether it occurred before."""
    order = np.argsort(textscan.mix(key.astype(np.uint64) + where.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    w, k = where[order], key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (w[1:] == w[:-1]) & (k[1:] == k[:-1])
    again, before = np.empty(len(key), bool), np.empty(len(key), bool)
    again[order], before[order] = same[:-1] | same[1:], same[:-1]
    return again, before


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The contract's counts for each text, over whole texts."""
    n = len(offsets) - 1
    text, hashes, starts, ends = textscan.words(data, offsets, keep_spans=True)
    n_words = _per_text(text, n)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    word_chars = np.bincount(text, weights=lead[ends] - lead[starts], minlength=n).astype(np.int64)
    symbols = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=symbols[1:])
    first, window = textscan.windows(text, hashes, 3)
    again, _ = _repeats(text[first], window)
    marked = np.zeros(len(text) + 2, bool)
    for k in range(3):
        marked[first[again] + k] = True
    repeat = _per_text(text[marked[: len(text)]], n)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]], "n_dup_lines": _dup_lines(data, offsets, text, starts), "n_repeat_words": repeat}


def _dup_lines(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    begin = np.unique(np.concatenate([offsets[:-1][full], breaks + 1]))
    begin = begin[begin < len(data)]
    end = np.concatenate([begin[1:], [len(data)]])
    where = np.searchsorted(offsets, begin, "right") - 1
    stop = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 10))  # the break itself is no part of the line
    has_word = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop, where = begin[has_word], stop[has_word], where[has_word]
    raw = data.tobytes()
    keys = np.fromiter((hash(raw[a:b]) for a, b in zip(begin.tolist(), stop.tolist())), np.int64, len(begin))
    out = np.zeros(n, np.int64)
    again, before = _repeats(where, keys)
    seen: dict[tuple[int, bytes], int] = {}
    for i in np.flatnonzero(again):  # equal hashes are held against the bytes
        line = (int(where[i]), raw[begin[i] : stop[i]])
        out[where[i]] += line in seen
        seen[line] = 1
    return out


def compression(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text; share of its bytes in chunks outside their band.

    A last chunk that is not full begins earlier, so it is as long as the others; a text of one chunk or less is its only chunk.
    """
    if not data:
        return 0.0, 0.0
    size = len(data)
    whole = len(packer.compress(data)) / size
    low, high = bands.band(min(size, bands.chunk))
    if size <= bands.chunk:
        return whole, float(not low <= whole <= high)
    bad = end = 0
    for a in [*range(0, size - bands.chunk, bands.chunk), size - bands.chunk]:
        if not low <= len(packer.compress(data[a : a + bands.chunk])) / bands.chunk <= high:
            bad, end = bad + a + bands.chunk - max(a, end), a + bands.chunk
    return whole, bad / size


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, bad_chunk_share double, base_failed boolean, kept boolean"
_TYPES = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def judge(docs: DataFrame, text_col: str = "text", bands: Bands = Bands(), keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with counts, ratios and the verdict `kept`; one narrow pass, no shuffle.

    Result columns that `docs` has already are replaced.
    """
    names = [f.split() for f in SCHEMA.split(", ")]
    own = [c for c in (docs.columns if keep is None else keep) if c not in {n for n, _ in names}]
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*own, text_col])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for whole in batches:
            for batch in textscan.pieces(whole, text_col):
                data, offsets = textscan.utf8(batch.column(text_col))
                out = base_counts(data, offsets)
                raw = data.tobytes()
                both = [compression(raw[a:b], bands, packer) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                ratio, bad = (np.array([x[i] for x in both], float) for i in (0, 1))
                limits = np.array([bands.band(int(s)) for s in np.diff(offsets)]).reshape(-1, 2)
                failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
                inside = (ratio >= limits[:, 0]) & (ratio <= limits[:, 1]) & (bad <= bands.bad_chunks)
                out |= {"zstd_ratio": ratio, "bad_chunk_share": bad, "base_failed": failed, "kept": ~failed & inside}
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(out[n], _TYPES[t]) for n, t in names)], names=[*own, *(n for n, _ in names)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*[f"`{c}`" for c in own]).schema), SCHEMA]) if own else SCHEMA
    return source.mapInArrow(run, schema)
