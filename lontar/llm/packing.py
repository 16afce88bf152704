"""Packing into length buckets whose boundaries minimise padding, and token-budget batches.

The lengths of all rows are counted in a global histogram. Dynamic programming over it chooses
at most `buckets` boundaries such that padding every row to the boundary of its bucket adds the fewest
tokens. Inside a bucket, rows in a seeded random order form batches of as many rows as the token budget
holds at the bucket's length (one at least, so a row longer than the budget stands alone).

The histogram has a bin for every length below 1024 and 512 bins for each doubling above, each with its
count, its sum and its largest length, so its size is bounded whatever the rows are; boundaries
are lengths that occur. For lengths below 1024 the choice is optimal over all lengths, beyond that over the
bins' largest lengths.

Null text is an empty text of length 0. Rows with equal ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lontar.llm import textscan
from lontar.llm.common import gapless_rank, materialise
from lontar.llm.sharding import cells_for, shuffle_key

EXACT, STEPS = 1024, 512


def boundaries(count: np.ndarray, total: np.ndarray, largest: np.ndarray, buckets: int) -> list[int]:
    """The boundaries of least padding for bins in ascending order of length.

    best[j] is the least padding of the first j bins; the best last cut never moves back as j
    grows, so each round is solved by halving.
    """
    n = len(count)
    if n == 0:
        return []
    c, s = np.concatenate([[0.0], np.cumsum(count)]), np.concatenate([[0.0], np.cumsum(total)])
    top = largest.astype(float)
    best = np.concatenate([[0.0], top * c[1:] - s[1:]])
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = best.copy(), np.zeros(n + 1, np.int64)
        jobs = [(1, n, 0, n - 1)]
        while jobs:
            a, b, low, high = jobs.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            cost = best[i] + top[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
            k = int(np.argmin(cost))
            new[j], cut[j] = cost[k], i[k]
            jobs += [(a, j - 1, low, int(i[k])), (j + 1, b, int(i[k]), high)]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(largest[j - 1]))
        j = int(cut[j])
    return out[::-1]


def count_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_tokens) of every row; tokens are the runs of non-space bytes."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.pieces(whole, "__text"):
                data, offsets = textscan.utf8(batch.column("__text"))
                inside = np.concatenate([[False], ~textscan.SPACE[data]])
                first = inside[1:] & ~inside[:-1]
                heads = offsets[:-1][offsets[:-1] < offsets[1:]]
                first[heads] = inside[heads + 1]
                lead = np.concatenate([[0], np.cumsum(first)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lead[offsets[1:]] - lead[offsets[:-1]], pa.int64())], names=["doc_id", "n_tokens"])

    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, n_tokens long")


def pack(docs: DataFrame, buckets: int = 16, budget: int = 32768, seed: str = "pack", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, bucket, padded_to, batch (in the bucket), place (in the batch), padding."""
    light = materialise(count_words(docs, id_col, text_col).withColumn("__key", shuffle_key(seed, F.col("doc_id"))))
    doubling = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double") / EXACT))
    step = F.pow(F.lit(2.0), doubling) * EXACT / STEPS
    fine = F.when(F.col("n_tokens") < EXACT, F.col("n_tokens")).otherwise((F.floor(F.col("n_tokens") / step) * step).cast("long"))
    bins = light.groupBy(fine.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("largest")).collect()
    bins = sorted((r.largest, r.n, r.total) for r in bins)
    limits = boundaries(*(np.array([b[i] for b in bins], np.int64) for i in (1, 2, 0)), buckets)
    rows = sum(b[1] for b in bins)
    bucket, padded = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, limit in reversed(list(enumerate(limits))):
        fits = F.col("n_tokens") <= limit
        bucket, padded = F.when(fits, i).otherwise(bucket), F.when(fits, F.lit(limit).cast("long")).otherwise(padded)
    cells = cells_for(rows)
    placed = light.withColumn("bucket", bucket).withColumn("padded_to", padded).withColumn("__cell", F.shiftright("__key", 60 - (cells.bit_length() - 1)))
    placed = gapless_rank(placed, ["bucket"], "__cell", [F.col("__key"), F.col("doc_id"), F.col("n_tokens")], "__rank")
    each = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div greatest(padded_to, 1L)"))
    return placed.withColumn("__each", each).select("doc_id", "n_tokens", "bucket", "padded_to", F.expr("__rank div __each").alias("batch"), F.expr("__rank % __each").alias("place"), (F.col("padded_to") - F.col("n_tokens")).alias("padding"))
