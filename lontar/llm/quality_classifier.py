"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One linear score over hashed features of the text and a few measures of shape is shared by all grades;
ordered thresholds cut it, P(grade <= k) = sigmoid(threshold_k - score). From these come the
expected grade and the tail probability P(grade >= k) by which rows are selected. The features are, each once a
text: its words, the stems (first five bytes) of its longer words, and the stems that two or more different
words of it share; a rude word that is inflected or compounded is thus known by its stem.
Only features that go with the grades (`least_z` standard errors from chance at some threshold) have a
weight, so long texts gather no noise from thousands of words that say nothing.

The model is fitted on a bounded sample of labelled rows (`most_labels`, those with the
smallest md5 of their id, with at most `most_words` distinct features in all), a part of which is held out. The features of
the sample stay with the executors, which count them by grade; only those with a weight are collected. Grades between the poorest and the best (toxic text) are
rare and count `rare_weight` times in the fit. On the held-out rows the selection limit is set: as low as `keep_share` of the
best grade asks, but higher where less than `rare_recall` of the grades between would go, while `least_share` of the best stays.
Scoring is one narrow pass over every row.

Null text is an empty text. A label with a null id or grade is ignored; of several labels of
one id the lowest counts. With fewer than two grades nothing can be fitted: probabilities are
null and every row is selected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lontar.llm import textscan
from lontar.llm.common import materialise

BITS = 26
SHAPE = 10
STEM = 5
#: A feature has a weight if it is in so many rows, and so many standard errors from chance.
LEAST_ROWS, LEAST_Z = 4, 4.0
_STEM_SALT, _SHARED_SALT = np.uint64(0x5354454D) << np.uint64(32), np.uint64(0x53484152) << np.uint64(32)


def _share(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]) / size


def _in(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _SYMBOL, _BREAK, _STOP = _in(bytes(range(65, 91))), _in(b"0123456789"), _in(b"#*$%&|<>!@^~=+_{}[]\\/"), _in(b"\n"), _in(b".,;:?")


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, hashed feature) of the distinct features of each text in order of the texts, and its measures of shape."""
    n = len(offsets) - 1
    text, hashes, start, end = textscan.words(data, offsets, lower=True, keep_spans=True, space=textscan.NOT_LETTER)
    word, first = np.unique((text.astype(np.int64) << BITS) | _slot(hashes), return_index=True)
    count, distinct = np.bincount(text, minlength=n), np.bincount(word >> BITS, minlength=n)
    first = first[end[first] - start[first] > STEM]
    stem = np.zeros(len(first), np.uint64)
    for i in range(STEM):
        stem |= textscan.LOWER[data[start[first] + i]].astype(np.uint64) << np.uint64(8 * i)
    made = [word]
    for salt, least in ((_STEM_SALT, 1), (_SHARED_SALT, 2)):
        pair, words = np.unique((text[first].astype(np.int64) << BITS) | _slot(textscan.mix(stem ^ salt)), return_counts=True)
        made.append(pair[words >= least])
    pair = np.unique(np.concatenate(made))
    follow = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=n) if len(text) else np.zeros(n)
    size, some = np.maximum(np.diff(offsets), 1), np.maximum(count, 1)
    shape = np.stack([np.log1p(count), distinct / some, follow / some, size / some / 10, *(_share(t, data, offsets, size) for t in (_UPPER, _DIGIT, _SYMBOL, _BREAK, _STOP)), np.log1p(distinct) / np.log1p(some)], axis=1)
    return pair >> BITS, pair & ((1 << BITS) - 1), shape.astype(np.float64)


@dataclass
class Ordinal:
    """weights: of the hashed features `names`, ascending; shape: per standardised measure; thresholds: ascending."""

    names: np.ndarray
    weights: np.ndarray
    shape: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    thresholds: np.ndarray
    limit: float = 0.5

    def weight(self, slot: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(slot))
        at = np.minimum(np.searchsorted(self.names, slot), len(self.names) - 1)
        return np.where(self.names[at] == slot, self.weights[at], 0.0)

    def score(self, where: np.ndarray, slot: np.ndarray, shape: np.ndarray) -> np.ndarray:
        words = np.bincount(where, weights=self.weight(slot), minlength=len(shape))
        return words + np.clip((shape - self.centre) / self.spread, -6, 6) @ self.shape

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 and up."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def stand_out(rows: np.ndarray, above: list[np.ndarray], part: list[float], n: int, least_rows: int, least_z: float) -> np.ndarray:
    """Which features, of those in `least_rows` rows or more, have a share of rows above some threshold that differs from all rows' by `least_z` standard errors.

    rows: that have the feature; above: those of them above each threshold; part: the share of all n rows that is.
    """
    out = np.zeros(len(rows), bool)
    for up, share in zip(above, part):
        error = np.sqrt(rows * share * (1 - share) * (1 - rows / n) + 0.5)
        out |= np.abs(up - rows * share) > least_z * error
    return out & (rows >= least_rows)


def telling(where: np.ndarray, feature: np.ndarray, features: int, grade: np.ndarray, grades: int, least_rows: int, least_z: float) -> np.ndarray:
    """Which features `stand_out`."""
    up = [grade >= k for k in range(1, grades)]
    above = [np.bincount(feature, weights=u[where], minlength=features) for u in up]
    return stand_out(np.bincount(feature, minlength=features), above, [u.mean() for u in up], len(grade), least_rows, least_z)


def fit(where: np.ndarray, slot: np.ndarray, shape: np.ndarray, grade: np.ndarray, grades: int, steps: int = 400, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z, penalty: float = 1e-3, weight: np.ndarray | None = None) -> Ordinal:
    """Maximum likelihood with an L2 penalty, by Adam over the whole sample, of the features that `telling` finds. weight: of each row."""
    n = len(grade)
    part_of = np.full(n, 1 / n) if weight is None else weight / weight.sum()
    names, local = np.unique(slot, return_inverse=True)
    chosen = telling(where, local, len(names), grade, grades, least_rows, least_z)
    use = chosen[local]
    where, local, names = where[use], (np.cumsum(chosen) - 1)[local[use]], names[chosen]
    centre, spread = shape.mean(0), shape.std(0) + 1e-6
    z = np.clip((shape - centre) / spread, -6, 6)
    part = np.array([(grade >= k).mean() for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(part / (1 - part))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    x = np.concatenate([np.zeros(len(names) + z.shape[1]), first[:1], gaps])
    m, v = np.zeros_like(x), np.zeros_like(x)
    w_end, s_end = len(names), len(names) + z.shape[1]
    sigma = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, steps + 1):
        cuts = x[s_end] + np.concatenate([[0.0], np.cumsum(np.exp(x[s_end + 1 :]))])
        score = np.bincount(where, weights=x[local] if len(local) else None, minlength=n)[:n] + z @ x[w_end:s_end]
        padded = np.concatenate([[-40.0], cuts, [40.0]])
        up, low = sigma(padded[grade + 1] - score), sigma(padded[grade] - score)
        chance = np.maximum(up - low, 1e-9)
        d_up, d_low = up * (1 - up) / chance, low * (1 - low) / chance
        d_score = (d_up - d_low) * part_of
        d_cut = np.array([((-d_up * (grade == k) + d_low * (grade == k + 1)) * part_of).sum() for k in range(grades - 1)])
        d_gap = np.exp(x[s_end + 1 :]) * np.cumsum(d_cut[::-1])[::-1][1:]
        g = np.concatenate([np.bincount(local, weights=d_score[where], minlength=w_end), z.T @ d_score, [d_cut.sum()], d_gap])
        g[:s_end] += penalty * x[:s_end]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= 0.08 * (1 - 0.7 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return Ordinal(names, x[:w_end], x[w_end:s_end], centre, spread, x[s_end] + np.concatenate([[0.0], np.cumsum(np.exp(x[s_end + 1 :]))]))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, most: int, most_words: int) -> tuple[DataFrame | None, list[Row]]:
    """(number, grade, slots) of at most `most` labelled rows with at most `most_words` distinct features in all; and (id, grade, shape) of each number, on the driver.

    Rows are taken in the order of their ids' md5; the one that would pass a bound and all after it are left out.
    """
    one = labels.filter(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(F.col(grade_col)).cast("int").alias("__grade"))
    sample = one.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(most)  # its size is bounded: it may be broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(sample), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.pieces(whole, "__text"):
                where, slot, shape = features(*textscan.utf8(batch.column("__text")))
                cuts = np.searchsorted(where, np.arange(batch.num_rows + 1))
                slots = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("__id").cast(pa.string()), batch.column("__grade"), pa.array(slots, pa.binary()), pa.array([r.tobytes() for r in shape], pa.binary())], names=["id", "grade", "slots", "shape"])

    # Ids may repeat in docs, and texts may be long: both bounds hold for what is taken.
    light = materialise(rows.mapInArrow(run, "id string, grade int, slots binary, shape binary").withColumn("row", F.monotonically_increasing_id()))
    head = light.select("row", "id", "grade", "shape", F.xxhash64("slots").alias("hash"), (F.octet_length("slots") / 4).cast("long").alias("n"))
    head = head.orderBy(F.md5("id"), "id", "hash", "shape").limit(most).collect()
    within = np.cumsum([r.n for r in head]) <= most_words
    head = sorted((r for r, x in zip(head, within) if x), key=lambda r: (r.id, r.grade, r.hash, r.shape))
    if not head:
        return None, []
    numbers = docs.sparkSession.createDataFrame([(r.row, i) for i, r in enumerate(head)], "row long, number int")
    return light.select("row", "grade", "slots").join(F.broadcast(numbers), "row").drop("row"), head


def _slots_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row index, hashed feature) of the column slots."""
    data, offsets = textscan.utf8(batch.column("slots"))
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 4), np.ascontiguousarray(data).view(np.int32)


def _telling_in(sample: DataFrame, grade: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    """The features that stand out in the fitted rows of the sample, ascending; they are counted where they are. grade, fitted: by number."""
    if len(np.unique(grade)) < 2:
        return np.empty(0, np.int64)
    grades, n = int(grade.max()) + 1, int(fitted.sum())
    part = [(grade[fitted] >= k).mean() for k in range(1, grades)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(fitted[whole.column("number").to_numpy()]))
            where, slot = _slots_of(batch)
            each, rows = np.unique(slot.astype(np.int64) * grades + batch.column("grade").to_numpy()[where], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((each // grades).astype(np.int32)), pa.array((each % grades).astype(np.int32)), pa.array(rows, pa.int64())], names=["slot", "grade", "rows"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, *above = (batch.column(k).to_numpy() for k in range(1, batch.num_columns))
            yield batch.select(["slot"]).filter(pa.array(stand_out(rows, above, part, n, LEAST_ROWS, LEAST_Z)))

    above = [F.sum(F.when(F.col("grade") >= k, F.col("rows")).otherwise(0)).alias(f"above{k}") for k in range(1, grades)]
    counted = sample.mapInArrow(count, "slot int, grade int, rows long").groupBy("slot").agg(F.sum("rows").alias("rows"), *above)
    return np.sort(np.array([r.slot for r in counted.mapInArrow(find, "slot int").collect()], np.int64))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, grade_col: str, most: int, most_words: int, choose: Callable[[DataFrame, np.ndarray], np.ndarray] | None = None) -> list[tuple]:
    """(id, grade, features, shape) of the rows of `_sample`, collected to the driver.

    choose: which features, ascending, to collect, by the sample and the grades in order of its numbers; without it all of them.
    """
    sample, head = _sample(docs, labels, id_col, text_col, grade_col, most, most_words)
    if sample is None:
        return []
    if choose is not None:
        shipped = docs.sparkSession.sparkContext.broadcast(choose(sample, np.array([r.grade for r in head], np.int64)))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = shipped.value
            for batch in batches:
                where, slot = _slots_of(batch)
                at = np.searchsorted(names, slot)
                use = np.append(names, -1)[at] == slot
                where, slot = where[use], slot[use]
                cuts = np.searchsorted(where, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([batch.column("number"), pa.array([slot[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["number", "slots"])

        sample = sample.select("number", "slots").mapInArrow(pick, "number int, slots binary")
    slots = {r.number: r.slots for r in sample.select("number", "slots").collect()}
    return [(r.id, r.grade, slots[i], r.shape) for i, r in enumerate(head)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", most_labels: int = 8000, most_words: int = 1 << 24, hold_out: int = 4, keep_share: float = 0.995, rare_weight: float = 3.0, rare_recall: float = 0.95, least_share: float = 0.985) -> Ordinal | None:
    """Fit on labelled rows; each `hold_out`-th of them sets the limit on P(best grade)."""
    rows = _labelled(docs, labels, id_col, text_col, grade_col, most_labels, most_words, lambda sample, grade: _telling_in(sample, grade, np.arange(len(grade)) % hold_out != 0))
    grade = np.array([r[1] for r in rows], np.int64)
    if len(np.unique(grade)) < 2:
        return None
    grades = int(grade.max()) + 1
    slots = [np.frombuffer(r[2], np.int32).astype(np.int64) for r in rows]
    shape = np.array([np.frombuffer(r[3]) for r in rows]).reshape(len(rows), SHAPE)
    held = np.arange(len(rows)) % hold_out == 0
    pack = lambda some: (np.repeat(np.arange(len(some)), [len(slots[i]) for i in some]), np.concatenate([slots[i] for i in some]), shape[some])
    fitted, aside = np.flatnonzero(~held), np.flatnonzero(held)
    between = (grade > 0) & (grade < grades - 1)
    model = fit(*pack(fitted), grade[fitted], grades, weight=np.where(between[fitted], rare_weight, 1.0))
    chance = model.tails(model.score(*pack(aside)))[:, -1]
    best, rare = chance[grade[aside] == grades - 1], chance[between[aside]]
    if len(best):
        model.limit = float(np.quantile(best, 1 - keep_share))
        if len(rare):
            model.limit = float(max(model.limit, min(np.quantile(rare, rare_recall), np.quantile(best, 1 - least_share))))
    return model


def score(docs: DataFrame, model: Ordinal | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with expected_grade, p_best (P of the best grade), p_above (P of grade 1 and up) and selected."""
    made = ["expected_grade", "p_best", "p_above", "selected"]
    own = [c for c in (docs.columns if keep is None else keep) if c not in made]
    if model is None:
        return docs.select(*[f"`{c}`" for c in own], *[F.lit(None).cast("double").alias(c) for c in made[:3]], F.lit(True).alias("selected"))
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*own, text_col])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in textscan.pieces(whole, text_col):
                tails = model.tails(model.score(*features(*textscan.utf8(batch.column(text_col)))))
                out = [tails.sum(1), tails[:, -1], tails[:, 0], tails[:, -1] >= model.limit]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *map(pa.array, out)], names=[*own, *made])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in own]).schema]
    return source.mapInArrow(run, ", ".join([*fields, "expected_grade double, p_best double, p_above double, selected boolean"]))


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the table labels: 0 poor, 1 good but toxic, 2 good. A null flag leaves the grade null."""
    q, t = F.col("quality"), F.col("toxic")
    return labels.select("doc_id", F.when(q == 0, 0).when(t == 1, 1).when((q == 1) & (t == 0), 2).alias("grade"))
