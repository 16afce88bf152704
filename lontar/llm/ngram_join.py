"""N-gram Jaccard join: universe partition, pigeonhole, one-deletion neighbourhoods, exact verification.

A text is the set of its distinct shingles; equal sets are one node. Two sets of sizes r and s
with 100 * intersection >= P * union differ in at most H = (100 - P)(r + s) / (100 + P) elements.

Index. Sizes are cut into bands, each so narrow that partners lie in one band or in two that
adjoin. A band deals the universe of shingles, by hash, into m segments. A set puts into the index the hash of what
it has in each segment that is not empty and, for the first `deletable` segments, of that less any one element.

Pigeonhole. A set may probe a segment exactly (one unit) or with one-deletion neighbourhoods as well (two units).
If its units come to H + 1 or more, every partner that is not larger agrees with it in one of them:
else each segment would differ by its units at least, H + 1 in all.

Allocation. Segments of a set that no other set shares cost nothing to probe, so they are all
probed. Of the others the most expensive ones (those that yield most candidates) are left out as long as the units suffice.

First round. Each set of a group (the sets that share a key) is verified against the group's hub, which links near copies through it.
After that, candidates within one component are needless and cost nothing.

Second round. Groups with few members give all their pairs between components. The sets of wide groups, where all pairs
would be too many, are partitioned once more, so finely that each shingle is a segment of its own, and
allocation takes the rarest ones: if a set's shingles stand in order of how many of these sets hold them, the first one
that it shares with a partner comes early, since all that follow must make up the intersection. A shingle at place i of s allows partners up to
`reach` = (100 + P)(s - i) / P - s, and both sides must allow the other. Shingles whose members have one label, or that no two members
of different labels allow, go; what is left is again joined to a hub for each shingle (the member with the farthest reach
for its size), round by round as long as that links something, and the few pairs then left are verified all.
No pair that links two components goes unseen, so the components are exact.

Verification is exact: the sets are made again from the texts, for candidates only, and intersected.
Shingles are held as 64-bit hashes.

Sets too small for their units (hardly any) go another way: in blocks of bounded size they are held against every text.

The index travels as packed arrays: for each block of texts and each bucket of keys one row. Buckets follow the number of
shingles and are read one after the other, sorted by key in numpy; keys with one set, nearly all, end there. A key that
`heavy` sets of one block share is dealt over all buckets, and its home bucket is told, so no bucket holds a hot key alone.

Rows are told apart by a hash of id and text, so ids may be of any type, null or repeated.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lontar.llm import textscan
from lontar.llm.common import drop_unread, in_few, materialise, settle
from lontar.llm.components import components
from lontar.llm.textscan import mix

U = np.uint64
CHUNK = 1 << 16
CELLS = 128
#: Rows to a task of frames of numbers, of cells, and of pairs of sets.
NUMBERS, OF_CELLS, OF_PAIRS = 1 << 16, 1 << 14, 1 << 12
#: The fewest segments of a band: small sets would otherwise fall into one or two and be short of units.
SMALL = 16
#: The most hub rounds before the pairs that are left are verified all.
ROUNDS = 6
#: Shingles of sets short of units that go to every task at once.
AT_ONCE = 1 << 21


@dataclass(frozen=True)
class Params:
    """percent: the least similarity. deletable: segments with one-deletion neighbourhoods (all, where there are SMALL of them). spare: segments beyond the need, in thousandths of the largest size.
    heavy: sets of one block that make a key heavy. wide: members above which a group is wide. bucket: shingles to a bucket of the index."""

    percent: int = 75
    width: int = 5
    deletable: int = 8
    spare: int = 12
    heavy: int = 64
    wide: int = 8
    bucket: int = 1 << 21

    def differ(self, total: np.ndarray) -> np.ndarray:
        """The most elements in which two linked sets of these sizes together can differ."""
        return (100 - self.percent) * total // (100 + self.percent)

    def bands(self) -> np.ndarray:
        """The least size of each band; a size and its least partner size are in one band or in two that adjoin."""
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(lows[-1] * 100 // self.percent + 1)
        return np.array(lows, np.int64)

    def segments(self, high: np.ndarray) -> np.ndarray:
        """Segments of a band up to size `high`: the need of its largest prober, which may be high * 100 / percent, and some to spare."""
        return np.maximum(SMALL, self.differ(high + high * 100 // self.percent) + 3 + self.spare * high // 1000)


def _starts(where: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(where), bool)
    new[1:] = where[1:] != where[:-1]
    return np.flatnonzero(new)


def set_ids(where: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and id of the set of each text; the empty set has id 0."""
    size = np.bincount(where, minlength=n).astype(np.int64)
    out = np.zeros(n, U)
    if len(where):
        at = _starts(where)
        out[where[at]] = mix(np.add.reduceat(mix(shingle + U(0x5851F42D4C957F2D)), at) + size[where[at]].astype(U))
    return size, out.view(np.int64)


def entries(where: np.ndarray, shingle: np.ndarray, size: np.ndarray, p: Params) -> Iterator[tuple[np.ndarray, ...]]:
    """Index entries of many sets: (text, key, unit, lower, slack), once for their own band and once as probers of the band below.

    unit: -1 a segment, 0.. a segment with deletions, SMALL.. its deletions. slack: units beyond the need; below 0 they don't suffice.
    """
    lows = p.bands()
    for lower in (False, True):
        band = np.searchsorted(lows, np.maximum(size, 1), "right") - 1 - lower
        high = lows[np.minimum(band + 1, len(lows) - 1)] - 1
        use = (size > 0) & (band >= 0)
        if lower:
            use &= 100 * high >= p.percent * size
        m = p.segments(high)
        pick = use[where]
        w, x = where[pick], shingle[pick]
        if not len(w):
            continue
        segment = ((x >> U(32)) * m[w].astype(U)) >> U(32)  # ascending, since the shingles of a text are
        e = mix(x + U(0x14057B7EF767814F))
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(new)
        total, count = np.add.reduceat(e, at), np.diff(np.append(at, len(w)))
        seg, text = segment[at].astype(np.int64), w[at]
        place = seg.astype(U) * U(0xD1342543DE82EF95) + (band[text].astype(U) + U(1)) * U(0xAF251AF3B0F025B5)
        special = seg < np.where(m[text] == SMALL, SMALL, p.deletable)
        units = np.bincount(text, minlength=len(size)) + np.bincount(text[special & (count >= 2)], minlength=len(size))
        slack = units - (p.differ(size + np.minimum(size, high)) + 1)
        yield text.astype(np.int32), mix(total + place), np.where(special, seg, -1).astype(np.int8), np.full(len(text), lower), slack[text].astype(np.int32)
        run = np.repeat(np.arange(len(at)), count)
        gone = np.flatnonzero((special & (count >= 2))[run])
        run = run[gone]
        yield text[run].astype(np.int32), mix(total[run] - e[gone] + place[run]), (seg[run] + SMALL).astype(np.int8), np.full(len(gone), lower), slack[text[run]].astype(np.int32)


#: A text of a block: its set, size, and the slack of its units in its own band and as a prober of the band below.
_TEXT = np.dtype([("set", "<i8"), ("size", "<i4"), ("slack", "<i2", 2)])


def _pack(size: np.ndarray, ids: np.ndarray, where: np.ndarray, shingle: np.ndarray, p: Params, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, texts and entries) of one block of texts; equal sets of the block count once.

    Entries are held column by column: the upper 48 bits of the key, the text's number in the block, unit and band. That the
    lower bits are gone only adds candidates, which verification drops.
    """
    _, first = np.unique(ids, return_index=True)
    keep = np.zeros(len(ids), bool)
    keep[first] = True
    keep &= size > 0
    pick = keep[where]
    parts = list(entries(where[pick], shingle[pick], np.where(keep, size, 0), p))
    if not parts:
        return
    text, key, unit, lower, slack = (np.concatenate(x) for x in zip(*parts))
    texts = np.zeros(len(ids), _TEXT)
    texts["set"], texts["size"] = ids, size
    for band in (0, 1):
        of = lower == bool(band)
        texts["slack"][text[of], band] = np.clip(slack[of], -1, 32000)
    bad = np.flatnonzero((texts["slack"] < 0).any(1) & keep)  # sets short of units, told to one partition, without entries
    for k, row in zip((texts["set"][bad] % buckets).tolist(), bad):
        yield k, struct.pack("<ii", 1, 0) + texts[row : row + 1].tobytes()
    tag = (unit + 1).astype(np.uint8) * np.uint8(2) + lower
    key &= U(0xFFFFFFFFFFFF0000)
    home = ((key >> U(16)) % U(buckets)).astype(np.int32)
    part = home.copy()
    order = np.argsort(key, kind="stable")
    at = _starts(key[order])
    count = np.diff(np.append(at, len(key)))
    hot = order[np.repeat(count >= p.heavy, count)]
    if len(hot):
        part[hot] = (mix(key[hot] + texts["set"][text[hot]].view(U)) % U(buckets)).astype(np.int32)
        tag[hot] |= SALTED
        told = order[at[count >= p.heavy]]  # one entry of each goes home
        text, key, tag, part = (np.concatenate(x) for x in ((text, text[told]), (key, key[told]), (tag, tag[told]), (part, home[told])))
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(buckets + 1))
    high = key.view(np.uint8).reshape(-1, 8)[:, 2:]  # little-endian: the upper six bytes
    for k in np.unique(part).tolist():
        some = order[cuts[k] : cuts[k + 1]]
        some = some[np.argsort(text[some], kind="stable")]
        for at in _runs(text[some]):
            rows = some[at]
            own, local = np.unique(text[rows], return_inverse=True)
            yield k, struct.pack("<ii", len(own), len(rows)) + texts[own].tobytes() + local.astype("<u2").tobytes() + tag[rows].tobytes() + high[rows].tobytes()


#: The bit of a tag that says that the key's other members may be in other buckets.
SALTED = np.uint8(128)


def _runs(text: np.ndarray) -> Iterator[slice]:
    """Parts of ascending text numbers with at most 2^16 different ones, which 16 bits can number."""
    if not len(text):
        return
    begin = np.append(_starts(text), len(text))
    for a in range(0, len(begin) - 1, 1 << 16):
        yield slice(int(begin[a]), int(begin[min(a + (1 << 16), len(begin) - 1)]))


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """key, set, size, tag and slack of the entries of all blobs."""
    keys, sets, sizes, tags, slacks = [], [], [], [], []
    for blob in blobs:
        n, m = struct.unpack_from("<ii", blob)
        texts = np.frombuffer(blob, _TEXT, n, 8)
        at = 8 + n * _TEXT.itemsize
        local, tag = np.frombuffer(blob, "<u2", m, at), np.frombuffer(blob, np.uint8, m, at + 2 * m)
        raw = np.zeros((m, 8), np.uint8)
        raw[:, :6] = np.frombuffer(blob, np.uint8, 6 * m, at + 3 * m).reshape(m, 6)
        keys.append(raw.view("<u8").ravel())
        sets.append(texts["set"][local])
        sizes.append(texts["size"][local])
        tags.append(tag)
        slacks.append(texts["slack"][local, tag & 1])
    return tuple(np.concatenate(x) for x in (keys, sets, sizes, tags, slacks))


def _short(blobs: list[bytes]) -> pa.RecordBatch:
    """The sets short of units as rows of no keys (times 0)."""
    texts = np.unique(np.concatenate([np.frombuffer(b, _TEXT, 1, 8) for b in blobs]))
    one = pa.array(np.arange(len(texts) + 1), pa.int32())
    lists = lambda x, kind: pa.ListArray.from_arrays(one, pa.array(x, kind))
    none = np.zeros(len(texts), np.int8)
    return pa.RecordBatch.from_arrays(
        [pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(none.astype(bool)), pa.array(texts["set"]), lists(texts["set"], pa.int64()), lists(texts["size"], pa.int32()), lists(none, pa.int8()), lists(none.astype(bool), pa.bool_()), lists(none, pa.int16())],
        names=["gid", "times", "salted", "hub", "sets", "sizes", "units", "lowers", "slacks"],
    )


def _groups(blobs: list[bytes]) -> pa.RecordBatch | None:
    """Keys that two sets or more share, as lists of members. Keys with the same list of plain segments are one row with their number."""
    key, sets, sizes, tag, slack = _unpack(blobs)
    order = np.argsort(key, kind="stable")
    at = _starts(key[order])
    count = np.diff(np.append(at, len(key)))
    salted = np.maximum.reduceat(tag[order] & SALTED, at) > 0
    order = order[np.repeat((count > 1) | salted, count)]
    if not len(order):
        return None
    key, sets, sizes, tag, slack = key[order], sets[order], sizes[order], tag[order], slack[order]
    salted = np.repeat(salted[(count > 1) | salted], count[(count > 1) | salted])
    tag = (tag & ~SALTED).astype(np.int64)
    order = np.lexsort((tag, sets, key))
    key, sets, sizes, tag, slack = key[order], sets[order], sizes[order], tag[order], slack[order]
    new = np.ones(len(key), bool)  # equal sets came from several blocks
    new[1:] = (key[1:] != key[:-1]) | (sets[1:] != sets[:-1]) | (tag[1:] != tag[:-1])
    key, sets, sizes, tag, slack, salted = (x[new] for x in (key, sets, sizes, tag, slack, salted))
    at = _starts(key)
    count = np.diff(np.append(at, len(key)))
    differ = np.ones(len(key), bool)
    differ[1:] = sets[1:] != sets[:-1]
    differ[at] = False  # beside the first set of the group
    shared = np.add.reduceat(differ.astype(np.int64), at) > 0
    held = np.repeat(shared, count) | salted
    key, sets, sizes, tag, slack, salted = (x[held] for x in (key, sets, sizes, tag, slack, salted))
    if not len(key):
        return None
    at = _starts(key)
    count = np.diff(np.append(at, len(key)))
    member = mix(sets.view(U) + tag.astype(U) * U(0xBEA225F9EB34556D))
    sign = np.add.reduceat(member, at) + count.astype(U)
    plain = (np.maximum.reduceat(tag, at) <= 1) & ~salted[at]
    sign = np.where(plain, mix(sign), key[at])
    _, first, times = np.unique(sign, return_index=True, return_counts=True)
    size = count[first]
    take = np.repeat(at[first] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    pieces = [(i, a, min(a + CHUNK, b)) for i, (a, b) in enumerate(zip(np.cumsum(size) - size, np.cumsum(size))) for a in range(a, b, CHUNK)]
    which = np.array([i for i, _, _ in pieces])
    part = salted[at][first][which]
    offsets = np.array([a for _, a, _ in pieces] + [len(take)], np.int32)
    lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[take], kind))
    hub = np.minimum.reduceat(sets[take], np.cumsum(size) - size)
    return pa.RecordBatch.from_arrays(
        [pa.array(mix(sign[first] + U(1)).view(np.int64)[which]), pa.array(times[which], pa.int32()), pa.array(part), pa.array(hub[which]), lists(sets, pa.int64()), lists(sizes, pa.int32()), lists((tag >> 1) - 1, pa.int8()), lists((tag & 1).astype(bool), pa.bool_()), lists(slack, pa.int16())],
        names=["gid", "times", "salted", "hub", "sets", "sizes", "units", "lowers", "slacks"],
    )


GROUP = "gid long, times int, salted boolean, hub long, sets array<long>, sizes array<int>, units array<tinyint>, lowers array<boolean>, slacks array<smallint>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and key, a hash of both that tells rows apart whatever the ids are."""
    both = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return both.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def _each_block(batches: Iterator[pa.RecordBatch], p: Params):
    """Blocks of a few megabytes of text with their shingles: (rows, text index, shingle, sizes, set ids)."""
    for whole in batches:
        for batch in textscan.pieces(whole, "text"):
            where, shingle = textscan.shingle_sets(*textscan.utf8(batch.column("text")), p.width)
            yield batch, where, shingle, *set_ids(where, shingle, batch.num_rows)


def _blobs(where: np.ndarray, shingle: np.ndarray, n: int) -> list[bytes]:
    cuts = np.searchsorted(where, np.arange(n + 1))
    return [shingle[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def document_sets(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, key, n_shingles, set_id, cells) of every row of `_texts`. cells: how many shingles fall in each of CELLS parts, 255 for more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, where, shingle, size, ids in _each_block(batches, p):
            cell = where * CELLS + (shingle & U(CELLS - 1)).astype(np.int64)
            count = np.minimum(np.bincount(cell, minlength=len(size) * CELLS), 255).astype(np.uint8).reshape(-1, CELLS)
            made = [pa.array(size), pa.array(ids), pa.array([r.tobytes() for r in count], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *made], names=["doc_id", "key", "n_shingles", "set_id", "cells"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n_shingles long, set_id long, cells binary")


def shared_keys(docs: DataFrame, p: Params = Params(), shingles: int = 0) -> DataFrame:
    """The groups of sets that share an index key, and the sets short of units (schema GROUP, times 0).

    shingles: of all texts together; it sets the number of buckets, of which a task holds one at a time.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-shingles // p.bucket))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, where, shingle, size, ids in _each_block(batches, p):
            rows = list(_pack(size, ids, where, shingle, p, buckets))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["bucket", "blob"])

    def found(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        full, short = ([b for b in blobs if (struct.unpack_from("<ii", b)[1] > 0) == kind] for kind in (True, False))
        if short:
            yield _short(short)
        groups = _groups(full) if full else None
        if groups is not None:
            for a in range(0, groups.num_rows, 4096):
                yield groups.slice(a, 4096)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blobs = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != held:
                    yield from found(blobs)
                    held, blobs = bucket, []
                blobs.append(blob)
        yield from found(blobs)

    dealt = docs.mapInArrow(index, "bucket int, blob binary").repartitionById(partitions, F.col("bucket") % partitions)
    return dealt.sortWithinPartitions("bucket").mapInArrow(gather, GROUP)


def _bits(values: DataFrame) -> bytes:
    """A bitmap of the longs in the column x, 16 bits for each and 2^28 at most, so it may go to every task.

    A value stands at its last bits after `mix`; where the bitmap fills up it only lets more pass.
    """

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").to_numpy(zero_copy_only=False).view(U)
            yield pa.RecordBatch.from_arrays([pa.array((mix(x) & U((1 << power) - 1)).astype(np.int64) + 1)], names=["s"])

    power = min(28, max(16, (16 * values.count()).bit_length()))
    rows = values.mapInArrow(spots, "s long").groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    out = bytearray(1 << (power - 3))
    for r in rows:
        out[(r.b - 1) * 4096 : r.b * 4096] = r.m
    return bytes(out)


def bits_of(bitmap: bytes):
    """Which of the values are in a bitmap of `_bits`, and a few others."""
    bits = np.frombuffer(bitmap, np.uint8)

    def has(x: np.ndarray) -> np.ndarray:
        at = (mix(x) & U(8 * len(bits) - 1)).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return has


def _sets_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()


def possible(pairs: DataFrame, sets: DataFrame, light: DataFrame, p: Params) -> DataFrame:
    """Those of the pairs (a, b) that may be linked by their cells: two sets share no more of a cell than either has there.

    It lets no linked pair go, and most others before their texts are read. sets: (set_id, key), one row of docs for each set.
    """
    n = pairs.count()
    wanted = _sets_of(pairs).join(sets.select("set_id", "key"), "set_id")
    cells = light.select(F.col("key").alias("of"), "n_shingles", "cells")
    cells = wanted.join(cells, F.col("key") == F.col("of")).dropDuplicates(["set_id"]).select("set_id", "n_shingles", "cells")
    cells = materialise(in_few(cells, 2 * n, OF_CELLS))
    rows = pairs.join(cells, F.col("b") == F.col("set_id")).select("a", "b", F.col("n_shingles").alias("n_b"), F.col("cells").alias("cells_b"))
    rows = rows.join(cells, F.col("a") == F.col("set_id")).select("a", "b", F.col("n_shingles").alias("n_a"), "n_b", F.col("cells").alias("cells_a"), "cells_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (textscan.utf8(batch.column(c))[0].reshape(-1, CELLS).astype(np.int32) for c in ("cells_a", "cells_b"))
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            both = np.minimum(x, y).sum(1)
            keep = ((x == 255) & (y == 255)).any(1) | (100 * both >= p.percent * (n - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return materialise(in_few(rows, n, OF_CELLS).mapInArrow(run, "a long, b long"))


def read_sets(docs: DataFrame, wanted: DataFrame, p: Params = Params()) -> DataFrame:
    """(set_id, blob): the ascending shingles of the wanted sets, one row each. wanted: (set_id, key), one row of docs for each set.

    The texts are read again; a bitmap of the keys, a few bytes for each, lets the rest go before it is cut into shingles.
    """
    wanted = materialise(wanted)
    shipped = docs.sparkSession.sparkContext.broadcast(_bits(wanted.select(F.col("key").alias("x"))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = bits_of(shipped.value)

        def passed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(has(batch.column("key").to_numpy().view(U))))

        for batch, where, shingle, _, ids in _each_block(passed(), p):
            one = np.unique(ids, return_index=True)[1]  # rows alike in id and text have one key
            blobs = _blobs(where, shingle, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids[one]), pa.array([blobs[i] for i in one], pa.binary())], names=["set_id", "blob"])

    made = docs.select("text", "key").mapInArrow(cut, "set_id long, blob binary")
    return made.join(wanted.select("set_id"), "set_id", "left_semi").groupBy("set_id").agg(F.first("blob").alias("blob"))


def verify(pairs: DataFrame, made: DataFrame, p: Params = Params()) -> DataFrame:
    """Those of the pairs (a, b) of set ids that are linked. made: the sets' shingles, by `read_sets`."""
    n = pairs.count()
    rows = pairs.join(made, F.col("b") == F.col("set_id")).select("a", "b", F.col("blob").alias("blob_b"))
    rows = rows.join(made, F.col("a") == F.col("set_id")).select("a", "b", F.col("blob").alias("blob_a"), "blob_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("blob_a"), batch.column("blob_b")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= p.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return settle(in_few(rows, n, OF_PAIRS).mapInArrow(check, "a long, b long"), "links")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _fits(a: str, b: str, p: Params) -> str:
    return f"100 * least({a}, {b}) >= {p.percent} * greatest({a}, {b})"


def _members(groups: DataFrame) -> DataFrame:
    zipped = F.explode(F.arrays_zip("sets", "sizes", "units", "lowers", "slacks")).alias("z")
    head = ["gid", "times", "salted", "hub"]
    return groups.select(*head, zipped).select(*head, F.col("z.sets").alias("set_id"), F.col("z.sizes").alias("size"), F.col("z.units").alias("unit"), F.col("z.lowers").alias("lower"), F.col("z.slacks").alias("slack"))


def to_hubs(groups: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Pairs of each set and the least set of its group, for near copies, which share many keys; pairs that share few are left to the second round."""
    salted = groups.filter("salted").groupBy("gid").agg(F.min("hub").alias("least"))
    members = _members(groups).join(salted, "gid", "left").withColumn("hub", F.coalesce("least", "hub"))
    star = members.filter("set_id != hub").groupBy("hub", "set_id").agg(F.max("size").alias("size"), F.sum("times").alias("shared")).filter("20 * shared >= size")
    star = star.join(sets.select(F.col("set_id").alias("hub"), F.col("size").alias("other")), "hub").filter(_fits("size", "other", p))
    return materialise(in_few(star.select(*_ordered("hub", "set_id")).distinct(), sets.count(), NUMBERS))


def probes(members: DataFrame, labels: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """The members of groups with several labels, and those of them that still probe their group, by cost-based allocation.

    width: how many members the group has.
    """
    named = members.join(labels.select(F.col("u").alias("set_id"), "label"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    n = members.count()
    few = lambda df: materialise(in_few(df, n, NUMBERS))
    several = few(named.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("gid"))
    # A plain group comes in one row from each bucket that holds keys of it: its keys are those of all of them. A salted key is one key.
    times = F.when(F.max("salted"), F.max("times")).otherwise(F.sum("times")).alias("times")
    left = few(named.join(several, "gid").groupBy("gid", "set_id", "size", "unit", "lower", "label").agg(times, F.min("slack").alias("slack")))
    per = few(left.groupBy("gid", "label").agg(F.sum(F.when(F.col("lower"), 0).otherwise(1)).alias("here"), F.count(F.lit(1)).alias("rows")))
    everywhere = per.groupBy("gid").agg(F.sum("here").alias("all"), F.sum("rows").alias("width"))
    cost = left.join(per.join(everywhere, "gid").drop("rows"), ["gid", "label"]).withColumn("cost", F.col("all") - F.col("here"))
    # One row for each unit of a set: a plain group of keys, a segment, or the deletions of a segment (which need the segment too).
    unit = F.when(F.col("unit") < 0, F.col("gid")).otherwise(F.col("unit").cast("long"))
    units = cost.groupBy("set_id", "lower", "unit", unit.alias("name")).agg(F.sum("cost").alias("cost"), F.max("times").alias("count"), F.min("slack").alias("slack"))
    segment = F.when(F.col("unit") < 0, F.lit(None)).otherwise(F.col("unit") % SMALL)
    own = Window.partitionBy("set_id", "lower", "segment")
    units = units.withColumn("segment", segment)
    exact = F.max(F.when(F.col("unit") < SMALL, F.col("cost"))).over(own)
    units = units.withColumn("cost", F.when(F.col("unit") >= SMALL, F.col("cost") + F.coalesce(exact, F.lit(0))).otherwise(F.col("cost")))
    dearest = Window.partitionBy("set_id", "lower").orderBy(F.desc("cost"), F.desc("unit"), "name").rowsBetween(Window.unboundedPreceding, 0)
    chosen = units.withColumn("so_far", F.sum("count").over(dearest)).filter("so_far > slack and cost > 0").select("set_id", "lower", "unit", "name")
    probing = left.withColumn("name", unit).join(chosen, ["set_id", "lower", "unit", "name"]).join(everywhere.select("gid", "width"), "gid")
    return left, few(probing.select("gid", "set_id", "size", "label", "lower", "width"))


def in_narrow(left: DataFrame, probing: DataFrame, p: Params) -> DataFrame:
    """The pairs of different labels in the groups of few members, as many as a constant allows each member."""
    index = left.filter("not lower").select(F.col("gid").alias("__gid"), F.col("set_id").alias("other_id"), F.col("size").alias("other"), F.col("label").alias("other_label"))
    some = probing.filter(F.col("width") <= p.wide)
    meet = some.join(index, F.expr("gid = __gid and label != other_label and other <= size and " + _fits("size", "other", p)))
    return meet.select(*_ordered("set_id", "other_id")).distinct()


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("u", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))


def postings(made: DataFrame, p: Params) -> tuple[DataFrame, int]:
    """(x, set_id, size, reach): where each set has a shingle x that others of `made` have too, rarest first, and the largest partner that this place allows; and how many rows that is."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(batch.column("set_id").to_pylist(), batch.column("blob")):
                x = np.frombuffer(blob.as_buffer(), np.int64)
                for a in range(0, len(x), CHUNK):
                    n = len(x[a : a + CHUNK])
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + CHUNK]), pa.array(np.full(n, key)), pa.array(np.full(n, len(x)))], names=["x", "set_id", "size"])

    rows = made.mapInArrow(spread, "x long, set_id long, size long")
    often = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    of_set = Window.partitionBy("set_id")
    place = F.col("size") - F.count(F.lit(1)).over(of_set) + F.row_number().over(of_set.orderBy("n", "x")) - 1
    placed = rows.join(often, "x").withColumn("place", place).withColumn("reach", F.expr(f"({100 + p.percent} * (size - place)) div {p.percent} - size"))
    shingles = made.agg(F.sum(F.octet_length("blob")) / 8).first()[0] or 0
    out = materialise(in_few(placed.filter(f"100 * reach >= {p.percent} * size").select("x", "set_id", "size", "reach"), int(shingles), NUMBERS))
    return out, out.count()


def _still_open(named: DataFrame, n: int) -> DataFrame:
    """Those postings (x, set_id, size, reach, label) that a member of another label allows."""
    several = lambda df: df.join(df.groupBy("x").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l != h").select("x"), "x")
    few = lambda df: materialise(in_few(df, n, NUMBERS))
    named = few(several(named))
    bounds = named.groupBy("x").agg(F.min("size").alias("least"), F.min_by("label", "size").alias("least_of"), F.max("reach").alias("most"), F.max_by("label", "reach").alias("most_of"))
    named = named.join(bounds, "x")
    others = named.groupBy("x").agg(F.min(F.when(F.col("label") != F.col("least_of"), F.col("size"))).alias("least2"), F.max(F.when(F.col("label") != F.col("most_of"), F.col("reach"))).alias("most2"))
    allowed = "reach >= if(label = least_of, least2, least) and size <= if(label = most_of, most2, most)"
    kept = few(named.join(others, "x").filter(allowed).select("x", "set_id", "size", "reach", "label"))
    return few(several(kept))


def in_wide(made: DataFrame, links: DataFrame, p: Params) -> DataFrame:
    """Links between the sets of `made` that join what the links so far leave apart; hub rounds first, then every pair that is left."""
    places, n = postings(made, p)
    allow = "l.size <= r.reach and r.size <= l.reach and l.label != r.label and " + _fits("l.size", "r.size", p)
    pair = [F.least("l.set_id", "r.set_id").alias("a"), F.greatest("l.set_id", "r.set_id").alias("b")]
    seen = found = None
    for step in range(ROUNDS + 1):
        rows = _still_open(_with_labels(places, components(links)), n)
        of_each = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.expr("cast(n as decimal(20, 0)) * (n - 1) / 2"))).first()
        if not of_each[0]:
            break
        last = step == ROUNDS or of_each[1] <= p.wide * of_each[0]
        if not last:
            hubs = rows.groupBy("x").agg(F.max_by("set_id", F.col("reach") / F.col("size")).alias("set_id"))
            hubs = hubs.join(rows, ["x", "set_id"])
            pairs = rows.alias("l").join(hubs.alias("r"), F.expr("l.x = r.x and " + allow)).select(*pair).distinct()
            pairs = materialise(in_few(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), n, NUMBERS))
            new = verify(pairs, made, p)
            seen = pairs if seen is None else seen.union(pairs)
        if last or new.isEmpty():
            pairs = rows.alias("l").join(rows.alias("r"), F.expr("l.x = r.x and l.set_id < r.set_id and " + allow)).select(*pair).distinct()
            new = verify(materialise(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti")), made, p)
            found = new if found is None else found.union(new)
            break
        found = new if found is None else found.union(new)
        links = links.union(new)
    return found if found is not None else links.limit(0)


def join(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, set_id, key (a hash of id and text) and component (a number of its own; null without shingles).

    component_id is the least id of the documents reachable by links. A text without words (or null) has no shingles, is linked with
    nothing and is its own component; equal sets are linked. A null id takes part in links but is never a component's name
    unless the component has no other. Ids may be of any type that has an order, and may repeat.
    """
    docs = _texts(docs, id_col, text_col)
    light = materialise(document_sets(docs, p))
    full = light.filter("n_shingles > 0")
    n, shingles = light.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    few = lambda df: materialise(in_few(df, n, NUMBERS))
    sets = few(full.groupBy("set_id").agg(F.min("key").alias("key"), F.max("n_shingles").alias("size")))
    groups = materialise(shared_keys(docs, p, shingles))
    drop_unread(docs.sparkSession)
    keyed = groups.filter("times > 0")
    first = possible(to_hubs(keyed, sets, p), sets, light, p)
    links = verify(first, read_sets(docs, _sets_of(first).join(sets.select("set_id", "key"), "set_id"), p), p)
    left, probing = probes(_members(keyed), components(links), p)
    drop_unread(docs.sparkSession)
    near = possible(few(in_narrow(left, probing, p).join(first, ["a", "b"], "left_anti")), sets, light, p)
    wide = left.join(probing.filter(F.col("width") > p.wide).select("gid").distinct(), "gid").select("set_id").distinct()
    short = groups.filter("times = 0").select(F.col("hub").alias("set_id")).distinct()
    wanted = few(wide.select("set_id", F.lit(1).alias("kind")).union(short.select("set_id", F.lit(2))).union(_sets_of(near).select("set_id", F.lit(0))))
    made = materialise(in_few(read_sets(docs, wanted.select("set_id").distinct().join(sets.select("set_id", "key"), "set_id"), p), wanted.count(), OF_PAIRS))
    links = links.union(verify(near, made, p))
    of_kind = lambda kind: made.join(wanted.filter(F.col("kind") == kind), "set_id", "left_semi")
    links = links.union(in_wide(materialise(in_few(of_kind(1), n, OF_PAIRS)), links, p)).union(against_all(docs, of_kind(2), p))
    named = few(_with_labels(sets.select("set_id", "key"), components(links)))
    ids = full.select(F.col("set_id").alias("of"), "doc_id").groupBy("of").agg(F.min("doc_id").alias("doc_id"))
    named = few(named.join(ids, F.col("set_id") == F.col("of"), "left").select("set_id", "label", "doc_id"))
    least = few(named.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    of_set = few(named.join(least, "label").select(F.col("set_id").alias("__set"), "component_id", F.col("label").alias("component")))
    out = light.join(of_set, (F.col("set_id") == F.col("__set")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "set_id", "key", "component")


def one_of_each(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each component: that with the least id (a null id is the last), of several the one with the least key.

    Texts without words stay all. Of rows alike in id and text any one stays.
    """
    name = "__key"
    while name in docs.columns:
        name += "_"
    found = join(docs, p, id_col, text_col).filter("component is not null")
    found = materialise(found.select("component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key").alias("row")))
    first = found.groupBy(F.col("component").alias("of")).agg(F.min("row").alias("first"))
    goes = materialise(found.join(first, F.col("component") == F.col("of")).filter(~F.col("row").eqNullSafe(F.col("first"))).select(F.col("row.key").alias("__goes")))
    twice = materialise(found.groupBy(F.col("row.key").alias("__twice")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("__twice"))
    rows = docs.withColumn(name, F.xxhash64(f"`{id_col}`", f"`{text_col}`"))
    rows = rows.join(goes, F.col(name) == F.col("__goes"), "left_anti")
    if not twice.isEmpty():
        again = F.col(name) == F.col("__twice")
        rows = rows.join(twice, again, "left_anti").union(rows.join(twice, again, "left_semi").dropDuplicates([name]))
    return rows.drop(name)


def against_all(docs: DataFrame, made: DataFrame, p: Params) -> DataFrame:
    """The links of the sets in `made` (set_id, blob) with any others, by counting the shingles they share with each text.

    The sets, few as they are, go to every task in blocks of AT_ONCE shingles (16 MB); each block is one pass over the texts.
    """
    context = docs.sparkSession.sparkContext
    made = materialise(made.withColumn("n", F.octet_length("blob") / 8))
    total = made.agg(F.sum("n")).first()[0] or 0
    blocks, out = int(-(-total // AT_ONCE)), docs.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for block in range(blocks):
        rows = made.filter(F.pmod(F.xxhash64("set_id"), F.lit(blocks)) == block).select("set_id", "blob").collect()
        if not rows:
            continue
        names, sizes = np.array([r.set_id for r in rows], np.int64), np.array([len(r.blob) // 8 for r in rows], np.int64)
        x, of = np.concatenate([np.frombuffer(bytes(r.blob), U) for r in rows]), np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(x, kind="stable")
        shipped = context.broadcast((names, sizes, x[order], of[order]))

        def meet(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            names, sizes, x, of = shipped.value
            for _, where, shingle, size, sets in _each_block(batches, p):
                low, high = np.searchsorted(x, shingle), np.searchsorted(x, shingle, "right")
                hit = np.flatnonzero(high > low)
                times = (high - low)[hit]
                take = np.repeat(low[hit] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                pair, both = np.unique(np.repeat(where[hit], times) * len(names) + of[take], return_counts=True)
                text, mine = pair // max(1, len(names)), pair % max(1, len(names))
                ok = (100 * both >= p.percent * (size[text] + sizes[mine] - both)) & (sets[text] != names[mine])
                a, b = sets[text[ok]], names[mine[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        out = out.union(settle(docs.select("text").mapInArrow(meet, "a long, b long").distinct(), "links"))
    return out
