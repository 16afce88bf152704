"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in SQL expressions only.

A text is the set of its paragraphs' 64-bit digests: lines that are not empty, those of more than LONG characters cut after
sentences. A sketch has
three tables of `width` cells. Every digest is added to one cell of each table: the cell counts
it and keeps the exclusive or of digests and of their checks. Sketches of two versions subtract
cell by cell; what both hold cancels. Peeling takes cells that hold a single digest, removes it from its
other cells, and goes on until nothing is left: the digests taken are the difference.

If cells are left, the difference was too large for the sketch. It is retried larger: the
digests are dealt into blocks (one for each BLOCK_LOAD digests of both versions), each with a sketch of its own; both versions are
sorted by block once, so work grows as a sort of the text's digests and not as their square; a second retry has twice the blocks. Should that
fail too (it takes a chance of about one in millions), the digests themselves are compared.

The fingerprint is the sketch of the first size as text, after the number of digests. Equal texts have equal ones.

Likeness is the Jaccard similarity of the digest sets, from the sizes and the difference; two
empty sets are alike (1).
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines longer than this are cut after sentences: a text of one line would have one digest, and be unlike any edited version of it.
LONG = 400
WIDTH = 10
RETRY_WIDTH = 12
BLOCK_LOAD = 14
ROUNDS = 20
#: Documents to a range of ids, and the most ranges.
DOCS_PER_CELL, MOST_CELLS = 1024, 65536


def digests(text: str) -> Column:
    """Distinct paragraphs of a text column: their digest d, check c, and one hash h that places them."""
    lines = f"filter(split(coalesce(`{text}`, ''), '\\n', -1), p -> p != '')"
    lines = f"flatten(transform({lines}, p -> if(length(p) > {LONG}, split(p, '(?<=[.!?]) '), array(p))))"
    entry = f"named_struct('d', d, 'c', cast(xxhash64(d, 7L) & 4294967295L as long), 'h', h, 'm', {_mask('h', WIDTH)}, 'r', {_mask('h', RETRY_WIDTH)})"
    return F.expr(f"transform(array_distinct(transform({lines}, p -> xxhash64(p))), d -> transform(array(xxhash64(d, 13L)), h -> {entry})[0])")


def _mask(h: str, width: int) -> str:
    """A bit for each of a digest's cells, one in each table: other bits of h for each."""
    place = lambda table: f"cast((shiftrightunsigned({h}, {16 * table}) & 65535L) % {width} as int) + {table * width}"
    return "(" + " | ".join(f"shiftleft(1L, {place(table)})" for table in range(3)) + ")"


def _sketch(entries: str, width: int, mask: str, sign: str = "1") -> str:
    return f"""transform(sequence(0, {3 * width - 1}), s -> transform(array(shiftleft(1L, s)), bit -> aggregate(filter({entries}, e -> (e.{mask} & bit) != 0L),
        named_struct('n', 0, 'k', 0L, 'c', 0L), (a, e) -> named_struct('n', a.n + {sign}, 'k', a.k ^ e.d, 'c', a.c ^ e.c)))[0])"""


def sketch(entries: str) -> Column:
    """Cells (n, k, c) of an array column that `digests` made."""
    return F.expr(_sketch(f"`{entries}`", WIDTH, "m"))


def _minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


def _peel(cells: str, width: int) -> str:
    """struct(cells, found, live): found has the digests d with the sign s, 1 for the first version's."""
    check = "cast(xxhash64(x.k, 7L) & 4294967295L as long)"
    entry = f"transform(array(xxhash64(x.k, 13L)), h -> named_struct('d', x.k, 's', x.n, 'c', x.c, 'm', {_mask('h', width)}))[0]"
    pure = f"array_distinct(transform(filter(st.cells, x -> abs(x.n) = 1 and x.c = {check}), x -> {entry}))"
    less = """transform(st2.cells, (x, j) -> transform(array(shiftleft(1L, j)), bit -> aggregate(filter(pure, p -> (p.m & bit) != 0L), x,
        (a, p) -> named_struct('n', a.n - p.s, 'k', a.k ^ p.d, 'c', a.c ^ p.c)))[0])"""
    step = f"""aggregate(array({pure}), st, (st2, pure) -> if(size(pure) = 0, named_struct('cells', st2.cells, 'found', st2.found, 'live', false),
        named_struct('cells', {less}, 'found', concat(st2.found, transform(pure, p -> named_struct('d', p.d, 's', p.s))), 'live', true)))"""
    start = f"named_struct('cells', {cells}, 'found', cast(array() as array<struct<d:bigint,s:int>>), 'live', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (st, r) -> if(st.live, {step}, st))"


_EMPTY = "forall({0}.cells, x -> x.n = 0 and x.k = 0)"


def _retry(a: str, b: str, level: int) -> str:
    """One difference, or null if a block keeps cells. Both versions are sorted by block once, and each block is a slice of that."""
    blocks = f"greatest(1L, cast(ceil((size({a}) + size({b})) * {level} / {BLOCK_LOAD}) as bigint))"
    signed = lambda e, sign: f"transform({e}, e -> named_struct('blk', pmod(shiftrightunsigned(e.h, 48) + e.c, blocks), 'd', e.d, 'c', e.c, 'r', e.r, 's', {sign}))"
    both = f"sort_array(flatten(transform(array({blocks}), blocks -> concat({signed(a, 1)}, {signed(b, -1)}))))"
    starts = "filter(sequence(0, size(srt) - 1), i -> i = 0 or srt[i].blk != srt[i - 1].blk)"
    cells = f"transform(array(slice(srt, st + 1, coalesce(get(sts, j + 1), size(srt)) - st)), part -> {_sketch('part', RETRY_WIDTH, 'r', 'e.s')})[0]"
    each = f"transform(array({starts}), sts -> transform(sts, (st, j) -> {_peel(cells, RETRY_WIDTH)}))[0]"
    done = f"transform(array({both}), srt -> if(size(srt) = 0, array(), {each}))[0]"
    return f"transform(array({done}), all -> if(forall(all, z -> {_EMPTY.format('z')}), flatten(transform(all, z -> z.found)), null))[0]"


def difference(a_cells: str, b_cells: str, a: str, b: str) -> Column:
    """The digests in which two versions differ, array<struct<d, s>>: s is 1 in the first only, -1 in the second only.

    Takes the names of their columns of cells and of digests.
    """
    first = f"transform(array({_peel(_minus(f'`{a_cells}`', f'`{b_cells}`'), WIDTH)}), z -> if({_EMPTY.format('z')}, z.found, null))[0]"
    ids = lambda e: f"transform(`{e}`, e -> e.d)"
    plain = f"concat(transform(array_except({ids(a)}, {ids(b)}), d -> named_struct('d', d, 's', 1)), transform(array_except({ids(b)}, {ids(a)}), d -> named_struct('d', d, 's', -1)))"
    return F.expr(f"coalesce({first}, {_retry(f'`{a}`', f'`{b}`', 1)}, {_retry(f'`{a}`', f'`{b}`', 2)}, {plain})")


def likeness(a: str, b: str, differing: str) -> Column:
    return F.expr(f"if(size(`{a}`) + size(`{b}`) = 0, 1.0D, cast(size(`{a}`) + size(`{b}`) - size(`{differing}`) as double) / (size(`{a}`) + size(`{b}`) + size(`{differing}`)))")


def as_text(entries: str, cells: str) -> Column:
    return F.expr(f"concat(cast(size(`{entries}`) as string), ':', array_join(transform(`{cells}`, x -> concat(hex(x.n), '.', hex(x.k), '.', hex(x.c))), ';'))")


def _borders(rows: DataFrame) -> tuple[list[int], list[int], int]:
    """Ids that cut the rows into ranges of about DOCS_PER_CELL, how many ranges start at each, and into how many the rows without an id are cut.

    The ids are quantiles, so neither outliers nor gaps matter; an id that a range's worth of rows repeat comes as often as it fills ranges.
    """
    n, none = rows.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    cells = min(MOST_CELLS, (n - none) // DOCS_PER_CELL)
    found = rows.agg(F.percentile_approx("doc_id", [i / cells for i in range(1, cells)], max(10_000, 4 * cells))).first()[0] if cells > 1 else []
    times = Counter(found)
    return sorted(times), [times[x] for x in sorted(times)], max(1, min(MOST_CELLS, none // DOCS_PER_CELL))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_text): the text of the next row in descending order of id, after the last the first's.

    Rows of equal id are ordered by a hash of the text, then the text; null ids come last. Ids are cut into ranges of about equal counts
    (one id that many rows have, and null, by the hash); a range is one window, and its first row gets its neighbour from a copy of the last row of the range
    before, so each text is shuffled once and the ids need not be without gaps. The table of those rows is bounded by 2 * MOST_CELLS and so may be broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts, times, none = _borders(rows.select("doc_id"))
    rows = rows.withColumn("__h", F.xxhash64("text")).withColumn("__u", F.expr("shiftrightunsigned(__h, 33)"))
    array = lambda xs: F.expr(f"cast(split('{','.join(map(str, xs))}', ',') as array<bigint>)")  # noqa: E731  folded into one literal
    if cuts:
        rows = rows.withColumns({"__cuts": array(cuts), "__times": array(times)})
        steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        place = F.expr(f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> if(coalesce(get(__cuts, at + step - 1) <= doc_id, false), at + step, at))")
        rows = rows.withColumn("__at", place)  # how many borders are not above the id
        many, here = F.expr("get(__times, __at - 1)"), F.expr("doc_id = get(__cuts, __at - 1)")
        within = F.when(here, F.expr("(__u * get(__times, __at - 1)) >> 31")).otherwise(F.coalesce(many - 1, F.lit(0)))
        rows = rows.withColumn("__in", within).drop("__cuts", "__times")
    else:
        rows = rows.withColumn("__at", F.lit(0)).withColumn("__in", F.lit(0).cast("long"))
    null = F.col("doc_id").isNull()
    rows = rows.withColumn("__cell", F.struct(F.when(null, -1).otherwise(F.col("__at")).cast("int").alias("at"), F.when(null, F.expr(f"(__u * {none}) >> 31")).otherwise(F.col("__in")).cast("long").alias("within"))).drop("__at", "__in")
    # The greatest row of each range: null ids first, then ids, then hashes.
    last = rows.groupBy("__cell").agg(F.max(F.struct("doc_id", "__u", "__h")).alias("__last"))
    order = Window.orderBy("__cell")
    borders = last.select(F.col("__cell").alias("__of"), F.col("__last"), F.coalesce(F.lead("__cell").over(order), F.min("__cell").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("__to"))
    ends = (F.col("__cell") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__last.doc_id")) & (F.col("__h") == F.col("__last.__h"))
    both = rows.join(F.broadcast(borders), ends, "left")
    own = F.struct(F.col("__cell").alias("cell"), F.lit(True).alias("own"))
    copy = F.struct(F.col("__to").alias("cell"), F.lit(False).alias("own"))
    dealt = both.withColumn("__as", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, copy)))).select("doc_id", "text", "__u", "__h", F.col("__as.cell").alias("__cell"), F.col("__as.own").alias("__own"))
    line = Window.partitionBy("__cell").orderBy("__own", F.asc_nulls_first("doc_id"), "__u", "__h", "text")
    return dealt.withColumn("next_text", F.lag("text").over(line)).filter("__own").select("doc_id", "text", "next_text")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third of the text, floor(n / 3) code points, replaced by as many of the first of the next text.
    Null text is an empty text; its edited text is empty as well. One row per row of docs.
    """
    rows = with_next(docs, id_col, text_col)
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - length(text) div 3 as int))"), F.expr("substring(next_text, 1, cast(length(text) div 3 as int))"))
    rows = rows.select("doc_id", "text", n.cast("long").alias("n_chars"), "next_text", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests("text").alias("a"), digests("edited").alias("b"), digests("next_text").alias("x"))
    rows = rows.select("*", sketch("a").alias("ca"), sketch("b").alias("cb"), sketch("x").alias("cx"))
    rows = rows.select("*", difference("ca", "cb", "a", "b").alias("ab"), difference("ca", "cx", "a", "x").alias("ax"))
    gone = lambda sign: F.expr(f"size(filter(ab, z -> z.s = {sign}))")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("a", "ca").alias("fingerprint"), as_text("b", "cb").alias("edited_fingerprint"),
        likeness("a", "b", "ab").alias("near_edited"), likeness("a", "x", "ax").alias("near_next"), gone(1).alias("n_removed"), gone(-1).alias("n_added"),
    )
