"""EXPLAIN: the plan in a few lines, with row counts from the snapshot's manifest; nothing is scanned.

How many values a join column has is known for keys and guessed for others.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from lontar.dialect import nodes as n
from lontar.dialect.compile import _join_pairs, contains_aggregate, resolve

if TYPE_CHECKING:
    from lontar.engine.session import Session

#: A view's rows are not counted.
VIEW_ROWS = 1000
#: Rows to a value of a column that is no key.
PER_VALUE = 10


def explain(session: Session, q: n.Select) -> list[str]:
    session.compile(q)  # the query must be valid
    out = [f"Query: {n.select_text(q)}"]
    rows: dict[str, int] = {}
    distinct: dict[tuple[str, str], int] = {}
    schema = [b for s in q.sources for b in session._source(s).schema]
    pairs = [(resolve(schema, a), resolve(schema, b)) for a, b in _join_pairs(q.join)] if q.join is not None else []
    for s in q.sources:
        src = session._source(s)
        if s in session.external or s not in session.manifest.views:
            t = session.manifest.table(s) if s not in session.external else None
            if t is not None and t.rows is None:  # written before counts were kept
                t.rows = src.df.count()
            rows[s] = t.rows if t is not None else VIEW_ROWS
            keys = {k for _, columns in t.keys() if len(columns) == 1 for k in columns} if t is not None else set()
            distinct |= {(s, b.name): rows[s] if b.name in keys else rows[s] // PER_VALUE for p in pairs for b in p if b.source == s}
            out.append(f"Scan {s} (rows={rows[s]})" if t is not None else f"Scan {s} (estimate unknown)")
        else:
            rows[s] = VIEW_ROWS
            out.append(f"Scan {s} (estimate unknown)")
    if pairs:
        order, left = [min(q.sources, key=lambda s: rows[s]) if len(q.sources) > 2 else q.sources[0]], list(q.sources)
        left.remove(order[0])
        size, steps = rows[order[0]], []
        while left:

            def linked(s: str) -> list:
                return [(a, b) for a, b in pairs if (a.source in order and b.source == s) or (b.source in order and a.source == s)]

            def estimate(s: str) -> int:
                # Each link keeps one row in as many as the key has values, on its richer side.
                est = size * rows[s]
                for a, b in linked(s):
                    est = est // max(1, distinct.get((a.source, a.name), 1), distinct.get((b.source, b.name), 1))
                return est

            best = min((s for s in left if linked(s)), key=estimate)
            links = " and ".join(f"{a.source}.{a.name}={b.source}.{b.name}" for a, b in linked(best))
            before, size = size, estimate(best)
            steps.append(f"  Hash Join {links} (estimated rows={size})")
            steps.append(f"  Build side: {best if rows[best] <= before else 'joined rows'}")
            order.append(best)
            left.remove(best)
        out += [f"Join order: {' -> '.join(order)}", *steps]
    if q.where is not None:
        out.append(f"Filter: {n.expr_text(q.where)}")
    if q.groups or any(contains_aggregate(i.expr) for i in q.items):
        out.append("Aggregate: hash group by" + (f" {', '.join(map(n.expr_text, q.groups))}" if q.groups else ""))
    if q.order:
        out.append("Sort: " + ", ".join(f"{n.expr_text(o.expr)} {'Bawah' if o.descending else 'Atas'}" for o in q.order))
    if q.limit is not None:
        out.append(f"Limit: {q.limit}")
    return out
