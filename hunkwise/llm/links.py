"""Groups of near-duplicates from sorted buckets, without all pairs of a bucket.

Bucket rows are dealt by range of all their sort columns and stream by in that order, so a bucket may
span tasks and none is ever gathered.  A row is held against the ``lags`` rows before it in its bucket
and pairs with the few of them that are closest, if they are close.  The sort columns after the bucket
bring like rows together.  What a partition's border cuts apart is looked at once more.

These bounds hold for the first round only.  ``join_close`` verifies its pairs, joins what they link, and
goes on with the buckets that held more close rows than a row pairs with, and with those longer than a
row is held against.  Where all rows of such a bucket are joined by then, nothing can be added and it is
dropped.  In the rest, the rows outside a bucket's largest group are held against all rows of other
groups, and every close pair is verified: two rows of a bucket that are close end up in one group exactly
if links join them.  With ``Inside`` that happens where the pairs are found, in the first bucket that
two rows share, and only links that join groups leave the task: fewer than the groups there, however many
pairs are verified.  Where that takes more than ``DENSE`` comparisons, a round comes before that holds
each of these rows against its neighbours on either side, in several orders of a long bucket, and joins
most of what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from hunkwise.operators.components import components
from hunkwise.session import cut

LAG, BEST = 128, 4
PAIR, EDGE, OPEN, LONG = 0, 1, 2, 3
#: Rows on a side of a cell, and pairs of a cell that are looked at together.
TILE, AT_ONCE = 1 << 12, 1 << 20
#: Sum of the sizes of rows on a side of a cell.
LARGE = 1 << 25
#: Comparisons of all rows that seek with all rows of their buckets, above which another round comes first.
DENSE = 1 << 34
#: Makes of a table's columns a score of how close rows i and j are, on index arrays; -1 is not close.
Closeness = Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]]
#: Makes of a table, and of what a task keeps from one to the next, what makes an output of close rows i and j and their scores.
Made = Callable[[pa.Table, dict], Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]]


class Inside(NamedTuple):
    """How links are found in the task that holds two rows.

    own: of nodes (node), the columns that ``linked`` and ``keys`` read beside those of the rows.  keys: of
    a table, all buckets of each row in one order, a column for each; one that a row lacks stands after
    all that it has.  linked: of a table, a test of rows i and j.  size: a row's size, as SQL; batch: pairs that
    are tested together.
    """

    own: Callable[[DataFrame], DataFrame]
    keys: Callable[[pa.Table], np.ndarray]
    linked: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]]
    size: str
    batch: int


def near_rows(bucket: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray], skip: int = 0, most: int = BEST, lags: int = LAG, seeks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, more): each sorted row i from ``skip`` on with the ``most`` closest rows j of the ``lags`` rows before it in its bucket; of equally close ones, the nearer.

    ``more``: the rows that have other close ones among these.  With ``seeks``, only the rows it marks
    have partners, and among the rows after them too.
    """
    n = len(bucket)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if n else np.zeros(0, np.int64)
    place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    # Score, nearness and side as one number: the larger, the better.
    best, count = np.full((most, n), -1), np.zeros(n, np.int64)

    def offer(to: np.ndarray, new: np.ndarray) -> None:
        count[to] += 1
        for k in range(most):
            old = best[k, to]
            best[k, to], new = np.maximum(old, new), np.minimum(old, new)

    i = np.flatnonzero(place >= 1)
    i = i[i >= skip]
    for lag in range(1, lags + 1):
        i = i[place[i] >= lag]
        if not len(i):
            break
        of = i if seeks is None else i[seeks[i] | seeks[i - lag]]
        s = score(of, of - lag)
        of, new = of[s >= 0], (s[s >= 0] * lags + lags - lag) * 2
        if seeks is None:
            offer(of, new)
        else:
            offer(of[seeks[of]], new[seeks[of]])
            offer(of[seeks[of - lag]] - lag, new[seeks[of - lag]] + 1)
    k, at = np.nonzero(best >= 0)
    code = best[k, at] % (2 * lags)
    away = lags - code // 2
    return at, np.where(code & 1, at + away, at - away), np.flatnonzero(count > most)


def _scan(closeness: Closeness, names: list[str], most: int, lags: int, borders: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of sorted rows: each node with those that are close (kind 0: a, others), the rows at the partition's borders (1; a: the partition), in a the buckets with more close pairs (2) and the long ones (3)."""

    def rows(kind: int, table: pa.Table | None, a: np.ndarray, others: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        n = len(a)
        own = [table.column(c) if table is not None else pa.nulls(n, t) for c, t in zip(names, types)]
        others = pa.nulls(n, pa.list_(pa.int64())) if others is None else others
        yield from pa.table([pa.array(np.full(n, kind, np.int32)), pa.array(a), others, *own], ["kind", "a", "others", *names]).combine_chunks().to_batches()

    types: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, head, begun, own = None, None, not borders, TaskContext.get().partitionId()
        edge = lambda t: rows(EDGE, t, np.full(t.num_rows, own))
        for batch in batches:
            if not batch.num_rows:
                continue
            if not types:
                types.extend(batch.schema.types)
            part = pa.Table.from_batches([batch])
            skip = tail.num_rows if tail is not None else 0
            whole = pa.concat_tables([tail, part]).combine_chunks() if skip else part.combine_chunks()
            bucket = whole.column("bucket").to_numpy()
            seeks = whole.column("seeks").to_numpy(zero_copy_only=False) if "seeks" in names else None
            i, j, more = near_rows(bucket, closeness(whole), skip, most, lags, seeks)
            if len(i):
                node, by = whole.column("node").to_numpy(), np.argsort(i, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(i[by]) > 0))
                others = pa.ListArray.from_arrays(pa.array(np.append(heads, len(i)).astype(np.int32)), pa.array(node[j[by]]))
                yield from rows(PAIR, None, node[i[by][heads]], others)
            if not begun:
                # A first batch may be shorter than ``lags``: the head goes on in the next.
                head = whole if head is None else pa.concat_tables([head, part])
                own_head = head.column("bucket").to_numpy()
                begun = own_head[0] != own_head[-1] or len(own_head) > lags
                if begun:
                    yield from edge(head.slice(0, int(np.searchsorted(own_head[: lags + 1], own_head[0], "right"))))
            for kind, found in ((OPEN, bucket[more]), (LONG, bucket[lags:][bucket[lags:] == bucket[:-lags]])):
                if len(found):
                    yield from rows(kind, None, np.unique(found))
            tail = whole.slice(max(int(np.searchsorted(bucket, bucket[-1])), whole.num_rows - lags))
        if not begun and head is not None:
            yield from edge(head)
        if tail is not None and borders:
            yield from edge(tail)

    return run


def close_pairs(rows: DataFrame, closeness: Closeness, most: int = BEST, lags: int = LAG) -> tuple[DataFrame, DataFrame]:
    """(different pairs (a, b), open buckets (bucket, long)) of rows (bucket, ..., node), sorted by all their columns that can be.

    A bucket is open if it holds close pairs beyond those given, and long if rows of it were not held
    against each other.
    """
    names = rows.columns
    order = [f.name for f in rows.schema.fields if not isinstance(f.dataType, T.BinaryType)]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("others", T.ArrayType(T.LongType())), *[T.StructField(f.name, f.dataType) for f in rows.schema.fields]])
    run = _scan(closeness, names, most, lags)
    found = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "close")
    edge = found.filter(F.col("kind") == EDGE).select(*names, F.col("a").alias("part")).distinct().repartition("bucket").sortWithinPartitions(*order)
    across = _scan(_apart(closeness, "part"), [*names, "part"], most, lags, False)
    edge = edge.mapInArrow(across, T.StructType([*schema.fields, T.StructField("part", T.LongType())]))
    both = cut(found.filter(F.col("kind") != EDGE).select("kind", "a", "others").unionByName(edge.select("kind", "a", "others")), "close")
    still = both.filter(F.col("kind") != PAIR).groupBy(F.col("a").alias("bucket")).agg((F.max("kind") == LONG).alias("long"))
    # A node meets another in several buckets: once is enough.
    each = both.filter(F.col("kind") == PAIR).groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others")).select("a", F.explode("others").alias("b"))
    return each.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), still


def _apart(closeness: Closeness, column: str) -> Closeness:
    """Close are only rows that differ in a column."""

    def of(rows: pa.Table):
        test, own = closeness(rows), rows.column(column).to_numpy()

        def apart(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out, other = np.full(len(i), -1), np.flatnonzero(own[i] != own[j])
            if len(other):
                out[other] = test(i[other], j[other])
            return out

        return apart

    return of


def join_close(rows: DataFrame, closeness: Closeness, verify: Callable[[DataFrame], DataFrame], turned: Callable[[DataFrame], DataFrame], most: int = BEST, further: int = BEST, lags: int = LAG, inside: Inside | None = None) -> DataFrame:
    """(vertex, component) of the nodes of rows (bucket, ..., node) that links join: those of all close pairs of a bucket.

    verify: of pairs (a, b), those that are links; at first it gets the nodes that later pairs are made of
    too.  turned: of rows, the same rows in other orders, each order a bucket of its own.  most, further:
    how many others a row pairs with in the first round and in the one for many comparisons.  inside: without
    it, the last pairs are rows for ``verify`` too.
    """
    names = rows.columns
    order = [c for c in names if c != "node"]
    pairs, still = close_pairs(rows, closeness, most, lags)
    tested = cut(pairs, "pairs")
    near = cut(rows.join(still, "bucket"), "near")
    found = cut(verify(tested, near.select("node")), "links")
    joined = cut(components(found, "a", "b"), "joined")
    if near.isEmpty():
        return joined
    again = cut(_mixed(near, joined), "again")
    sizes = again.groupBy("bucket").agg((F.count("*") * F.count_if("seeks")).alias("n"))
    if sizes.agg(F.coalesce(F.sum(F.col("n").cast("double")), F.lit(0.0))).first()[0] > DENSE:
        rest = again.filter("not long").drop("long").unionByName(turned(again.filter("long").drop("long")))
        rest = cut(rest.select(*order, "group", "seeks", "node"), "rest")
        pairs, _ = close_pairs(rest, _apart(closeness, "group"), min(further, lags), lags)
        pairs = cut(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        joined = _merged(joined, cut(verify(pairs), "links"))
        tested = cut(tested.unionByName(pairs), "tested")
        again = cut(_mixed(near, joined), "again")
    if again.isEmpty():
        return joined
    if inside:
        return _merged(joined, cut(joining(again.drop("long"), closeness, inside), "links"))
    pairs = cut(all_close(again.drop("long"), closeness).join(tested, ["a", "b"], "left_anti"), "pairs")
    return _merged(joined, cut(verify(pairs), "links"))


def _ends(whole: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    a, b = (whole.column("node").to_numpy()[x] for x in (i, j))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def all_close(rows: DataFrame, closeness: Closeness) -> DataFrame:
    """(a, b): all different close pairs of rows (bucket, ..., group, seeks, node) of one bucket and several groups; two rows that do not seek are of one group."""
    return cells(rows, closeness, lambda whole, kept: lambda i, j, score: _ends(whole, i, j), "a long, b long").distinct()


def joining(rows: DataFrame, closeness: Closeness, inside: Inside) -> DataFrame:
    """(a, b): links among the pairs of ``all_close`` that join the same groups as all of them do.

    Two rows are looked at in the first bucket that both have.  Where that is not among these rows, the
    two are no close pair, or were verified before, or are of one group.  Of the links of a task, those
    between groups that the others join already are left out, and of pairs of such groups none is verified.
    """
    return cells(rows, closeness, _joins(inside.keys, inside.linked, inside.batch), "a long, b long", inside.own, inside.size)


def _joins(keys_of: Callable[[pa.Table], np.ndarray], linked_of: Callable[[pa.Table], Callable[[np.ndarray, np.ndarray], np.ndarray]], batch: int) -> Made:
    def of(whole: pa.Table, kept: dict[int, int]):
        keys, bucket, linked = keys_of(whole), whole.column("bucket").to_numpy(), linked_of(whole)
        # kept: of groups that links of this task joined, the one that each was joined to.
        names, group = np.unique(whole.column("group").to_numpy(), return_inverse=True)

        def top(x: int) -> int:
            end = x
            while end in kept:
                end = kept[end]
            while x != end:
                kept[x], x = end, kept[x]
            return end

        own = np.array([top(x) for x in names.tolist()], np.int64) if kept else names
        root = np.searchsorted(names, own)
        # A group that is not in this table stands for itself by the first of those joined to it.
        away = np.flatnonzero(names[np.minimum(root, len(names) - 1)] != own)
        _, one, at = np.unique(own[away], return_index=True, return_inverse=True)
        root[away] = away[one][at]

        def find(x: int) -> int:
            while root[x] != x:
                x = root[x]
            return x

        def made(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            first = (keys[i] == keys[j]).argmax(1)
            here = np.flatnonzero(keys[i, first] == bucket[i])
            here = here[np.argsort(-score[here], kind="stable")]
            out = []
            while len(here):
                here = here[root[group[i[here]]] != root[group[j[here]]]]
                some, here = here[:batch], here[batch:]
                if not len(some):
                    break
                hit = some[linked(i[some], j[some])]
                for k in hit.tolist():
                    a, b = find(group[i[k]]), find(group[j[k]])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        x, y = top(names[a].item()), top(names[b].item())
                        kept[max(x, y)] = min(x, y)
                        out.append(k)
                while len(hit) and (root[root] != root).any():
                    root[:] = root[root]
            return _ends(whole, i[out], j[out])

        return made

    return of


def cells(rows: DataFrame, closeness: Closeness, made: Made, schema: str, own: Callable[[DataFrame], DataFrame] | None = None, size: str = "0") -> DataFrame:
    """What ``made`` makes of the close pairs of ``all_close``, given a table and the places of both.

    Rows that seek are held against all of their bucket, in cells of some ``TILE`` rows on each side, fewer
    of large ``size``, so no bucket is ever gathered.  A bucket of one cell is dealt once.  own: further
    columns of nodes.
    """
    names = [c for c in rows.columns if c not in ("bucket", "seeks")]
    parts = lambda n, s: F.greatest(F.ceil(n / F.lit(TILE)), F.ceil(s / F.lit(LARGE))).cast("int")
    large = F.expr(size)
    sizes = rows.groupBy("bucket").agg(parts(F.count("*"), F.sum(large)).alias("of"), parts(F.count_if("seeks"), F.coalesce(F.sum(F.when(F.col("seeks"), large)), F.lit(0))).alias("by")).filter("by > 0")
    dealt = rows.join(sizes, "bucket")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = F.col("of") == 1
    # A row of a bucket of one cell may both ask and be held there.
    asks = dealt.filter(F.col("seeks") & ~whole).select("bucket", place(F.col("by")).alias("row"), each(F.col("of")).alias("column"), F.lit(True).alias("asks"), F.lit(False).alias("held"), "seeks", *names)
    held = dealt.select("bucket", each(F.col("by")).alias("row"), place(F.col("of")).alias("column"), (whole & F.col("seeks")).alias("asks"), F.lit(True).alias("held"), "seeks", *names)
    cell = ["bucket", "row", "column"]
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = asks.unionByName(held)
    if own:
        both = both.join(own(rows.select("node").distinct()), "node")
    both = both.repartition(count, *cell).sortWithinPartitions(*cell, F.desc("held"))
    return both.mapInArrow(_cells(closeness, made), schema)


def _cells(closeness: Closeness, made: Made) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by cell, those that are held first: what is made of the close pairs of a row that asks and one that is held, of two groups."""

    def pairs(whole: pa.Table, cell: np.ndarray, kept: dict) -> Iterator[pa.RecordBatch]:
        test, make = closeness(whole), made(whole, kept)
        asks, seeks, holds = (whole.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "seeks", "held"))
        node, group = (whole.column(c).to_numpy() for c in ("node", "group"))
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        held = np.add.reduceat(holds, heads, dtype=np.int64)
        left = np.flatnonzero(asks)
        at = np.searchsorted(heads, left, "right") - 1
        first, many = heads[at], held[at]
        ends = np.cumsum(many)
        s = 0
        while s < len(left):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + AT_ONCE, "right")))
            n = many[s:e]
            i = np.repeat(left[s:e], n)
            j = np.arange(len(i)) + np.repeat(first[s:e] - (np.cumsum(n) - n), n)
            hit = np.flatnonzero((group[i] != group[j]) & (~seeks[j] | (node[i] < node[j])))
            i, j = i[hit], j[hit]
            score = test(i, j)
            close = np.flatnonzero(score >= 0)
            if len(close):
                yield make(i[close], j[close], score[close])
            s = e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, kept = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            if tail is not None:
                whole = pa.concat_tables([tail, whole])
            whole = whole.combine_chunks()
            cell = _numbers(whole)
            # The last cell may go on in the next batch.
            last = int(np.searchsorted(cell, cell[-1]))
            if last:
                yield from pairs(whole.slice(0, last).combine_chunks(), cell[:last], kept)
            tail = whole.slice(last)
        if tail is not None:
            yield from pairs(tail.combine_chunks(), _numbers(tail), kept)

    return run


def _numbers(rows: pa.Table) -> np.ndarray:
    """Numbers of the cells of rows sorted by cell, from 0."""
    new = np.zeros(rows.num_rows, bool)
    for c in ("bucket", "row", "column"):
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def turn(sample: str, width: int, orders: int, to: str) -> Callable[[DataFrame], DataFrame]:
    """Makes of rows (bucket, ..., ``sample``, ...) ``orders`` of each, sorted first, in ``to``, by six bytes of the sample, which start elsewhere in each bucket and order."""

    def of(rows: DataFrame) -> DataFrame:
        each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("by"))
        start = F.pmod(F.col("bucket") + F.col("by") * F.lit(width // orders), F.lit(width)).cast("int")
        bytes_ = F.substring(F.concat(sample, sample), start + 1, F.lit(6))
        return each.withColumns({"bucket": F.xxhash64("bucket", "by"), to: F.conv(F.hex(bytes_), 16, 10).cast("long")}).select(*rows.columns)

    return of


def _mixed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of buckets that hold several groups, with their ``group``, and whether they are outside the bucket's largest one (``seeks``)."""
    named = rows.join(joined.select(F.col("vertex").alias("node"), "component"), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    groups = named.groupBy("bucket", "group").agg(F.count("*").alias("n"))
    mixed = groups.groupBy("bucket").agg(F.count("*").alias("n"), F.max_by("group", F.struct("n", "group")).alias("largest")).filter("n > 1").select("bucket", "largest")
    return named.join(mixed, "bucket").withColumn("seeks", F.col("group") != F.col("largest")).drop("largest")


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links between their vertices."""
    edges = joined.select(F.col("vertex").alias("a"), F.col("component").alias("b")).unionByName(links.select("a", "b"))
    return cut(components(cut(edges, "links"), "a", "b"), "joined")
