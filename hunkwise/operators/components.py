"""Weak components of a graph: in one task up to a bound of edges, beyond it by alternating star contractions.

Each round of contractions lets every vertex hang its larger neighbours on its smallest neighbour (large star), then
all of its smaller neighbours and itself on the smallest (small star).  The number of rounds grows
with the logarithm of the size; each is two aggregations and two joins on (vertex, neighbour) rows,
and no vertex's neighbours are ever gathered.  Rounds are cut by a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from hunkwise.session import cut, ship

#: Different edges that one task joins: 32 MB of numbers, or some 200 MB of short names.
SMALL = 1 << 21


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vertex, component) of all edges (v, m) together: every vertex takes its neighbours' least label, and then its label's, until none changes."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    kind = parts[0].schema.types[0]
    ends = [pa.chunked_array([b.column(k) for b in parts], kind).combine_chunks() for k in (0, 1)]
    names = pc.unique(pa.concat_arrays(ends))
    names = names.take(pc.sort_indices(names))
    v, m = (pc.index_in(x, names).to_numpy(zero_copy_only=False) for x in ends)
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[v], label[m])
        new = label.copy()
        # Labels are vertices too: lowering a label's own label joins whole groups.
        for at in (label[v], label[m], v, m):
            np.minimum.at(new, at, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], ["vertex", "component"])


def _forest(edges: DataFrame) -> bool:
    """Whether every vertex has one parent and no parent has a parent."""
    seen = edges.groupBy("v").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    return seen == 1 and edges.select("m").join(edges.select(F.col("v").alias("m")), "m", "left_semi").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component): all vertices with an edge to another and the smallest vertex of their component.

    Edges may repeat, go both ways or be loops; rows with nulls are ignored.  A vertex with loops only
    has no row.
    """
    e = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).filter("v is not null and m is not null and v <> m").distinct()
    e = cut(e, "edges")
    if e.count() <= SMALL:
        ship(e.sparkSession)
        kind = e.schema["v"].dataType.simpleString()
        return cut(e.coalesce(1).mapInArrow(_joined, f"vertex {kind}, component {kind}"), "components")
    while not _forest(e):
        both = e.unionByName(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min(F.least("v", "m")).alias("low"))
        large = both.join(low, "v").filter("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.when(F.col("m") == F.col("low"), F.col("v")).otherwise(F.col("m")).alias("v"), F.col("low").alias("m"))
        e = cut(small.distinct(), "edges", instead=e)
    return e.select(F.col("v").alias("vertex"), F.col("m").alias("component")).unionByName(e.select(F.col("m").alias("vertex"), F.col("m").alias("component")).distinct())
