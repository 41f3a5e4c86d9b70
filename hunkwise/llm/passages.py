"""Substring dedup: compact windows of token min-hashes, interval joins, verified passages.

Tokens are the hashes of a text's 5-word shingles.  For each of a few hash functions a text's Cartesian
tree (each token over the larger ones around it) groups its subsequences by their smallest token: the
token at c is the min-hash of exactly the subsequences [x, y] with left <= x <= c <= y <= right, a
compact window.  Only windows wide enough for the shortest passage count; their tokens are the minima
of a window of that width as it slides, and their bounds come from a table of minima over powers of
two, so a chunk of texts needs no loop over tokens.

Windows of several texts with the same min-hash at c are sorted by what stands beside c, and each is
joined to the one before it of another text: the two intervals, laid over each other at c, give a region
that both texts may share.  Hashes of the 4, 8, ... 45 tokens on a side, as one number, bring those
together that share the longest stretch on it.  There are four such orders: by what follows c and by
what precedes it, each among all windows of the min-hash and among those with the same 16 tokens on
the other side.  So two texts that share a passage meet however many others hold a part of it.  Two
windows are joined if ``BESIDE`` tokens or more are equal beside c, by the same hashes: a passage of the
shortest length and the similarity asked for has a run of twenty equal ones.

Windows that share a run of ``WHOLE`` tokens or more are copies of a passage; in one of the orders all
copies stand in a row, and each is joined to the one before it.  Windows that share less are of different
passages; two of each kind, told apart by 45 tokens on both sides, are joined to all others of their
min-hash with enough equal tokens beside c, wherever they stand in the orders (``_between``).

For classes and covered words (``joining_passages``) these last pairs are no rows: the windows go with
their tokens to cells, where every pair of them is verified unless both texts are of one group and cannot
have a word covered by it, and only passages that join groups or cover more words leave a task.

Regions of the same two texts that overlap are merged, and a merged region that enough hash functions
and orders support is verified: inside it, the longest stretches of at least the shortest passage whose
shingle sets have the required Jaccard similarity are passages.  (One support is enough, as every region
is verified.)

Equal texts are one text until the end, told apart by a 64-bit hash and by md5 where that is equal for
different ones; each copy then points to the first.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkwise.llm import links, textvec as tv
from hunkwise.operators.components import components
from hunkwise.session import cut

HASHES, ENOUGH = 4, 1
MIN_WORDS = 50
SIMILARITY = 0.8
BESIDE, WHOLE = 16, 46
#: Tokens beside c whose hashes, of six bits each, sort windows.
LEVELS = (4, 8, 12, 16, 20, 25, 30, 35, 40, 45)
#: Intervals end this far from c, or up to twice as far; longer runs are covered by several.
REACH = 1 << 12
GAP = 12
GRID = 32
HALF = (1 << 30) - 1
HASHES_MOST = 8


def windows(h: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """(place, left, right) of the compact windows of at least ``width`` tokens, in chunk places, bounds included.

    A window whose token equals that of the window before it, less than ``width`` behind, is left out.
    """
    n, docs = len(h), len(first) - 1
    if n < width:
        e = np.zeros(0, np.int64)
        return e, e, e
    # A wall of 0 stands before each text and after the last; equal hashes are ordered by place.
    places = np.arange(n) + np.repeat(np.arange(1, docs + 1), np.diff(first))
    size = n + docs + 1
    low = tv.U(max(1, size - 1).bit_length())
    x = np.zeros(size, tv.U)
    x[places] = (tv.mix(h ^ tv.U(seed)) >> low << low | places.astype(tv.U)) | tv.U(1) << tv.U(63)
    minima = [x]
    longest = min(int(np.diff(first).max()), REACH)
    while 2 << (len(minima) - 1) <= max(longest, width):
        m, s = minima[-1], 1 << (len(minima) - 1)
        up = m.copy()
        np.minimum(m[:-s], m[s:], out=up[:-s])
        up[-s:] = 0
        minima.append(up)
    p = width.bit_length() - 1
    slide = np.minimum(minima[p][: size - width + 1], minima[p][width - (1 << p) : size - (1 << p) + 1])
    slide = slide[slide > 0]
    new = np.ones(len(slide), bool)
    new[1:] = slide[1:] != slide[:-1]
    at = (slide[new] & ((tv.U(1) << low) - tv.U(1))).astype(np.int64)
    value = x[at]
    left, right = at.copy(), at.copy()
    for k in range(len(minima) - 1, -1, -1):
        s, m = 1 << k, minima[k]
        go = np.where(left >= s, m[np.maximum(left - s, 0)], 0) > value
        left = np.where(go, left - s, left)
        go = np.where(right + s < size, m[np.minimum(right + 1, size - 1)], 0) > value
        right = np.where(go, right + s, right)
    doc = np.searchsorted(first + np.arange(docs + 1), at, "right") - 1
    # In text that goes round, the first of equal tokens has the widest window; those close behind add nothing.
    again = (value[1:] >> low == value[:-1] >> low) & (doc[1:] == doc[:-1]) & (np.diff(at) < width)
    keep = np.append(True, ~again) if len(at) else np.zeros(0, bool)
    back = doc[keep] + 1
    return at[keep] - back, left[keep] - back, right[keep] - back


def _shingles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, rows' offsets, hashes of full shingles) by chunk."""
    for i, _, buf, at in tv.chunks(texts):
        w = tv.Words(buf, at)
        k, h = w.windows(tv.SHINGLE)
        yield i, np.searchsorted(w.doc[k], np.arange(len(at))), h


def _beside(h: np.ndarray, first: np.ndarray, doc: np.ndarray, c: np.ndarray) -> list[np.ndarray]:
    """Hashes of the tokens before and at c, and of those at and after it, 32 bits each in one number; then the sort numbers of what precedes and of what follows c."""
    sums = np.zeros(len(h) + 1, tv.U)
    np.cumsum(h * tv.powers(tv.R, len(h)), out=sums[1:])
    before = lambda n: tv.span_hash(sums, np.maximum(first[doc], c - n), c + 1)
    after = lambda n: tv.span_hash(sums, c, np.minimum(first[doc + 1], c + n + 1))
    out = [(before(BESIDE) >> tv.U(32)) << tv.U(32) | after(BESIDE) >> tv.U(32)]
    for side in (before, after):
        number = np.zeros(len(c), tv.U)
        for n in LEVELS:
            number = number << tv.U(6) | side(n) >> tv.U(58)
        out.append(number)
    return [x.astype(np.int64) for x in out]


def _windows(b: pa.RecordBatch, seeds: list[int], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """By chunk and hash function of a batch (tid, text): its number, the windows' keys, texts' ids, c, left and right, and the chunk's tokens, offsets and rows."""
    tids = b.column(0).to_numpy(zero_copy_only=False)
    for i, first, h in _shingles(b.column(1)):
        for k, seed in enumerate(seeds):
            c, l, r = windows(h, first, width, seed)
            if len(c):
                doc = np.searchsorted(first, c, "right") - 1
                yield k, tv.mix(h[c] + tv.U(seed)).astype(np.int64), tids[i + doc], c, l, r, h, first, doc


def window_rows(docs: DataFrame, hashes: int, width: int) -> DataFrame:
    """(h, tid, c, ext, beside, preceding, following): the wide windows whose min-hash several texts have, and few others.

    ext holds the hash function's number, and how far the window reaches left and right of c.  The
    texts are gone through twice, so that only these windows are shuffled.
    """
    seeds = [int(s) for s in tv.seeds(hashes, 99)]
    keys = lambda b: ((key, tid) for _, key, tid, *_ in _windows(b, seeds, width))
    narrow = docs.select("tid", "text")
    about = narrow.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] * hashes // (4 * width)
    several = docs.sparkSession.sparkContext.broadcast(tv.bit_map(tv.repeated(narrow, keys, about), "hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, key, tid, c, l, r, h, first, doc in _windows(b, seeds, width):
                hit = np.flatnonzero(tv.in_map(several.value, key))
                if len(hit):
                    key, tid, c, l, r, doc = (x[hit] for x in (key, tid, c, l, r, doc))
                    ext = (k << 60) + (np.minimum(c - l, HALF) << 30) + np.minimum(r - c, HALF)
                    cols = [key, tid, (c - first[doc]).astype(np.int32), ext, *_beside(h, first, doc, c)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "tid", "c", "ext", "beside", "preceding", "following"])

    return narrow.mapInArrow(run, "h long, tid long, c int, ext long, beside long, preceding long, following long")


ORDER = ["g", "o", "tid", "c", "ext", "k", "p"]
PAIR = ["tid", "c", "ext", "k", "l_tid", "l_c", "l_ext"]
_KINDS = {"c": "int", "l_c": "int", "k": "int"}


def _equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens at least are equal on a side, by sort numbers of it."""
    out, same = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for k, n in enumerate(LEVELS):
        same &= (x ^ y).view(tv.U) >> tv.U(6 * (len(LEVELS) - 1 - k)) == 0
        out[same] = n
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (``ORDER``) sorted so: each with the last row of another text before it in its group g, if enough beside c is equal; rows at the partition's borders, with no partner."""
    tail, head = None, None
    empty = lambda n: [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]

    def edge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [t.column(c).combine_chunks() for c in ORDER]
        if t.num_rows:
            yield pa.RecordBatch.from_arrays([*cols, *empty(t.num_rows)], [*ORDER, "l_tid", "l_c", "l_ext"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        skip = tail.num_rows if tail is not None else 0
        whole = pa.concat_tables([tail, part]).combine_chunks() if skip else part.combine_chunks()
        g, tid = (whole.column(c).to_numpy() for c in ("g", "tid"))
        n, at = len(g), np.arange(len(g))
        new = np.append(True, (g[1:] != g[:-1]) | (tid[1:] != tid[:-1]))
        start = np.maximum.accumulate(np.where(new, at, 0))
        other = np.where((start > 0) & (g[np.maximum(start - 1, 0)] == g), start - 1, -1)
        hit = np.flatnonzero((other >= 0) & (at >= skip))
        o, p = (whole.column(c).to_numpy() for c in ("o", "p"))
        hit = hit[_equal(o[hit], o[other[hit]]) + _equal(p[hit], p[other[hit]]) >= BESIDE]
        if len(hit):
            a, b = whole.take(pa.array(hit)), whole.take(pa.array(other[hit]))
            cols = [*(a.column(c).combine_chunks() if c in PAIR else pa.nulls(len(hit), pa.int64()) for c in ORDER), *(b.column(c).combine_chunks() for c in ("tid", "c", "ext"))]
            yield pa.RecordBatch.from_arrays(cols, [*ORDER, "l_tid", "l_c", "l_ext"])
        if head is None:
            head = (g[skip], tid[skip])
        if head:
            # The first text's rows lack a partner that may stand in the partition before.
            differs = (g[skip:] != head[0]) | (tid[skip:] != head[1])
            yield from edge(whole.slice(skip, int(np.argmax(differs)) if differs.any() else n - skip))
            head = () if differs.any() else head
        tail = whole.take(pa.array([*([int(other[-1])] if other[-1] >= 0 else []), n - 1]))
    if tail is not None:
        yield from edge(tail)


def _neighbours(rows: DataFrame) -> DataFrame:
    """Windows (``PAIR``) joined to the one of another text before them, in each of the four orders."""
    before, after = F.shiftright("beside", 32), F.col("beside").bitwiseAND(0xFFFFFFFF)
    k = F.shiftright("ext", 60).cast("int")
    sides = ("following", "preceding")
    ways = [(F.xxhash64("h", F.lit(0)), *sides), (F.xxhash64("h", F.lit(1), before), *sides), (F.xxhash64("h", F.lit(2)), *sides[::-1]), (F.xxhash64("h", F.lit(3), after), *sides[::-1])]
    each = F.array(*[F.struct(g.alias("g"), F.col(o).alias("o"), (k + HASHES_MOST * i).alias("k"), F.col(p).alias("p")) for i, (g, o, p) in enumerate(ways)])
    dealt = rows.select("tid", "c", "ext", F.explode(each).alias("w")).select("w.g", "w.o", "tid", "c", "ext", "w.k", "w.p")
    schema = ", ".join(f"{c} {_KINDS.get(c, 'long')}" for c in (*ORDER, "l_tid", "l_c", "l_ext"))
    found = cut(dealt.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_scan, schema), "beside")
    edge = found.filter("l_tid is null").select(*ORDER).distinct().repartition("g").sortWithinPartitions(*ORDER).mapInArrow(_scan, schema)
    return found.filter("l_tid is not null").select(*PAIR).unionByName(edge.filter("l_tid is not null").select(*PAIR))


def _kin(rows: pa.Table):
    """Close are windows with enough equal tokens beside c that are not copies in a row of ``_neighbours``."""
    before, after = (rows.column(c).to_numpy() for c in ("preceding", "following"))
    #: More than half of enough: a side has to have it.
    half = 6 * (len(LEVELS) - LEVELS.index(BESIDE // 2) - 1)

    def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.full(len(i), -1)
        some = np.flatnonzero(((before[i] ^ before[j]) >> half == 0) | ((after[i] ^ after[j]) >> half == 0))
        i, j = i[some], j[some]
        x, y = _equal(before[i], before[j]), _equal(after[i], after[j])
        least, most = np.minimum(x, y), np.maximum(x, y)
        # Rows stand by one side, or by it among those with the same BESIDE tokens on the other.
        copies = (most + 1 >= WHOLE) | ((least >= BESIDE) & (most + BESIDE + 1 >= WHOLE))
        out[some] = np.where((x + y >= BESIDE) & ~copies, 0, -1)
        return out

    return test


def _kinds(rows: DataFrame) -> DataFrame:
    """Windows of min-hashes that stand for different passages, as rows of ``links.cells``: two, of two texts if there are two, for all with the same 45 tokens on both sides.

    One alone may be of the same text as those it would be joined to.
    """
    one = F.struct("tid", "c", "ext")
    kinds = rows.groupBy("h", "preceding", "following").agg(F.array_distinct(F.array(F.min(one), F.max(one))).alias("w"))
    kinds = kinds.select("h", "preceding", "following", F.explode("w").alias("w")).select("h", "preceding", "following", "w.*")
    # The one pair of two windows stands in every order.
    several = kinds.groupBy("h").agg(F.count("*").alias("n")).filter("n > 2").select("h")
    kinds = cut(kinds.join(several, "h"), "kinds")
    return kinds.select(F.col("h").alias("bucket"), "preceding", "following", "tid", "c", "ext", F.col("tid").alias("group"), F.lit(True).alias("seeks"), F.xxhash64("tid", "c", "h").alias("node"))


def _between(rows: DataFrame) -> DataFrame:
    """Windows (``PAIR``) of different passages joined to all others of their min-hash with enough equal tokens beside c."""

    def pair(whole: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        a, b = (whole.select(["tid", "c", "ext"]).take(pa.array(x)).combine_chunks() for x in (i, j))
        k = (a.column("ext").to_numpy() >> 60) + 4 * HASHES_MOST
        return pa.RecordBatch.from_arrays([*(a.column(c).combine_chunks() for c in ("tid", "c", "ext")), pa.array(k.astype(np.int32)), *(b.column(c).combine_chunks() for c in ("tid", "c", "ext"))], PAIR)

    return links.cells(_kinds(rows), _kin, lambda whole, kept: lambda i, j, score: pair(whole, i, j), ", ".join(f"{c} {_KINDS.get(c, 'long')}" for c in PAIR))


def _kin_within(width: int) -> links.Closeness:
    """``_kin``, of windows whose common reach is wide enough."""

    def of(rows: pa.Table):
        kin, ext = _kin(rows), rows.column("ext").to_numpy()
        left, right = ext >> 30 & HALF, ext & HALF

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            out = np.full(len(i), -1)
            some = np.flatnonzero(np.minimum(left[i], left[j]) + np.minimum(right[i], right[j]) + 1 >= width)
            out[some] = kin(i[some], j[some])
            return out

        return test

    return of


def _partners(whole: pa.Table, kept: dict):
    """The windows that have a close one, each once a task."""
    node = whole.column("node").to_numpy()
    done = np.array([x in kept for x in node.tolist()], bool)

    def made(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        new = np.unique(np.concatenate([i, j]))
        new = np.unique(node[new[~done[new]]])
        kept.update(dict.fromkeys(new.tolist()))
        done[np.isin(node, new)] = True
        return pa.RecordBatch.from_arrays([pa.array(new)], ["node"])

    return made


def _runs(docs: DataFrame, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(node, start, run, covered) of windows (node, tid, c, ext): the tokens in reach, 32 bits each, from start on, and the spans of these that passages cover."""
    span = lambda s, e: F.struct(F.col(s).alias("s"), F.col(e).alias("e"))
    spans = found.select("tid", span("a0", "a1").alias("x")).unionByName(found.select(F.col("lead").alias("tid"), span("b0", "b1").alias("x"))).distinct()
    spans = _islands(spans.select("tid", "x.s", "x.e")).groupBy("tid").agg(F.array_sort(F.collect_list(span("s", "e"))).alias("spans"))
    s = F.greatest(F.col("c") - F.shiftright("ext", 30).bitwiseAND(HALF), F.lit(0))
    e = F.col("c") + F.col("ext").bitwiseAND(HALF)
    grid = lambda x: F.floor(x / F.lit(GRID)) * GRID
    asked = wanted.groupBy("tid").agg(F.collect_list(F.struct("node", grid(s).alias("s"), (grid(e) + (GRID - 1)).alias("e"))).alias("asked"))
    texts = docs.join(asked, "tid").groupBy("tid").agg(F.first("text").alias("text"), F.first("asked").alias("asked")).join(spans, "tid", "left").select("text", "asked", "spans")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, first, h in _shingles(b.column(0)):
                h = (h >> tv.U(32)).astype(np.uint32)
                for d in range(len(first) - 1):
                    own, asked, spans = h[first[d] : first[d + 1]], b.column(1)[i + d].values, b.column(2)[i + d].values
                    node, s, e = (asked.field(c).to_numpy() for c in ("node", "s", "e"))
                    x, y = (spans.field(c).to_numpy() for c in ("s", "e")) if spans is not None else (np.zeros(0, np.int64),) * 2
                    # Spans are apart and in order.
                    some = [slice(int(np.searchsorted(y, u)), int(np.searchsorted(x, v, "right"))) for u, v in zip(s, e)]
                    cover = [np.stack([x[k], y[k]]).T.astype(np.int32).tobytes() for k in some]
                    cols = [pa.array(node), pa.array(s), pa.array([own[u : v + 1].tobytes() for u, v in zip(s, e)], pa.binary()), pa.array(cover, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "start", "run", "covered"])

    return cut(texts.mapInArrow(pick, "node long, start long, run binary, covered binary"), "runs")


def _islands(spans: DataFrame) -> DataFrame:
    """(tid, s, e) of spans with their ends: those that overlap or touch are one."""
    run = Window.partitionBy("tid").orderBy("s", "e")
    apart = F.coalesce(F.col("s") > F.max("e").over(run.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    named = spans.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("tid", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


class _Cover:
    """Rows' runs of tokens, and which of these passages cover."""

    def __init__(self, rows: pa.Table, spans: dict[int, list[tuple[int, int]]]):
        self.tid, self.start = (rows.column(c).to_numpy() for c in ("tid", "start"))
        runs = [np.frombuffer(x, np.uint32) for x in rows.column("run").to_pylist()]
        self.at = np.zeros(len(runs) + 1, np.int64)
        np.cumsum([len(x) for x in runs], out=self.at[1:])
        self.tokens = np.concatenate(runs) if runs else np.zeros(0, np.uint32)
        names, self.token = np.unique(self.tokens, return_inverse=True)
        self.covered = np.zeros(len(self.token), bool)
        self.rows_of: dict[int, list[int]] = {}
        for k, (t, x) in enumerate(zip(self.tid.tolist(), rows.column("covered").to_pylist())):
            self.rows_of.setdefault(t, []).append(k)
            for s, e in np.frombuffer(x, np.int32).reshape(-1, 2).tolist():
                self._cover(k, s, e)
        for t in self.rows_of.keys() & spans.keys():
            for k in self.rows_of[t]:
                for s, e in spans[t]:
                    self._cover(k, s, e)
        # Tokens of one text only are in no passage, but between tokens that are.
        owner = np.repeat(self.tid, np.diff(self.at))
        by = np.argsort(self.token, kind="stable")
        heads = np.searchsorted(self.token[by], np.arange(len(names)))
        self.shared = (np.minimum.reduceat(owner[by], heads) != np.maximum.reduceat(owner[by], heads))[self.token] if len(by) else self.covered
        self.mark, self.slot = np.zeros(len(names), np.int8), np.zeros(len(names), np.int64)
        self.open = np.zeros(len(self.token), bool)
        # Rows where no token stands twice.
        pairs = np.sort(np.repeat(np.arange(len(runs)), np.diff(self.at)) * max(1, len(names)) + self.token)
        self.once = np.ones(len(runs), bool)
        self.once[pairs[1:][pairs[1:] == pairs[:-1]] // max(1, len(names))] = False
        self.hungry, self.gap = np.zeros(len(runs), bool), np.zeros(len(runs), bool)
        for k in range(len(runs)):
            self._look(k)

    def _cover(self, k: int, s: int, e: int) -> bool:
        a, b = max(s - int(self.start[k]), 0) + self.at[k], min(int(self.at[k] + e + 1 - self.start[k]), int(self.at[k + 1]))
        if a >= b or self.covered[a:b].all():
            return False
        self.covered[a:b] = True
        return True

    def _look(self, k: int) -> None:
        s, e = self.at[k], self.at[k + 1]
        covered = self.covered[s:e]
        self.open[s:e] = self.shared[s:e] & ~covered
        jumps = np.diff(np.flatnonzero(covered))
        self.gap[k] = bool(((jumps > 1) & (jumps <= GAP)).any())
        self.hungry[k] = self.gap[k] or bool(self.open[s:e].any())

    def add(self, t: int, s: int, e: int) -> None:
        """Text t has a passage."""
        for k in self.rows_of[t]:
            if self._cover(k, s, e):
                self._look(k)

    def whole(self, k: int, s: int, e: int) -> bool:
        """Whether passages cover places s to e of row k."""
        return bool(self.covered[self.at[k] + s : self.at[k] + e + 1].all())

    def run(self, k: int) -> np.ndarray:
        return self.tokens[self.at[k] : self.at[k + 1]]

    def _held(self, i: int, js: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of rows js one after the other, where each row ends there, and whether row i holds the token (1), open there (3)."""
        s, e = self.at[i], self.at[i + 1]
        n = self.at[js + 1] - self.at[js]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(js) else 0) + np.repeat(self.at[js] - (ends - n), n)
        self.mark[self.token[s:e]] = 1
        self.mark[self.token[s:e][self.open[s:e]]] = 3
        held = self.mark[self.token[at]]
        self.mark[self.token[s:e]] = 0
        return at, ends, held

    def common(self, i: int, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many places of rows js hold tokens of row i, and whether one of these, of either side, is open."""
        at, ends, held = self._held(i, js)
        sums = np.zeros((2, len(at) + 1), np.int64)
        np.cumsum(held > 0, out=sums[0, 1:])
        np.cumsum((held > 1) | ((held > 0) & self.open[at]), out=sums[1, 1:])
        many, fresh = np.diff(sums[:, np.append(0, ends)])
        return many, fresh > 0

    def matches(self, i: int, js: np.ndarray, width: int, threshold: float) -> tuple[np.ndarray, ...]:
        """``match`` of each of rows js and row i, all without a token that stands twice: (place in js, and its columns)."""
        at, ends, held = self._held(i, js)
        row, hit = np.repeat(np.arange(len(js)), np.diff(ends, prepend=0)), np.flatnonzero(held)
        self.slot[self.token[self.at[i] : self.at[i + 1]]] = np.arange(self.at[i + 1] - self.at[i])
        row, own, to = row[hit], at[hit] - self.at[js][row[hit]], self.slot[self.token[at[hit]]]
        jump = np.append(np.abs(np.diff(own)) + np.abs(np.diff(to) - 1), 0)
        s = np.flatnonzero(np.append(True, (np.diff(own) > GAP) | (np.diff(row) > 0))) if len(hit) else hit
        e = np.append(s[1:], len(hit)) if len(hit) else hit
        ends_to, out = np.append(to, 0), []
        over = lambda f, x, s, e: f.reduceat(x, np.stack([s, e], 1).reshape(-1))[::2]
        while len(s):
            wide = own[e - 1] - own[s] + 1 >= width
            s, e = s[wide], e[wide]
            if not len(s):
                break
            a0, a1, b0, b1 = own[s], own[e - 1], over(np.minimum, ends_to, s, e), over(np.maximum, ends_to, s, e)
            sim = (e - s) / ((a1 - a0 + 1) + (b1 - b0 + 1) - (e - s))
            good = (b1 - b0 + 1 >= width) & (sim >= threshold)
            out.append([x[good] for x in (row[s], a0, a1, b0, b1, sim)])
            s, e = s[~good], e[~good]
            s, e = s[e - s > 1], e[e - s > 1]
            if not len(s):
                break
            # Part at the first of the widest gaps.
            n = e - 1 - s
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) + np.repeat(s - (np.cumsum(n) - n), n)
            most = over(np.maximum, jump, s, e - 1)
            _, first = np.unique(of[jump[k] == most[of]], return_index=True)
            m = k[jump[k] == most[of]][first] + 1
            part = most > 1
            s, e = np.concatenate([s[part], m[part]]), np.concatenate([m[part], e[part]])
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 6


def _adding(width: int, threshold: float) -> links.Made:
    """Passages (``FOUND``) of close windows that join groups of texts or cover more words of one.

    Two windows of one group are left out only where no passage of theirs can cover a word more: where
    all tokens that both have are covered, and no gap that a passage may cross lies between these.
    """

    def of(whole: pa.Table, kept: dict):
        spans, above = kept.setdefault("spans", {}), kept.setdefault("above", {})
        cover, joined = _Cover(whole, spans), whole.column("joined").to_numpy()
        names, group = np.unique(joined, return_inverse=True)

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        tops = np.array([top(x) for x in names.tolist()], np.int64)

        def made(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
            out: list[tuple] = []
            by = np.argsort(i, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(i[by]) > 0))
            for x, js in zip(i[by][heads].tolist(), np.split(j[by], heads[1:])):
                _one(x, js, out)
            cols = list(zip(*out)) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.float64())], FOUND)

        def _one(x: int, js: np.ndarray, out: list[tuple]) -> None:
            apart = tops[group[js]] != tops[group[x]]
            some = apart | cover.hungry[x] | cover.hungry[js]
            js, apart = js[some], apart[some]
            size = np.cumsum(cover.at[js + 1] - cover.at[js]) >> 20
            for at in np.split(np.arange(len(js)), np.flatnonzero(np.diff(size)) + 1):
                many, fresh = cover.common(x, js[at])
                ys = js[at][(many >= width * threshold) & (apart[at] | fresh | cover.gap[x] | cover.gap[js[at]])]
                once = cover.once[ys] & cover.once[x]
                k, *passages = cover.matches(x, ys[once], width, threshold)
                for y, *passage in zip(ys[once][k].tolist(), *(c.tolist() for c in passages)):
                    _add(x, y, passage, out)
                for y in ys[~once].tolist():
                    if tops[group[y]] != tops[group[x]] or cover.hungry[x] or cover.hungry[y]:
                        for passage in match(cover.run(y), cover.run(x), width, threshold):
                            _add(x, y, passage, out)

        def _add(x: int, y: int, passage: list, out: list[tuple]) -> None:
            p, q = sorted((int(tops[group[x]]), int(tops[group[y]])))
            a0, a1, b0, b1, sim = passage
            if p == q and cover.whole(y, a0, a1) and cover.whole(x, b0, b1):
                return
            t, u = int(cover.tid[y]), int(cover.tid[x])
            (a0, a1), (b0, b1) = ((int(s + cover.start[k]), int(e + cover.start[k])) for k, s, e in ((y, a0, a1), (x, b0, b1)))
            cover.add(t, a0, a1)
            cover.add(u, b0, b1)
            spans.setdefault(t, []).append((a0, a1))
            spans.setdefault(u, []).append((b0, b1))
            out.append((t, u, a0, a1, b0, b1, sim) if t < u else (u, t, b0, b1, a0, a1, sim))
            if p != q:
                above[q] = p
                tops[tops == q] = p

        return made

    return of


FOUND = ["tid", "lead", "a0", "a1", "b0", "b1", "similarity"]


def _joining(docs: DataFrame, rows: DataFrame, found: DataFrame, width: int, threshold: float) -> DataFrame:
    """(``FOUND``): of the passages of all windows of ``_between``, those that join groups of texts that others do not join, or cover words that others do not.

    found: passages that are known.  Windows are held against each other in cells, first by the hashes
    beside c; those that have a close one then go with their tokens, and are verified in the cell.
    """
    joined = components(found.select("tid", "lead"), "tid", "lead").select(F.col("vertex").alias("tid"), "component")
    kinds = _kinds(rows)
    close = _kin_within(width)
    wanted = cut(links.cells(kinds, close, _partners, "node long").distinct(), "wanted")
    kinds = kinds.join(wanted, "node").join(joined, "tid", "left").withColumn("joined", F.coalesce("component", "tid")).drop("component")
    kinds = cut(kinds, "wanted-kinds")
    runs = _runs(docs, kinds.select("node", "tid", "c", "ext").distinct(), found)
    size = f"4 * ((shiftright(ext, 30) & {HALF}) + (ext & {HALF}) + {2 * GRID})"
    schema = ", ".join(f"{c} long" for c in FOUND[:-1]) + ", similarity double"
    return links.cells(kinds, close, _adding(width, threshold), schema, lambda nodes: runs, size)


def _regions(hits: DataFrame, width: int, enough: int) -> DataFrame:
    """Merged regions (tid, lead, a0, a1, b0, b1) of windows and those they are joined to (``PAIR``)."""
    reach = lambda e: (F.shiftright(e, 30).bitwiseAND(HALF), e.bitwiseAND(HALF))
    (al, ar), (bl, br) = reach(F.col("ext")), reach(F.col("l_ext"))
    # Each pair of texts in one direction.
    turned = F.col("tid") > F.col("l_tid")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    ends = [pick("tid", "l_tid", "tid"), pick("l_tid", "tid", "lead"), pick("c", "l_c", "c"), pick("l_c", "c", "lc")]
    hits = hits.select(*ends, "k", F.least(al, bl).alias("left"), F.least(ar, br).alias("right"))
    hits = hits.filter(F.col("left") + F.col("right") + 1 >= width)
    run = Window.partitionBy("tid", "lead").orderBy("a0", "a1", "k")
    spans = hits.select("tid", "lead", "k", (F.col("c") - F.col("left")).alias("a0"), (F.col("c") + F.col("right")).alias("a1"), (F.col("lc") - F.col("left")).alias("b0"), (F.col("lc") + F.col("right")).alias("b1"))
    apart = F.coalesce(F.col("a0") + (width - 1) > F.max("a1").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("new", apart.cast("int")).withColumn("island", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    found = spans.groupBy("tid", "lead", "island").agg(F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1"), F.bit_or(F.expr("shiftleft(1L, k)")).alias("ks"))
    # Bounds on a grid: how many regions of one text are asked for depends on its length, not on its partners.
    down, up = lambda c: F.expr(f"({c} div {GRID}) * {GRID}").alias(c), lambda c: F.expr(f"({c} div {GRID}) * {GRID} + {GRID - 1}").alias(c)
    found = found.filter(F.bit_count("ks") >= enough).select("tid", "lead", down("a0"), up("a1"), down("b0"), up("b1"))
    return found.distinct()


def _follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of a's tokens, all of which b has, a place in b: the next one if it fits, else the first after the last place, else the first."""
    places: dict[int, list[int]] = {}
    own = b.tolist()
    for j, x in enumerate(own):
        places.setdefault(x, []).append(j)
    out, last = [], -1
    for x in a.tolist():
        if last + 1 < len(own) and own[last + 1] == x:
            last += 1
        else:
            at = places[x]
            k = bisect.bisect_right(at, last)
            last = at[k] if k < len(at) else at[0]
        out.append(last)
    return np.array(out, np.int64)


def match(a: np.ndarray, b: np.ndarray, width: int, threshold: float) -> list[tuple[int, int, int, int, float]]:
    """Passages of two token runs: (a's first, a's last, b's first, b's last, Jaccard similarity)."""
    own, places = a.tolist(), {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, j)
    at = np.array([places.get(x, -1) for x in own], np.int64)
    hit = np.flatnonzero(at >= 0)
    if len(hit) < width * threshold:
        return []
    to = at[hit] if len(places) == len(b) else _follow(a[hit], b)
    #: Where no token stands twice, the hits are the common ones.
    once = len(places) == len(b) and len(set(own)) == len(own)
    out, todo = [], []
    breaks = np.flatnonzero(np.diff(hit) > GAP) + 1
    for s, e in zip([0, *breaks.tolist()], [*breaks.tolist(), len(hit)]):
        todo.append((s, e))
    while todo:
        s, e = todo.pop()
        a0, a1 = int(hit[s]), int(hit[e - 1])
        if a1 - a0 + 1 < width:
            continue
        b0, b1 = int(to[s:e].min()), int(to[s:e].max())
        if b1 - b0 + 1 >= width:
            if once:
                x, y, common = a1 - a0 + 1, b1 - b0 + 1, e - s
            else:
                u, v = np.unique(a[a0 : a1 + 1]), np.unique(b[b0 : b1 + 1])
                x, y, common = len(u), len(v), len(np.intersect1d(u, v, assume_unique=True))
            sim = common / (x + y - common)
            if sim >= threshold:
                out.append((a0, a1, b0, b1, sim))
                continue
        # Part at the widest gap, of the text or of the other's places.
        jump = np.abs(np.diff(hit[s:e])) + np.abs(np.diff(to[s:e]) - 1)
        if len(jump) and jump.max() > 1:
            m = s + int(jump.argmax()) + 1
            todo += [(s, m), (m, e)]
    return out


def _verified(docs: DataFrame, regions: DataFrame, width: int, threshold: float) -> DataFrame:
    """(tid, lead, a0, a1, b0, b1, similarity): passages in the regions, bounds as tokens of the texts.

    Tokens are compared by 32 bits: of some 10^5 pairs of runs, one has a token too many in common.
    """
    asked = regions.select("tid", F.struct(F.col("a0").alias("s"), F.col("a1").alias("e")).alias("r")).unionByName(regions.select(F.col("lead").alias("tid"), F.struct(F.col("b0").alias("s"), F.col("b1").alias("e")).alias("r")))
    asked = asked.distinct().groupBy("tid").agg(F.collect_list("r").alias("asked"))
    texts = docs.groupBy("tid").agg(F.first("text").alias("text")).join(asked, "tid")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tids, asked = b.column(0).to_pylist(), b.column(2)
            for i, first, h in _shingles(b.column(1)):
                rows = []
                h = (h >> tv.U(32)).astype(np.uint32)
                for d in range(len(first) - 1):
                    own = h[first[d] : first[d + 1]]
                    rows += [(tids[i + d], q["s"], q["e"], own[q["s"] : q["e"] + 1].tobytes()) for q in asked[i + d].as_py()]
                cols = list(zip(*rows)) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["t", "s", "e", "run"])

    runs = cut(texts.select("tid", "text", "asked").mapInArrow(pick, "t long, s long, e long, run binary"), "runs")
    both = regions.join(runs.select(F.col("t").alias("tid"), F.col("s").alias("a0"), F.col("e").alias("a1"), F.col("run").alias("ra")), ["tid", "a0", "a1"])
    both = both.join(runs.select(F.col("t").alias("lead"), F.col("s").alias("b0"), F.col("e").alias("b1"), F.col("run").alias("rb")), ["lead", "b0", "b1"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tid, lead, a0, b0, ra, rb in zip(*(c.to_pylist() for c in b.columns)):
                x, y = np.frombuffer(ra, np.uint32), np.frombuffer(rb, np.uint32)
                if len(x) and len(y):
                    rows += [(tid, lead, a0 + p, a0 + q, b0 + u, b0 + v, sim) for p, q, u, v, sim in match(x, y, width, threshold)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(cols[6], pa.float64())], ["tid", "lead", "a0", "a1", "b0", "b1", "similarity"])

    return both.select("tid", "lead", "a0", "b0", "ra", "rb").mapInArrow(verify, "tid long, lead long, a0 long, a1 long, b0 long, b1 long, similarity double")


def passage_links(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = SIMILARITY, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """(tid, lead, a0, a1, b0, b1, similarity): passages that two different texts of (tid, text) share, by tokens.

    A token's number is that of its first word; a passage of tokens a0 to a1 has words a0 to a1 + 4.
    """
    width = min_words - tv.SHINGLE + 1
    shared = cut(window_rows(docs, hashes, width).distinct(), "windows")
    hits = _neighbours(shared).unionByName(_between(shared))
    return cut(_verified(docs, cut(_regions(hits, width, enough), "regions"), width, threshold), "passages")


def joining_passages(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = SIMILARITY, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """Of ``passage_links``, as many as join the same texts and cover the same words, not every pair of a group.

    Where a region takes more than one hash function or order (``enough``), the two are the same.
    """
    if enough > 1:
        return passage_links(docs, min_words, threshold, hashes, enough)
    width = min_words - tv.SHINGLE + 1
    shared = cut(window_rows(docs, hashes, width).distinct(), "windows")
    found = cut(_verified(docs, cut(_regions(_neighbours(shared), width, enough), "regions"), width, threshold), "passages")
    return found.unionByName(cut(_joining(docs, shared, found, width, threshold), "passages"))


def text_ids(docs: DataFrame, short: Column | None = None) -> DataFrame:
    """doc_id, tid, text of documents, null texts as empty: a 64-bit number for each different text.

    The number is a hash (``short``); texts that differ and share it get others, made from their md5,
    until none does.  Such texts are few enough to be named in a query: of n texts, n * n / 2**65.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.md5(text.cast("binary"))
    tid = F.xxhash64(text) if short is None else short
    for turn in itertools.count():
        ids = cut(docs.select(tid.alias("tid"), key.alias("key")).distinct(), "text-ids")
        clash = ids.groupBy("tid").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("tid")
        found = [r["key"] for r in ids.join(clash, "tid").select("key").collect()]
        if not found:
            return docs.select("doc_id", tid.alias("tid"), text.alias("text"))
        tid = F.when(key.isin(found), F.xxhash64(F.lit(turn), key)).otherwise(tid)


def _found(docs: DataFrame, links_of: Callable[..., DataFrame], settings: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages (``links_of``) of the documents' texts; the documents (doc_id, tid, n: words); by tid the least and the largest id, how many documents there are and n."""
    keyed = text_ids(docs.select("doc_id", "text"))
    found = links_of(keyed.select("tid", "text"), **settings)
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    owners = cut(keyed.select("doc_id", "tid", n_words.cast("long").alias("n")), "owners")
    first = owners.groupBy("tid").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), F.count("*").alias("many"), F.max("n").alias("n"))
    return found, owners, cut(first, "firsts")


def passage_classes(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, text_id, class_id, n_verified, passages): a row for each document that shares a passage with another one.

    text_id: least id among the documents with the same text.  class_id: least id among all documents
    that shared passages, or equal texts, join.  n_verified: with how many other texts a shared passage
    was verified that joined groups or covered more words; more may hold it, and how many are counted depends
    on how rows are dealt to tasks.  passages: the words
    that any of these passages covers, as (start, end) without the end, in order; of a text that several documents
    have, all words.  Which documents have a row, and ids, as in ``repeated_passages``.
    """
    found, owners, first = _found(docs, joining_passages, settings)
    joined = cut(components(cut(found.select("tid", "lead").distinct(), "text-links"), "tid", "lead"), "joined")
    span = lambda s, e: F.struct(F.col(s).alias("s"), (F.col(e) + tv.SHINGLE).alias("e"))
    each = found.select("tid", F.col("lead").alias("other"), span("a0", "a1").alias("span")).unionByName(found.select(F.col("lead").alias("tid"), F.col("tid").alias("other"), span("b0", "b1").alias("span")))
    links_of = each.select("tid", "other").distinct().groupBy("tid").agg(F.count("*").alias("n_verified"))
    # Spans that overlap or touch are one.
    run = Window.partitionBy("tid").orderBy("span.s", "span.e")
    apart = F.coalesce(F.col("span.s") > F.max("span.e").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = each.select("tid", "span").distinct().withColumn("new", apart.cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("tid", "island").agg(F.struct(F.min("span.s").alias("start"), F.max("span.e").alias("end")).alias("span"))
    spans = spans.groupBy("tid").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    whole = (F.col("many") > 1) & (F.col("n") >= settings.get("min_words", MIN_WORDS))
    texts = first.join(joined.withColumnRenamed("vertex", "tid"), "tid", "left").join(links_of, "tid", "left").join(spans, "tid", "left")
    texts = texts.filter(whole | F.col("n_verified").isNotNull()).withColumn("class", F.coalesce("component", "tid"))
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    texts = cut(texts.select("tid", "class", "id", F.coalesce("n_verified", F.lit(0).cast("long")).alias("n_verified"), F.when(whole, all_words).otherwise(F.col("spans")).alias("passages")), "text-classes")
    classes = texts.groupBy("class").agg(F.min("id").alias("class_id"))
    return owners.select("doc_id", "tid").join(texts.join(classes, "class"), "tid").select("doc_id", F.col("id").alias("text_id"), "class_id", "n_verified", "passages")


def repeated_passages(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, start_word, end_word, match_id, match_start, match_end, similarity), ends not included.

    Pairs of texts stand once in each direction, between the documents of least id that hold them;
    every other document with one of these texts has a row for its whole text, matching that first
    document.  Documents that share no passage of ``min_words`` words have no row; null, empty and
    shorter texts never do; an empty table gives no row.  Passages that repeat only within one text are
    not reported.  A null id is used only where all documents with the text have none; repeated rows and
    equal ids with one text are copies of it.  Texts may be of any length; columns other than doc_id and
    text are ignored, whatever their names.
    """
    found, owners, first = _found(docs, passage_links, settings)
    min_words = settings.get("min_words", MIN_WORDS)
    more = tv.SHINGLE
    one = found.select("tid", "lead", "a0", (F.col("a1") + more).alias("a1"), "b0", (F.col("b1") + more).alias("b1"), "similarity")
    two = one.select(F.col("lead").alias("tid"), F.col("tid").alias("lead"), F.col("b0").alias("a0"), F.col("b1").alias("a1"), F.col("a0").alias("b0"), F.col("a1").alias("b1"), "similarity")
    pairs = one.unionByName(two).distinct()
    named = pairs.join(first.select("tid", F.col("id").alias("doc_id")), "tid").join(first.select(F.col("tid").alias("lead"), F.col("id").alias("match_id")), "lead")
    named = named.select("doc_id", F.col("a0").alias("start_word"), F.col("a1").alias("end_word"), "match_id", F.col("b0").alias("match_start"), F.col("b1").alias("match_end"), "similarity")
    copies = owners.join(first.filter((F.col("many") > 1) & (F.col("n") >= min_words)).drop("n"), "tid")
    other = F.when(F.col("doc_id").eqNullSafe(F.col("id")), F.col("last")).otherwise(F.col("id"))
    zero = F.lit(0).cast("long")
    whole = copies.select("doc_id", zero.alias("start_word"), F.col("n").alias("end_word"), other.alias("match_id"), zero.alias("match_start"), F.col("n").alias("match_end"), F.lit(1.0).alias("similarity"))
    return named.unionByName(whole)
