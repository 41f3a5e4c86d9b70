"""Near-duplicate documents: consistent weighted sampling over TF-IDF shingles.

A text is the bag of its 5-word shingles (a shorter text is one shingle).  A shingle weighs its count
in the text times ln(1 + n / (df + SMOOTH * n)) for n different texts, df of which hold it: 2.4 for a rare
one, 2.0 at a twentieth of all texts, 1.0 at half of them.  SMOOTH bounds how much a group of near copies,
whose shingles are frequent by its own size, loses of them.  Equal texts count as one in n and df, so a
group of copies loses nothing: a document counts as one part of the number of documents with its text.
Both numbers come from count-min sketches of fixed size that are summed over all documents: they are
never too low but by rounding, and too high by a part of n that the sketch's width sets.

Improved consistent weighted sampling (Ioffe) draws ``bands * rows`` samples from each text; two texts
agree in a sample with the probability of their weighted Jaccard similarity.  Texts that agree in a
whole band share a bucket.  ``links.join_close`` finds the pairs of a bucket whose weights and samples
allow the similarity asked for, and each is verified by the exact weighted Jaccard similarity of the
two whole texts, unless others have joined the two by then.  Equal texts are one node throughout, so a group of copies
of any size costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hunkwise.llm import links, textvec as tv
from hunkwise.session import cut, fresh

WIDTH, DEPTH, BLOCK = 1 << 17, 2, 1 << 12
COPIES = 1 << 19
SMOOTH = 0.1
#: What a text counts as in the sketch; a copy counts as a part of it.
ONE = 1 << 16
BANDS, ROWS = 14, 4
SIMILARITY = 0.8
SMALL = 1 << 18
MOST, FURTHER, ORDERS = 2, 4, 2
#: Texts of a part, two of which a cell pairs.
CELL = 512
#: Pairs of a cell whose similarities are found together.
TOGETHER = 1 << 15


def bag(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, shingle, count) of the different shingles of each text, by text."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def bags(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, h = tv.shingles(tv.Words(buf, at))
    return bag(h, np.repeat(np.arange(len(at) - 1), np.diff(first)))


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> tv.U(20 * k)) % tv.U(WIDTH) for k in range(DEPTH)]


class Frequencies:
    """The number of texts, in parts of ``ONE``, and a count-min sketch of shingles' text frequencies."""

    def __init__(self, documents: int, sketch: np.ndarray):
        self.documents, self.sketch = documents, sketch

    def weight(self, h: np.ndarray) -> np.ndarray:
        df = np.minimum.reduce([self.sketch[k][c] for k, c in enumerate(_cells(h))])
        n = max(1, self.documents)
        return np.log1p(n / (df + n * SMOOTH)).astype(np.float32)


def _key_cells(short: np.ndarray) -> list[np.ndarray]:
    return [(tv.mix(short.view(tv.U) * tv.STEP[40 + k]) % tv.U(COPIES)).astype(np.int64) for k in range(DEPTH)]


def copies(ids: DataFrame) -> np.ndarray:
    """A count-min sketch of how many rows have each ``short`` key."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DEPTH, COPIES), np.int64)
        for b in batches:
            for k, c in enumerate(_key_cells(b.column(0).to_numpy(zero_copy_only=False))):
                total[k] += np.bincount(c, minlength=COPIES)
        flat = total.reshape(-1, BLOCK)
        full = np.flatnonzero(flat.any(1))
        if len(full):
            yield tv.block_rows(full, flat[full])

    sketch = np.zeros((DEPTH * COPIES // BLOCK, BLOCK), np.int64)
    for k, x in tv.block_sums(ids.select("short").mapInArrow(partial, tv.BLOCK_SCHEMA)).items():
        sketch[k] = x
    return sketch.reshape(DEPTH, COPIES)


def frequencies(docs: DataFrame, text: str = "text") -> Frequencies:
    """Over all documents.  Each task sums its own sketch; the blocks of the sketches are summed as they stream by."""
    short = F.xxhash64(F.coalesce(text, F.lit(""))).alias("short")
    several = docs.sparkSession.sparkContext.broadcast(copies(docs.select(short)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((DEPTH, WIDTH), np.int64), 0
        for b in batches:
            cells = _key_cells(b.column(1).to_numpy(zero_copy_only=False))
            part = ONE // np.minimum.reduce([several.value[k][c] for k, c in enumerate(cells)])
            n += int(part.sum())
            for i, j, buf, at in tv.chunks(b.column(0)):
                doc, h, _ = bags(buf, at)
                for k, c in enumerate(_cells(h)):
                    total[k] += np.bincount(c.astype(np.int64), part[i:j][doc], WIDTH).astype(np.int64)
        if n:
            flat = total.reshape(-1, BLOCK)
            full = np.flatnonzero(flat.any(1))
            yield tv.block_rows([-1, *full], [np.array([n]), *flat[full]])

    sketch, n = np.zeros((DEPTH * WIDTH // BLOCK, BLOCK), np.int64), 0
    for k, x in tv.block_sums(docs.select(text, short).mapInArrow(partial, tv.BLOCK_SCHEMA)).items():
        if k < 0:
            n = int(x[0])
        else:
            sketch[k] = x
    return Frequencies(n, sketch.reshape(DEPTH, WIDTH))


def _gamma_table(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of n equal parts."""
    p, x = (np.arange(n) + 0.5) / n, np.full(n, 1.5)
    lo, hi = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        x = (lo + hi) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        lo, hi = np.where(under, x, lo), np.where(under, hi, x)
    return x.astype(np.float32)


GAMMA = _gamma_table(1 << 12)
EXP = (-np.log((np.arange(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, n: int) -> np.ndarray:
    """n consistent weighted samples (64-bit) of each text; bags as from ``bag``, a text without shingles gets 0."""
    out = np.zeros((texts, n), tv.U)
    if not len(h):
        return out
    heads = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(heads, len(h)))
    log_w = np.log(weight, dtype=np.float32)
    keys = tv.seeds(n, 1234)
    mask16, mask12 = tv.U(0xFFFF), tv.U(0xFFF)
    for k in range(n):
        x = (h ^ keys[k]) * tv.U(0x9E3779B97F4A7C15)
        x ^= x >> tv.U(32)
        x *= tv.U(0xD6E8FEB86659FD93)
        x ^= x >> tv.U(29)
        r = GAMMA[(x & mask12).astype(np.int32)]
        beta = ((x >> tv.U(12)) & mask16).astype(np.float32) * np.float32(1 / 65536)
        c = EXP[((x >> tv.U(28)) & mask16).astype(np.int32)] + EXP[(x >> tv.U(48)).astype(np.int32)]
        t = np.floor(log_w / r + beta)
        a = np.log(c) - r * (t - beta + np.float32(1))
        low = np.minimum.reduceat(a, heads)
        hit = np.flatnonzero(a == np.repeat(low, size))
        first = hit[np.searchsorted(hit, heads)]
        out[doc[heads], k] = tv.mix(h[first] + t[first].astype(np.int64).astype(tv.U) * tv.STEP[1] + keys[k])
    return out


def bands(values: np.ndarray, n_bands: int, n_rows: int) -> np.ndarray:
    """Band keys of samples; the band's number is part of the key."""
    v = values.reshape(len(values), n_bands, n_rows)
    acc = np.zeros(v.shape[:2], tv.U)
    for j in range(n_rows):
        acc = tv.mix(acc + v[:, :, j] * tv.STEP[j + 2])
    return tv.mix(acc + np.arange(1, n_bands + 1, dtype=tv.U) * tv.STEP[10])


def similarity(hx: np.ndarray, hy: np.ndarray, freq: Frequencies) -> float:
    """Weighted Jaccard similarity of two texts' shingles; two texts without any are alike."""
    if not len(hx) and not len(hy):
        return 1.0
    ux, cx = np.unique(hx, return_counts=True)
    uy, cy = np.unique(hy, return_counts=True)
    both, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    total = float((cx * freq.weight(ux)).sum() + (cy * freq.weight(uy)).sum())
    common = float((np.minimum(cx[ix], cy[iy]) * freq.weight(both)).sum())
    return common / (total - common) if total > common else 1.0


def _text_key(text: str = "text"):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _close(n_samples: int, threshold: float):
    """How alike texts may be: the samples in which they agree, -1 if these or the texts' weights rule the threshold out.

    The share of agreeing samples is an estimate of the similarity; four standard deviations below the
    threshold are let through.
    """
    least = n_samples * threshold - 4 * np.sqrt(n_samples * threshold * (1 - threshold))

    def of(rows: pa.Table):
        total = rows.column("total").to_numpy()
        sample = tv.buffers(rows.column("sample"))[0].reshape(-1, n_samples)

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            near = np.flatnonzero(np.minimum(total[i], total[j]) >= threshold * (1 - 1e-5) * np.maximum(total[i], total[j]))
            same = (sample[i[near]] == sample[j[near]]).sum(1)
            out = np.full(len(i), -1)
            out[near] = np.where(same >= least, same, -1)
            return out

        return test

    return of


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """(doc_id, key, class_id, group_id, keep): a row for each document.

    key: md5 of the text.  class_id: least id among equal texts.  group_id: least id among the texts
    that links of at least ``threshold`` join.  keep: whether the row is the one that stays of its
    group: least id, then least key; rows equal in both id and text are all marked, and
    ``drop_near_duplicates`` keeps one of them.  Null and empty texts are equal to each other and near
    no other text.  Null ids count after all others.  Texts may be of any length; an empty table gives no
    row; columns other than doc_id and text are ignored, whatever their names.
    """
    narrow = docs.select("doc_id", "text")
    freq = docs.sparkSession.sparkContext.broadcast(frequencies(narrow))
    ids = cut(narrow.select("doc_id", _text_key().alias("key")), "ids")
    nodes = cut(_signed(narrow, freq, n_bands, n_rows).withColumn("node", F.monotonically_increasing_id()), "nodes")
    joined = _groups(narrow, nodes, freq, threshold, n_bands, n_rows)
    named = nodes.join(joined, nodes["node"] == joined["vertex"], "left").select("key", F.coalesce("component", "node").alias("group"))
    # Texts without a shingle have no node: their key is their group.
    grouped = ids.join(named, "key", "left")
    grouped = cut(grouped.withColumn("group", F.coalesce(F.col("group").cast("string"), F.hex("key"))), "grouped")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = grouped.groupBy("group", "key").agg(F.min("doc_id").alias("class_id"), F.min(order).alias("first"))
    best = classes.groupBy("group").agg(F.min("first").alias("best"), F.min("class_id").alias("group_id"))
    per_key = cut(classes.join(best, "group").select("key", "class_id", "group_id", "best"), "classes")
    keep = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("key") == F.col("best.key"))
    return ids.join(per_key, "key").select("doc_id", "key", "class_id", "group_id", keep.alias("keep"))


def _signed(docs: DataFrame, freq, n_bands: int, n_rows: int) -> DataFrame:
    """(key, bands, sample, total) of each different text with shingles: band keys, the samples' last bytes, the sum of weights."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, at in tv.chunks(b.column(1), SMALL):
                doc, h, count = bags(buf, at)
                weight = count * freq.value.weight(h)
                s = samples(doc, h, weight, len(at) - 1, n_bands * n_rows)
                keys = bands(s, n_bands, n_rows).astype(np.int64)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), n_bands).cast(pa.list_(pa.int64()))
                last = s.astype(np.uint8)
                part = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, pa.array([x.tobytes() for x in last], pa.binary()), pa.array(np.bincount(doc, weight, j - i))], ["key", "bands", "sample", "total"])
                yield part.filter(pa.array(np.isin(np.arange(j - i), doc)))

    signed = docs.select(_text_key().alias("key"), "text").mapInArrow(sign, "key binary, bands array<bigint>, sample binary, total double")
    return signed.groupBy("key").agg(*(F.min(c).alias(c) for c in ("bands", "sample", "total")))  # equal for equal texts


def _groups(docs: DataFrame, nodes: DataFrame, freq, threshold: float, n_bands: int, n_rows: int) -> DataFrame:
    """(vertex, component) of the nodes that links join: pairs whose texts reach the threshold.

    In its bucket a text is sorted by the next two bands: the texts that agree with it in most stand
    next to it, in a bucket of any size.
    """
    turn = lambda by: F.get("bands", (F.col("k") + by) % n_bands)
    rows = nodes.select("bands", "sample", "total", "node", F.posexplode("bands").alias("k", "bucket"))
    rows = rows.select("bucket", turn(1).alias("next"), turn(2).alias("after"), "total", "sample", "node")
    verify = lambda pairs, later=None: (_links_in_cells if later is None else _links)(docs, nodes, pairs, freq, threshold)

    def own(wanted: DataFrame) -> DataFrame:
        named = cut(wanted.join(nodes.select("node", "key", "bands"), "node"), "wanted")
        return _texts(docs, named.select("node", "key")).join(named.select("node", "bands"), "node")

    keys = lambda rows: rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, n_bands)
    # A word takes some eight bytes, and its shingle weighs one or two.
    inside = links.Inside(own, keys, _near(freq, threshold), "total * 8", TOGETHER)
    return links.join_close(rows, _close(n_bands * n_rows, threshold), verify, links.turn("sample", n_bands * n_rows, ORDERS, "next"), MOST, FURTHER, inside=inside)


def _near(freq, threshold: float):
    """Whether rows' texts reach the threshold; a text's bag is made when a pair first asks for it."""

    def of(rows: pa.Table):
        text, held = rows.column("text").combine_chunks(), {}

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            new = np.array([x for x in np.unique(np.concatenate([i, j])).tolist() if x not in held], np.int64)
            _hold(held, new, text.take(pa.array(new)), freq)
            return _similarities(held, i, j) >= threshold

        return test

    return of


def _hold(held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], names: np.ndarray, texts: pa.Array, freq) -> None:
    """Puts the texts' bags (shingles, counts, weights) under their names."""
    for i, j, buf, at in tv.chunks(texts, SMALL):
        doc, h, count = bags(buf, at)
        own, first = freq.value.weight(h), np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(j - i):
            x = slice(first[k], first[k + 1])
            held[names[i + k].item()] = h[x], count[x], own[x]


def _links(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, freq, threshold: float) -> DataFrame:
    """(a, b): the pairs of nodes whose texts reach the threshold."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = _texts(docs, cut(wanted.join(nodes.select("node", "key"), "node"), "wanted"))

    @F.arrow_udf("double")
    def weigh(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for i, j, buf, at in tv.chunks(a):
            fx, hx = tv.shingles(tv.Words(buf, at))
            for k in range(i, j):
                _, hy = tv.shingles(tv.Words(*tv.buffers(b.slice(k, 1))))
                out.append(similarity(hx[fx[k - i] : fx[k - i + 1]], hy, freq.value))
        return pa.array(out, pa.float64())

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    return both.withColumn("s", weigh("ta", "tb")).filter(F.col("s") >= threshold).select("a", "b")


def _links_in_cells(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, freq, threshold: float) -> DataFrame:
    """As ``_links``, for many pairs of few nodes: a text goes once to each cell that pairs the texts of two parts, not once to each pair."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = cut(ends.join(nodes.select("node", "key"), "node"), "wanted")
    texts, parts = _texts(docs, wanted), 1 + wanted.count() // CELL
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    dealt = pairs.select(F.least(part("a"), part("b")).alias("row"), F.greatest(part("a"), part("b")).alias("column"), "a", "b")
    needs = dealt.select("row", "column", F.explode(F.array("a", "b")).alias("a")).distinct()
    sent = needs.join(texts.select(F.col("node").alias("a"), "text"), "a").select("row", "column", "a", F.lit(None).cast("long").alias("b"), "text")
    both = sent.unionByName(dealt.withColumn("text", F.lit(None).cast("string")))
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Null sorts first: a cell's texts come before its pairs.
    both = both.repartition(count, "row", "column").sortWithinPartitions("row", "column", "b", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            row, column, a = (batch.column(k).to_numpy() for k in range(3))
            is_pair = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            new = (row[1:] != row[:-1]) | (column[1:] != column[:-1]) | (is_pair[1:] != is_pair[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:]):
                if s == e:
                    continue
                if cell != (row[s], column[s]):
                    cell, held = (row[s], column[s]), {}
                if is_pair[s]:
                    b = batch.column(3).slice(s, e - s).to_numpy()
                    near = np.flatnonzero(_similarities(held, a[s:e], b) >= threshold)
                    yield pa.RecordBatch.from_arrays([pa.array(a[s:e][near]), pa.array(b[near])], ["a", "b"])
                    continue
                _hold(held, a[s:e], batch.column(4).slice(s, e - s), freq)

    return both.mapInArrow(run, "a long, b long")


def _similarities(held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of pairs of nodes by their bags (shingles, counts, weights), none of them empty."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = [held[x] for x in names.tolist()]
    size = np.array([len(h) for h, _, _ in own])
    first = np.cumsum(size) - size
    every, code = np.unique(np.concatenate([h for h, _, _ in own]), return_inverse=True)
    count, weight = (np.concatenate([x[k] for x in own]).astype(np.float64) for k in (1, 2))
    total = np.add.reduceat(count * weight, first)
    out, there = np.empty(len(a)), np.zeros(len(every))
    x, y = at[: len(a)], at[len(a) :]
    by = np.argsort(x, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(x[by]) > 0))
    for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(by)]):
        me = x[by[s]]
        mine = slice(first[me], first[me] + size[me])
        there[code[mine]] = count[mine]
        for k in range(s, e, CELL):
            to = y[by[k : min(e, k + CELL)]]
            starts = np.cumsum(size[to]) - size[to]
            where = np.arange(size[to].sum()) + np.repeat(first[to] - starts, size[to])
            common = np.add.reduceat(np.minimum(there[code[where]], count[where]) * weight[where], starts)
            out[by[k : k + len(to)]] = common / (total[me] + total[to] - common)
        there[code[mine]] = 0
    return out


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted (node, key).

    A bit map of the wanted keys keeps most other texts from being shuffled; equal
    texts meet within each task before they are.
    """
    short = F.xxhash64("key").alias("short")
    bits = docs.sparkSession.sparkContext.broadcast(tv.bit_map(wanted.select(short), "short"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.flatnonzero(tv.in_map(bits.value, b.column(2).to_numpy(zero_copy_only=False)))
            if len(hit):
                yield b.select(["key", "text"]).take(pa.array(hit))

    keyed = docs.select(_text_key().alias("key"), "text").select("key", "text", short)
    found = keyed.mapInArrow(pick, "key binary, text string").groupBy("key").agg(F.first("text").alias("text"))
    return cut(found.join(wanted, "key").select("node", "text"), "texts")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    key, text_key, doc = fresh(docs, "_key", "_text_key", "_doc")
    kept = near_duplicates(docs, **settings).filter("keep").select(F.col("doc_id").alias(doc), F.col("key").alias(text_key)).distinct()
    once = docs.withColumn(key, _text_key()).dropDuplicates(["doc_id", key])
    out = once.join(kept, (F.col(key) == F.col(text_key)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left_semi")
    return out.select(*docs.columns)
