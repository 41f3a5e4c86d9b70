"""Sorted buckets that span partitions, bit maps and sketches."""

import numpy as np

from pyspark.sql import functions as F

from hunkwise.llm import lines, links, minhash, textvec as tv


def within(bits):
    """Rows are close whose hashes differ in so many bits at most."""

    def of(rows):
        sim = rows.column("sim").to_numpy().view(tv.U)
        return lambda i, j: np.maximum(bits - np.bitwise_count(sim[i] ^ sim[j]).astype(np.int64), -1)

    return of


def joined(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_a_bucket_over_several_partitions(four_partitions):
    spark = four_partitions
    rows = [(7, k // 300 << 40, k) for k in range(900)] + [(8, 5, 900), (9, 5, 901)]
    df = spark.createDataFrame(rows, "bucket long, sim long, node long")
    assert df.repartitionByRange("bucket", "sim", "node").rdd.getNumPartitions() == 4
    pairs, still = links.close_pairs(df, within(3))
    pairs = {(r.a, r.b) for r in pairs.collect()}
    assert all(a < b for a, b in pairs) and len(pairs) < links.BEST * (902 + 4 * 2 * links.LAG)
    # Hashes of the three runs differ in one or two bits, so all rows of bucket 7 are close.
    assert joined(902, pairs) == [0] * 900 + [900, 901]
    assert [(r.bucket, r.long) for r in still.collect()] == [(7, True)]


def test_far_hashes_are_no_pairs(shipped):
    rows = [(1, 0, 0), (1, 0b1111, 1), (1, 0b111, 2), (2, 0, 3), (2, -1, 4)]
    pairs, still = links.close_pairs(shipped.createDataFrame(rows, "bucket long, sim long, node long"), within(3))
    assert {(r.a, r.b) for r in pairs.collect()} == {(0, 2), (1, 2)} and still.isEmpty()
    none = shipped.createDataFrame([], "bucket long, sim long, node long")
    assert links.close_pairs(none, within(3))[0].isEmpty()


def test_near_rows_against_plain():
    rng = np.random.default_rng(1)
    bucket = np.sort(rng.integers(0, 12, 300))
    value = rng.integers(0, 9, 300)
    score = lambda x, y: np.maximum(2 - np.abs(value[x] - value[y]), -1)
    i, j, more = links.near_rows(bucket, score, skip=40)
    want, every, beyond = set(), set(), set()
    for k in range(40, 300):
        close = [m for m in range(max(0, k - links.LAG), k) if bucket[m] == bucket[k] and abs(value[m] - value[k]) <= 2]
        want |= {(k, m) for m in sorted(close, key=lambda m: (abs(value[m] - value[k]), -m))[: links.BEST]}
        every |= {(k, m) for m in close}
        beyond |= {k for _ in close[links.BEST :]}
    assert set(zip(i.tolist(), j.tolist())) == want and set(more.tolist()) == beyond
    i, j, more = links.near_rows(bucket, score, 40, links.LAG)
    assert set(zip(i.tolist(), j.tolist())) == every and not len(more)


def test_rows_whose_closest_are_no_links(shipped):
    # All 300 rows of a bucket look alike, and only those half a bucket apart are links: rounds go on as long as they find some.
    rows = [(7, 0, 0, bytes(np.random.default_rng(k % 150).integers(0, 256, 20).astype(np.uint8)), k) for k in range(300)]
    df = shipped.createDataFrame(rows, "bucket long, order long, sim long, low binary, node long")
    verify = lambda pairs, later=None: pairs.filter("b - a = 150")
    got = links.join_close(df, within(3), verify, links.turn("low", 20, 4, "order")).collect()
    assert {(r.vertex, r.component) for r in got} == {(k, k % 150) for k in range(300)}


def test_few_links_among_many_close_rows(shipped, monkeypatch):
    # All 700 rows look alike and stand in no telling order; three pairs of them, far apart, are links.
    monkeypatch.setattr(links, "TILE", 100)
    rows = [(7, 0, 0, np.random.default_rng(k).bytes(20), k) for k in range(700)]
    df = shipped.createDataFrame(rows, "bucket long, order long, sim long, low binary, node long")
    want = {(0, 0), (350, 0), (100, 100), (450, 100), (200, 200), (690, 200)}
    few = "(a = 0 and b = 350) or (a = 100 and b = 450) or (a = 200 and b = 690)"
    for more, dense, group in (("false", links.DENSE, set()), ("false", 0, set()), ("a >= 201 and b = a + 1 and b < 350", links.DENSE, set(range(201, 350)))):
        monkeypatch.setattr(links, "DENSE", dense)
        verify = lambda pairs, later=None: pairs.filter(f"({few}) or ({more})")  # noqa: E731, B023
        got = links.join_close(df, within(3), verify, links.turn("low", 20, 4, "order")).collect()
        assert {(r.vertex, r.component) for r in got} == want | {(k, 201) for k in group}


def test_all_close_against_plain(shipped, monkeypatch):
    monkeypatch.setattr(links, "TILE", 16)
    monkeypatch.setattr(links, "AT_ONCE", 50)
    rng = np.random.default_rng(6)
    bucket, value, group = rng.integers(0, 4, 300) ** 2, rng.integers(0, 5, 300), rng.integers(0, 6, 300)
    rows = [(int(b), int((1 << int(v)) - 1), int(g), bool(g), k) for k, (b, v, g) in enumerate(zip(bucket, value, group))]
    df = shipped.createDataFrame(rows, "bucket long, sim long, group long, seeks boolean, node long")
    got = [(r.a, r.b) for r in links.all_close(df, within(1)).collect()]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if bucket[i] == bucket[j] and group[i] != group[j] and abs(value[i] - value[j]) <= 1}
    assert len(got) == len(want) and set(got) == want


def test_borders_in_short_batches(four_partitions):
    # Buckets of fewer rows than a row is held against are cut by borders and end behind them; batches are shorter than what stands there.
    spark = four_partitions
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(7 + k // 50, k << 40, k) for k in range(120)]
    df = spark.createDataFrame(rows, "bucket long, sim long, node long")
    every = {(i, j) for i in range(120) for j in range(i + 1, 120) if rows[i][0] == rows[j][0] and (rows[i][1] ^ rows[j][1]).bit_count() <= 6}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        pairs, still = links.close_pairs(df, within(6), links.LAG)
        assert {(r.a, r.b) for r in pairs.collect()} == every and still.isEmpty()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_links_of_cells_join_what_all_close_links_join(shipped, monkeypatch):
    monkeypatch.setattr(links, "AT_ONCE", 500)
    rng = np.random.default_rng(8)
    n, keys = 400, rng.integers(0, 3, (400, 3)) * 3 + np.arange(3)
    # Groups of one; a bucket's largest group does not seek.
    value, group = rng.integers(0, 4, n), np.where(rng.random(n) < 0.2, 0, np.arange(n))
    linked = lambda x, y: abs(x - y) % 37 == 0
    rows = [(int(b), (1 << int(value[k])) - 1, int(group[k]), bool(group[k]), k) for k in range(n) for b in keys[k]]
    df = shipped.createDataFrame(rows, "bucket long, sim long, group long, seeks boolean, node long")
    own = shipped.createDataFrame([(k, [int(x) for x in keys[k]]) for k in range(n)], "node long, keys array<long>")
    close = [(i, j) for i in range(n) for j in range(i + 1, n) if group[i] != group[j] and (keys[i] == keys[j]).any() and abs(value[i] - value[j]) <= 1]
    want = joined(n, [(int(group[i]), int(group[j])) for i, j in close if linked(i, j)])

    def test(table):
        node = table.column("node").to_numpy()
        return lambda i, j: linked(node[i], node[j])

    for tile, size, parts in ((1 << 12, "0", "1"), (50, "0", "4"), (1 << 12, "1 << 20", "4")):
        monkeypatch.setattr(links, "TILE", tile)
        shipped.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            inside = links.Inside(lambda nodes: own.join(nodes, "node"), lambda t: t.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, 3), test, size, 64)
            got = [(r.a, r.b) for r in links.joining(df, within(1), inside).collect()]
        finally:
            shipped.conf.set("spark.sql.shuffle.partitions", "4")
        assert set(got) <= {(i, j) for i, j in close if linked(i, j)}
        assert joined(n, [(int(group[i]), int(group[j])) for i, j in got]) == want
        # Not a row for each link: fewer than the groups that a task holds.
        assert parts != "1" or len(got) < len(set(group.tolist()))


def test_repeated_hashes(shipped):
    rng = np.random.default_rng(4)
    own = rng.integers(-(1 << 63), (1 << 63) - 1, 500)
    rows = [(int(x), int(o)) for x in own for o in rng.integers(0, 4, rng.integers(1, 6))]
    df = shipped.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "h long, o long").repartition(7)
    owners = {}
    for x, o in rows:
        owners.setdefault(x, set()).add(o)
    hashes = lambda b: iter([(b.column(0).to_numpy(), b.column(1).to_numpy())])
    for n in (1, 40 * tv.PART):
        assert sorted(r.hash for r in tv.repeated(df, hashes, n).collect()) == sorted(x for x, o in owners.items() if len(o) > 1)
    assert tv.repeated(df.filter("false"), hashes, 0).isEmpty()


def test_lines_of_a_chunk():
    texts = ["", "a\n\nb", None, "\n", "c", "", "d\n"]
    start, end, row, line = tv.lines(*tv.buffers(tv.pa.array(texts)))
    buf = tv.buffers(tv.pa.array(texts))[0].tobytes()
    got = [(r, k, buf[s:e].decode()) for s, e, r, k in zip(start.tolist(), end.tolist(), row.tolist(), line.tolist())]
    assert got == [(r, k, x) for r, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]


def test_bit_maps_miss_nothing(shipped):
    rng = np.random.default_rng(2)
    own = rng.integers(-(1 << 63), (1 << 63) - 1, 2000)
    df = shipped.createDataFrame([(int(x),) for x in own], "h long").repartition(5)
    bits = tv.bit_map(df, "h", 1 << 20)
    other = rng.integers(-(1 << 63), (1 << 63) - 1, 2000)
    assert tv.in_map(bits, own).all() and tv.in_map(bits, other).mean() < 0.02


def test_frequencies_are_never_too_low(small):
    freq = minhash.frequencies(small.repartition(6))
    held = {}
    for t in {r.text or "" for r in small.collect()}:
        _, h = tv.shingles(tv.Words(*tv.buffers(tv.pa.array([t]))))
        for x in set(h.tolist()):
            held[x] = held.get(x, 0) + 1
    h = np.array(list(held), np.uint64)
    df = np.minimum.reduce([freq.sketch[k][c] for k, c in enumerate(minhash._cells(h))])
    true = np.array(list(held.values()))
    df = df / minhash.ONE
    n = small.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert (df >= 0.99 * true).all() and (df - true).mean() < 2 and abs(freq.documents / minhash.ONE - n) < 0.01 * n
