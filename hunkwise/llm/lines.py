"""Line dedup: SimHashes and min-hashes of normalised lines, edit similarity, one line of each group.

A line is normalised to lower-case words: marks are dropped and every run of digits is one 0 (case is
folded for ASCII and Latin-1 letters).  Equal normalised lines are one node; lines of any length are
grouped by equality.  Near lines are sought among those of ``MIN_WORDS`` words or more.

Blocks of a SimHash within three bits find a fifth of the lines of the similarity asked for, as one
changed word turns several bits; so the blocks are keys of min-hashes instead.  A node has ``BANDS`` keys
of two min-hashes each over the pairs of words that follow each other, and one of fewer than ``SHORT``
words also keys of one min-hash, as a changed word leaves few of its pairs.  Only keys that several
nodes have make buckets.

``links.join_close`` finds the pairs of a bucket, which is sorted by SimHash (64 bits over a line's
different words, so that frequent words do not make lines alike).  Rows whose SimHashes differ in more
than ``FAR`` bits, that agree in fewer than ``AGREE`` min-hashes (lines of ``LONG`` words or more have
bounds of their own, on the sum of both too), or whose lengths rule the similarity out are no pair.  All
other pairs of a bucket are verified, unless others have joined the two by then.

A pair is a link if the edit similarity of the normalised lines, 1 - distance / longer length, reaches
the threshold.  Of all lines that equality and links join, the first stays: least document id, then text
key, then line number.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hunkwise.llm import links, textvec as tv
from hunkwise.session import cut, fresh

MIN_WORDS = 4
SIMILARITY = 0.8
BANDS, SHORT, SINGLE = 10, 12, 4
LOWS = 2 * BANDS
#: Of 116,305 links of a table, 99.6 % lie within these; unlike lines differ in about 32 bits and agree in none.
FAR, AGREE = 22, 4
LONG, FAR_LONG, AGREE_LONG, LEAD = 16, 20, 6, -8
MANY = 1 << 24
MOST, FURTHER, ORDERS = 1, 2, 2
ANCHOR, STRIDE = 8, 32
#: Pairs whose distances are found together, and bytes that their bit vectors take.
BATCH, TABLE = 1024, 1 << 23
#: Pairs of like length are done together from so many on, or from a part of their code points on.
FEW, FEW_OF = 24, 48
#: Columns after which pairs that are too far apart are looked for.
STEP = 32
#: Symbols of all pairs that are told apart at once.
SYMBOLS = 1 << 22

#: What a byte becomes: marks nothing, digits 0, upper case lower; a zero byte stays a byte.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0] = 1
_FOLD[65:91] += 32
_FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0
_FOLD[48:58] = 48
#: A byte's bits as eight bytes of 0 or 1.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(tv.U).reshape(-1)

#: The least sum of the first bits, none to all eight, of steps up and down, by the bytes of both.
_STEPS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.int8)
_LEAST = np.minimum(np.cumsum(_STEPS[:, None] - _STEPS[None], axis=2, dtype=np.int8).min(2), 0).reshape(-1)


def normalise(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The normalised bytes of a chunk and the texts' offsets in them; lines stay lines."""
    low = _FOLD[buf]
    again = (low[1:] == 48) & (low[:-1] == 48)
    inner = at[(at > 0) & (at < len(buf))]
    again[inner - 1] = False
    keep = low != 0
    keep[1:] &= ~again
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1
    upper = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
    low[upper] += 0x20
    return low[keep], at - np.searchsorted(np.flatnonzero(~keep), at)


def simhash(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """64-bit SimHash of runs of feature hashes that begin at ``heads``: the bits that more than half of them have."""
    size = np.diff(np.append(heads, len(h)))
    # Byte lanes hold up to 255, so runs are summed in parts.
    parts = -(-size // 255)
    starts = np.repeat(heads, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    data = h.view(np.uint8).reshape(-1, 8)
    ones = np.empty((len(starts), 64), np.uint8)
    for k in range(8):
        ones[:, 8 * k : 8 * k + 8] = np.add.reduceat(_SPREAD[data[:, k]], starts).view(np.uint8).reshape(-1, 8)
    total = np.add.reduceat(ones, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
    return np.packbits(2 * total > size[:, None], axis=1, bitorder="little").view(tv.U).reshape(-1)


class Lines:
    """Lines with words of a chunk of normalised texts: ``row``, ``line`` (from 0), ``size`` in words, hashes ``h1`` and ``h2``, each text's ``n_lines``, and what ``sims``, ``lows``, ``chars`` and ``body`` give."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        w = tv.Words(buf, at)
        n = len(w.start)
        breaks = np.flatnonzero(buf == 10)
        new = np.zeros(n + 1, bool)
        new[w.first] = True
        new[np.searchsorted(w.start, breaks)] = True
        self.heads = np.flatnonzero(new[:n])
        self.size = np.diff(np.append(self.heads, n))
        self.h, self.words = w.h, w
        self.row = w.doc[self.heads]
        before = np.searchsorted(breaks, at)
        self.n_lines = np.diff(before) + 1
        self.line = np.searchsorted(breaks, w.start[self.heads]) - before[self.row]
        if n:
            place = np.arange(n) - np.repeat(self.heads, self.size)
            longest = int(self.size.max())
            ids = []
            for k, base in enumerate((tv.R, tv.R_INV)):
                sums = np.add.reduceat((w.h + tv.STEP[20 + k]) * tv.powers(base, longest)[place], self.heads)
                ids.append(tv.mix(sums + self.size.astype(tv.U) * tv.STEP[30 + k]).astype(np.int64))
        else:
            ids = [np.zeros(0, np.int64)] * 2
        self.h1, self.h2 = ids

    def sims(self) -> np.ndarray:
        """SimHashes over each line's different words (by 40 bits of their hashes)."""
        out = [np.zeros(0, np.int64)]
        for s in range(0, len(self.heads), MANY):
            size = self.size[s : s + MANY]
            n, first = len(size), self.heads[s]
            # One number holds the line and the word: sorting brings equal words together.
            both = np.repeat(np.arange(n, dtype=tv.U), size) << tv.U(40) | self.h[first : first + size.sum()] >> tv.U(24)
            both = np.sort(both)
            both = both[np.append(True, both[1:] != both[:-1])]
            heads = np.searchsorted(both, np.arange(n, dtype=tv.U) << tv.U(40))
            out.append(simhash(tv.mix(both & tv.U((1 << 40) - 1)), heads).astype(np.int64))
        return np.concatenate(out)

    def lows(self) -> np.ndarray:
        """Each line's ``LOWS`` 32-bit min-hashes over its pairs of words that follow each other; of a line of one word, over itself."""
        if not len(self.heads):
            return np.zeros((0, LOWS), np.uint32)
        # The last word of a line would pair with the next line's first.
        pair = np.ones(len(self.h), bool)
        pair[(self.heads + self.size - 1)[self.size > 1]] = False
        f = tv.mix(self.h * tv.STEP[11] + np.append(self.h[1:], tv.U(0)) * tv.STEP[12])[pair]
        heads = self.heads - np.cumsum(self.size > 1) + (self.size > 1)
        out = np.empty((len(heads), LOWS), np.uint32)
        for k, x in enumerate(tv.seeds(LOWS, 4321)):
            out[:, k] = tv.mix(np.minimum.reduceat((f ^ x) * tv.STEP[13], heads)) >> tv.U(32)
        return out

    def chars(self) -> np.ndarray:
        """Code points of each line's words and the spaces between them."""
        if not len(self.heads):
            return np.zeros(0, np.int64)
        w = self.words
        inner = np.flatnonzero((w.buf & 0xC0) == 0x80)  # bytes that begin no code point
        ends = np.searchsorted(inner, w.end[self.heads + self.size - 1]) - np.searchsorted(inner, w.start[self.heads])
        return np.add.reduceat(w.end - w.start, self.heads) - ends + self.size - 1

    def body(self, k: int) -> str:
        w, i, n = self.words, self.heads[k], self.size[k]
        return b" ".join(w.buf[w.start[i] : w.end[i + n - 1]].tobytes().split()).decode(errors="replace")


def keys(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node's place, key): the keys of lines by their min-hashes and number of words; a key's own place is part of it."""
    out, has = key_table(low, size)
    return np.nonzero(has)[0], out[has]


def key_table(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column for each key of lines, and which of them a line has."""
    n, x = len(low), low.astype(tv.U)
    out = np.empty((n, BANDS + SINGLE), np.int64)
    for k in range(BANDS):
        out[:, k] = tv.mix(x[:, 2 * k] << tv.U(32) | x[:, 2 * k + 1]) * tv.STEP[k]
    for k in range(SINGLE):
        out[:, BANDS + k] = tv.mix(x[:, 2 * k]) * tv.STEP[BANDS + k]
    has = np.ones(out.shape, bool)
    has[size >= SHORT, BANDS:] = False
    return out, has


def _common(a: str, b: str) -> int:
    """How many code points both begin with."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance; what both begin and end with is cut off, the rest is done by bit vectors.  A distance above ``most`` may be given as any number above it."""
    k = _common(a, b)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - k], b[: len(b) - k]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    most = len(b) if most is None else most
    m, n, peq = len(a), len(b), {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    get, full = peq.get, (1 << m) - 1
    pv, mv = full, 0
    for start in range(0, n, STRIDE):
        for c in b[start : start + STRIDE]:  # Myers' column step
            eq = get(c, 0)
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = (mv | ~(xh | pv)) << 1 | 1
            mh = (pv & xh) << 1
            eq |= mv
            pv = (mh | ~(eq | ph)) & full
            mv = ph & eq & full
        # A column begins with its number, and steps by +1 and -1 from there; each of those left lowers its end by one at most.
        done = min(n, start + STRIDE)
        d = done + pv.bit_count() - mv.bit_count()
        if d - (n - done) > most:
            return d - (n - done)
    return d


def edit_similarity(a: str, b: str) -> float:
    return 1 - edit_distance(a, b) / max(len(a), len(b), 1)


def _bound(a: str, b: str, most: int) -> int:
    """No less than the edit distance, by steps from each difference to the next ``ANCHOR`` code points that are equal again; above ``most`` if that fails."""
    i = j = d = 0
    while d <= most:
        k = _common(a[i:], b[j:])
        i, j = i + k, j + k
        if i == len(a) or j == len(b):
            return d + max(len(a) - i, len(b) - j)
        step = most + 1
        for ahead in range(0, most - d + 1):
            x, y = b.find(a[i + ahead : i + ahead + ANCHOR], j, j + ahead + ANCHOR), a.find(b[j + ahead : j + ahead + ANCHOR], i, i + ahead + ANCHOR)
            if x >= 0 and i + ahead + ANCHOR <= len(a):
                step, i, j = ahead, i + ahead, x
                break
            if y >= 0 and j + ahead + ANCHOR <= len(b):
                step, i, j = ahead, y, j + ahead
                break
        d += step
    return d


def _distances(pairs: list[tuple[str, str]], most: np.ndarray | None = None) -> np.ndarray:
    """Levenshtein distances of pairs of texts that are not empty, by bit vectors of all pairs at once, a column of the longer texts at a time.

    A distance above its pair's ``most`` may be given as any number above it.  A path to a smaller one stays
    within ``most`` rows of the diagonal, so only blocks of rows that this band touches are stepped: a row
    above the band grows by one a column, a block below it by one a row, which is never too little.
    Every ``STEP`` columns the pairs go that no row of the band leads to the end of within ``most``.
    """
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in pairs]
    order = np.array(sorted(range(len(pairs)), key=lambda k: -len(pairs[k][1])))  # those with a column left stand first
    m, n = (np.array([len(pairs[k][side]) for k in order]) for side in (0, 1))
    bound = n if most is None else np.minimum(most[order], n)
    points = np.frombuffer("".join([pairs[k][side] for side in (0, 1) for k in order]).encode("utf-32-le", "surrogatepass"), "<u4")
    there = np.zeros(int(points.max()) + 1, bool)
    there[points] = True
    names, code = np.flatnonzero(there), (np.cumsum(there) - 1)[points]
    count, blocks, one, top = len(order), -(-int(m.max()) // 64), tv.U(1), tv.U(63)
    if count > 1 and count * len(names) > SYMBOLS:
        half = count // 2
        return np.concatenate([_distances(pairs[s], None if most is None else most[s]) for s in (slice(half), slice(half, None))])
    # A row for each symbol of a pair's shorter text; row 0 is for all others.
    own = np.repeat(np.arange(count), m) * len(names) + code[: m.sum()]
    rows = np.zeros(count * len(names), bool)
    rows[own] = True
    rows = np.cumsum(rows, dtype=np.int32) * rows
    place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    equal = np.zeros((int(rows.max()) + 1) * blocks, tv.U)
    np.bitwise_or.at(equal, rows[own] * blocks + (place >> 6), one << (place & 63).astype(tv.U))
    equal = equal.reshape(-1, blocks)
    owner = np.repeat(np.arange(count), n)
    later = np.zeros((int(n.max()), count), np.int32)
    later[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), owner] = rows[owner * len(names) + code[m.sum() :]]
    plus, minus = np.full((blocks, count), ~tv.U(0)), np.zeros((blocks, count), tv.U)
    out, band = np.empty(count, np.int64), int(bound.max())

    def ends(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        bits = np.clip(m[None] - 64 * np.arange(blocks)[:, None], 0, 64)
        used = np.where(bits == 64, ~tv.U(0), (one << np.minimum(bits, 63).astype(tv.U)) - one)
        return n + np.bitwise_count(x & used).sum(0, dtype=np.int64) - np.bitwise_count(y & used).sum(0, dtype=np.int64)

    j, x = 0, plus[0, :0]
    while count:
        k = int(np.searchsorted(-n, -j, "left"))  # those of more than j columns
        if k < count:
            out[order[k:]] = ends(plus[:, k:], minus[:, k:], m[k:], n[k:])
            order, m, n, bound, later, plus, minus, count = order[:k], m[:k], n[:k], bound[:k], later[:, :k], plus[:, :k], minus[:, :k], k
            continue
        first, last = max(0, (j - band) // 64), min(blocks, (j + band) // 64 + 1)
        if j and j % STEP == 0:
            # By eight rows: the least value among them, and the least way from one of them to the end.
            up, down = (np.ascontiguousarray(side[first:last].T).view(np.uint8) for side in (plus, minus))
            value = _LEAST[up.astype(np.uint16) << 8 | down].astype(np.int16)
            steps = np.bitwise_count(up).astype(np.int16) - np.bitwise_count(down)
            value[:, 1:] += np.cumsum(steps[:, :-1], axis=1, dtype=np.int16)
            before = np.bitwise_count(plus[:first]).sum(0, dtype=np.int64) - np.bitwise_count(minus[:first]).sum(0, dtype=np.int64)
            way = (m - n + j - 64 * first).astype(np.int16)[:, None] - 8 * np.arange(value.shape[1], dtype=np.int16)
            value += np.maximum(np.maximum(way - 8, -way), 0)
            least = j + before + value.min(1)
            stay = np.flatnonzero(least <= bound)
            if len(stay) < 0.9 * count:
                gone = np.setdiff1d(np.arange(count), stay)
                out[order[gone]] = least[gone]
                order, m, n, bound, later, plus, minus, count = order[stay], m[stay], n[stay], bound[stay], later[:, stay], plus[:, stay], minus[:, stay], len(stay)
                if not count:
                    break
                band = int(bound.max())
        at = np.ascontiguousarray(equal.take(later[j], 0).T)
        up, down = np.ones(count, tv.U), np.zeros(count, tv.U)
        if len(x) != count:
            x, y, z = (np.empty(count, tv.U) for _ in range(3))
        for w in range(first, last):
            pv, mv, eq = plus[w], minus[w], at[w]
            # x: eq | mv; y: xh; z: ph.
            np.bitwise_or(eq, mv, out=x)
            np.bitwise_or(eq, down, out=eq)
            np.bitwise_and(eq, pv, out=y)
            np.add(y, pv, out=y)
            np.bitwise_xor(y, pv, out=y)
            np.bitwise_or(y, eq, out=y)
            np.bitwise_or(y, pv, out=z)
            np.invert(z, out=z)
            np.bitwise_or(z, mv, out=z)
            np.bitwise_and(y, pv, out=y)  # mh
            np.left_shift(z, one, out=eq)
            np.bitwise_or(eq, up, out=eq)
            np.right_shift(z, top, out=up)
            np.left_shift(y, one, out=z)
            np.bitwise_or(z, down, out=z)
            np.right_shift(y, top, out=down)
            np.bitwise_and(eq, x, out=mv)
            np.bitwise_or(x, eq, out=x)
            np.invert(x, out=x)
            np.bitwise_or(x, z, out=pv)
        j += 1
    return out


def near_pairs(pairs: list[tuple[str, str]], threshold: float, bound: bool = True) -> np.ndarray:
    """Whether the edit similarity of each pair of texts reaches the threshold; ``bound`` saves time where most do."""
    out, open_ = np.zeros(len(pairs), bool), []
    for k, (a, b) in enumerate(pairs):
        most = int((1 - threshold) * max(len(a), len(b), 1) + 1e-9)
        if abs(len(a) - len(b)) > most:
            continue
        out[k] = _bound(a, b, most) <= most if bound else a == b
        if not out[k]:
            open_.append((len(a) + len(b), k, most))
    # Texts of like length go together, so many at once that their bit vectors stay small.
    open_.sort()
    while open_:
        some = open_[-max(1, min(BATCH, TABLE // (open_[-1][0] * 8))) :]
        # A column's steps cost as much for few pairs as for many: a few of the longest are done one by one.
        longest = some[bisect.bisect_left(some, (some[-1][0] * 3 // 4,)) :]
        alone = len(longest) < max(FEW, some[-1][0] // FEW_OF)
        some = longest if alone else some
        del open_[-len(some) :]
        if alone:
            for _, k, most in some:
                out[k] = edit_distance(*pairs[k], most) <= most
            continue
        bounds = np.array([most for *_, most in some])
        out[[k for _, k, _ in some]] = _distances([pairs[k] for _, k, _ in some], bounds) <= bounds
    return out


def is_near(a: str, b: str, threshold: float) -> bool:
    return bool(near_pairs([(a, b)], threshold)[0])


def _text_key():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _short_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _places(short: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Hashes of lines by their text's short key and number."""
    return tv.mix(short.view(tv.U) + line.astype(tv.U) * tv.STEP[7]).astype(np.int64)


PACKED = [f"l{k}" for k in range(LOWS // 2)]


def line_decisions(docs: DataFrame, min_words: int = MIN_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, n_lines, removed): the numbers, from 0, of each text's lines that go.

    A row for each different (doc_id, text); rows equal in both are one.  n_lines counts all lines,
    one more than line ends; null and empty texts have one, and none goes.  Lines without a word stay.
    Equal normalised lines are repeats at any length; near ones are sought from ``min_words`` words on.
    key: md5 of the text.  Null ids count after all others.  Texts may be of any length; an empty table
    gives no row; columns other than doc_id and text are ignored, whatever their names.
    """
    narrow = docs.select("doc_id", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = b.column(2).to_numpy(zero_copy_only=False)
            for i, j, buf, at in tv.chunks(b.column(3)):
                x = Lines(*normalise(buf, at))
                # A row of line -1 for each text, with its number of lines.
                n = j - i
                with_own = lambda own, more: pa.array(np.concatenate([own, np.asarray(more, own.dtype)]))  # noqa: E731, B023
                of = with_own(np.arange(n) + i, x.row + i)
                low = x.lows().view(np.int64)
                zero = np.zeros(n, np.int64)
                cols = [with_own(np.full(n, -1, np.int32), x.line.astype(np.int32)), with_own(zero, _places(short[x.row + i], x.line)), with_own(zero, x.h1), with_own(zero, x.h2), with_own(zero, x.sims())]
                cols += [with_own(x.n_lines, x.chars()), with_own(zero, x.size), *(with_own(zero, low[:, k]) for k in range(LOWS // 2))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), *cols], ["doc_id", "key", "line", "place", "h1", "h2", "sim", "chars", "words", *PACKED])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    keyed = narrow.select("doc_id", _text_key().alias("key"), _short_key().alias("short"), "text")
    found = cut(keyed.mapInArrow(split, f"doc_id {kind}, key binary, line int, place long, h1 long, h2 long, sim long, chars long, words long, {', '.join(f'{c} long' for c in PACKED)}"), "lines")
    each = found.filter("line >= 0")
    nodes = each.groupBy("h1", "h2").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("place", "sim", "chars", "words", *PACKED)))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "line-nodes")
    joined = _join_near(narrow, nodes.filter(F.col("words") >= min_words), threshold)
    several = nodes.join(joined, nodes["node"] == joined["vertex"], "left").filter("n > 1 or component is not null")
    hit = each.join(several.select("h1", "h2", F.coalesce("component", "node").alias("group")), ["h1", "h2"])
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line")
    hit = cut(hit.select("group", place.alias("place")), "line-groups")
    stays = hit.groupBy("group").agg(F.min("place").alias("stays"))
    gone = hit.join(stays, "group").filter("place <> stays").select("place.doc_id", "place.key", "place.line")
    gone = gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    every = found.filter("line < 0").select("doc_id", "key", F.col("chars").alias("n_lines")).distinct()
    same = every["doc_id"].eqNullSafe(gone["doc_id"]) & (every["key"] == gone["key"])
    return every.join(gone, same, "left").select(every["doc_id"], every["key"], "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def _closeness(threshold: float) -> links.Closeness:
    def of(rows: pa.Table):
        sim, chars = rows.column("sim").to_numpy().view(tv.U), rows.column("chars").to_numpy()
        low = tv.buffers(rows.column("low"))[0].reshape(-1, LOWS)
        long = rows.column("words").to_numpy() >= LONG
        far, agree = np.where(long, FAR_LONG, FAR), np.where(long, AGREE_LONG, AGREE)

        def test(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            apart = np.bitwise_count(sim[i] ^ sim[j]).astype(np.int64)
            near = np.flatnonzero((apart <= np.maximum(far[i], far[j])) & (np.minimum(chars[i], chars[j]) >= threshold * np.maximum(chars[i], chars[j]) - 1e-9))
            a, b = i[near], j[near]
            same = (low[a] == low[b]).sum(1)
            out = np.full(len(i), -1)
            lead = same - apart[near]
            alike = (same >= np.minimum(agree[a], agree[b])) & ((lead >= LEAD) | ~(long[a] & long[b]))
            out[near] = np.where(alike, lead + FAR, -1)
            return out

        return test

    return of


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(bucket, order, sim, chars, words, low, node): the nodes in each bucket that several of them share, and few alone in theirs."""

    def lows(b: pa.RecordBatch) -> np.ndarray:
        return np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(len(PACKED))], 1).view(np.uint32).reshape(b.num_rows, LOWS)

    def all_keys(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield keys(lows(b), b.column(len(PACKED)).to_numpy(zero_copy_only=False))[1], None

    twice = nodes.sparkSession.sparkContext.broadcast(tv.bit_map(tv.repeated(nodes.select(*PACKED, "words"), all_keys, nodes.count() * BANDS), "hash"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = lows(b)
            at, key = keys(low, b.column(len(PACKED)).to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(tv.in_map(twice.value, key))
            at, key = at[hit], key[hit]
            last = low.astype(np.uint8)
            of = pa.array(at)
            cols = [pa.array(key), pa.array(np.zeros(len(at), np.int64)), *(b.column(len(PACKED) + k).take(of) for k in (1, 2, 0)), pa.array([x.tobytes() for x in last], pa.binary()).take(of), b.column(len(PACKED) + 3).take(of)]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "order", "sim", "chars", "words", "low", "node"])

    return cut(nodes.select(*PACKED, "words", "sim", "chars", "node").mapInArrow(pick, "bucket long, order long, sim long, chars long, words long, low binary, node long"), "line-buckets")


def _join_near(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(vertex, component) of the line nodes that links join."""

    @F.arrow_udf("boolean")
    def near(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(near_pairs(list(zip(a.to_pylist(), b.to_pylist())), threshold))

    read: list[DataFrame] = []

    def verify(pairs: DataFrame, later: DataFrame | None = None) -> DataFrame:
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        wanted = (ends if later is None else ends.unionByName(later)).distinct()
        if read:
            wanted = cut(wanted.join(read[-1], "node", "left_anti"), "wanted")
        if not read or not wanted.isEmpty():
            new = _bodies(docs, cut(wanted.join(nodes.select("node", "h1", "h2", "place"), "node"), "wanted"))
            read.append(cut(read[-1].unionByName(new), "bodies") if read else new)
        bodies = read[-1]
        both = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("ta")), "a").join(bodies.select(F.col("node").alias("b"), F.col("body").alias("tb")), "b")
        return both.filter(near("ta", "tb")).select("a", "b")

    own = lambda wanted: read[-1].join(wanted, "node").join(nodes.select("node", *PACKED), "node")
    inside = links.Inside(own, _all_keys, _near(threshold), "chars", 4 * BATCH)
    return links.join_close(bucket_rows(nodes), _closeness(threshold), verify, links.turn("low", LOWS, ORDERS, "order"), MOST, FURTHER, inside=inside)


def _all_keys(rows: pa.Table) -> np.ndarray:
    low = np.stack([rows.column(c).to_numpy() for c in PACKED], 1).view(np.uint32).reshape(rows.num_rows, LOWS)
    return key_table(low, rows.column("words").to_numpy())[0]


def _near(threshold: float):
    """Most pairs that are left for the last round are no links."""

    def of(rows: pa.Table):
        body = rows.column("body").combine_chunks()
        text = lambda at: body.take(pa.array(at)).to_pylist()
        return lambda i, j: near_pairs(list(zip(text(i), text(j))), threshold, False)

    return of


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, body): the normalised line of each wanted (node, h1, h2, place).

    The texts are read once more; a bit map of the wanted places keeps most other lines from being
    looked at, and the join drops the rest.
    """
    bits = docs.sparkSession.sparkContext.broadcast(tv.bit_map(wanted, "place"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, at in tv.chunks(b.column(1)):
                start, end, doc, line = tv.lines(buf, at)
                hit = np.flatnonzero(tv.in_map(bits.value, _places(short[doc + i], line)))
                if not len(hit):
                    continue
                own = [buf[start[k] : end[k]] for k in hit]
                x = Lines(*normalise(np.concatenate(own), np.cumsum([0, *map(len, own)])))
                yield pa.RecordBatch.from_arrays([pa.array(x.h1), pa.array(x.h2), pa.array([x.body(k) for k in range(len(x.heads))], pa.string())], ["h1", "h2", "body"])

    lines = docs.select(_short_key().alias("short"), "text").mapInArrow(pick, "h1 long, h2 long, body string").groupBy("h1", "h2").agg(F.min("body").alias("body"))
    return cut(lines.join(wanted, ["h1", "h2"]).select("node", "body"), "bodies")


def drop_lines(docs: DataFrame, **settings) -> DataFrame:
    """The documents without the lines that go, with all their columns; n_chars follows the text if there is one.

    Every document stays, even one whose lines all go: its text is then empty.
    """
    key, text_key, doc, removed = fresh(docs, "_key", "_text_key", "_doc", "_removed")
    gone = line_decisions(docs, **settings).filter(F.size("removed") > 0).select(F.col("doc_id").alias(doc), F.col("key").alias(text_key), F.col("removed").alias(removed))
    both = docs.withColumn(key, _text_key()).join(gone, (F.col(key) == F.col(text_key)) & F.col("doc_id").eqNullSafe(F.col(doc)), "left")
    hit = F.col(removed).isNotNull()
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(removed, i))
    both = both.withColumn("text", F.when(hit, F.array_join(kept, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(*docs.columns)
