"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs of word bytes (ASCII letters, digits, ``_+/.~-`` and all non-ASCII bytes) and runs
of other marks; white space parts them.  The field labels each token O (outside), B (first token of
a secret) or I (inside one).  Its potentials are sums of weights of categorical features: the
token's shape and length, a lexicon of words that stand near secrets for the token and its
neighbours on both sides, the neighbours' shapes, and features of the whole text.  Decoding is
exact: Viterbi runs over every token of every text.  It runs as a max-plus product, for all blocks
of 64 tokens at once, then over the blocks, then back through them.

The weights are fitted here, by the likelihood's gradient with forward-backward sums, on labelled
lines that a seeded generator makes from statement shapes; their number is a parameter (``examples``).
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hunkwise.llm import textvec as tv

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "crf")
O, B, I = range(3)
BLOCK = 64
EXAMPLES = 1500

# Words and marks that stand near secrets or near things that resemble them.
LEXICON = (
    "password passwd pwd secret token apikey api_key api key bearer authorization auth access private credential credentials "
    "login user username client_secret begin end rsa openssh aws github slack stripe connection "
    "commit sha sha1 sha256 md5 hash checksum digest uuid guid id version http https url file image "
    "= : \" ' => := =\" :\" ': \": == ; , ( ) - ://"
).split()
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "AIza", "eyJ", "glpat-")

SPACE_, WORD_, MARK_ = 0, 1, 2
_GROUP = np.full(256, MARK_, np.int8)
_GROUP[tv.SPACE] = SPACE_
_GROUP[[ord(c) for c in string.ascii_letters + string.digits + "_+/.~-"]] = WORD_
_GROUP[128:] = WORD_
_SORT = np.full(256, 3, np.int8)  # lower, upper, digit, mark, non-ASCII
for _k, _cs in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)):
    _SORT[[ord(c) for c in _cs]] = _k
_SORT[128:] = 4
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


def _hash_words(words) -> np.ndarray:
    data = [w.encode() for w in words]
    buf = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    end = np.cumsum([len(d) + 1 for d in data]) - 1
    return tv.span_hash(tv.prefix(buf, tv.LOWER), end - [len(d) for d in data], end)


_LEX_HASH = _hash_words(LEXICON)
_LEX_ORDER = np.argsort(_LEX_HASH)
_LEX_SORTED = _LEX_HASH[_LEX_ORDER]
LEX = len(LEXICON) + 1


class Tokens:
    """Byte ``start`` and ``end`` of a chunk's tokens, and ``first``, the rows' token offsets."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        g = np.zeros(len(buf) + 2, np.int8)
        g[1:-1] = _GROUP[buf]
        change = g[1:] != g[:-1]
        change[at] = True
        self.start = np.flatnonzero(change & (g[1:] != SPACE_))
        self.end = np.flatnonzero(change & (g[:-1] != SPACE_))
        self.group = g[1:][self.start]
        self.first = np.searchsorted(self.start, at)
        self.buf, self.at = buf, at


def _bucket(x: np.ndarray, edges) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), x, "right")


def _shift(x: np.ndarray, by: int, doc: np.ndarray, fill: int) -> np.ndarray:
    """x of the token ``by`` places on (back if negative) in the same text, else ``fill``."""
    out = np.full(len(x), fill, x.dtype)
    if abs(by) < len(x):
        to, of = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
        out[to] = np.where(doc[to] == doc[of], x[of], fill)
    return out


#: Sizes of the feature groups that ``features`` makes, in its order.
SIZES = [9 * 32, 9 * 4, 9 * 6, LEX, LEX, LEX, LEX, LEX, 12, 12, 4 * 3 * 3, len(PREFIXES) + 1]
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])


def features(t: Tokens) -> list[np.ndarray]:
    """For each feature group the weight row of each token."""
    buf, n = t.buf, len(t.start)
    length = t.end - t.start
    sort = _SORT[buf]
    counts = []
    for k in range(5):
        run = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(sort == k, out=run[1:])
        counts.append(run[t.end] - run[t.start])
    run = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(_HEX[buf], out=run[1:])
    all_hex = run[t.end] - run[t.start] == length
    run = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(sort[1:] != sort[:-1], out=run[2:])
    turns = run[t.end] - run[np.minimum(t.start + 1, len(buf))]
    lower, upper, digit, mark, other = (c > 0 for c in counts)

    size = _bucket(length, [2, 4, 8, 12, 16, 24, 32, 48])
    shape = lower + 2 * upper + 4 * digit + 8 * mark + 16 * other
    hexed = np.where(all_hex, 1 + digit + (digit & (counts[0] > 0)), 0)
    turning = np.where(length > 1, _bucket(turns / np.maximum(length, 1), [0.02, 0.1, 0.2, 0.35, 0.5]), 0)
    h = tv.span_hash(tv.prefix(buf, tv.LOWER), t.start, t.end)
    at = np.minimum(np.searchsorted(_LEX_SORTED, h), LEX - 2)
    lex = np.where(_LEX_SORTED[at] == h, _LEX_ORDER[at] + 1, 0)
    doc = np.repeat(np.arange(len(t.at) - 1), np.diff(t.first))
    odd = digit & (lower | upper) & (length >= 8)
    kind = np.where(t.group == MARK_, 1 + np.minimum(length, 2) - 1, np.where(odd, 3 + (length >= 16), np.where(digit, 5, np.where(upper & ~lower, 6, np.where(upper, 7, 8)))))
    rows = len(t.at) - 1
    total = np.maximum(np.bincount(doc, minlength=rows), 1)
    share = [np.bincount(doc[m], minlength=rows) / total for m in (odd, t.group == MARK_, upper & ~lower)]
    whole = (_bucket(share[0], [0.005, 0.05, 0.2]) * 3 + _bucket(share[1], [0.15, 0.35])) * 3 + _bucket(share[2], [0.1, 0.5])
    prefix = np.zeros(n, np.int64)
    for k, p in enumerate(PREFIXES, 1):
        b = p.encode()
        ok = length > len(b)
        for j, c in enumerate(b):
            ok &= buf[np.minimum(t.start + j, len(buf) - 1)] == c
        prefix[ok] = k
    groups = [
        size * 32 + shape, size * 4 + hexed, size * 6 + turning,
        lex, _shift(lex, -1, doc, 0), _shift(lex, -2, doc, 0), _shift(lex, -3, doc, 0), _shift(lex, 1, doc, 0),
        _shift(kind, -1, doc, 0), _shift(kind, 1, doc, 0), whole[doc], prefix,
    ]
    return [g + o for g, o in zip(groups, OFFSETS)]


def potentials(t: Tokens, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(t.start), 3), np.float32)
    for rows in features(t):
        out += weights[rows]
    return out


def _steps(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(tokens, 3, 3): what it adds to go from a label to a label at each token; a text's first token has no label before."""
    out = trans[None] + emit[:, None, :]
    heads = first[:-1][np.diff(first) > 0]
    out[heads] = (begin + emit[heads])[:, None, :]
    return out


def viterbi(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The best labels of all tokens of a chunk's texts, exactly."""
    n = len(emit)
    if not n:
        return np.zeros(0, np.int8)
    blocks = -(-n // BLOCK)
    steps = np.zeros((blocks * BLOCK, 3, 3), np.float32)
    steps[:n] = _steps(emit, first, trans, begin)
    steps[n:] = np.where(np.eye(3, dtype=bool), 0, -1e9)
    steps = steps.reshape(blocks, BLOCK, 3, 3)
    best = np.broadcast_to(np.where(np.eye(3, dtype=bool), 0, -1e9).astype(np.float32), (blocks, 3, 3))
    back = np.empty((BLOCK, blocks, 3, 3), np.int8)
    for k in range(BLOCK):
        via = best[:, :, :, None] + steps[:, k][:, None]  # block, label at the block's start, before, after
        back[k] = via.argmax(2)
        best = via.max(2)
    score, came = np.zeros(3, np.float64), []
    for m in best.astype(np.float64):
        via = score[:, None] + m
        p = via.argmax(0)
        came.append(p)
        score = via[p, (0, 1, 2)]
        score -= score.max()
    ends, starts = np.empty(blocks, np.int64), np.empty(blocks, np.int64)
    label = int(score.argmax())
    for k in range(blocks - 1, -1, -1):
        ends[k] = label
        starts[k] = label = int(came[k][label])
    out = np.empty((blocks, BLOCK), np.int8)
    now, every = ends, np.arange(blocks)
    for k in range(BLOCK - 1, -1, -1):
        out[:, k] = now
        now = back[k, every, starts, now]
    return out.reshape(-1)[:n]


def _examples(n: int, seed: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Labelled lines: a text and the byte spans of its secrets."""
    r = random.Random(seed)
    hexa, b64, alnum, caps = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    pick = lambda cs, k: "".join(r.choice(cs) for _ in range(k))
    word = lambda: pick(string.ascii_lowercase + ("éèüñä" if r.random() < 0.2 else ""), r.randint(1, 16)) if r.random() < 0.8 else r.choice("the of and to in der die und de la le que is token key password secret file user".split())
    say = lambda k: " ".join(w.capitalize() if r.random() < 0.1 else w.upper() if r.random() < 0.04 else w + r.choice(".,;!###&&&%%%") if r.random() < 0.15 else w for w in (word() for _ in range(r.randint(0, k))))

    def secret() -> str:
        return r.choice((
            lambda: pick(hexa, r.choice((32, 40, 64))), lambda: "AKIA" + pick(caps, 16), lambda: "ghp_" + pick(alnum, 36),
            lambda: "sk-" + pick(alnum, r.randint(24, 48)), lambda: pick(b64, r.randint(20, 60)) + r.choice(("", "=", "==")),
            lambda: "eyJ" + ".".join(pick(alnum, r.randint(20, 60)) for _ in range(3)), lambda: pick(b64, r.randint(40, 90)), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick(string.digits, 11) + "-" + pick(alnum, 24),
            lambda: pick(alnum, r.randint(12, 32)),
        ))()

    def plain() -> str:
        return r.choice((
            lambda: f"commit {pick(hexa, 40)}", lambda: f"sha256: {pick(hexa, 64)}", lambda: f"md5 {pick(hexa, 32)}",
            lambda: f"{pick(string.digits, 4)}-{pick('01', 2)}-{pick('012', 2)}", lambda: f"https://{word()}.example.com/{word()}/{pick(string.digits, 5)}?ref={word()}",
            lambda: f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", lambda: f"{word()}.{pick(string.digits, 2)}@mail{pick(string.digits, 1)}.example.com",
            lambda: pick(string.digits, r.randint(3, 18)), lambda: f"+1 ({pick(string.digits, 3)}) {pick(string.digits, 3)}-{pick(string.digits, 4)}", lambda: f"{pick(string.digits, 3)}.{pick(string.digits, 3)}.{pick(string.digits, 2)}.{pick(string.digits, 3)}",
            lambda: f"{word()} = {word()}", lambda: f"key: {word()}", lambda: f"the {r.choice(('token', 'password', 'secret', 'key'))} {word()} {word()}", lambda: f"version {pick('0123456789', 1)}.{pick('0123456789', 2)}.0-rc{pick('123', 1)}",
            lambda: f"{r.choice(('token', 'password', 'secret', 'key'))} = {word()}.{word()}_{r.choice(('token', 'password', 'key'))}()", lambda: f"{r.choice(('password', 'api_key'))}={word()}({word()}_{word()})", lambda: f"{word()}.{word()}({word()}) {word()}_{word()}.{word()}",
            lambda: f"{word()}_{word()}{pick(string.digits, 2)}.{r.choice(('py', 'txt', 'html'))}", lambda: pick(string.ascii_lowercase, r.randint(17, 40)), lambda: pick(string.ascii_uppercase, r.randint(4, 24)),
        ))()

    out = []
    for _ in range(n):
        parts: list[tuple[str, bool]] = [(say(14), False)]
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            s, q = secret(), r.choice(("", '"', "'"))
            name = r.choice(("token", "secret", "password", "api_key", "apikey", "passwd", "pwd", "client_secret", "private_key", "auth", "credential", "API_KEY", "AWS_SECRET", "Authorization"))
            if r.random() < 0.3:
                name = f"{r.choice(('AWS', 'DB', 'GITHUB', 'STRIPE', 'APP', 'SMTP'))}_{r.choice(('SECRET', 'TOKEN', 'PASSWORD', 'KEY', 'SECRET_ACCESS_KEY', 'PRIVATE_KEY'))}"
            if r.random() < 0.2:
                name = f"export {name}"
            form = r.random()
            if form < 0.45:
                lead = f"{name}{r.choice((' = ', '=', ': ', ' : ', '": '))}{q}"
            elif form < 0.65:
                lead, q = r.choice(("Authorization: Bearer ", "Bearer ", "Authorization: Basic ", "-----BEGIN RSA PRIVATE KEY----- ", "-----BEGIN OPENSSH PRIVATE KEY----- ")), ""
            elif form < 0.8:
                lead, q = f"{r.choice(('postgres', 'mysql', 'redis', 'amqp'))}://{r.choice((word(), ''))}:", f"@{word()}.{r.choice(('local', 'internal', 'example.com'))}"
                s = pick(alnum, r.randint(10, 20))
            else:
                lead = f"{r.choice(('access', 'login', 'github', 'stripe', 'aws', 'key', 'user', 'jwt'))} {r.choice(('key ', 'token ', 'secret ', 'is ', '', 'password '))}"
                s = r.choice(("AKIA" + pick(caps, 16), "ghp_" + pick(alnum, 36), "sk-" + pick(alnum, 32), "eyJ" + ".".join(pick(alnum, r.randint(20, 60)) for _ in range(3))))
            parts += [(" " + lead, False), (s, True), (q + " " + say(8), False)]
        for _ in range(r.choice((0, 1, 2))):
            parts.insert(r.choice([k for k in range(len(parts) + 1) if k in (0, len(parts))]), (" " + plain() + " ", False))
        text, spans = b"", []
        for s, hit in parts:
            b = s.encode()
            if hit:
                spans.append((len(text), len(text) + len(b)))
            text += b
        out.append((text, spans))
    return out


def _labels(t: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """A token that overlaps a secret is of it."""
    y = np.zeros(len(t.start), np.int64)
    for row, own in enumerate(spans):
        for a, b in own:
            a, b = a + t.at[row], b + t.at[row]
            hit = np.flatnonzero((t.start < b) & (t.end > a))
            y[hit[:1]], y[hit[1:]] = B, I
    return y


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


@functools.lru_cache(4)
def fit(examples: int = EXAMPLES, seed: int = 7, rounds: int = 120, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature weights, transitions, begin) by full-batch gradient steps on the mean log-likelihood."""
    made = _examples(examples, seed)
    arr = pa.array([t for t, _ in made], pa.binary())
    buf, at = tv.buffers(arr)
    t = Tokens(buf, at)
    y = _labels(t, [s for _, s in made])
    rows = features(t)
    first, count = t.first[:-1], np.diff(t.first)
    longest, live = int(count.max()), count > 0
    place = np.minimum(first[:, None] + np.arange(longest)[None], len(y) - 1)  # example x time
    inside = np.arange(longest)[None] < count[:, None]
    w, trans, begin = np.zeros((OFFSETS[-1], 3)), np.zeros((3, 3)), np.zeros(3)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, trans, begin)]
    gold = np.zeros((len(y), 3))
    gold[np.arange(len(y)), y] = 1
    for step in range(1, rounds + 1):
        emit = sum(w[g] for g in rows)
        e = emit[place]
        fwd = np.empty((len(first), longest, 3))
        fwd[:, 0] = begin + e[:, 0]
        for k in range(1, longest):
            fwd[:, k] = np.where(inside[:, k, None], _log_sum(fwd[:, k - 1, :, None] + trans, 1) + e[:, k], fwd[:, k - 1])
        z = _log_sum(fwd[:, -1], 1)
        bwd = np.zeros((len(first), longest, 3))
        for k in range(longest - 2, -1, -1):
            bwd[:, k] = np.where(inside[:, k + 1, None], _log_sum(trans + (e[:, k + 1] + bwd[:, k + 1])[:, None], 2), 0)
        unary = np.exp(fwd + bwd - z[:, None, None]) * inside[:, :, None]
        d_emit = np.zeros((len(y), 3))
        d_emit[place[inside]] = unary[inside]
        d_emit = gold - d_emit
        d_w = np.stack([sum(np.bincount(g, d_emit[:, c], len(w)) for g in rows) for c in range(3)], 1)
        d_trans = np.zeros((3, 3))
        for k in range(1, longest):
            on = inside[:, k]
            if on.any():
                pair = fwd[on, k - 1, :, None] + trans + (e[on, k] + bwd[on, k])[:, None] - z[on, None, None]
                d_trans -= np.exp(pair).sum(0)
        same = np.ones(len(y), bool)
        same[first[live]] = False
        both = np.flatnonzero(same)
        np.add.at(d_trans, (y[both - 1], y[both]), 1)
        d_begin = (gold[first[live]] - unary[live, 0]).sum(0)
        for x, d, (m, v) in zip((w, trans, begin), (d_w, d_trans, d_begin), state):  # Adam
            d = d / len(made) - decay * x
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w.astype(np.float32), trans.astype(np.float32), begin.astype(np.float32)


def _hex_runs(buf: np.ndarray, at: np.ndarray, least: int = 32) -> list[tuple[int, int]]:
    m = np.zeros(len(buf) + 2, bool)
    m[1:-1] = _HEX[buf]
    cut = m[1:] != m[:-1]
    inner = np.zeros(len(buf) + 1, bool)
    inner[at] = True
    start = np.flatnonzero(m[1:] & (cut | inner))
    end = np.flatnonzero(m[:-1] & (cut | inner))
    ok = end - start >= least
    return list(zip(start[ok].tolist(), end[ok].tolist()))


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) by bytes of the assign and access patterns in one text."""
    out = []
    low = data.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(data) if m.end() - m.start() >= 16]
    return out


#: Bytes of the shortest secret that the field reports, as in the assign pattern: a shorter one is hard to tell from a word.
LEAST = 8


def crf_spans(t: Tokens, labels: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Byte spans of the labelled secrets of ``least`` bytes or more; an I without a B before it begins one."""
    hot = np.flatnonzero(labels)
    out: list[tuple[int, int]] = []
    last = -2
    for k in hot.tolist():
        if labels[k] == I and last == k - 1 and k not in t.first:
            out[-1] = (out[-1][0], int(t.end[k]))
        else:
            out.append((int(t.start[k]), int(t.end[k])))
        last = k
    trimmed = []
    for a, b in out:  # a sentence's marks around a secret are not part of it
        while b > a and chr(t.buf[b - 1]) in ".,;:!?\"')#&%$*":
            b -= 1
        while a < b and chr(t.buf[a]) in "\"'(:=":
            a += 1
        if b - a >= least:
            trimmed.append((a, b))
    return trimmed


SCHEMA = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string,n_crf:bigint>"


def scan_column(examples: int = EXAMPLES, seed: int = 7):
    """A function of a text column to a struct: counts by kind, the base spans' digest, and all spans."""
    weights, trans, begin = fit(examples, seed)

    def chunk(buf: np.ndarray, at: np.ndarray) -> list[tuple]:
        n, data = len(at) - 1, buf.tobytes()
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        low = data.lower()
        if b"AKIA" in data or any(h in low for h in HINTS):
            for i in range(n):
                a = int(at[i])
                found[i] += [(a + s, a + e, k) for s, e, k in base_spans(data[a : int(at[i + 1])])]
        for s, e in _hex_runs(buf, at):
            found[int(np.searchsorted(at, s, "right")) - 1].append((s, e, 2))
        t = Tokens(buf, at)
        labels = viterbi(potentials(t, weights), t.first, trans, begin)
        more = crf_spans(t, labels)
        for s, e in more:
            own = found[int(np.searchsorted(at, s, "right")) - 1]
            if not any(x[2] < 3 and s < x[1] and x[0] < e for x in own):
                own.append((s, e, 3))
        point = tv.code_points(buf, at) if any(found) else None
        out = []
        for i, own in enumerate(found):
            if not own:
                out.append((0, 0, 0, EMPTY, "", 0))
                continue
            own.sort(key=lambda x: (x[0], x[2]))
            zero = point[at[i]]
            said = [(k, f"{KINDS[k]}:{point[s] - zero}:{point[e] - zero}") for s, e, k in own]
            base = ",".join(x for k, x in said if k < 3)
            n_of = [sum(k == j for k, _ in said) for j in range(4)]
            out.append((n_of[0], n_of[1], n_of[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said), n_of[3]))
        return out

    @F.arrow_udf(SCHEMA)
    def scan(text: pa.Array) -> pa.Array:
        rows = [r for _, _, buf, at in tv.chunks(text) for r in chunk(buf, at)]
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)

    return scan


EMPTY = hashlib.sha256(b"").hexdigest()


def scan(docs: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf: a row for each document.

    Spans are ``kind:start:end`` in code points, by start, then kind.  Base spans (assign, access,
    hex) are all matches of the patterns; the field's own spans (crf) are those of ``LEAST`` bytes or
    more that overlap no base span.  Null text counts as empty and has none.  Spans of one start stand
    in the order of kinds; labels of equal score go to the earlier one.  Repeated rows are scanned each;
    an empty table gives no row.  Texts may be of any length, and are tagged as one sequence.  Columns
    other than doc_id and text are ignored, whatever their names.
    """
    return docs.select("doc_id", scan_column(examples)("text").alias("s")).select("doc_id", "s.*")
