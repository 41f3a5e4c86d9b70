"""Quality rules: word statistics, and Jensen-Shannon distance to language references.

Two histograms describe a text: its characters by class, and its words by a short list of common
words with all other words in one further bin.  A language's reference is the sum of both over all
documents of that language in the table (the languages below; every other value, null included, is
pooled as one more).  A text is rejected where the square root of the Jensen-Shannon divergence (in
bits, so 0 to 1) to its language's reference exceeds a limit for either histogram.  Short texts have
noisy histograms: the limit for words falls with the square root of their number, as the distance of a
sample to its own source does, and below a minimum length the distances decide nothing.

The references are a few hundred sums whatever the input, gathered by one aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hunkwise.llm import textvec as tv
from hunkwise.session import fresh

# Common words by language.
COMMON = {
    "en": "the of and to a in is it that for on was with as be at by this are from or an not have you they which but his her".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par pas sur au plus avec ce il sont elle se ou son ne aux".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo como más o pero sus le ha me si sin".split(),
}
LANGS = [*COMMON, ""]
WORDS = sorted({w for ws in COMMON.values() for w in ws})
CLASSES = 10
#: The limit for characters, that for words (a constant and a part over the root of their number), and the least words.
CHAR_LIMIT, WORD_LIMIT, MIN_WORDS = 0.30, (0.19, 2.2), 60


def _class_table() -> np.ndarray:
    """Class of each byte: space, lower, upper, digit, sentence mark, other ASCII, and by lead byte Latin, other 2-byte, 3-byte, 4-byte; -1 within a code point."""
    t = np.full(256, -1, np.int64)
    t[:128] = 5
    t[[9, 10, 11, 12, 13, 32]] = 0
    t[97:123], t[65:91], t[48:58] = 1, 2, 3
    t[[ord(c) for c in ".,;:!?'\"()-"]] = 4
    t[0xC2], t[0xC3:0xC6], t[0xC6:0xE0], t[0xE0:0xF0], t[0xF0:] = 5, 6, 7, 8, 9
    return t


CLASS = _class_table()
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?'\"()"]] = True


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    data = [w.encode() for w in WORDS]
    buf = np.frombuffer(b" ".join(data), np.uint8)
    end = np.cumsum([len(d) + 1 for d in data]) - 1
    h = tv.span_hash(tv.prefix(buf, tv.LOWER), end - [len(d) for d in data], end)
    order = np.argsort(h)
    return h[order], order


HASHES, PLACES = _word_table()


def histograms(w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """(texts x classes, texts x (common words + 1)) counts.  One mark at a word's end is not part of it."""
    n = len(w.at) - 1
    cls = CLASS[w.buf]
    doc = np.repeat(np.arange(n), np.diff(w.at))
    ok = cls >= 0
    chars = np.bincount(doc[ok] * CLASSES + cls[ok], minlength=n * CLASSES).reshape(n, CLASSES)
    end = w.end - (_TRIM[w.buf[w.end - 1]] & (w.end - w.start > 1)) if len(w.end) else w.end
    h = tv.span_hash(tv.prefix(w.buf, tv.LOWER), w.start, end)
    at = np.minimum(np.searchsorted(HASHES, h), len(HASHES) - 1)
    word = np.where(HASHES[at] == h, PLACES[at], len(WORDS))
    m = len(WORDS) + 1
    return chars, np.bincount(w.doc * m + word, minlength=n * m).reshape(n, m)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row the square root of the Jensen-Shannon divergence in bits; 0 where either has no counts."""
    sp, sq = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    p, q = p / np.maximum(sp, 1), q / np.maximum(sq, 1)
    m = (p + q) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(1)

    d = np.sqrt(np.maximum(part(p) + part(q), 0) / 2)
    return np.where((sp[:, 0] > 0) & (sq[:, 0] > 0), d, 0.0)


def _language(langs: pa.Array) -> np.ndarray:
    known = {x: i for i, x in enumerate(LANGS)}
    return np.array([known.get(x, len(LANGS) - 1) for x in langs.to_pylist()], np.int64)


def references(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(languages x classes, languages x (common words + 1)) counts over all documents."""
    bins = CLASSES + len(WORDS) + 1

    def partial(batches):
        total = np.zeros((len(LANGS), bins))
        for b in batches:
            for i, j, buf, at in tv.chunks(b.column(1)):
                both = np.hstack(histograms(tv.Words(buf, at, hashed=False)))
                np.add.at(total, _language(b.column(0).slice(i, j - i)), both)
        lang, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(k, pa.int64()), pa.array(total[lang, k].astype(np.int64))], ["lang", "bin", "n"])

    sums = docs.select("lang", "text").mapInArrow(partial, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    out = np.zeros((len(LANGS), bins))
    for r in sums.collect():  # at most languages x bins
        out[r["lang"], r["bin"]] = r["n"]
    return out[:, :CLASSES], out[:, CLASSES:]


def _repeats(h: np.ndarray) -> np.ndarray:
    """Where values stand that occur more than once."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(h), bool)
    return twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h


def statistics(w: tv.Words) -> dict[str, np.ndarray]:
    """The counts of each text: words, their code points, symbols, repeated lines, words in repeated windows."""
    n, buf, at = len(w.at) - 1, w.buf, w.at
    point = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(tv.LEAD[buf] & ~tv.SPACE[buf], out=point[1:])
    symbol = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SYMBOL[buf], out=symbol[1:])
    salt = tv.mix(np.arange(1, n + 1, dtype=tv.U))

    newline = np.flatnonzero(buf == 10)
    begins = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], newline + 1]))
    begins = begins[begins < len(buf)]
    ends = np.minimum(np.concatenate([newline, [len(buf)]])[np.searchsorted(newline, begins)], at[np.searchsorted(at, begins, "right")])
    full = point[ends] > point[begins]
    begins, ends = begins[full], ends[full]
    line_doc = np.searchsorted(at, begins, "right") - 1
    h = tv.span_hash(w.sums, begins, ends) ^ salt[line_doc]
    order = np.argsort(h, kind="stable")
    later = np.zeros(len(h), bool)
    later[order[1:]] = h[order[1:]] == h[order[:-1]]
    dup = np.bincount(line_doc[later], minlength=n)

    i, g = w.windows(8)
    hit = i[_repeats(g ^ salt[w.doc[i]])]
    edge = np.zeros(len(w.start) + 9, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 8, -1)
    covered = np.cumsum(edge)[: len(w.start)] > 0
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": point[at[1:]] - point[at[:-1]],
        "n_symbols": symbol[at[1:]] - symbol[at[:-1]],
        "n_dup_lines": dup.astype(np.int64),
        "n_repeat_words": np.bincount(w.doc[covered], minlength=n).astype(np.int64),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = ", ".join(f"{c}: long" for c in COUNTS) + ", base_failed: boolean, char_distance: double, word_distance: double, kept: boolean"


def verdict(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: tuple[float, float] = WORD_LIMIT, min_words: int = MIN_WORDS) -> Column:
    """A struct column over docs' text and lang: the counts, both distances, base_failed and kept.

    Null and empty texts have no words and fail the base rule.  The references come from ``docs``;
    an empty table has none, and a distance to a reference without counts is 0.
    """
    ref_chars, ref_words = references(docs)

    @F.arrow_udf("struct<" + SCHEMA.replace(" long", "bigint").replace(" ", "") + ">")
    def judge(text: pa.Array, lang: pa.Array) -> pa.Array:
        parts: list[dict] = []
        for i, j, buf, at in tv.chunks(text):
            w = tv.Words(buf, at)
            s = statistics(w)
            chars, words = histograms(w)
            lg = _language(lang.slice(i, j - i))
            s["base_failed"] = (s["n_words"] < 20) | (100 * s["n_repeat_words"] > 30 * s["n_words"])
            s["char_distance"] = js_distance(chars, ref_chars[lg])
            s["word_distance"] = js_distance(words, ref_words[lg])
            most = word_limit[0] + word_limit[1] / np.sqrt(np.maximum(s["n_words"], 1))
            odd = (s["char_distance"] > char_limit) | (s["word_distance"] > most)
            s["kept"] = ~s["base_failed"] & ~(odd & (s["n_words"] >= min_words))
            parts.append(s)
        names = [c.split(":")[0] for c in SCHEMA.split(", ")]
        cols = [pa.array(np.concatenate([p[c] for p in parts])) if parts else pa.array([], pa.int64()) for c in names]
        return pa.StructArray.from_arrays(cols, names)

    return judge("text", "lang")


def score(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and the columns of ``verdict``, a row for each document.

    Null text counts as empty: no words, not kept.  A null or unknown language is judged by the pooled
    reference.  Texts may be of any length.  Repeated rows are kept; an empty table gives no row.  A
    distance at a limit is within it.  Columns other than doc_id, text and lang are ignored, whatever
    their names.
    """
    docs = docs.select("doc_id", "text", "lang")
    return docs.withColumn("v", verdict(docs, **limits)).select("doc_id", "v.*")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, with all their columns; the rest as in ``score``."""
    (v,) = fresh(docs, "_verdict")
    return docs.withColumn(v, verdict(docs, **limits)).filter(F.col(v)["kept"]).select(*docs.columns)
