"""GIF as a media column: writing, reading, compositing and colour histograms.

The reader takes any GIF87a or GIF89a: global and local palettes, interlaced rows, graphic controls
(delay, disposal, transparency), several frames, LZW streams of variable code width with early or
deferred clear codes.  The writer makes GIF89a with real LZW compression.

Code widths depend only on the number of codes since the last clear code, so the reader cuts a whole
run of codes out of the bit stream with array arithmetic before it follows them through the
dictionary.  A truncated or damaged stream gives the pixels before the damage, index 0 after.
Sizes come from a header that may be wrong: nothing of more than ``MOST_PIXELS`` pixels is made.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hunkwise.llm import textvec as tv

FULL = 4096
#: Bits of each colour channel that name a bin: 64 bins.
DEPTH = 2
BINS = 1 << 3 * DEPTH
MOST_PIXELS = 1 << 24


@dataclass
class Frame:
    pixels: np.ndarray  # rows x columns, palette indexes
    left: int = 0
    top: int = 0
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None
    palette: np.ndarray | None = None  # local, n x 3


@dataclass
class Gif:
    width: int
    height: int
    palette: np.ndarray | None = None
    background: int = 0
    loops: int | None = None
    frames: list[Frame] = field(default_factory=list)


_WIDTHS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _widths(least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the n codes after a clear code, and the n+1 bit places where they begin and end."""
    have = _WIDTHS.get(least)
    if have is None or len(have[0]) < n:
        k = np.arange(max(n, FULL))
        top = (1 << least) + 2 + np.maximum(k - 1, 0)
        w = np.clip(np.floor(np.log2(top)).astype(np.int64) + 1, least + 1, 12)
        _WIDTHS[least] = have = (w, np.concatenate([[0], np.cumsum(w)]))
    return have[0][:n], have[1][: n + 1]


def lzw_decode(data: bytes, least: int, size: int) -> bytes:
    """The ``size`` first bytes of an LZW stream with codes of ``least`` bits at first, fewer if it ends."""
    clear, stop = 1 << least, (1 << least) + 1
    d = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    bits, at, out, got = len(data) * 8, 0, [], 0
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    while got < size and at < bits:
        n = min(2 * FULL, bits // (least + 1) + 1)
        while True:
            w, place = _widths(least, n)
            n_in = int(np.searchsorted(place[1:], bits - at, "right"))
            o = at + place[:n_in]
            b = o >> 3
            codes = ((d[b] | d[b + 1] << 8 | d[b + 2] << 16) >> (o & 7).astype(np.uint32)) & ((1 << w[:n_in]) - 1).astype(np.uint32)
            ends = np.flatnonzero((codes == clear) | (codes == stop))
            if len(ends) or n_in < n:
                break
            n *= 4
        k = int(ends[0]) if len(ends) else n_in
        table, last = base.copy(), b""
        for c in codes[:k].tolist():
            if c < len(table):
                e = table[c]
            elif c == len(table) and last:
                e = last + last[:1]
            else:
                return b"".join(out)[:size]
            out.append(e)
            got += len(e)
            if last and len(table) < FULL:
                table.append(last + e[:1])
            last = e
        if not len(ends) or codes[k] == stop:
            break
        at += int(place[k + 1])
    return b"".join(out)[:size]


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """An LZW stream of the data; the dictionary is cleared when it is full."""
    clear, stop = 1 << least, (1 << least) + 1
    most = FULL - clear - 2
    runs, table, run = [], {}, []
    get, new = table.get, clear + 2
    it = iter(data)
    cur = next(it, None)
    if cur is not None:
        for b in it:
            key = cur << 8 | b
            code = get(key)
            if code is None:
                run.append(cur)
                table[key] = new
                new += 1
                cur = b
                if new == FULL:
                    runs.append(run)
                    run, new = [], clear + 2
                    table.clear()
            else:
                cur = code
        run.append(cur)
    runs.append(run)
    codes, widths = [np.array([clear])], [np.array([least + 1])]
    for k, r in enumerate(runs):
        codes.append(np.array([*r, stop if k == len(runs) - 1 else clear]))
        widths.append(_widths(least, len(r) + 1)[0])
    assert max(map(len, runs)) <= most + 1
    c, w = np.concatenate(codes), np.concatenate(widths)
    place = np.arange(12)
    bit = (c[:, None] >> place & 1).astype(np.uint8)
    return np.packbits(bit[place[None] < w[:, None]], bitorder="little").tobytes()


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(part := data[i : i + 255])]) + part for i in range(0, len(data), 255)) + b"\0"


def _table(palette: np.ndarray) -> tuple[int, bytes]:
    """The size field of a palette and its bytes, filled to a power of two."""
    n = max(1, (max(2, len(palette)) - 1).bit_length())
    return n - 1, palette.astype(np.uint8).tobytes().ljust(3 << n, b"\0")


def write(gif: Gif) -> bytes:
    out = [b"GIF89a", struct.pack("<HH", gif.width, gif.height)]
    if gif.palette is not None:
        n, data = _table(gif.palette)
        out += [bytes([0x80 | 0x70 | n, gif.background, 0]), data]
    else:
        out.append(bytes([0x70, 0, 0]))
    if gif.loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", gif.loops) + b"\0")
    for f in gif.frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay_ms // 10, f.transparent or 0) + b"\0")
        h, w = f.pixels.shape
        n, data = _table(f.palette) if f.palette is not None else (0, b"")
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, (0x80 | n) if data else 0) + data)
        colours = f.palette if f.palette is not None else gif.palette
        least = max(2, (len(colours) - 1).bit_length()) if colours is not None else 8
        out.append(bytes([least]) + _blocks(lzw_encode(f.pixels.astype(np.uint8).tobytes(), least)))
    return b"".join(out) + b"\x3b"


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of sub-blocks from a place on, and the place after them."""
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _woven(rows: np.ndarray) -> np.ndarray:
    """Rows of an interlaced image, in order from the top."""
    h = len(rows)
    order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def read(data: bytes) -> Gif:
    """Reads a GIF; what follows the first damage is left out: a code size that no palette has, or a frame above ``MOST_PIXELS``, counts as such.

    Anything else, and a canvas above ``MOST_PIXELS``, raises ValueError.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background = struct.unpack("<HHBB", data[6:12])
    if width * height > MOST_PIXELS:
        raise ValueError("too large a canvas")
    at = 13

    def palette(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 2 << (flags & 7)
        raw = data[at : at + 3 * n].ljust(3 * n, b"\0")
        return np.frombuffer(raw, np.uint8).reshape(n, 3), at + 3 * n

    colours, at = palette(flags, at)
    gif = Gif(width, height, colours, background)
    control = (0, 0, None)
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 2 < len(data):
            label = data[at + 1]
            body, at = _joined(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, clear = struct.unpack("<BHB", body[:4])
                control = (delay * 10, packed >> 2 & 7, clear if packed & 1 else None)
            elif label == 0xFF and body[:11] == b"NETSCAPE2.0" and len(body) >= 14:
                gif.loops = struct.unpack("<H", body[12:14])[0]
        elif kind == 0x2C and at + 11 < len(data):
            left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            local, at = palette(packed, at + 10)
            least = data[at] if at < len(data) else 0
            stream, at = _joined(data, at + 1)
            if not 1 <= least <= 8 or w * h > MOST_PIXELS:
                break
            raw = lzw_decode(stream, least, w * h).ljust(w * h, b"\0")
            pixels = np.frombuffer(raw, np.uint8).reshape(h, w)
            gif.frames.append(Frame(_woven(pixels) if packed & 0x40 else pixels, left, top, *control, local))
            control = (0, 0, None)
        else:
            break
    return gif


def composite(gif: Gif) -> Iterator[np.ndarray]:
    """What is shown for each frame: height x width x 4 (red, green, blue, opacity), new arrays.

    Disposal 2 clears the frame's rectangle before the next frame, 3 brings back what was before it.
    """
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        colours = f.palette if f.palette is not None else gif.palette
        if colours is None:
            colours = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
        rgba = np.zeros((256, 4), np.uint8)
        rgba[: len(colours), :3], rgba[:, 3] = colours[:256], 255
        if f.transparent is not None:
            rgba[f.transparent, 3] = 0
        h, w = f.pixels.shape
        h, w = max(0, min(h, gif.height - f.top)), max(0, min(w, gif.width - f.left))
        area = canvas[f.top : f.top + h, f.left : f.left + w]
        before = area.copy() if f.disposal == 3 else None
        new = rgba[f.pixels[:h, :w]]
        if f.transparent is None:
            area[:] = new
        else:
            np.copyto(area, new, where=new[:, :, 3:] > 0)
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif f.disposal == 3:
            area[:] = before


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour: bin r, g, b (the upper bits of each channel) stands at (r << 4) + (g << 2) + b."""
    c = canvas[canvas[:, :, 3] > 0] >> (8 - DEPTH)
    return np.bincount(c[:, 0] << 2 * DEPTH | c[:, 1] << DEPTH | c[:, 2], minlength=BINS)


# Sample bytes of a payload become palette indexes: three bits red, three green, two blue.
_I = np.arange(256)
SAMPLES = np.stack([(_I >> 5) * 36, (_I >> 2 & 7) * 36, (_I & 3) * 85], 1).astype(np.uint8)
ROW, ROWS = 64, 512


def store(payload: bytes, delay_ms: int = 100) -> bytes:
    """A payload of whole 64-byte rows as a GIF 64 pixels wide, with a frame for each 512 rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    frames = [Frame(rows[i : i + ROWS], delay_ms=delay_ms, disposal=1) for i in range(0, len(rows), ROWS)]
    return write(Gif(ROW, min(len(rows), ROWS), SAMPLES, loops=0, frames=frames))


def load(media: bytes) -> tuple[bytes, Gif]:
    """The payload back from the stored bytes."""
    gif = read(media)
    return b"".join(f.pixels.tobytes() for f in gif.frames), gif


def feature(gif: Gif) -> str:
    """Frames, milliseconds, and the colour histogram summed over what each frame shows."""
    total = np.zeros(BINS, np.int64)
    for canvas in composite(gif):
        total += histogram(canvas)
    return f"{len(gif.frames)};{sum(f.delay_ms for f in gif.frames)};{','.join(map(str, total))}"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW or (0 if text else ROW))


def _pages(docs: DataFrame, names: list[str], kinds: list, schema: str, work) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, at in tv.chunks(b.column(1)):
                data = buf.tobytes()
                rows = [work(data[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *cols], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def media_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text's bytes, zero-padded to whole rows, stored as a GIF.

    Null text counts as empty and gives one row of zeros.  Repeated rows are kept, other columns ignored.
    """
    return _pages(docs, ["n_bytes", "media"], [pa.int64(), pa.binary()], "n_bytes long, media binary", lambda t: (len(t), store(padded(t))))


def frame_rows(media: DataFrame) -> DataFrame:
    """(doc_id, frame, delay_ms, width, height, pixels, histogram): the timed frames of a ``media`` column as shown.

    pixels: red, green, blue and opacity of each pixel.  histogram: as ``histogram``.  Null or empty
    media has no frames; media that is no GIF, or one with a canvas above ``MOST_PIXELS``, has none either.
    """
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    gif = read(data or b"")
                except ValueError:
                    continue
                for k, canvas in enumerate(composite(gif)):
                    row = [doc, k, gif.frames[k].delay_ms, gif.width, gif.height, canvas.tobytes(), histogram(canvas).tolist()]
                    kinds = [b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], ["doc_id", "frame", "delay_ms", "width", "height", "pixels", "histogram"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, frame int, delay_ms int, width int, height int, pixels binary, histogram array<bigint>")


def media_digests(docs: DataFrame) -> DataFrame:
    """Stores every text as a GIF, reads it back and returns digests of both, a row for each document.

    Null and empty texts are one row of zeros.  Texts may be of any length (a frame holds 512 rows);
    repeated rows are kept; an empty table gives no row; columns other than doc_id and text are ignored,
    whatever their names.
    """

    def work(text: bytes) -> tuple:
        media = store(padded(text))
        payload, gif = load(media)
        return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(gif))

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _pages(docs, names, kinds, schema, work)
