"""GIF: an encoder and decoder of animated images, and media columns made with them.

``encode`` writes samples as frames (LZW, variable code width, clear codes when the table is full), one chunk of samples a
timed frame, each in the way that its content picks: with the global palette; with a local palette that orders its values
by frequency; as an overlay whose most frequent value is transparent, over an underlay of no duration, and which is put
back (disposal 3); or as what differs from the canvas, the rest transparent. So a reader gets the samples only if it
applies palettes, transparency and disposal.

``decode`` reads any GIF87a/89a: it decodes LZW code streams, applies global and local palettes, interlacing,
transparency and the disposal rules, and gives the canvas after each frame with its time.

``media_columns`` stores every text's bytes, padded to a multiple of ``ROW``, in a GIF, and then reads the stored
bytes back: payload, timed frames and their colour histograms come from the decoded canvases only. It is a map over rows;
a text is in one task alone.

Defined results: null text is the empty text, a payload of one zero row; equal texts have equal values; a stream that is
broken or cut off anywhere raises ``ValueError`` in ``decode``. Time and memory are linear in a text's bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, types as T

from conceptlake.llm.arrowtext import map_text

ROW, ROWS = 64, 64
#: Hundredths of a second that a frame of stored samples is shown.
DELAY = 4
BINS = 64
#: Codes that are read at once, more than most writers put between two clears.
RUN = 1 << 12


_WIDTHS: dict[int, np.ndarray] = {}


def code_widths(bits: int) -> np.ndarray:
    """For a minimal code size: bits of the k-th code after a clear (k below RUN)."""
    if bits not in _WIDTHS:
        first = (1 << bits) + 2
        k = np.arange(RUN)
        entries = np.minimum(first + np.maximum(k - 1, 0), 4096)  # known before reading code k
        need = np.full(RUN, bits + 1)
        for w in range(bits + 1, 12):
            need[entries >= 1 << w] = w + 1
        _WIDTHS[bits] = need.astype(np.int64)
    return _WIDTHS[bits]


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of ``samples`` (each below 2**bits)."""
    clear, end = 1 << bits, (1 << bits) + 1
    if not samples:
        return pack(np.array([clear, end], np.uint32), np.array([bits + 1] * 2))
    codes, starts = [clear], [0]
    put = codes.append
    table: dict[int, int] = {}
    get, size = table.get, end + 1
    rest = iter(samples)
    prefix = next(rest)
    for c in rest:
        key = prefix << 8 | c
        found = get(key)
        if found is not None:
            prefix = found
            continue
        put(prefix)
        prefix = c
        if size < 4096:
            table[key] = size
            size += 1
        else:
            starts.append(len(codes))
            put(clear)
            table.clear()
            size = end + 1
    put(prefix)
    put(end)
    # Bits of each code: the clear code that ends a run is as wide as the run's place asks.
    all_codes, w = np.array(codes, np.uint32), np.empty(len(codes), np.int64)
    scale, at = code_widths(bits), 0
    w[0] = bits + 1
    bounds = [*starts[1:], len(codes) - 1]
    for at, stop in zip(starts, bounds, strict=True):
        w[at + 1 : stop + 1] = scale[: stop - at]
    return pack(all_codes, w)


def pack(codes: np.ndarray, w: np.ndarray) -> bytes:
    """Codes of ``w`` bits each, least significant bit first."""
    place = np.arange(12)
    bits = (codes[:, None] >> place & 1).astype(bool)
    return np.packbits(bits[place < w[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, n: int) -> bytes:
    """The first ``n`` samples of an LZW code stream."""
    if not 2 <= bits <= 8:
        raise ValueError(f"LZW codes of {bits} bits")
    clear, end = 1 << bits, (1 << bits) + 1
    data = np.concatenate((np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8))).astype(np.uint32)
    total, at = len(stream) * 8, 0
    scale = code_widths(bits)
    parts: list[bytes] = []
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    have, room = 0, 4096 - len(roots) + 1
    while have < n:
        # All codes up to the next clear have known places: read them at once.
        place = at + np.concatenate(([0], np.cumsum(scale)))
        m = int(np.searchsorted(place[1:], total, "right"))
        if m == 0:
            raise ValueError("LZW stream ends early")
        byte, w = place[:m] >> 3, scale[:m]
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (place[:m] & 7) & ((1 << w) - 1)).astype(np.int64)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else m
        if stop == m == len(scale):  # no clear code for long: the table stays full
            scale = np.concatenate((scale, np.full(len(scale), 12)))
            continue
        run, at = codes[:stop].tolist(), int(place[min(stop + 1, m)])
        first = len(parts)
        if run:
            table = roots.copy()
            add, put, size = table.append, parts.append, len(table)
            if run[0] >= clear:
                raise ValueError("LZW code before its entry")
            last = roots[run[0]]
            put(last)
            for code in run[1:room]:
                if code < size:
                    entry = table[code]
                elif code == size:  # the entry that this very code completes
                    entry = last + last[:1]
                else:
                    raise ValueError("LZW code before its entry")
                add(last + entry[:1])
                size += 1
                put(entry)
                last = entry
            parts.extend(table[code] for code in run[room:])
        have += sum(map(len, parts[first:]))
        if (stop < m and codes[stop] == end) or (stop == m and at >= total):
            break
    if have < n:
        raise ValueError("LZW stream has too few samples")
    return b"".join(parts)[:n]


def _blocks(data: bytes) -> bytes:
    """Data sub-blocks: up to 255 bytes behind their length, ended by an empty one."""
    parts = [data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(bytes([len(x)]) + x for x in parts) + b"\x00"


#: The colour of each sample value: red is the value, green and blue spread it over the colour bins.
COLOURS = np.array([(v, v * 37 & 255, v * 101 & 255) for v in range(256)], np.uint8)


@lru_cache(maxsize=ROWS)
def _underlay(n: int) -> bytes:
    """The code stream of ``n`` samples of index 0."""
    return lzw_encode(bytes(n), 2)


def _image(height: int, width: int, stream: bytes, *, disposal: int, delay: int, clear: int | None = None, palette: np.ndarray | None = None, bits: int = 8) -> bytes:
    """A graphic control block and an image at the canvas's upper left corner."""
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\x00"
    local = 0 if palette is None else 0x80 | len(palette).bit_length() - 2
    head = b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, local)
    return control + head + (b"" if palette is None else palette.tobytes()) + bytes([bits]) + _blocks(stream)


def encode(samples: bytes, width: int = ROW, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """An animated GIF whose timed frames, one below the other, hold ``samples`` (a positive multiple of ``width``)."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), COLOURS.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    # The canvas as a reader has it: the value of each pixel, -1 where nothing is shown.
    canvas = np.full(height * width, -1, np.int64)
    for i in range(0, len(samples), width * rows):
        frame = samples[i : i + width * rows]
        v, n, h = np.frombuffer(frame, np.uint8), len(frame), len(frame) // width
        way = zlib.crc32(frame) % 4
        counts = np.bincount(v, minlength=256)
        if way == 3:
            same, unused = canvas[:n] == v, np.flatnonzero(counts == 0)
            if same.any() and len(unused):
                clear = int(unused[0])
                out.append(_image(h, width, lzw_encode(np.where(same, np.uint8(clear), v).tobytes()), disposal=1, delay=delay, clear=clear))
                canvas[:n] = v
                continue
            way = 0
        if way == 0:
            out.append(_image(h, width, lzw_encode(frame), disposal=1, delay=delay))
            canvas[:n] = v
            continue
        order = np.argsort(-counts, kind="stable").astype(np.uint8)
        index = np.empty(256, np.uint8)
        index[order] = np.arange(256, dtype=np.uint8)
        stream = lzw_encode(index[v].tobytes())
        if way == 1:
            out.append(_image(h, width, stream, disposal=2, delay=delay, palette=COLOURS[order]))
            canvas[:n] = -1
        else:
            common = order[0]
            under = COLOURS[np.array([common, 0, 0, 0])]
            out.append(_image(h, width, _underlay(n), disposal=1, delay=0, palette=under, bits=2))
            canvas[:n] = common
            over = COLOURS[order]
            over[0] = 255 - over[0]  # never seen, as it is transparent
            out.append(_image(h, width, stream, disposal=3, delay=delay, clear=0, palette=over))
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    start: int  #: hundredths of a second
    delay: int
    disposal: int
    transparent: int | None
    box: tuple[int, int, int, int]  #: left, top, width, height
    canvas: np.ndarray  #: height x width x 3, after this frame is drawn
    shown: np.ndarray  #: height x width, pixels that some frame has set


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, one at a time; each has arrays of its own."""
    try:
        yield from _frames(data)
    except (struct.error, IndexError) as e:
        raise ValueError("the GIF ends early") from e


def _frames(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colour_table(at: int, flags: int) -> tuple[np.ndarray, int]:
        end = at + 3 * (2 << (flags & 7))
        if end > len(data):
            raise ValueError("the GIF ends early")
        return np.frombuffer(data, np.uint8, end - at, at).reshape(-1, 3), end

    palette = None
    if flags & 0x80:
        palette, at = colour_table(at, flags)
    canvas, shown = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
    delay, disposal, transparent, start = 0, 0, None, 0

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = sub_blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block {data[at]:#x}")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        colours = palette
        if local & 0x80:
            colours, at = colour_table(at, local)
        if colours is None:
            raise ValueError("no palette")
        bits = data[at]
        stream, at = sub_blocks(at + 1)
        index = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8).reshape(h, w)
        if local & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        before = (canvas.copy(), shown.copy()) if disposal == 3 else None
        fit_h, fit_w = max(0, min(h, height - top)), max(0, min(w, width - left))
        index = index[:fit_h, :fit_w]
        spot = (slice(top, top + fit_h), slice(left, left + fit_w))
        wide = colours if len(colours) == 256 else np.concatenate((colours, np.zeros((256 - len(colours), 3), np.uint8)))
        if transparent is None:
            canvas[spot] = wide[index]
            shown[spot] = True
        else:
            opaque = index != transparent
            canvas[spot][opaque] = wide[index[opaque]]
            shown[spot] |= opaque
        yield Frame(start, delay, disposal, transparent, (left, top, w, h), canvas.copy(), shown.copy())
        start += delay
        if disposal == 2:  # back to the background, which viewers leave clear
            canvas[spot], shown[spot] = 0, False
        elif before is not None:
            canvas, shown = before
        delay, disposal, transparent = 0, 0, None


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 64 colour bins: two bits of red, green and blue."""
    c = canvas.reshape(-1, 3) & 0xC0
    return np.bincount(c[:, 0] >> 2 | c[:, 1] >> 4 | c[:, 2] >> 6, minlength=BINS)


def pad(data: bytes, row: int = ROW) -> bytes:
    return data + bytes(-len(data) % row or (row if not data else 0))


def frames_of(media: bytes) -> tuple[bytes, list[tuple[int, int, int, list[int]]]]:
    """The samples stored in a GIF of ``encode``'s, and (start, delay, rows, histogram) of each timed frame."""
    samples, rows = [], []
    for f in decode(media):
        if f.delay:
            left, top, w, h = f.box
            drawn = f.canvas[top : top + h, left : left + w]
            samples.append(drawn[:, :, 0].tobytes())
            rows.append((f.start, f.delay, h, histogram(drawn).tolist()))
    return b"".join(samples), rows


FRAMES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("delay", T.IntegerType()), T.StructField("rows", T.IntegerType()), T.StructField("histogram", T.ArrayType(T.LongType()))]))


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text's padded bytes as a GIF in a binary column."""

    def start():
        def step(texts: list) -> list[tuple]:
            raw = [(t or "").encode() for t in texts]
            return [(len(b), encode(pad(b))) for b in raw]

        return step

    return map_text(df, [id_col], [("n_bytes", T.LongType()), ("media", T.BinaryType())], start, text_col)


def read_media(df: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """``keep`` columns with what the stored bytes hold: samples' digests, frames and colour histograms."""

    def start():
        def step(blobs: list) -> list[tuple]:
            out = []
            for media in blobs:
                payload, frames = frames_of(media)
                total = np.sum([f[3] for f in frames], axis=0)
                feature = f"frames={len(frames)};time={sum(f[1] for f in frames)};" + ",".join(f"{i}:{v}" for i, v in enumerate(total.tolist()) if v)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature, [{"start": a, "delay": b, "rows": c, "histogram": d} for a, b, c, d in frames]))
            return out

        return step

    names = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()), ("frames", FRAMES)]
    return map_text(df, keep, names, start, media_col)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media and read it back: a row for each row."""
    return read_media(store_media(df, id_col, text_col), [id_col, "n_bytes"])
