"""GIF as a media column: LZW code streams, palettes, disposal, transparency and frame timing.

``decode_gif`` reads a GIF file into composed RGB frames with their delays; ``decode_frames`` applies it
to a binary column and returns a row per frame with the pixels and colour-histogram columns;
``encode_gif`` writes 8-bit samples losslessly, with a grey palette in which the sample is the colour.

Defined results: null or empty bytes hold no frames; a file that breaks off or breaks the format raises
``GifError`` in ``decode_gif`` and gives one row with ``error`` set in ``decode_frames``; frames read
before a truncation are not guessed at.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.columns import Carried

#: Bins of each colour channel's histogram.
BINS = 16
#: Width of the frames that samples are stored in, and the most rows of one frame.
ROW_BYTES, FRAME_ROWS = 192, 4096
_GREYS = bytes(i for grey in range(256) for i in (grey,) * 3)
#: GIF: the largest number of LZW codes.
LZW_CODES = 4096


class GifError(ValueError):
    """The bytes are not a whole GIF file."""


@dataclass(frozen=True)
class Frame:
    """A composed picture of the animation: what is on the canvas for ``delay_ms`` from ``start_ms``."""

    rgb: np.ndarray  # height x width x 3, uint8
    delay_ms: int
    start_ms: int
    disposal: int
    transparent: int | None
    interlaced: bool


# ---------------------------------------------------------------------------------------------- LZW


def _code_widths(min_size: int) -> np.ndarray:
    """The widths of the codes after a clear code: the table grows by one with each code but the first, up to its limit."""
    known = (1 << min_size) + 2 + np.maximum(np.arange(LZW_CODES - (1 << min_size)) - 1, 0)
    return np.minimum(12, np.floor(np.log2(known)).astype(np.int64) + 1)


def _unpack(data: np.ndarray, bit: int, widths: np.ndarray) -> np.ndarray:
    """Codes of the given widths from a bit position on, as many as there are whole ones. ``data`` has spare bytes at its end."""
    starts = bit + np.cumsum(widths) - widths
    starts = starts[: np.searchsorted(starts + widths[: len(starts)], (len(data) - 4) * 8, side="right")]
    at = starts >> 3
    window = data[at] | data[at + 1] << np.uint32(8) | data[at + 2] << np.uint32(16)
    return (window >> (starts & 7).astype(np.uint32)) & ((np.uint32(1) << widths[: len(starts)].astype(np.uint32)) - np.uint32(1))


def lzw_decode(data: bytes, min_size: int, n_pixels: int) -> bytes:
    """The first ``n_pixels`` samples of an LZW code stream; GifError if it ends before.

    Codes are unpacked by the thousand, as their widths depend only on their number since the last clear code.
    """
    if not 1 <= min_size <= 11:
        raise GifError(f"LZW code size {min_size}")
    clear, end = 1 << min_size, (1 << min_size) + 1
    roots = [bytes([i]) if i < 256 else b"" for i in range(clear)] + [b"", b""]
    first = _code_widths(min_size)
    bits = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(4, dtype=np.uint8)]).astype(np.uint32)
    out: list[bytes] = []
    made = bit = since = 0  # since: codes read after the last clear code
    table, previous = roots.copy(), b""
    while made < n_pixels:
        widths = first[since:] if since < len(first) else np.full(LZW_CODES, 12)
        codes = _unpack(bits, bit, widths)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else len(codes)
        if not len(codes):
            raise GifError("the LZW stream ends too early")
        found = iter(codes[:n].tolist())
        chunk: list[bytes] = []
        if not previous and n:
            code = next(found)
            if code >= clear:
                raise GifError("an LZW code that is not in the table")
            chunk.append(previous := table[code])
        emit, add, known = chunk.append, table.append, len(table)
        for code in itertools.islice(found, LZW_CODES - known):
            if code < known:
                entry = table[code]
            elif code == known:
                entry = previous + previous[:1]
            else:
                raise GifError("an LZW code that is not in the table")
            add(previous + entry[:1])
            known += 1
            emit(entry)
            previous = entry
        for code in found:  # the table is full
            emit(table[code])
        made += sum(map(len, chunk))
        out += chunk
        since += n
        bit += int(widths[:n].sum())
        if made < n_pixels and len(stops):
            if codes[n] == end:
                raise GifError("the LZW stream ends too early")
            bit += int(widths[n])
            since, table, previous = 0, roots.copy(), b""
    return b"".join(out)[:n_pixels]


def lzw_encode(samples: bytes) -> bytes:
    """The LZW code stream of 8-bit samples (minimum code size 8), packed into bytes."""
    clear, end = 256, 257
    codes, widths_at = [clear], [(0, 9)]  # (index of the first code, its width)
    table: dict[tuple[int, int], int] = {}
    known, limit = 258, 512
    width = 9
    prefix = -1
    emit, find = codes.append, table.get
    for sample in samples:
        if prefix < 0:
            prefix = sample
            continue
        key = (prefix << 8) | sample
        code = find(key)
        if code is not None:
            prefix = code
            continue
        emit(prefix)
        table[key] = known
        if known == limit:
            width += 1
            limit <<= 1
            widths_at.append((len(codes), width))
        known += 1
        if known == LZW_CODES:
            emit(clear)
            table.clear()
            known, limit, width = 258, 512, 9
            widths_at.append((len(codes), 9))
        prefix = sample
    if prefix >= 0:
        emit(prefix)
        if known == limit and width < 12:
            width += 1
            widths_at.append((len(codes), width))
    emit(end)
    return _pack(np.asarray(codes, dtype=np.uint16), widths_at)


def _pack(codes: np.ndarray, widths_at: list[tuple[int, int]]) -> bytes:
    """Codes of changing widths, least significant bit first."""
    widths = np.empty(len(codes), dtype=np.int64)
    for (start, width), stop in zip(widths_at, [at for at, _ in widths_at[1:]] + [len(codes)], strict=True):
        widths[start:stop] = width
    ends = np.cumsum(widths)
    starts = ends - widths
    out = np.zeros(int(ends[-1] + 7) // 8 + 3, dtype=np.uint8)
    shifted = codes.astype(np.uint32) << (starts & 7).astype(np.uint32)
    first = starts >> 3
    for k in range(3):  # a code of 12 bits at most lies in three bytes
        np.bitwise_or.at(out, first + k, ((shifted >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8))
    return out[: int(ends[-1] + 7) // 8].tobytes()


# --------------------------------------------------------------------------------------------- files


def _sub_blocks(data: bytes) -> bytes:
    parts = []
    for at in range(0, len(data), 255):
        part = data[at : at + 255]
        parts += (bytes([len(part)]), part)
    return b"".join(parts) + b"\0"


def encode_gif(samples: bytes, row_bytes: int = ROW_BYTES, frame_rows: int = FRAME_ROWS, delay_cs: int = 10) -> bytes:
    """Store samples, a positive multiple of ``row_bytes``, as grey frames of that width.

    Each frame but the last has ``frame_rows`` rows. Palette entry i is the grey (i, i, i), so a decoded
    pixel's red channel is the sample. A last frame that is lower than the canvas leaves the rest as it is.
    """
    if not samples or len(samples) % row_bytes:
        raise ValueError(f"{len(samples)} samples are no positive multiple of {row_bytes}")
    rows = len(samples) // row_bytes
    parts = [b"GIF89a", struct.pack("<HHBBB", row_bytes, min(rows, frame_rows), 0xF7, 0, 0), _GREYS]
    for top in range(0, rows, frame_rows):
        height = min(frame_rows, rows - top)
        parts += (b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0")
        parts += (b"\x2c", struct.pack("<HHHHB", 0, 0, row_bytes, height, 0), b"\x08")
        parts.append(_sub_blocks(lzw_encode(samples[top * row_bytes : (top + height) * row_bytes])))
    return b"".join(parts) + b"\x3b"


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        found = self.data[self.at : self.at + n]
        if len(found) < n:
            raise GifError("the file ends too early")
        self.at += n
        return found

    def unpack(self, layout: str) -> tuple:
        return struct.unpack(layout, self.take(struct.calcsize(layout)))

    def blocks(self) -> bytes:
        parts = []
        while n := self.take(1)[0]:
            parts.append(self.take(n))
        return b"".join(parts)

    def palette(self, flags: int) -> np.ndarray | None:
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        return np.frombuffer(self.take(3 * n), dtype=np.uint8).reshape(n, 3)


def _row_order(height: int) -> np.ndarray:
    """Where each stored row of an interlaced picture belongs: four passes, by the format's steps."""
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read_pictures(data: bytes) -> Iterator[tuple]:
    """The canvas size and background first, then (left, top, indices, palette, delay, disposal, transparent, interlaced)."""
    reader = _Reader(data)
    if reader.take(6) not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF signature")
    width, height, flags, background, _ = reader.unpack("<HHBBB")
    shared = reader.palette(flags)
    yield width, height, shared[background] if shared is not None and background < len(shared) else np.zeros(3, np.uint8)
    delay, disposal, transparent = 0, 0, None
    while (kind := reader.take(1)) != b"\x3b":
        if kind == b"\x21":
            label, block = reader.take(1), reader.blocks()
            if label == b"\xf9":
                if len(block) < 4:
                    raise GifError("a graphic control block that is too short")
                packed, delay, index = struct.unpack("<BHB", block[:4])
                disposal, transparent = (packed >> 2) & 7, index if packed & 1 else None
        elif kind == b"\x2c":
            left, top, w, h, flags = reader.unpack("<HHHHB")
            palette = reader.palette(flags)
            palette = shared if palette is None else palette
            if palette is None:
                raise GifError("a picture without a palette")
            min_size = reader.take(1)[0]
            indices = np.frombuffer(lzw_decode(reader.blocks(), min_size, w * h), dtype=np.uint8).reshape(h, w)
            if flags & 0x40:
                indices, stored = np.empty_like(indices), indices
                indices[_row_order(h)] = stored
            if indices.size and indices.max() >= len(palette):
                raise GifError("a colour that is not in the palette")
            yield left, top, indices, palette, delay * 10, disposal, transparent, bool(flags & 0x40)
            delay, disposal, transparent = 0, 0, None
        elif kind != b"\0":
            raise GifError(f"an unknown block {kind!r}")


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The composed frames in order, one at a time (two canvases are held at most).

    Transparent pixels show what the canvas held. After a frame its disposal applies: 2 clears the
    frame's area to the background colour, 3 restores what was there before, others leave the frame.
    """
    pictures = read_pictures(data)
    width, height, background = next(pictures)
    canvas = np.empty((height, width, 3), dtype=np.uint8)
    canvas[:] = background
    start = 0
    for left, top, indices, palette, delay, disposal, transparent, interlaced in pictures:
        indices = indices[: max(0, height - top), : max(0, width - left)]
        area = canvas[top : top + indices.shape[0], left : left + indices.shape[1]]
        before = area.copy() if disposal == 3 else None
        colours = palette[indices]
        if transparent is None:
            area[:] = colours
        else:
            shown = indices != transparent
            area[shown] = colours[shown]
        yield Frame(canvas.copy(), delay, start, disposal, transparent, interlaced)
        start += delay
        if disposal == 2:
            area[:] = background
        elif before is not None:
            area[:] = before


def histogram(rgb: np.ndarray, bins: int = BINS) -> list[list[int]]:
    """Pixel counts by channel and by bins of equal width."""
    return [np.bincount(rgb[..., c].ravel() // (256 // bins), minlength=bins).tolist() for c in range(3)]


# ------------------------------------------------------------------------------------------ operators

FRAME_COLUMNS = "frame int, start_ms long, delay_ms int, width int, height int, disposal int, rgb binary, hist_red array<int>, hist_green array<int>, hist_blue array<int>, error string"


def decode_frames(df: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """A row per frame of each GIF in ``gif_col``: timing, size, RGB bytes and colour histograms.

    Null and empty values give no row; a broken file gives one row with only ``error`` set. Frames
    are yielded file by file, so memory is bounded by the largest animation.
    """
    carried = Carried(df, id_col)
    names = ["id", *(x.split()[0] for x in FRAME_COLUMNS.split(", "))]

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, data in zip(batch["id"], batch["gif"], strict=True):
                if not data:
                    continue
                rows = []
                try:
                    for k, f in enumerate(decode_gif(bytes(data))):
                        rows.append((key, k, f.start_ms, f.delay_ms, f.rgb.shape[1], f.rgb.shape[0], f.disposal, f.rgb.tobytes(), *histogram(f.rgb), None))
                except GifError as error:
                    rows = [(key, None, None, None, None, None, None, None, None, None, None, str(error))]
                yield pd.DataFrame(rows, columns=names).astype({c: object for c in names})

    narrow = df.select(carried.sent, F.col(gif_col).alias("gif"))
    return narrow.mapInPandas(frames, f"id {carried.kind}, {FRAME_COLUMNS}").select(carried.back, *names[1:])


def text_payload(text: str | None, unit: int = ROW_BYTES) -> tuple[int, bytes]:
    """The UTF-8 length of ``text`` and its bytes, filled up with spaces to a positive multiple of ``unit``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // unit)) * unit, b" ")


def stored_samples(data: bytes, n: int) -> tuple[bytes, list[int], int, int]:
    """Read stored samples back: the first ``n`` of all frames, the grey histogram, frames and duration.

    Each frame but the last fills the canvas; of the last, ``n`` says how many rows are new.
    """
    parts, counts, taken, frames, end = [], np.zeros(BINS, dtype=np.int64), 0, 0, 0
    for frame in decode_gif(data):
        samples = frame.rgb[..., 0].ravel()[: n - taken]
        counts += np.bincount(samples // (256 // BINS), minlength=BINS)
        parts.append(samples.tobytes())
        taken += len(samples)
        frames += 1
        end = frame.start_ms + frame.delay_ms
    return b"".join(parts), counts.tolist(), frames, end


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a GIF, read the stored bytes back, and return digests and features of both.

    A row per row of ``df``; equal texts have equal values. Null counts as empty, which is stored as
    one row of spaces. ``feature`` has the frames, the duration in ms and the grey histogram.
    """
    carried = Carried(df, id_col)
    columns = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                n_bytes, payload = text_payload(text)
                media = encode_gif(payload)
                back, counts, frames, end = stored_samples(media, len(payload))
                feature = f"frames={frames};ms={end};hist={','.join(map(str, counts))}"
                rows.append((n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame({"id": batch["id"], **{c: [r[k] for r in rows] for k, c in enumerate(columns)}})

    narrow = df.select(carried.sent, F.col(text_col).alias("text"))
    return narrow.mapInPandas(stored, f"id {carried.kind}, " + ", ".join(f"{c} {t}" for c, t in columns.items())).select(carried.back, *columns)
