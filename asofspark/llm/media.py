"""Media columns: AVI motion-JPEG.

Writing: each byte of a payload becomes one flat 8x8 block of a grayscale baseline JPEG. With every quantizer at 8 the
block's DC coefficient is the byte less 128, so any baseline decoder returns exactly that byte for all 64 pixels.
192 blocks (16 x 12) are a frame; the frames and their idx1 index make an AVI file.

Reading: the RIFF chunks and the idx1 index give the frames; their entropy-coded scans are decoded side by side in
numpy, a lane for each frame; shots are cut where the histogram difference between neighbouring frames stands out from
those just before it, which yields timed clip rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

COLUMNS, ROWS = 16, 12
UNIT = COLUMNS * ROWS  # blocks of a frame, one byte each
FPS = 25
QUANT = 8
AT_ONCE = 2048  # frames whose samples are worked on at a time
CHUNK = 1 << 20  # bytes of payload handled at once, at least one row
LANES = 1 << 14

# Zigzag order of the JPEG standard.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)

DC_COUNTS, DC_SYMBOLS = (0, 0, 5, 4) + (0,) * 12, (4, 5, 6, 7, 3, 0, 1, 2, 8)  # codes of 3 and 4 bits
AC_COUNTS, AC_SYMBOLS = (1,) + (0,) * 15, (0,)  # only the end of a block: one bit


def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """symbol: (code, bits), canonical as in the JPEG standard."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(width: int, height: int) -> bytes:
    huff = lambda kind, counts, symbols: _segment(0xC4, bytes([kind, *counts, *symbols]))
    return b"".join([
        b"\xff\xd8", _segment(0xDB, bytes([0] + [QUANT] * 64)), _segment(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0)),
        huff(0x00, DC_COUNTS, DC_SYMBOLS), huff(0x10, AC_COUNTS, AC_SYMBOLS), _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


HEAD, END = _head(8 * COLUMNS, 8 * ROWS), b"\xff\xd9"
_DIFF = np.arange(-255, 256)
_SIZE = np.array([int(abs(d)).bit_length() for d in _DIFF])
_EXTRA = np.where(_DIFF < 0, _DIFF + (1 << _SIZE) - 1, _DIFF)
_DC = _codes(DC_COUNTS, DC_SYMBOLS)
_CODE = ((np.array([_DC[s][0] for s in _SIZE]) << _SIZE | _EXTRA) << 1).astype(np.int64)  # and the end of the block
_BITS = np.array([_DC[s][1] for s in _SIZE]) + _SIZE + 1


def _scans(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded data of each frame (rows of UNIT samples); codes and positions are held for AT_ONCE frames."""
    return [scan for i in range(0, len(samples), AT_ONCE) for scan in _coded(samples[i : i + AT_ONCE])]


def _coded(samples: np.ndarray) -> list[bytes]:
    diff = np.diff(samples.astype(np.int64) - 128, axis=1, prepend=0) + 255
    code, bits = _CODE[diff], _BITS[diff]
    ends = np.cumsum(bits, axis=1)
    size = -(-ends[:, -1] // 8)
    base = np.cumsum(size) - size
    at = (base * 8)[:, None] + ends - bits
    word = code << (24 - bits - (at & 7))
    first, total = (at >> 3).ravel(), int(size.sum())
    out = np.zeros(total + 2)
    for i in range(3):
        out += np.bincount(first + i, ((word >> (16 - 8 * i)) & 255).ravel(), total + 2)[: total + 2]
    flat = out[:total].astype(np.uint8)
    flat[base + size - 1] |= ((1 << (size * 8 - ends[:, -1])) - 1).astype(np.uint8)
    full = np.flatnonzero(flat == 255)
    stuffed = np.insert(flat, full + 1, 0)
    size = size + np.bincount(np.searchsorted(base, full, "right") - 1, minlength=len(size))
    data, stops = stuffed.tobytes(), np.cumsum(size).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], width: int = 8 * COLUMNS, height: int = 8 * ROWS) -> bytes:
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    sizes = np.fromiter(map(len, frames), np.int64, n)
    idx = np.zeros((n, 4), "<u4")
    idx[:, 0], idx[:, 1], idx[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    idx[:, 2] = 4 + np.cumsum(8 + sizes + (sizes & 1)) - (8 + sizes + (sizes & 1))
    movi = b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", hdrl) + _chunk(b"LIST", movi) + _chunk(b"idx1", idx.tobytes()))


def write(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, a multiple of UNIT bytes long."""
    scans = _scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)) if any(payloads) else []
    out, at = [], 0
    for p in payloads:
        n = len(p) // UNIT
        out.append(_avi([HEAD + s + END for s in scans[at : at + n]]))
        at += n
    return out


def frames_of(media: bytes) -> list[bytes]:
    """The JPEG frames that the idx1 index of an AVI file lists, or without one those of its movi list."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = (at + 8, size)
        elif name == b"idx1":
            index = np.frombuffer(media, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None:
        return []
    if index is None:
        at, out = movi[0] + 4, []
        while at + 8 <= movi[0] + movi[1]:
            size = int.from_bytes(media[at + 4 : at + 8], "little")
            if media[at + 2 : at + 4] in (b"dc", b"db"):
                out.append(media[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
        return out
    starts = index[:, 2].astype(np.int64)
    if len(starts) and starts[0] >= movi[0]:  # some writers count from the start of the file
        starts -= movi[0]
    return [media[s : s + n] for s, n in zip((starts + movi[0] + 8).tolist(), index[:, 3].tolist())]


@dataclass
class Header:
    size: int  # bytes up to the scan
    width: int
    height: int
    quant: np.ndarray
    dc: np.ndarray  # by the next 16 bits: symbol << 8 | bits of the code
    ac: np.ndarray
    end_only: int  # bits of the end-of-block code if the AC table has no other, else 0


def header_of(jpeg: bytes) -> Header:
    """Tables of a baseline JPEG with one component and without restart intervals; others raise ValueError."""
    at, quant, huff, frame = 2, {}, {}, None
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        if jpeg[at] != 0xFF or marker in (0xC1, 0xC2, 0xC3, 0xDD) or marker == 0xC0 and body[5] != 1:
            raise ValueError("only baseline JPEG with one component and no restart intervals is read")
        if marker == 0xDB:
            for i in range(0, len(body), 65):
                quant[body[i] & 15] = np.frombuffer(body, np.uint8, 64, i + 1).astype(np.int64)
        elif marker == 0xC0:
            frame = struct.unpack(">BHHB3B", body)
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                counts = tuple(body[i + 1 : i + 17])
                symbols = tuple(body[i + 17 : i + 17 + sum(counts)])
                lut = np.zeros(1 << 16, np.int64)
                for s, (code, bits) in _codes(counts, symbols).items():
                    lut[code << (16 - bits) : (code + 1) << (16 - bits)] = s << 8 | bits
                huff[body[i]] = (lut, counts.index(1) + 1 if symbols == (0,) else 0)
                i += 17 + sum(counts)
        at += 2 + size
        if marker == 0xDA:
            dc, ac = huff[body[2] >> 4], huff[0x10 | body[2] & 15]
            return Header(at, frame[2], frame[1], quant[frame[6]], dc[0], ac[0], ac[1])


def _signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra) * (size > 0)


def coefficients(scans: list[bytes], head: Header) -> np.ndarray:
    """frames x blocks x 64 (or x 1, if the tables allow no AC coefficient), in zigzag order, not yet dequantized."""
    blocks = -(-head.width // 8) * -(-head.height // 8)
    flat = np.frombuffer(b"".join(scans) + bytes(8), np.uint8)
    lens = np.fromiter(map(len, scans), np.int64, len(scans))
    stuffed = np.flatnonzero((flat[1:] == 0) & (flat[:-1] == 255)) + 1
    base = np.cumsum(lens) - lens
    base -= np.searchsorted(stuffed, base, "left")
    flat = np.delete(flat, stuffed[stuffed < len(flat) - 8]).astype(np.int64)
    flat = np.concatenate([flat, np.zeros(8, np.int64)])
    five = flat[:-4] << 32 | flat[1:-3] << 24 | flat[2:-2] << 16 | flat[3:-1] << 8 | flat[4:]  # 40 bits from each byte
    last = len(five) - 1
    pos, pred = base * 8, np.zeros(len(scans), np.int64)
    out = np.zeros((len(scans), blocks, 1 if head.end_only else 64), np.int16)

    def symbol(lut: np.ndarray, p: np.ndarray, category: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = five[np.minimum(p >> 3, last)]
        free = 40 - (p & 7)  # bits of w that are ahead
        found = lut[(w >> (free - 16)) & 0xFFFF]
        size = (found >> 8) & category
        used = (found & 255) + size
        return found >> 8, (w >> (free - used)) & ((1 << size) - 1), used

    for b in range(blocks):
        size, extra, used = symbol(head.dc, pos, 255)
        pred = pred + _signed(extra, size)
        out[:, b, 0] = pred
        pos = pos + used + head.end_only
        if not head.end_only:
            k, lanes = np.ones(len(pos), np.int64), np.arange(len(pos))
            while len(lanes):
                s, extra, used = symbol(head.ac, pos[lanes], 15)
                pos[lanes] += used
                k[lanes] += np.where(s == 0, 64, s >> 4)
                here = (s != 0) & ((s & 15) > 0) & (k[lanes] < 64)
                out[lanes[here], b, k[lanes[here]]] = _signed(extra, s & 15)[here]
                k[lanes] += 1
                lanes = lanes[k[lanes] < 64]
    return out


_COS = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8) * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)


def block_pixels(coefs: np.ndarray, head: Header) -> np.ndarray:
    """frames x blocks x 64 pixels, or x 1 where every block is flat."""
    values = coefs * head.quant[: coefs.shape[2]]
    if coefs.shape[2] == 1:
        return np.clip((values + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    square = np.zeros((*values.shape[:2], 64))
    square[:, :, ZIGZAG] = values
    pixels = np.einsum("xu,fbuv,yv->fbxy", _COS, square.reshape(*values.shape[:2], 8, 8), _COS)
    return np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8).reshape(*values.shape[:2], 64)


def read(media: list[bytes]) -> list[np.ndarray]:
    """The decoded blocks (frames x blocks x 1 or 64) of each AVI file."""
    frames = [frames_of(m) for m in media]
    every = [f for fs in frames for f in fs]
    if not every:
        return [np.zeros((0, 0, 1), np.uint8) for _ in media]
    heads: list[Header] = []
    raw: list[bytes] = []
    of = np.zeros(len(every), np.int64)
    for i, f in enumerate(every):
        k = next((k for k, r in enumerate(raw) if f.startswith(r)), None)
        if k is None:
            heads.append(header_of(f))
            raw.append(f[: heads[-1].size])
            k = len(raw) - 1
        of[i] = k
    done: list[np.ndarray] = [None] * len(every)  # type: ignore[list-item]
    for k, h in enumerate(heads):
        mine = np.flatnonzero(of == k)
        lanes = LANES if h.end_only else LANES // 64
        for i in range(0, len(mine), lanes):
            part = mine[i : i + lanes]
            for j, p in zip(part.tolist(), block_pixels(coefficients([every[j][h.size : -2] for j in part], h), h)):
                done[j] = p
    out, at = [], 0
    for fs in frames:
        out.append(np.stack(done[at : at + len(fs)]) if fs else np.zeros((0, 0, 1), np.uint8))
        at += len(fs)
    return out


def _histograms(flat: np.ndarray, bins: int) -> np.ndarray:
    n = len(flat)
    return np.bincount(((flat >> 4) + np.arange(n)[:, None] * bins).ravel(), minlength=n * bins).reshape(n, bins) / flat.shape[1]


def shots(blocks: np.ndarray, bins: int = 16, past: int = 8, factor: float = 3.0, least: float = 0.3) -> np.ndarray:
    """First frames of the shots. A frame starts one if its histogram differs from the frame before by `least` or more
    of all pixels, and by `factor` deviations more than the mean of up to `past` differences before."""
    n = len(blocks)
    if n < 2:
        return np.zeros(min(n, 1), np.int64)
    flat = blocks.reshape(n, -1)
    hist = np.concatenate([_histograms(flat[i : i + AT_ONCE], bins) for i in range(0, n, AT_ONCE)])
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff**2)])
    i = np.arange(len(diff))
    lo = np.maximum(0, i - past)
    k = np.maximum(1, i - lo)
    mean = (s1[i] - s1[lo]) / k
    dev = np.sqrt(np.maximum(0, (s2[i] - s2[lo]) / k - mean**2))
    return np.concatenate([[0], 1 + np.flatnonzero((diff >= least) & (diff > mean + factor * dev))])


def _groups(sizes: list[int]) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end] <= CHUNK):
            total += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def payload(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
        for part in _groups([len(t) for t in texts]):
            some = texts[part]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")[part], pa.array([len(t) for t in some], pa.int64()), pa.array(write([payload(t) for t in some]), pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )


def store(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, n_bytes, media): each whole text as an AVI file. Null is the empty text, which is one frame
    of blanks; one row per input row; equal texts give equal files; further columns are ignored."""
    return docs.select("doc_id", "text").mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


_CLIP = pa.list_(pa.struct([("clip", pa.int64()), ("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = b.column("media").to_pylist()
        rows = []
        for part in _groups([len(m) for m in media]):
            for m, blocks in zip(media[part], read(media[part])):
                back = blocks[:, :, 0].tobytes() if blocks.shape[2] == 1 else b""
                cuts = shots(blocks)
                clips = [
                    {"clip": i, "first_frame": a, "frames": z - a, "start_s": a / FPS, "end_s": z / FPS}
                    for i, (a, z) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)]))
                ]
                mean = float(blocks.mean()) if blocks.size else 0.0
                light = sum((np.bincount(blocks[i : i + AT_ONCE].ravel() >> 4, minlength=16) for i in range(0, len(blocks), AT_ONCE)), np.zeros(16, np.int64))
                feature = f"frames={len(blocks)};shots={len(cuts)};mean={mean:.4f};levels={','.join(map(str, light))}"
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, clips))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _CLIP)
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
        keep = [n for n in b.schema.names if n != "media"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *columns], names=[*keep, *names])


def describe(media: DataFrame) -> DataFrame:
    """Columns of media but the file itself, with what is read back from it: digests, a feature string and clips, an
    array of timed shots. Files that are no AVI file of grayscale baseline JPEG raise an error."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema.fields if f.name != "media")
    found = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    clips = "clips array<struct<clip:long,first_frame:long,frames:long,start_s:double,end_s:double>>"
    return media.mapInArrow(_described, f"{columns}, {found}, {clips}")


def clip_rows(media: DataFrame) -> DataFrame:
    """media (doc_id, media) -> one row per clip: doc_id, clip, first_frame, frames, start_s, end_s."""
    return describe(media).select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")


def op5_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = describe(store(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("clips").alias("n_clips"), "clips")
