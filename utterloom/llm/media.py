"""Media columns: AVI files of motion-JPEG frames, written, parsed and cut into shots.

A payload is kept losslessly in the format's own unit, the quantised coefficient: byte v is one coefficient of an 8 x 8
block, 64 bytes a block, in zigzag order. The writer's Huffman tables give a coefficient of size s a code of 9 - s bits, so
each takes 9 bits, a block is 72 bytes and packing is one vector operation; the file is an ordinary baseline JPEG to
any decoder. The reader takes tables, frame size and index from the file. Where every code of its tables ends at 9 bits it
decodes in one vector operation, otherwise symbol by symbol.

Shots: each frame's pixels (inverse DCT) give a 32-bin histogram; a cut is where the difference to the frame before exceeds
the mean of the last differences by two deviations and a floor. Rows are clips with start and end times.

Nulls: a null text is an empty payload (64 zero bytes after padding); a null doc_id stays null. Equal texts give equal
files. Long texts become more frames. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lean
from .text import utf8

BLOCKS, FPS, BINS = 64, 25, 32
SHOT_FLOOR, SHOT_DEVIATIONS, SHOT_MEMORY = 0.12, 2.0, 8


def _zigzag() -> np.ndarray:
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([y * 8 + x for y, x in cells])


ZIGZAG = _zigzag()


def _idct() -> np.ndarray:
    """Zigzag coefficients of a block times this matrix are its pixels, less 128."""
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * n + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


IDCT = _idct()
SIZES = np.array([int(x).bit_length() for x in range(256)])
#: Huffman tables: number of codes by length 1..16, symbols in order of code.
DC_COUNTS, DC_SYMBOLS = [1] * 9 + [0] * 7, [8, 7, 6, 5, 4, 3, 2, 1, 0]
AC_COUNTS, AC_SYMBOLS = [1] * 9 + [0] * 7, [8, 7, 6, 5, 4, 3, 2, 1, 0]


def _codeword(c: int) -> int:
    """The 9 bits of a coefficient or difference in -255..255."""
    s = abs(c).bit_length()
    if s == 0:
        return 0b111111110
    prefix = (1 << (9 - s)) - 2
    return prefix << s | (c if c > 0 else c + (1 << s) - 1)


DIFF_CODE = np.array([_codeword(d) for d in range(-255, 256)], np.uint16)
AC_CODE = np.array([_codeword(v - 128 if v < 128 else v - 127) for v in range(256)], np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(blocks: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\0" + bytes([1] * 64))
        + _segment(0xC0, struct.pack(">BHHB", 8, 8 * blocks, 8, 1) + bytes([1, 0x11, 0]))
        + _segment(0xC4, b"\x00" + bytes(DC_COUNTS) + bytes(DC_SYMBOLS))
        + _segment(0xC4, b"\x10" + bytes(AC_COUNTS) + bytes(AC_SYMBOLS))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def pack9(codes: np.ndarray) -> np.ndarray:
    """9-bit words (a multiple of 8 of them) as bytes."""
    c = codes.reshape(-1, 8)
    out = np.empty((len(c), 9), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = ((c[:, i - 1] & ((1 << i) - 1)) << (8 - i)) | (c[:, i] >> (i + 1))
    out[:, 8] = c[:, 7] & 255
    return out.ravel()


def unpack9(data: np.ndarray) -> np.ndarray:
    b = data.reshape(-1, 9).astype(np.uint16)
    out = np.empty((len(b), 8), np.uint16)
    for i in range(8):
        out[:, i] = ((b[:, i] << (i + 1)) & 0x1FF) | (b[:, i + 1] >> (7 - i))
    return out.ravel()


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def encode(payload: bytes) -> bytes:
    """An AVI file whose frames' coefficients are the payload (a positive multiple of 64 bytes)."""
    n = len(payload) // 64
    if n * 64 != len(payload) or not n:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    per = min(BLOCKS, n)
    frames = -(-n // per)
    v = np.zeros(frames * per * 64, np.uint8)
    v[: len(payload)] = np.frombuffer(payload, np.uint8)
    v = v.reshape(-1, 64)
    codes = AC_CODE[v]
    dc = v[:, 0].astype(np.int16) - 128
    diff = dc.copy()
    diff[1:] -= dc[:-1]
    diff[::per] = dc[::per]
    codes[:, 0] = DIFF_CODE[diff + 255]
    scan, step, head = pack9(codes.ravel()).tobytes(), per * 72, _jpeg_head(per)
    movi, index, at = [], [], 4
    for f in range(frames):
        body = head + scan[f * step : (f + 1) * step].replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
        piece = _chunk(b"00dc", body)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(body)))
        movi.append(piece)
        at += len(piece)
    largest = max(map(len, movi))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, frames, 0, 1, largest, 8, 8 * per, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, largest, 0xFFFFFFFF, 0, 0, 0, 8, 8 * per)
    strf = struct.pack("<IiiHH4sIiiII", 40, 8, 8 * per, 1, 24, b"MJPG", 192 * per, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body = b"AVI " + hdrl + _chunk(b"PLEN", struct.pack("<Q", len(payload))) + _list(b"movi", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_avi(media: bytes) -> dict:
    """Frame places (offset, length) from the index, frame rate and payload length (None if the file has none)."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"micros": 1_000_000 // FPS, "frames": [], "payload": None}
    movi, index, end = None, b"", 8 + struct.unpack_from("<I", media, 4)[0]

    def walk(at: int, stop: int) -> None:
        nonlocal movi, index
        while at + 8 <= stop:
            name, n = struct.unpack_from("<4sI", media, at)
            if at + 8 + n > stop:
                raise ValueError(f"chunk {name!r} is cut short")
            if name == b"LIST":
                if media[at + 8 : at + 12] == b"movi":
                    movi = (at + 8, at + 8 + n)
                else:
                    walk(at + 12, at + 8 + n)
            elif name == b"avih":
                out["micros"] = struct.unpack_from("<I", media, at + 8)[0]
            elif name == b"PLEN":
                out["payload"] = struct.unpack_from("<Q", media, at + 8)[0]
            elif name == b"idx1":
                index = media[at + 8 : at + 8 + n]
            at += 8 + n + (n & 1)

    walk(12, min(end, len(media)))
    if movi is None:
        raise ValueError("no movi list")
    for name, _, at, n in struct.iter_unpack("<4sIII", index):
        if name[2:] in (b"dc", b"db"):
            at += movi[0]
            if media[at : at + 4] != name or struct.unpack_from("<I", media, at + 4)[0] != n:
                raise ValueError("the index does not fit the frames")
            out["frames"].append((at + 8, n))
    if not index:  # no index: the frames one after the other
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            name, n = struct.unpack_from("<4sI", media, at)
            if name[2:] in (b"dc", b"db"):
                out["frames"].append((at + 8, n))
            at += 8 + n + (n & 1)
    return out


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, by the canonical order."""
    out, code, k = {}, 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _extend(bits: int, s: int) -> int:
    return bits if s == 0 or bits >> (s - 1) else bits - (1 << s) + 1


def _fixed(codes: dict[tuple[int, int], int]) -> np.ndarray | None:
    """Value of each 9-bit word if every symbol (without run) with its bits takes 9, unused words 9999; else None."""
    lut = np.full(512, 9999, np.int16)
    for (length, code), symbol in codes.items():
        if symbol == 0 and length == 9:
            lut[code] = 0
            continue
        if symbol >> 4 or length + symbol != 9:
            return None
        for bits in range(1 << symbol):
            lut[code << symbol | bits] = _extend(bits, symbol)
    return lut


_tables: dict[bytes, tuple] = {}


def _read_head(jpeg: bytes) -> tuple:
    """(blocks, quantisation, DC codes, AC codes, DC words, AC words, start of scan) of a baseline grey frame."""
    at, blocks, quant, dc, ac = 2, 0, None, None, None
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("marker expected")
        marker, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        if marker == 0xDB:
            quant = np.frombuffer(body[1:65], np.uint8).astype(np.float32)
        elif marker == 0xC0:
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            if parts != 1:
                raise ValueError("grey frames only")
            blocks = -(-height // 8) * -(-width // 8)
        elif marker in (0xC1, 0xC2, 0xC3):
            raise ValueError("baseline frames only")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                table = _codes(counts, body[k + 17 : k + 17 + sum(counts)])
                if body[k] >> 4:
                    ac = table
                else:
                    dc = table
                k += 17 + sum(counts)
        at += 2 + n
        if marker == 0xDA:
            return blocks, quant, dc, ac, _fixed(dc), _fixed(ac), at


def _slow_scan(scan: bytes, blocks: int, dc: dict, ac: dict) -> np.ndarray:
    """Coefficients of a scan with any tables, symbol by symbol."""
    bits = int.from_bytes(scan + b"\xff" * 8, "big")
    total, at, pred = 8 * (len(scan) + 8), 0, 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        if at > total:
            raise ValueError("the scan is cut short")
        return bits >> (total - at) & ((1 << n) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")

    out = np.zeros((blocks, 64), np.int16)
    for b in range(blocks):
        s = symbol(dc)
        pred += _extend(take(s), s)
        out[b, 0], k = pred, 1
        while k < 64:
            rs = symbol(ac)
            run, s = rs >> 4, rs & 15
            if not s:
                if run != 15:
                    break
                k += 16
                continue
            k += run
            out[b, k] = _extend(take(s), s)
            k += 1
    return out


def decode_frames(media: bytes, places: list[tuple[int, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Coefficients (blocks x 64, zigzag) of each frame, and the quantisation of the last."""
    out, quant, fast = [], np.ones(64, np.float32), []
    for at, n in places:
        jpeg = media[at : at + n]
        cut = jpeg.find(b"\xff\xda")
        cut += 2 + struct.unpack_from(">H", jpeg, cut + 2)[0]
        head = jpeg[:cut]
        if head not in _tables:
            if len(_tables) > 256:
                _tables.clear()
            _tables[head] = _read_head(head)
        blocks, quant, dc, ac, dc9, ac9, start = _tables[head]
        stop = jpeg.rfind(b"\xff\xd9")
        scan = jpeg[start:stop].replace(b"\xff\x00", b"\xff")
        if dc9 is not None and ac9 is not None and len(scan) == 72 * blocks:
            words = unpack9(np.frombuffer(scan, np.uint8)).reshape(blocks, 64)
            got = ac9[words]
            got[:, 0] = np.cumsum(dc9[words[:, 0]])
            fast.append(got)
        else:
            got = _slow_scan(scan, blocks, dc, ac)
        out.append(got)
    return out, quant


def payload_of(coefs: np.ndarray) -> bytes:
    """The bytes that ``encode`` kept as these coefficients."""
    c = coefs.reshape(-1, 64)
    v = np.where(c < 0, c + 128, c + 127)
    v[:, 0] = c[:, 0] + 128
    if len(v) and (v.min() < 0 or v.max() > 255 or not c[:, 1:].all()):
        raise ValueError("the coefficients are no payload")
    return v.astype(np.uint8).tobytes()


def histograms(coefs: np.ndarray, frame: np.ndarray, frames: int, quant: np.ndarray) -> np.ndarray:
    """Share of pixels by brightness bin, a row for each frame."""
    pix = (coefs.reshape(-1, 64).astype(np.float32) * quant) @ IDCT
    pix += 128.5
    np.clip(pix, 0, 255, out=pix)
    bins = (pix.astype(np.uint8) >> 3).astype(np.int32)
    bins += (frame * BINS)[:, None].astype(np.int32)
    h = np.bincount(bins.ravel(), minlength=frames * BINS).reshape(frames, BINS).astype(np.float64)
    return h / np.maximum(h.sum(1, keepdims=True), 1)


def cuts(hist: np.ndarray) -> list[int]:
    """Frames that begin a shot, the first not counted."""
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2 if len(hist) > 1 else np.zeros(0)
    out, since = [], 0
    for i, x in enumerate(d.tolist()):
        past = d[max(since, i - SHOT_MEMORY) : i]
        limit = SHOT_FLOOR if not len(past) else max(SHOT_FLOOR, float(past.mean() + SHOT_DEVIATIONS * past.std()))
        if x > limit:
            out.append(i + 1)
            since = i + 1
    return out


def decode(media: bytes) -> dict:
    """Payload, frame count, seconds a frame and clips [(first, end)] of a file written by ``encode``."""
    info = parse_avi(media)
    parts, quant = decode_frames(media, info["frames"])
    coefs = np.concatenate(parts)
    frame = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    hist = histograms(coefs, frame, len(parts), quant)
    edges = [0, *cuts(hist), len(parts)]
    payload = payload_of(coefs)[: info["payload"]]
    return {"payload": payload, "frames": len(parts), "micros": info["micros"], "clips": list(zip(edges, edges[1:], strict=False)), "hist": hist}


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip:int,start_s:double,end_s:double,frames:int>>"
_CLIPS = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())]))
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("clips", _CLIPS)])


def describe(text: bytes) -> dict:
    """One text stored and read back."""
    payload = text + b"\0" * (-len(text) % 64 or (64 if not text else 0))
    media = encode(payload)
    got = decode(media)
    back, s = got["payload"], got["micros"] / 1e6
    clips = [{"clip": i, "start_s": a * s, "end_s": b * s, "frames": b - a} for i, (a, b) in enumerate(got["clips"])]
    lead = (got["hist"].mean(0) * 1000).round().astype(int)
    return {
        "n_bytes": len(text), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"frames={got['frames']};shots={len(clips)};cuts={','.join(str(a) for a, _ in got['clips'][1:])};hist={'.'.join(map(str, lead[:: BINS // 8]))}", "clips": clips,
    }


def store_texts(docs: DataFrame) -> DataFrame:
    """A row for each document: sizes and digests of payload and file, a feature string, and the timed clips."""

    def run(batches):
        for b in batches:
            data, off = utf8(b.column(1))
            ids = b.column(0).cast(pa.int64()).to_pylist()
            raw, rows = data.tobytes(), []
            for k, i in enumerate(ids):
                rows.append({"doc_id": i} | describe(raw[off[k] : off[k + 1]]))
            yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return docs.select("doc_id", "text").mapInArrow(lean(run), OUT)


def clip_rows(docs: DataFrame) -> DataFrame:
    """A row for each clip: doc_id, clip, start_s, end_s, frames."""
    return store_texts(docs).selectExpr("doc_id", "inline(clips)")
