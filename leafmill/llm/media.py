"""Operator 5: timed clips of AVI motion-JPEG files.

Files are read through their RIFF index (idx1, or a walk over the movi lists where it is
missing or wrong), frames are decoded by a baseline JPEG decoder (intra frames only, as
motion-JPEG has no others), and a shot ends where the difference of luma histograms
stands out against the differences around it.

The decoder takes many frames, of many files, in lockstep: each step of its numpy loop
reads one Huffman symbol of every frame (of every restart segment), so its cost a symbol is
a few array operations shared by all.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
#: A cut differs by more than the median plus DEVIATIONS robust standard deviations of the AROUND differences on either side, and by FLOOR of the pixels at least.
DEVIATIONS, AROUND, FLOOR = 5.0, 6, 0.2
#: Luma blocks that are decoded together, about; a larger frame is alone.
BLOCKS = 1 << 17

ZIGZAG = np.array([int(x) for x in "0 1 8 16 9 2 3 10 17 24 32 25 18 11 4 5 12 19 26 33 40 48 41 34 27 20 13 6 7 14 21 28 35 42 49 56 57 50 43 36 29 22 15 23 30 37 44 51 58 59 52 45 38 31 39 46 53 60 61 54 47 55 62 63".split()])
_K = np.arange(8)
_COS = np.cos((2 * _K[:, None] + 1) * _K[None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)
# the standard's tables (K.3 to K.6), which motion-JPEG frames may leave out
_DC = (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12)))
_DC_CHROMA = (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12)))
_AC = (bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D]), bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"))
_AC_CHROMA = (bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 0x77]), bytes.fromhex(
    "0001020311040521310612415107617113223281081442" "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"))


class Broken(ValueError):
    """The bytes aren't a file or frame of the kind expected."""


def _codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, bits, symbol) of a Huffman table."""
    out, code, at = [], 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, bits, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """bits << 8 | symbol by the next 16 bits; 0 for no code."""
    table = np.zeros(1 << 16, np.int32)
    for code, bits, symbol in _codes(counts, symbols):
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return table


@dataclass
class _Frame:
    """What a frame's header says, and its entropy-coded segments."""

    units: list[tuple[int, int, tuple[bytes, bytes], tuple[bytes, bytes]]]  # (component, block of it, DC table, AC table) of each block of an MCU
    wide: int  # luma blocks of an MCU, across and down
    high: int
    across: int  # MCUs
    down: int
    restart: int
    quant: np.ndarray
    top: int  # rows and columns of the luma plane
    left: int
    segments: list[bytes]

    @property
    def blocks(self) -> int:
        return self.across * self.wide * self.down * self.high


def _header(data: bytes) -> _Frame:
    if data[:2] != b"\xff\xd8":
        raise Broken("no start of image")
    quant: dict[int, np.ndarray] = {}
    huff = {(0, 0): _DC, (1, 0): _AC, (0, 1): _DC_CHROMA, (1, 1): _AC_CHROMA}
    at, restart, parts = 2, 0, None
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if data[at] != 0xFF:
            raise Broken("no marker")
        kind = data[at + 1]
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                q = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                if len(q) != 64:
                    raise Broken("quantisation table ends early")
                quant[body[0] & 15], body = q, body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                m = sum(body[1:17])
                huff[(body[0] >> 4, body[0] & 15)], body = (body[1:17], body[17 : 17 + m]), body[17 + m :]
        elif kind in (0xC0, 0xC1):
            _, height, width, c = struct.unpack(">BHHB", body[:6])
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(c)]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            break
        elif kind in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0), 0xD9):
            raise Broken("not baseline")
    if not parts or len(parts) > 4 or not width or not height:
        raise Broken("no size")
    use = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    units = [(k, b, huff[(0, use[i] >> 4)], huff[(1, use[i] & 15)]) for k, (i, h, v, _) in enumerate(parts) for b in range(h * v)]
    segments = _segments(data, at)
    # a block takes two bits at least, so a damaged size costs no memory
    if not 0 < len(units) <= 10 or not parts[0][1] * parts[0][2] or across * down * len(units) > 4 * sum(map(len, segments)):
        raise Broken("frame ends early")
    if restart and len(segments) < -(-across * down // restart):
        raise Broken("frame ends early")
    for _, _, dc, ac in units:
        _lookup(*dc), _lookup(*ac)
    _, h, v, q = parts[0]
    return _Frame(units, h, v, across, down, restart, quant[q], -(-height * v // high), -(-width * h // wide), segments)


def _coefficients(frames: list[_Frame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(luma coefficients of all blocks, in zigzag order; each frame's first block; whether each frame was whole)."""
    tables = {key: i for i, key in enumerate(dict.fromkeys(t for f in frames for u in f.units for t in u[2:]))}
    table = np.concatenate([_lookup(*key) for key in tables])
    size = np.array([len(f.units) for f in frames])
    dc, ac, part, place = (np.zeros((len(frames), 10), np.int64) for _ in range(4))
    for i, f in enumerate(frames):
        for u, (k, b, d, a) in enumerate(f.units):
            dc[i, u], ac[i, u], part[i, u], place[i, u] = tables[d] << 16, tables[a] << 16, k, b
    wide, high, across = (np.array([getattr(f, x) for f in frames]) for x in ("wide", "high", "across"))
    first = np.concatenate([[0], np.cumsum([f.blocks for f in frames])])
    own, begin, end, mcu, stop, data, at = [], [], [], [], [], [], 0
    for i, f in enumerate(frames):
        total = f.across * f.down
        step = f.restart or total
        for k, lo in enumerate(range(0, total, step)):
            own.append(i), begin.append(8 * at), end.append(8 * (at + len(f.segments[k]) + 8)), mcu.append(lo), stop.append(min(lo + step, total))
            data += [f.segments[k], bytes(16)]
            at += len(f.segments[k]) + 16
    buf = np.frombuffer(b"".join(data), np.uint8)
    own, pos, end, mcu, stop = (np.array(x, np.int64) for x in (own, begin, end, mcu, stop))
    unit, coef = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)  # block of the MCU, place in it
    last = np.zeros((len(own), 4), np.int64)
    out, whole = np.zeros(first[-1] * 64, np.int32), np.ones(len(frames), bool)
    go = np.arange(len(own))
    while len(go):
        f, u, c, p = own[go], unit[go], coef[go], pos[go]
        byte = p >> 3
        w = buf[byte].astype(np.int64)
        for k in range(1, 5):
            w = w << 8 | buf[byte + k]
        off, is_dc = p & 7, c == 0
        x = table[np.where(is_dc, dc[f, u], ac[f, u]) + ((w >> (24 - off)) & 0xFFFF)].astype(np.int64)
        bits, symbol = x >> 8, x & 255
        n, run = symbol & 15, symbol >> 4
        raw = (w >> (40 - off - bits - n)) & ((1 << n) - 1)
        value = np.where(raw >> np.maximum(n - 1, 0) > 0, raw, raw - (1 << n) + 1)
        p = p + bits + n
        k = part[f, u]
        value[is_dc] = last[go[is_dc], k[is_dc]] = last[go[is_dc], k[is_dc]] + value[is_dc]
        spot = np.where(is_dc, 0, c + run)
        some = is_dc | (n > 0)
        bad = (x == 0) | (p > end[go]) | (is_dc & (run > 0)) | (some & (spot > 63))
        put = np.flatnonzero(some & (k == 0) & ~bad)
        g, b, m = f[put], place[f[put], u[put]], mcu[go[put]]
        y, z = m // across[g] * high[g] + b // wide[g], m % across[g] * wide[g] + b % wide[g]
        out[(first[g] + y * across[g] * wide[g] + z) * 64 + spot[put]] = value[put]
        c = np.where(is_dc, 1, np.where(n > 0, spot + 1, np.where(run == 15, c + 16, 64)))
        done = c >= 64
        u = u + done
        turn = u == size[f]
        coef[go], pos[go], unit[go] = np.where(done, 0, c), p, np.where(turn, 0, u)
        mcu[go] += turn
        whole[f[bad]] = False
        go = go[~bad & (mcu[go] < stop[go])]
    return out.reshape(-1, 64), first, whole


def planes(data: list[bytes]) -> list[np.ndarray | None]:
    """The luma plane (uint8) of each baseline JPEG; None for one that isn't whole."""
    out: list[np.ndarray | None] = [None] * len(data)
    held: list[tuple[int, _Frame]] = []

    def flush() -> None:
        if not held:
            return
        coef, first, whole = _coefficients([f for _, f in held])
        like: dict[tuple, list[int]] = {}
        for j, (_, f) in enumerate(held):
            if whole[j]:
                like.setdefault((f.down * f.high, f.across * f.wide, f.top, f.left), []).append(j)
        for (rows, columns, top, left), js in like.items():
            x = np.zeros((len(js), rows * columns, 64))
            x[..., ZIGZAG] = np.stack([coef[first[j] : first[j + 1]] for j in js]) * np.stack([held[j][1].quant for j in js])[:, None]
            pixel = _COS @ x.reshape(len(js), rows, columns, 8, 8) @ _COS.T + 128
            plane = np.clip(np.rint(pixel.transpose(0, 1, 3, 2, 4).reshape(len(js), rows * 8, columns * 8)), 0, 255).astype(np.uint8)[:, :top, :left]
            for j, own in zip(js, plane):
                out[held[j][0]] = own
        held.clear()

    blocks = 0
    for i, x in enumerate(data):
        try:
            f = _header(x)
        except (ArithmeticError, LookupError, ValueError, struct.error):
            continue
        held.append((i, f))
        blocks += f.blocks
        if blocks > BLOCKS or len(held) > 8192:
            flush()
            blocks = 0
    flush()
    return out


def luma(data: bytes) -> np.ndarray:
    """The luma plane (uint8) of a baseline JPEG; raises Broken where it isn't one."""
    (plane,) = planes([data])
    if plane is None:
        raise Broken("no whole baseline JPEG")
    return plane


def _segments(data: bytes, at: int) -> list[bytes]:
    """Entropy-coded segments between restart markers, stuffing removed."""
    out, start = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            out.append(data[start:].replace(b"\xff\0", b"\xff"))
            return out
        if data[k + 1] == 0:
            at = k + 2
        elif 0xD0 <= data[k + 1] <= 0xD7:
            out.append(data[start:k].replace(b"\xff\0", b"\xff"))
            at = start = k + 2
        elif data[k + 1] == 0xFF:
            at = k + 1
        else:
            out.append(data[start:k].replace(b"\xff\0", b"\xff"))
            return out


def frames(data: bytes) -> tuple[float, list[bytes]]:
    """(seconds a frame, compressed frames) of the first video stream of an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise Broken("no AVI file")
    seconds, stream, video, lists, index = 0.0, -1, None, [], b""
    todo = [(0, len(data))]
    while todo:
        at, end = todo.pop(0)
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            stop = min(end, at + 8 + n)
            if name in (b"RIFF", b"LIST"):
                if data[at + 8 : at + 12] == b"movi":
                    lists.append((at + 8, stop))
                else:
                    todo.append((at + 12, stop))
            elif name == b"avih" and n >= 4:
                seconds = seconds or struct.unpack("<I", data[at + 8 : at + 12])[0] / 1e6
            elif name == b"strh" and n >= 28:
                stream += 1
                if data[at + 8 : at + 12] == b"vids" and video is None:
                    video = stream
                    scale, rate = struct.unpack("<II", data[at + 28 : at + 36])
                    seconds = scale / rate if scale and rate else seconds
            elif name == b"idx1":
                index = data[at + 8 : stop]
            at += 8 + n + (n & 1)
    if not lists or seconds <= 0:
        raise Broken("no movie or no frame rate")
    names = {b"%02d%s" % (video or 0, kind) for kind in (b"dc", b"db")}
    return seconds, _indexed(data, index, lists, names) or _walked(data, lists, names)


def _indexed(data: bytes, index: bytes, lists: list[tuple[int, int]], names: set[bytes]) -> list[bytes]:
    entries = [struct.unpack("<4sIII", index[k : k + 16]) for k in range(0, len(index) - 15, 16)]
    entries = [e for e in entries if e[0] in names]
    for base in (lists[0][0], 0):  # offsets count from the list or from the file
        if len(lists) == 1 and entries and all(data[base + e[2] : base + e[2] + 8] == struct.pack("<4sI", e[0], e[3]) for e in entries):
            return [data[base + e[2] + 8 : base + e[2] + 8 + e[3]] for e in entries]
    return []


def _walked(data: bytes, lists: list[tuple[int, int]], names: set[bytes]) -> list[bytes]:
    out, todo = [], list(lists)
    while todo:
        at, end = todo.pop(0)
        at += 4
        while at + 8 <= end:
            name, n = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            if name == b"LIST":
                todo.insert(0, (at + 8, min(end, at + 8 + n)))
            elif name in names and at + 8 + n <= end:
                out.append(data[at + 8 : at + 8 + n])
            at += 8 + n + (n & 1)
    return out


_LEVEL = np.arange(256) / (256 / BINS) - 0.5
#: Weight of each grey level in each bin: linear between bin centres, so slow changes of light make small differences.
_WEIGHT = np.clip(1 - np.abs(np.clip(_LEVEL, 0, BINS - 1)[:, None] - np.arange(BINS)), 0, 1)


def histogram(plane: np.ndarray) -> np.ndarray:
    """Shares of the pixels in BINS bins of grey."""
    return np.bincount(plane.ravel(), minlength=256) @ _WEIGHT / plane.size


def shots(difference: np.ndarray) -> np.ndarray:
    """Frames that begin a shot; difference[k] is that of frame k + 1 to frame k."""
    n = len(difference)
    if not n:
        return np.array([0])
    padded = np.concatenate([np.full(AROUND, np.nan), difference, np.full(AROUND, np.nan)])
    near = np.delete(np.lib.stride_tricks.sliding_window_view(padded, 2 * AROUND + 1), AROUND, axis=1)
    limit = np.zeros(n)
    some = ~np.isnan(near).all(1)
    middle = _median(near[some])  # other cuts near by don't raise the median
    limit[some] = middle + DEVIATIONS * 1.4826 * _median(np.abs(near[some] - middle[:, None]))
    return np.append(0, np.flatnonzero((difference >= FLOOR) & (difference > np.minimum(limit, 0.9))) + 1)


def _median(rows: np.ndarray) -> np.ndarray:
    """Medians of rows, their NaNs left out."""
    x, n = np.sort(rows, 1), (~np.isnan(rows)).sum(1)
    at = np.arange(len(x))
    return (x[at, (n - 1) // 2] + x[at, n // 2]) / 2


def clips(data: bytes | None) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start, end in seconds) of a file; nothing for one that can't be read.

    An empty frame repeats the one before it, as the format has it; a broken one is taken the same way.
    """
    return clips_of([data])[0]


def clips_of(files: list[bytes | None]) -> list[list[tuple[int, int, int, float, float]]]:
    """`clips` of each file, their frames decoded together."""
    out: list[list[tuple[int, int, int, float, float]]] = [[] for _ in files]
    read, waiting = [], 0

    def flush() -> None:
        hist = [None if x is None or not x.size else histogram(x) for x in planes([x for _, _, coded in read for x in coded])]
        at = 0
        for i, seconds, coded in read:
            out[i] = _shots(seconds, hist[at : at + len(coded)])
            at += len(coded)
        read.clear()

    for i, data in enumerate(files):
        try:
            seconds, coded = frames(bytes(data or b""))
        except (ArithmeticError, LookupError, ValueError, struct.error):
            continue
        read.append((i, seconds, coded))
        waiting += len(coded)
        if waiting > 4096:
            flush()
            waiting = 0
    flush()
    return out


def _shots(seconds: float, hist: list[np.ndarray | None]) -> list[tuple[int, int, int, float, float]]:
    known = next((x for x in hist if x is not None), None)
    if known is None:
        return []
    filled = []
    for x in hist:
        known = known if x is None else x
        filled.append(known)
    h = np.stack(filled)
    start = shots(np.abs(np.diff(h, axis=0)).sum(1) / 2)
    end = np.append(start[1:], len(h))
    return [(k, int(a), int(b - a), float(a * seconds), float(b * seconds)) for k, (a, b) in enumerate(zip(start, end))]


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        while at < len(batch):  # files of some 32 MB at once, at least one
            stop, size = at, 0
            while stop < len(batch) and (stop == at or size < 32 << 20):
                size += batch.column(1)[stop].as_buffer().size if batch.column(1)[stop].is_valid else 0
                stop += 1
            found = clips_of(batch.column(1).slice(at, stop - at).to_pylist())
            rows = [(i, *c) for i, own in zip(batch.column(0).slice(at, stop - at).to_pylist(), found) for c in own]
            at = stop
            if rows:
                kinds = [pa.int64()] * 4 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["video_id", "clip", "first_frame", "n_frames", "start_s", "end_s"])


def clip_rows(videos: DataFrame, id_col: str = "video_id", data_col: str = "data") -> DataFrame:
    """(video_id, clip, first_frame, n_frames, start_s, end_s) for every shot of every file.

    Null, empty and unreadable files give no rows, broken frames count as repeats of the
    one before.  Rows that repeat an id, or have none, are each a file.  Other columns are
    ignored; an empty table gives an empty result.
    """
    videos = videos.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{data_col}`").alias("data"))
    return videos.mapInArrow(_clips, "video_id bigint, clip bigint, first_frame bigint, n_frames bigint, start_s double, end_s double")


# Writing, for tables without media and for tests.


def jpeg(blocks: np.ndarray, tables: bool = True) -> bytes:
    """A grey baseline JPEG of blocks (rows x columns x 64 zigzag coefficients, quantised by 1 in DC and AC)."""
    dc = {s: (c, b) for c, b, s in _codes(*_DC)}
    ac = {s: (c, b) for c, b, s in _codes(*_AC)}
    acc = n = last = 0

    def put(code: int, bits: int) -> None:
        nonlocal acc, n
        acc, n = acc << bits | code, n + bits

    def number(v: int, size: int) -> None:
        put(v if v >= 0 else v + (1 << size) - 1, size)

    flat = blocks.reshape(-1, 64)
    row, place = np.nonzero(flat[:, 1:])
    cut = np.searchsorted(row, np.arange(len(flat) + 1)).tolist()
    spots, values = (place + 1).tolist(), flat[row, place + 1].tolist()
    for i, level in enumerate(flat[:, 0].tolist()):
        d, last = level - last, level
        size = abs(d).bit_length()
        put(*dc[size])
        number(d, size)
        at = 1
        for spot, v in zip(spots[cut[i] : cut[i + 1]], values[cut[i] : cut[i + 1]]):
            while spot - at > 15:
                put(*ac[0xF0])
                at += 16
            size = abs(v).bit_length()
            put(*ac[spot - at << 4 | size])
            number(v, size)
            at = spot + 1
        if at < 64:
            put(*ac[0])
    pad = -n % 8
    put((1 << pad) - 1, pad)
    body = acc.to_bytes(n // 8, "big").replace(b"\xff", b"\xff\0")
    seg = lambda kind, x: b"\xff" + bytes([kind]) + struct.pack(">H", len(x) + 2) + x
    out = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([1] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, blocks.shape[0] * 8, blocks.shape[1] * 8, 1) + b"\1\x11\0")
    if tables:
        out += seg(0xC4, b"\0" + _DC[0] + _DC[1]) + seg(0xC4, b"\x10" + _AC[0] + _AC[1])
    return out + seg(0xDA, b"\1\1\0\0\x3f\0") + body + b"\xff\xd9"


def avi(coded: list[bytes], width: int, height: int, fps: int = 25, index: bool = True) -> bytes:
    """A motion-JPEG AVI file of compressed frames."""
    chunk = lambda name, x: name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) & 1)
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 16, len(coded), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(coded), 0, 0, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, idx, at = [], [], 4
    for frame in coded:
        movi.append(chunk(b"00dc", frame))
        idx.append(struct.pack("<4sIII", b"00dc", 16, at, len(frame)))
        at += len(movi[-1])
    body = b"AVI " + hdrl + chunk(b"LIST", b"movi" + b"".join(movi)) + (chunk(b"idx1", b"".join(idx)) if index else b"")
    return b"RIFF" + struct.pack("<I", len(body)) + body
