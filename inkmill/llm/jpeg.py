"""JPEG frames without any imaging library: lossless (SOF3) both ways, baseline (SOF0) decoding.

Lossless frames are written with a Huffman table in which a difference of s bits has a code of 9 - s bits,
s = 0 .. 8 (the all-ones code of nine bits stays free, as the standard asks). So each sample takes nine
bits, code and difference together, and whole frames are read and written by table look-up.
"""

from __future__ import annotations

import struct

import numpy as np

SOI, EOI = b"\xff\xd8", b"\xff\xd9"
CODE_BITS = 9
DHT = b"\xff\xc4" + struct.pack(">HB", 2 + 1 + 16 + 9, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Nine-bit fields by difference + 255, and differences by field."""
    fields = np.zeros(511, np.uint16)
    back = np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code = (1 << (8 - s)) - 1 << 1
        field = code << s | (d if d >= 0 else d + (1 << s) - 1)
        fields[d + 255] = field
        back[field] = d
    return fields, back


FIELDS, DIFFERENCES = _tables()


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """JPEG files of 8-bit greyscale frames (n, height, width), each sample predicted from its left."""
    n, height, width = frames.shape
    x = frames.astype(np.int16)
    before = np.empty_like(x)
    before[:, :, 1:] = x[:, :, :-1]
    before[:, 1:, 0] = x[:, :-1, 0]
    before[:, 0, 0] = 128
    fields = FIELDS[(x - before + 255).reshape(n, -1)]
    bits = (fields[:, :, None] >> np.arange(CODE_BITS - 1, -1, -1, dtype=np.uint16)) & 1
    rest = -(height * width * CODE_BITS) % 8
    bits = bits.reshape(n, -1).astype(np.uint8)
    if rest:
        bits = np.c_[bits, np.ones((n, rest), np.uint8)]
    head = SOI + DHT + b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00" + b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00"
    return [head + row.tobytes().replace(b"\xff", b"\xff\x00") + EOI for row in np.packbits(bits, axis=1)]


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8

    def peek(self, n: int) -> int:
        # ones follow the end, as a coder pads
        if self.left >= n:
            return self.value >> (self.left - n) & ((1 << n) - 1)
        short = n - self.left
        return (self.value & ((1 << self.left) - 1)) << short | ((1 << short) - 1)

    def skip(self, n: int) -> None:
        self.left = max(0, self.left - n)

    def take(self, n: int) -> int:
        out = self.peek(n) if n else 0
        self.skip(n)
        return out

    def difference(self, s: int) -> int:
        v = self.take(s)
        return v if not s or v >> (s - 1) else v - (1 << s) + 1


class _Chunks(_Bits):
    """_Bits over a long scan, a piece at a time, so that shifts stay short."""

    STEP = 64

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        super().__init__(b"")
        self._more()

    def _more(self) -> None:
        while self.left < 64 and self.at < len(self.data):
            piece = self.data[self.at : self.at + self.STEP]
            self.at += len(piece)
            self.value = (self.value & ((1 << self.left) - 1)) << (8 * len(piece)) | int.from_bytes(piece, "big")
            self.left += 8 * len(piece)

    def peek(self, n: int) -> int:
        if self.left < n:
            self._more()
        return super().peek(n)


def _huffman(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    table, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            table[length, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def _symbol(bits: _Bits, table: dict[tuple[int, int], int]) -> int:
    word = bits.peek(16)
    for length in range(1, 17):
        if (found := table.get((length, word >> (16 - length)))) is not None:
            bits.skip(length)
            return found
    raise ValueError("no such Huffman code")


class Frame:
    """The headers of a JPEG file and its scan, still packed."""

    def __init__(self, data: bytes):
        if data[:2] != SOI:
            raise ValueError("no JPEG file")
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], dict] = {}
        self.raw_tables = b""
        self.restart, self.kind, at = 0, None, 2
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            mark, (size,) = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + size]
            if mark == 0xDB:
                while body:
                    wide, n = body[0] >> 4, body[0] & 15
                    width = 64 << (wide > 0)
                    self.quant[n] = np.frombuffer(body[1 : 1 + width], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[1 + width :]
            elif mark == 0xC4:
                self.raw_tables += data[at : at + 2 + size]
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0] >> 4, body[0] & 15] = _huffman(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif mark in (0xC0, 0xC1, 0xC3):
                self.kind = mark
                self.bits, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC0 < mark < 0xD0 and mark not in (0xC8, 0xCC):
                raise ValueError(f"JPEG process {mark:#x} is not read here")
            elif mark == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif mark == 0xDA:
                n = body[0]
                self.scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)}
                self.predictor, self.shift = body[1 + 2 * n], body[3 + 2 * n] & 15
                at += 2 + size
                break
            at += 2 + size
        if self.kind is None:
            raise ValueError("a scan without a frame")
        end = data.rfind(EOI)
        self.packed = data[at : end if end >= at else len(data)]

    @property
    def plain(self) -> bool:
        """Whether encode_lossless may have made it."""
        return self.kind == 0xC3 and self.raw_tables == DHT and self.predictor == 1 and len(self.parts) == 1 and not (self.shift or self.restart) and self.bits == 8

    def intervals(self) -> list[bytes]:
        parts, at, found = [], 0, self.packed.find(b"\xff")
        while found >= 0:
            if 0xD0 <= self.packed[found + 1 : found + 2][0] <= 0xD7 if found + 1 < len(self.packed) else False:
                parts.append(self.packed[at:found])
                at = found + 2
            found = self.packed.find(b"\xff", found + 2)
        return [p.replace(b"\xff\x00", b"\xff") for p in (*parts, self.packed[at:])]


def decode_plain(frames: list[Frame]) -> np.ndarray:
    """Frames of encode_lossless and of one size, all at once."""
    height, width = frames[0].height, frames[0].width
    n, size = len(frames), height * width
    raw = b"".join(f.packed.replace(b"\xff\x00", b"\xff") for f in frames)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(n, -1), axis=1)[:, : size * CODE_BITS]
    fields = bits.reshape(n, size, CODE_BITS) @ (1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.uint16))
    d = DIFFERENCES[fields].reshape(n, height, width).astype(np.int32)
    # the first sample of a row is predicted from above, the others from their left
    first = np.cumsum(d[:, :, 0], axis=1) + 128
    d[:, :, 0] = first
    return np.cumsum(d, axis=2).astype(np.uint8)


def _decode_lossless(f: Frame) -> np.ndarray:
    (part,) = f.parts  # greyscale
    table = f.tables[0, f.scan[part[0]][0]]
    out = np.zeros((f.height, f.width), np.int64)
    bits = [_Chunks(p) for p in f.intervals()]
    left, now = f.restart or f.height * f.width, 0
    fresh = True
    for y in range(f.height):
        for x in range(f.width):
            if not left:
                now, left, fresh = now + 1, f.restart, True
            a, b = int(out[y, x - 1]) if x else 0, int(out[y - 1, x]) if y else 0
            c = int(out[y - 1, x - 1]) if x and y else 0
            if fresh:
                guess = 1 << (f.bits - f.shift - 1)
            elif not y:
                guess = a
            elif not x:
                guess = b
            else:
                guess = (0, a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[f.predictor]
            s = _symbol(bits[now], table)
            out[y, x] = guess + (32768 if s == 16 else bits[now].difference(s)) & 0xFFFF
            left, fresh = left - 1, False
    return (out << f.shift).astype(np.uint8 if f.bits == 8 else np.uint16)


def _zigzag() -> np.ndarray:
    """Place in a block of 8 by 8 by order in the stream: along the diagonals, turning at each end."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


ZIGZAG = _zigzag()
_k = np.arange(8)
COSINES = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5)


def _decode_baseline(f: Frame) -> np.ndarray:
    """Samples (height, width), of the first component where there are more (luminance)."""
    wide, high = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    if len(f.parts) == 1:
        f.parts, wide, high = [(f.parts[0][0], 1, 1, f.parts[0][3])], 1, 1
    columns, rows = -(-f.width // (8 * wide)), -(-f.height // (8 * high))
    planes = [np.zeros((rows * p[2] * 8, columns * p[1] * 8)) for p in f.parts]
    streams = [_Chunks(p) for p in f.intervals()]
    last = [0] * len(f.parts)
    for unit in range(rows * columns):
        now = unit // f.restart if f.restart else 0
        if f.restart and unit % f.restart == 0:
            last = [0] * len(f.parts)
        bits = streams[now]
        for i, (name, h, v, q) in enumerate(f.parts):
            dc, ac = f.scan[name]
            for k in range(h * v):
                block = np.zeros(64)
                last[i] += bits.difference(_symbol(bits, f.tables[0, dc]))
                block[0], at = last[i] * f.quant[q][0], 1
                while at < 64:
                    run = _symbol(bits, f.tables[1, ac])
                    if run == 0:
                        break
                    at += run >> 4
                    if run & 15:
                        block[ZIGZAG[at]] = bits.difference(run & 15) * f.quant[q][at]
                    at += 1
                y, x = (unit // columns * v + k // h) * 8, (unit % columns * h + k % h) * 8
                planes[i][y : y + 8, x : x + 8] = COSINES.T @ block.reshape(8, 8) @ COSINES
    luma = planes[0][: -(-f.height * f.parts[0][2] // high), : -(-f.width * f.parts[0][1] // wide)]
    return np.clip(np.rint(luma + 128), 0, 255).astype(np.uint8)[: f.height, : f.width]


def decode(data: bytes) -> np.ndarray:
    """Samples of one frame."""
    f = Frame(data)
    if f.plain:
        return decode_plain([f])[0]
    return _decode_lossless(f) if f.kind == 0xC3 else _decode_baseline(f)
