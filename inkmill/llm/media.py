"""AVI motion-JPEG columns: storing, reading through the RIFF index, and shots as timed clips.

Bytes are stored as frames of `SIDE` by `SIDE` 8-bit samples, each a lossless JPEG, in an AVI file with an
idx1 index. Reading parses the RIFF lists and the index, decodes the intra frames, and compares the
histograms of neighbouring frames: a shot ends where the difference is above mean + `SPREAD` standard
deviations of the differences within `AROUND` frames, above `LEAST`, and the greatest of its neighbours.

Defined results: a null text counts as empty; an empty text is one frame of bytes 255; equal texts have
equal files and features; an AVI column that is null or broken gives a row with an error and no clips; an
empty table gives no rows. Frames are handled `BLOCK` at a time, so a long text needs few times its size.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkmill.llm import jpeg
from inkmill.llm._shared import small_batches

SIDE, RATE = 24, 25
UNIT, FILL = SIDE * SIDE, b"\xff"
BINS, AROUND, SPREAD, LEAST = 32, 8, 2.0, 0.10
BLOCK = 1024


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those bytes filled up to a positive multiple of UNIT)."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + FILL * (-len(data) % UNIT if data else UNIT)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE) -> bytes:
    """An AVI file of JPEG frames with its index."""
    most = max(map(len, frames), default=0)
    avih = struct.pack("<10I16x", 1_000_000 // rate, most * rate, 0, 0x10, len(frames), 0, 1, most, width, height)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, rate, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    index, parts, at = [], [b"movi"], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        parts.append(_chunk(b"00dc", f))
        at += len(parts[-1])
    body = b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


class Avi:
    """An AVI file: its frame rate and, through idx1 or else the movi list, its video frames."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
            raise ValueError("no AVI file")
        self.data, self.rate, self.spans = memoryview(data), float(RATE), []
        movi, index, loose = None, None, []
        todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
        while todo:
            at, end = todo.pop()
            while at + 8 <= end:
                name, (size,) = data[at : at + 4], struct.unpack_from("<I", data, at + 4)
                body = at + 8
                if name == b"LIST":
                    if data[body : body + 4] == b"movi":
                        movi = body
                    todo.append((body + 4, min(end, body + size)))
                elif name == b"strh" and data[body : body + 4] == b"vids":
                    scale, rate = struct.unpack_from("<II", data, body + 20)
                    if scale and rate:
                        self.rate = rate / scale
                elif name == b"idx1":
                    index = (body, size)
                elif name[2:] in (b"dc", b"db"):
                    loose.append((body, size))
                at = body + size + (size & 1)
        if index and movi is not None:
            entries = [struct.unpack_from("<4sIII", data, index[0] + 16 * i) for i in range(index[1] // 16)]
            video = [e for e in entries if e[0][2:] in (b"dc", b"db")]
            if video:
                # offsets count from the movi list, or in some files from the file's start
                base = movi if data[movi + video[0][2] : movi + video[0][2] + 4] == video[0][0] else 0
                self.spans = [(base + e[2] + 8, e[3]) for e in video]
        if not self.spans:
            self.spans = sorted(loose)

    def __len__(self) -> int:
        return len(self.spans)

    def frames(self, block: int = BLOCK) -> Iterator[np.ndarray]:
        """Decoded frames (n, height, width), block by block; those of one block have one size."""
        for at in range(0, len(self.spans), block):
            packed = [jpeg.Frame(bytes(self.data[a : a + n])) for a, n in self.spans[at : at + block]]
            if all(f.plain and (f.height, f.width) == (packed[0].height, packed[0].width) for f in packed):
                yield jpeg.decode_plain(packed)
            else:
                for a, n in self.spans[at : at + block]:
                    yield jpeg.decode(bytes(self.data[a : a + n]))[None]


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of the samples in BINS bins, for each frame."""
    n = len(frames)
    level = frames.reshape(n, -1).astype(np.int64)
    level = level * BINS >> (8 if frames.dtype == np.uint8 else 16)
    counts = np.bincount((level + np.arange(n)[:, None] * BINS).ravel(), minlength=n * BINS).reshape(n, BINS)
    return counts / level.shape[1]


def cuts(shares: np.ndarray) -> list[int]:
    """Frames that begin a new shot, after the first."""
    n = len(shares)
    if n < 2:
        return []
    d = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    total, square = np.r_[0, np.cumsum(d)], np.r_[0, np.cumsum(d * d)]
    i = np.arange(len(d))
    a, b = np.maximum(i - AROUND, 0), np.minimum(i + AROUND + 1, len(d))
    mean = (total[b] - total[a]) / (b - a)
    spread = np.sqrt(np.maximum((square[b] - square[a]) / (b - a) - mean**2, 0))
    peak = (d >= np.r_[0, d[:-1]]) & (d > np.r_[d[1:], 0])
    return (np.flatnonzero(peak & (d > LEAST) & (d > mean + SPREAD * spread)) + 1).tolist()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, the text's bytes as an AVI file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            # few rows at a time: files are larger than their texts
            for at in range(0, len(texts), 100):
                sizes, files = [], []
                for text in texts.slice(at, 100).to_pylist():
                    n, payload = payload_of(text)
                    samples = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE)
                    frames = [f for k in range(0, len(samples), BLOCK) for f in jpeg.encode_lossless(samples[k : k + BLOCK])]
                    sizes.append(n)
                    files.append(write_avi(frames, SIDE, SIDE))
                yield pa.RecordBatch.from_arrays([ids.slice(at, 100), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: bytes | None) -> dict:
    """Rate, payload figures, shot starts and mean levels of an AVI file, or its error."""
    try:
        if media is None:
            raise ValueError("no file")
        film = Avi(media)
        sha, n, tail, shares, level = hashlib.sha256(), 0, b"", [], 0
        for frames in film.frames():
            data = frames.tobytes()
            sha.update(data)
            n, tail, level = n + len(data), (tail + data)[-32:], level + int(frames.sum(dtype=np.int64))
            shares.append(histograms(frames))
        starts = cuts(np.concatenate(shares)) if shares else []
        return {"rate": film.rate, "frames": len(film), "payload_bytes": n, "payload_sha256": sha.hexdigest(), "tail_crc32": zlib.crc32(tail), "starts": starts, "level": level / n if n else 0.0, "error": None}
    except (ValueError, struct.error, IndexError, KeyError) as e:
        return {"rate": 0.0, "frames": 0, "payload_bytes": 0, "payload_sha256": None, "tail_crc32": None, "starts": [], "level": 0.0, "error": str(e) or type(e).__name__}


def clips(stored: DataFrame) -> DataFrame:
    """doc_id, shot, first_frame, end_frame, start_s and end_s: a row for each shot of the column `media`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                film = read(media)
                bounds = [0, *film["starts"], film["frames"]]
                rows += [(doc_id, k, a, b, a / film["rate"], b / film["rate"]) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "shot", "first_frame", "end_frame", "start_s", "end_s"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, shot int, first_frame int, end_frame int, start_s double, end_s double")


def op8(docs: DataFrame) -> DataFrame:
    """Stores every text, reads the stored bytes back and gives their digests and shots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            films = [read(m) for m in media]
            marks = [f"frames={f['frames']};level={f['level']:.3f};shots={len(f['starts']) + 1};cuts={','.join(map(str, f['starts']))}" for f in films]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([f["payload_bytes"] for f in films], pa.int64()),
                    pa.array([f["payload_sha256"] for f in films], pa.string()),
                    pa.array([f["tail_crc32"] for f in films], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                    pa.array(marks, pa.string()),
                ],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return store(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
