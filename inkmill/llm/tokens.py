"""Token-id files: each document's ids are packed on their own with one shared zstandard dictionary.

The dictionary is trained on the serialised ids of a bounded sample of documents. Files follow ascending
doc_id; each holds the dictionary's SHA-256 and, at its end, an index of doc_id, place and number of ids,
so that one short document is read without the others. A file is written under a passing name and moved,
so that a task that is run again, or twice, leaves whole files only; its name and bytes depend on its
documents alone.

    file: magic 8 bytes | sha256 of the dictionary 32 bytes | width of an id 1 byte | packed documents
          | index: doc_id, has_id, offset, length, n_tokens as arrays of 64-bit integers | n documents 8 bytes | magic

Encoding: a text is cut before white space that follows something else. There the tokenizer's own
pre-tokenizer cuts too, so equal pieces have equal ids wherever they stand; each worker encodes a piece
once and remembers it, in bounded arrays that its next tasks use, too. Texts are cut, and ids put together,
by Arrow and numpy for a group of texts at once. A piece of Latin letters and ASCII signs goes to the
library's BPE model word by word, any other to its whole tokenizer; texts with a special token's string are
encoded whole, as are all texts where the tokenizer's file names a normalizer or another pre-tokenizer than
plain byte level.

Defined results: a null text counts as empty; each document ends with id 0; a null doc_id comes first;
rows of one doc_id follow in the order of a hash of their text; an empty table writes no files and gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.llm._shared import cut, hash_order, new_folder, small_batches

MAGIC = b"IMTOKEN1"
END_ID = 0
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 8192, 65536, 1
#: A file is closed when it has this many bytes; so much of it is in memory at most, and one document.
FILE_BYTES = 32 << 20
#: Documents in a range, about, and ranges at most, beyond which they hold more; a range has as many files as it needs.
DOCS_IN_RANGE, MOST_RANGES, MOST_READERS = 20_000, 4096, 20_000
CACHE_PIECES = 400_000
#: Longer pieces are not remembered; texts are encoded by so many bytes at a time; longer ones are cut in Python.
LONGEST_PIECE, GROUP_BYTES, LONGEST_EVEN = 64, 8 << 20, 256 << 20
#: White space and what follows it up to the next; signs that count as white space here but not to all libraries.
PIECES, OUTSIDE = re.compile(r"\s*\S+|\s+"), re.compile("[\x1c-\x1f]")
#: Texts with runs of white space, with it at an end, or with other than spaces and line ends; a sign that no other text has.
UNEVEN = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CUT = "\x1f"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [letters[b] for b in range(256)]


BYTE_LETTERS = _byte_letters()
_LETTERS, _SIGNS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", r"[!-/:-@\[-`{-~]+"
#: A line end, a word of Latin letters and ASCII signs: the parts that the pre-tokenizer sees in most pieces.
SIMPLE = rf"\A(?P<line>\n?)(?:(?P<word> ?{_LETTERS})(?P<signs>{_SIGNS})?|(?P<alone> ?{_SIGNS}))\z"


def _runs(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of each pair, one behind the other."""
    end = np.cumsum(length)
    at = np.repeat((start - end + length).astype(np.int32), length)
    at += np.arange(len(at), dtype=np.int32)
    return flat[at]


class Known:
    """Strings and their ids, kept as arrays: at most `CACHE_PIECES` of at most `LONGEST_PIECE` bytes."""

    def __init__(self, kind: np.dtype):
        self.strings = pa.array([], pa.string())
        self.flat, self.start, self.length = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, strings: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it those of each of these different strings start and how many they are."""
        at = pc.index_in(strings, value_set=self.strings)
        new = np.asarray(at.is_null())
        at = np.array(at.fill_null(0), np.int64)
        at[new] = len(self.strings) + np.arange(new.sum())
        fresh = strings.filter(pa.array(new))
        ids, n = encode(fresh)
        flat = np.concatenate([self.flat, ids])
        start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
        length = np.concatenate([self.length, n])
        if len(start) > CACHE_PIECES:
            # what these texts have is likelier to come again than what only others had
            self._keep(strings.slice(0, CACHE_PIECES), flat, start[at[:CACHE_PIECES]], length[at[:CACHE_PIECES]])
        else:
            self._keep(pa.concat_arrays([self.strings, fresh]), flat, start, length)
        return flat, start[at], length[at]

    def _keep(self, strings: pa.Array, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        short = np.asarray(pc.less_equal(pc.binary_length(strings), LONGEST_PIECE))
        self.strings, self.length = strings.filter(pa.array(short)), length[short]
        self.flat, self.start = _runs(flat, start[short], self.length), np.cumsum(self.length) - self.length


class Encoder:
    """Ids of texts as packed little-endian integers, by a byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        #: Whether pieces may be encoded apart: byte level words cut by the usual rule, from the text as it stands.
        said = json.loads(self.tokenizer.to_str())
        cutter = said["pre_tokenizer"] or {}
        self.apart = said["normalizer"] is None and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter["add_prefix_space"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of pieces, and of the pre-tokenizer's words.
        self.pieces, self.words = Known(self.kind), Known(self.kind)
        self.end = self._packed([END_ID])

    def _packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def whole(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pre-tokenizer's words, and how many each has."""
        tokenize, ids, n = self.model.tokenize, array("I"), array("q")
        for word in words.to_pylist():
            found = [t.id for t in tokenize("".join([BYTE_LETTERS[b] for b in word.encode()]))] if word else []
            ids.extend(found)
            n.append(len(found))
        return np.array(ids, self.kind), np.array(n, np.int64)

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has: word by word, or by the whole tokenizer."""
        parts = pc.extract_regex(pieces, SIMPLE)
        other = np.asarray(parts.is_null())
        n = len(pieces)
        words = pa.concat_arrays([pc.fill_null(pc.struct_field(parts, i), "") for i in range(4)]).dictionary_encode()
        flat, start, length = self.words.find(words.dictionary, self._of_words)
        at = np.asarray(words.indices)
        start, length = (x[at].reshape(4, n).T.copy() for x in (start, length))
        wholes = [np.frombuffer(self.whole(p), self.kind) for p in pieces.filter(pa.array(other)).to_pylist()]
        sizes = np.array([len(w) for w in wholes], np.int64)
        start[other, 0], length[other, 0] = len(flat) + np.cumsum(sizes) - sizes, sizes
        return _runs(np.concatenate([flat, *wholes]), start.ravel(), length.ravel()), length.sum(axis=1)

    def _group(self, texts: pa.Array) -> list[bytes]:
        uneven = pc.or_(pc.match_substring_regex(texts, UNEVEN), pc.greater(pc.binary_length(texts), LONGEST_EVEN))
        for sign in self.special:
            uneven = pc.or_(uneven, pc.match_substring(texts, sign))
        even = pc.if_else(uneven, "", texts)
        even = pc.split_pattern(pc.replace_substring(pc.replace_substring(even, " ", CUT + " "), "\n", CUT + "\n"), CUT)
        bounds = np.asarray(even.offsets)
        first, last = bounds[:-1].copy(), bounds[1:].copy()
        others, wholes = [], {}
        for i in np.flatnonzero(np.asarray(uneven)).tolist():
            text = texts[i].as_py()
            if OUTSIDE.search(text) or any(s in text for s in self.special):
                wholes[i] = self.whole(text)
            else:
                first[i] = bounds[-1] + len(others)
                others += PIECES.findall(text)
                last[i] = bounds[-1] + len(others)
        pieces = pa.concat_arrays([even.flatten(), pa.array(others, pa.string())]).dictionary_encode()
        flat, start, length = self.pieces.find(pieces.dictionary, self._of_pieces)
        at = np.asarray(pieces.indices)
        length = length[at]
        data = memoryview(_runs(flat, start[at], length).tobytes())
        byte = np.r_[0, np.cumsum(length)] * self.width
        return [b"".join((wholes.get(i, data[a:b]), self.end)) for i, (a, b) in enumerate(zip(byte[first].tolist(), byte[last].tolist()))]

    def __call__(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text, with the end id."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        texts = texts.fill_null("")
        if not self.apart:
            return [self.whole(t) + self.end for t in texts.to_pylist()]
        size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        out: list[bytes] = []
        while len(out) < len(texts):
            at = len(out)
            until = np.searchsorted(size, (size[at - 1] if at else 0) + GROUP_BYTES, "right")
            out += self._group(texts.slice(at, max(1, int(until) - at)))
        return out


@functools.lru_cache(1)
def _loaded(path: str, changed: int) -> Encoder:
    return Encoder(path)


def worker_encoder(path: str) -> Encoder:
    """The encoder of this process, with what it remembers from the tasks before."""
    return _loaded(path, os.stat(path).st_mtime_ns)


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """A dictionary from the ids of a sample of at most `SAMPLE_DOCS` documents, `SAMPLE_BYTES` of each.

    Too small a sample for training serves as it is, as raw content.
    """
    n = max(1, docs.count())
    drawn = docs.where(F.pmod(hash_order("doc_id", 61), F.lit(n)) < 2 * SAMPLE_DOCS).select(F.substring("text", 1, SAMPLE_BYTES).alias("text"), hash_order("doc_id", 61).alias("at"))
    texts = [r.text for r in drawn.orderBy("at", "text").limit(SAMPLE_DOCS).collect()]
    samples = [s[:SAMPLE_BYTES] for s in Encoder(tokenizer_path)(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\0")


def _words(content: bytes) -> zstandard.ZstdCompressionDict:
    trained = content[:4] == (0xEC30A437).to_bytes(4, "little")
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Gathers packed documents and writes them as one file."""

    def __init__(self, sha: bytes, width: int):
        self.sha, self.width = sha, width
        self.blobs: list[bytes] = []
        self.index: list[tuple[int, int, int, int, int]] = []
        self.at = len(MAGIC) + 33

    def add(self, doc_id: int | None, n_tokens: int, blob: bytes) -> None:
        self.index.append((doc_id or 0, doc_id is not None, self.at, len(blob), n_tokens))
        self.blobs.append(blob)
        self.at += len(blob)

    def write(self, folder: str, name: str) -> tuple[str, int, int]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        passing = f"{root}/.{name}-{uuid.uuid4().hex}"
        index = np.array(self.index, "<i8").reshape(-1, 5)
        with store.open_output_stream(passing) as out:
            for part in (MAGIC, self.sha, bytes([self.width]), *self.blobs, index.T.tobytes(), len(index).to_bytes(8, "little"), MAGIC):
                out.write(part)
        store.move(passing, f"{root}/{name}")
        return name, len(index), int(index[:, 4].sum())


class Reader:
    """A token-id file. `ids(i)` reads one document through the index."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        store, root = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{root}/{name}")
        size = self.file.size()
        tail = self._at(size - 16, 16)
        head = self._at(0, len(MAGIC) + 33)
        if tail[8:] != MAGIC or head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{name} is no whole token-id file")
        if head[len(MAGIC) : len(MAGIC) + 32] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was packed with another dictionary")
        self.kind = np.dtype(f"<u{head[-1]}")
        n = int.from_bytes(tail[:8], "little")
        self.doc_id, self.has_id, self.offset, self.length, self.n_tokens = np.frombuffer(self._at(size - 16 - 40 * n, 40 * n), "<i8").reshape(5, n)
        self.unpack = zstandard.ZstdDecompressor(dict_data=_words(dictionary))

    def _at(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def __len__(self) -> int:
        return len(self.doc_id)

    def ids(self, i: int) -> np.ndarray:
        """The i-th document's ids, its end id among them, as unsigned 32-bit integers."""
        packed = self._at(int(self.offset[i]), int(self.length[i]))
        return np.frombuffer(self.unpack.decompress(packed, max_output_size=int(self.n_tokens[i]) * self.kind.itemsize), self.kind).astype("<u4")


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, dictionary: bytes) -> DataFrame:
    """Writes docs to folder; gives the table of files: name, place, n_docs, n_tokens, first (ids before it)."""
    spark = docs.sparkSession
    small_batches(spark)
    n, nulls = docs.agg(F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = max(1, min(MOST_RANGES, -(-n // DOCS_IN_RANGE)))
    # documents without a doc_id stand before all ranges, or with the first if they are few
    before_all = min(MOST_RANGES, nulls // DOCS_IN_RANGE)
    bounds: list[int] = []
    if ranges > 1:
        bounds = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("b")).first().b or []
    ends = np.array(sorted(bounds), np.int64)
    shared = spark.sparkContext.broadcast(dictionary)
    sha = hashlib.sha256(dictionary).digest()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_words(shared.value), write_content_size=True)
        for batch in batches:
            ids, tie = batch.column(0), batch.column(1).to_numpy()
            known = np.asarray(ids.is_valid())
            value = np.asarray(ids.fill_null(0))
            first = np.where(known, np.searchsorted(ends, value, "left"), 0)
            # a doc_id that fills whole ranges is dealt over them by the hash of its text
            span = np.where(known, np.searchsorted(ends, value, "right"), 0) - first
            place = before_all + first + np.where(span > 1, (tie & 0x7FFFFFFFFFFFFFFF) % (span + 1), 0)
            if before_all:
                place = np.where(known, place, (tie & 0x7FFFFFFFFFFFFFFF) % before_all)
            order = np.where(span > 1, place, 0)
            packed, count = [], []
            for data in encoder(batch.column(2)):
                count.append(len(data) // encoder.width)
                packed.append(pack.compress(data))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), ids, pa.array(order, pa.int64()), batch.column(1), pa.array(count, pa.int64()), pa.array(packed, pa.binary())], names=["place", "doc_id", "dealt", "tie", "n", "blob"])

    width = Encoder(tokenizer_path).width

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, writer = None, 0, Writer(sha, width)

        def close() -> pa.RecordBatch:
            name, docs_in, tokens_in = writer.write(folder, f"tokens-{now:08d}-{part:04d}.imt")
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, now, part, docs_in, tokens_in)], names=["name", "place", "part", "n_docs", "n_tokens"])

        for batch in batches:
            place, ids, counts, blobs = (batch.column(i).to_pylist() for i in (0, 1, 4, 5))
            for p, i, c, b in zip(place, ids, counts, blobs):
                if p != now or writer.at > FILE_BYTES:
                    if writer.index:
                        yield close()
                    part = part + 1 if p == now else 0
                    now, writer = p, Writer(sha, width)
                writer.add(i, c, b)
        if writer.index:
            yield close()

    encoded = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(encode, "place long, doc_id long, dealt long, tie long, n long, blob binary")
    # by number, not by hash, under which a few tasks would hold several ranges
    ordered = encoded.repartitionById(before_all + ranges, F.col("place").cast("int")).sortWithinPartitions("place", F.asc_nulls_first("doc_id"), "tie")
    files = cut(ordered.mapInArrow(write, "name string, place long, part long, n_docs long, n_tokens long"))
    before = Window.orderBy("place", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, files: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    shared = spark.sparkContext.broadcast(dictionary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Reader(folder, name, shared.value)
                crcs, counts = [], []
                for i in range(len(file)):
                    ids = file.ids(i)
                    crcs.append(zlib.crc32(ids.tobytes()))
                    counts.append(len(ids))
                starts = first + np.r_[0, np.cumsum(counts)[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_id, pa.int64(), mask=file.has_id == 0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    # a task for each few files: by their number, as the rows are too small to be dealt by size
    tasks = max(1, min(files.count(), MOST_READERS))
    return files.select("name", "first").repartition(tasks, "name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encodes docs, writes them as token-id files in the shared folder and reads those back."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path)
    folder = new_folder(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, tokenizer_path, folder, dictionary), folder, dictionary)
