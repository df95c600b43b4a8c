"""Language identification by compression: the language whose dictionary packs a text smallest wins.

For each language a raw-content zstandard dictionary is made of a bounded sample of its training rows
(`SAMPLE_DOCS` documents by a hash of doc_id, of them whole texts up to `SAMPLE_BYTES` in all; a language
that has longer texts only gets its shortest). A text is cut
into pieces of `PIECE` bytes, each packed with every dictionary, and the sizes are added up over the
whole text. The margin is what the second best needs beyond the best, as a share of the best; below
`MIN_MARGIN` the answer is marked as rejected.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; equal sizes go
to the language with more training rows, then to the one that sorts first; a table without training rows
gives `und` throughout; equal texts get equal answers. Only doc_id, text and lang are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm._shared import hash_order, held_out, small_batches

SAMPLE_DOCS, SAMPLE_BYTES, MAX_LANGUAGES = 192, 160_000, 512
PIECE, LEVEL, MIN_MARGIN = 1024, 6, 0.01
#: Letters, and numbers and signs that are no digits: `str.isalpha` tells them apart.
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def learn(training: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(lang, dictionary content) of the non-null languages in training, the commonest first."""
    known = training.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    n = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]
    text = F.lower("text")
    short = known.where(F.octet_length("text") <= SAMPLE_BYTES)
    drawn = short.where(F.pmod(hash_order("doc_id", 2), n) < sample_docs).select("lang", text.alias("text"), hash_order("doc_id", 3).alias("at"))
    # rows of a sample are bounded, and so are their texts
    rows = drawn.orderBy("at", "text").limit(3 * sample_docs * len(counts)).toLocalIterator()
    content: dict[str, list[bytes]] = {lang: [] for lang in counts}
    held = dict.fromkeys(counts, 0)
    for r in rows:
        data = r.text.encode("utf-8", "replace")
        if len(content[r.lang]) < sample_docs and held[r.lang] + len(data) <= SAMPLE_BYTES:
            content[r.lang].append(data)
            held[r.lang] += len(data)
    if none := [lang for lang in counts if not held[lang]]:
        for r in known.where(F.col("lang").isin(none)).groupBy("lang").agg(F.min_by(text, F.struct(F.octet_length("text"), "text")).alias("text")).toLocalIterator():
            content[r.lang] = [r.text.encode("utf-8", "replace")]
    return [(lang, b"\n".join(content[lang])) for lang in sorted(counts, key=lambda x: (-counts[x], x))]


class Classifier:
    """The packers of all languages, made once in each Python worker."""

    def __init__(self, model: list[tuple[str, bytes]]):
        self.names = [name for name, _ in model]
        self.packers = []
        for _, content in model:
            # zstandard takes no content of under 8 bytes
            words = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """The language, the score and whether the margin is wide enough."""
        if not self.names or text is None or not any(m[0].isalpha() for m in LETTER.finditer(text)):
            return UNKNOWN, 0.0, False
        data = text.lower().encode("utf-8", "replace")
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = [sum(len(p.compress(x)) for x in pieces) for p in self.packers]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, True
        margin = (min(x for i, x in enumerate(sizes) if i != best) - sizes[best]) / sizes[best]
        return self.names[best], margin / (margin + MIN_MARGIN), margin >= MIN_MARGIN


def identify(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score (0.5 at the narrowest accepted margin) and accepted, for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(shared.value)
        for batch in batches:
            found = [classify(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op2(docs: DataFrame) -> DataFrame:
    """Language of every document, learnt from those outside the held-out quarter."""
    model = learn(docs.where(~held_out("doc_id", 4, 2)))
    found = identify(docs, model)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "accepted")
