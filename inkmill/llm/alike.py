"""Near copies beyond a few bits: links between texts whose five-word shingles agree to 0.8 or more.

A SimHash of 64 bits moves by up to some fourteen bits between such texts, too many for shards by bands. So
texts are dealt to shards by shingles that they share: the hashes of a text's shingles fall into `KEYS`
ranges, and the least of each range is a key. Two texts with similarity s agree on a range's least hash
with probability s, on none of eight with (1 - s)**8 (three in a million at 0.8).

Within a shard all texts are first compared by short sketches: of `BINS` ranges of hashes, the least hash of
each in 8 remixed bits. The share of equal ones estimates the similarity, and pairs that it puts `SLACK`
standard deviations or more below `AGREE` are no candidates. What candidates connect goes on with the whole
sets of hashes, and a pair counts if these agree to `AGREE`. Groups with the same texts are one.

Groups of more than `CROWD` texts are linked in blocks that have one text in common; unless all their texts
are then connected, each block meets each other one. Shards of more than `CROWDED` texts are first tried in
such blocks, each text in its largest shard. Where that doesn't connect all their texts, these are dealt anew
by `BANDS` numbers, each made of `BAND` least hashes under permutations of their own: texts at 0.8 share none
of them with probability (1 - 0.8**3)**16, one in 100,000. So every task's groups are bounded, and every text
is compared with all others of its shards that it is not yet connected with.

Null, empty and wordless texts have no keys here; fewer than five words make one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.llm._shared import cut, cut_as_dealt, small_batches
from inkmill.llm.components import connected_components
from inkmill.llm.simhash import fingerprint

WORDS, KEYS, BINS, SEED = 5, 8, 64, 7
AGREE, SLACK = 0.8, 5.0
#: Texts that are compared by their sets in one group or block of a larger one; texts of a shard that are compared by sketches.
CROWD, CROWDED = 512, 4096
#: Bands of texts in crowded shards, and permutations to a band.
BANDS, BAND = 16, 3
SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, (BANDS * BAND, 1), np.uint64)
NODE = ["node", "fp"]
#: Texts in a task that holds sets.
TEXTS_IN_TASK = 10_000
LINKS = "a long, b long"


def hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - WORDS + 1)
    digest = xxhash.xxh64_digest
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(WORDS)))) if n > 1 else [b" ".join(words)]
    return np.unique(np.frombuffer(b"".join([digest(x, SEED) for x in shingles]), ">u8").astype(np.uint64))


def short(found: np.ndarray) -> np.ndarray:
    """The upper 32 bits of hashes, each once: of n shingles, a share of about n / 2**32 falls together."""
    return np.unique((found >> np.uint64(32)).astype(np.uint32))


def _firsts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def keys_of(found: np.ndarray) -> list[int]:
    return found[_firsts(found >> np.uint64(64 - KEYS.bit_length() + 1))].view(np.int64).tolist()


def sketch_of(found: np.ndarray) -> np.ndarray:
    """Of short hashes, the least of each bin in 8 bits of its own mixture, 0 for an empty bin."""
    least = np.zeros(BINS, np.uint8)
    bins = found >> np.uint32(32 - BINS.bit_length() + 1)
    first = _firsts(bins)
    # the leading bits of a least hash are the same in all long texts
    least[bins[first]] = np.maximum(found[first] * np.uint32(0x9E3779B1) >> np.uint32(24), 1)
    return least


def sketch(text: str | None) -> tuple[list[int], bytes]:
    """(keys, sketch) of a text."""
    found = hashes(text)
    return keys_of(found), sketch_of(short(found)).tobytes()


def bands_of(found: np.ndarray) -> list[int]:
    """Of short hashes, one number a band: equal with probability s**BAND at similarity s."""
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        x = found[at : at + 4096].astype(np.uint64) ^ SALTS
        for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x ^= x >> np.uint64(33)
            x *= np.uint64(m)
        least = np.minimum(least, (x ^ x >> np.uint64(33)).min(1))
    bands = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, BAND))]
    return np.array(bands, np.uint64).view(np.int64).tolist()


def marked(docs: DataFrame, mark: Column) -> DataFrame:
    """doc_id, fp and mark of every row, and node, keys, sketch and short hashes of its text, null where its task has met that before."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            rows: list[tuple] = []
            for t, fp in zip(texts, prints.tolist()):
                found = hashes(t)
                shingles = (x := short(found)).tobytes()
                node = xxhash.xxh64_intdigest(shingles, fp & (1 << 63) - 1) - (1 << 63)
                if not len(x) or node in met:
                    rows.append((None,) * 4)
                else:
                    met.add(node)
                    rows.append((node, keys_of(found), sketch_of(x).tobytes(), shingles))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints), batch.column(2), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "fp", "mark", "node", "keys", "sketch", "shingles"]
            )

    return docs.select("doc_id", "text", mark.alias("mark")).mapInArrow(run, "doc_id long, fp long, mark long, node long, keys array<bigint>, sketch binary, shingles binary")


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a sketch with each of many."""
    return _agreement(one, many)[0]


def _agreement(one: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = ((many == one) & (one != 0)).sum(1)
    used = np.maximum(((many != 0) | (one != 0)).sum(1), 1)
    return both / used, used


def candidates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of many sketches may be of texts that agree with that of one."""
    estimate, used = _agreement(one, many)
    return estimate >= AGREE - SLACK * np.sqrt(AGREE * (1 - AGREE) / used)


def same(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether the similarity of two sets is `AGREE` or more."""
    few, most = sorted((len(one), len(two)))
    if few / most < AGREE:
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both / (few + most - both) >= AGREE


def groups(sketches: np.ndarray) -> np.ndarray:
    """A number for each sketch, equal where candidates connect them."""
    group = np.arange(len(sketches))
    for i in range(1, len(group)):
        others = np.flatnonzero(group[:i] != i)
        near = others[candidates(sketches[i], sketches[others])]
        for g in np.unique(group[near]):
            group[group == g] = i
    return group


def forest(fps: list[int], tops: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the fingerprints of texts that are alike; those of one top are known to be connected."""
    sketches = np.stack([sketch_of(s) for s in sets])
    group = np.unique(tops, return_inverse=True)[1]
    for i in range(1, len(fps)):
        near = np.flatnonzero(group[:i] != group[i])
        for j in near[candidates(sketches[i], sketches[near])] if len(near) else ():
            if group[i] != group[j] and same(sets[i], sets[j]):
                group[group == group[j]] = group[i]
    first = {g: fps[i] for i, g in reversed(list(enumerate(group.tolist())))}
    return [(fp, first[g]) for fp, g in zip(fps, group.tolist()) if fp != first[g]]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Of rows in the order of their first column, those of each of its values."""
    now: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if now and row[0] != now[0][0]:
                yield now
                now = []
            now.append(row)
    if now:
        yield now


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, fp, top, shingles) in the order of key, the forests of each key."""

    def rows(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    out: list[tuple[int, int]] = []
    for _, fps, tops, sets in (zip(*g) for g in _by_key(batches) if len(g) > 1):
        out += forest(fps, tops, [np.frombuffer(s, np.uint32) for s in sets])
        if len(out) > 10_000:
            yield rows(out)
            out = []
    yield rows(out)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, fp, sketch) in the order of key, rows (node, fp, shard, part): what candidates connect in each key."""
    for g in _by_key(batches):
        if len(g) > 1:
            group = groups(np.frombuffer(b"".join([r[3] for r in g]), np.uint8).reshape(-1, BINS))
            some = np.flatnonzero(np.bincount(group)[group] > 1)
            if len(some):
                columns = [[g[i][c] for i in some] for c in (1, 2, 0)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(group[some], pa.int64())], names=[*NODE, "shard", "part"])


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [bands_of(np.frombuffer(s, np.uint32)) for s in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], names=[*NODE, "keys"])


def _shards(places: DataFrame) -> DataFrame:
    """key and number of nodes of the keys that several nodes share; of keys with the same nodes, one."""
    sums = [F.expr(f"bit_xor(xxhash64(node, {i}))").alias(f"x{i}") for i in (0, 1)]
    held = places.groupBy("key").agg(F.count("*").alias("n"), *sums).where("n > 1")
    return cut(held.groupBy("n", "x0", "x1").agg(F.min("key").alias("key")).select("key", "n"))


class Texts:
    """Distinct texts of the rows that `marked` gives, and the links between them."""

    def __init__(self, found: DataFrame):
        some = found.where("node is not null").select(*NODE, "keys", "sketch", "shingles")
        tasks = max(1, -(-found.count() // TEXTS_IN_TASK))
        self.sets = cut_as_dealt(some.repartition(tasks, "node").dropDuplicates(["node"]))
        self.nodes = self.sets.drop("shingles")

    def linked(self, *places: DataFrame) -> DataFrame:
        """Links within each key, by the whole sets of rows (node, fp, key, top)."""
        held = reduce(DataFrame.unionByName, [p.select(*NODE, "key", "top") for p in places])
        rows = self.sets.select("node", "shingles").join(held, "node").select("key", "fp", "top", "shingles")
        return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_links, LINKS)

    def by_sketch(self, places: DataFrame) -> DataFrame:
        """Groups (node, fp, key) that candidates connect in the shards of places (node, fp, key)."""
        rows = self.sets.select("node", "sketch").join(places.select(*NODE, "key"), "node").select("key", *NODE, "sketch")
        found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_groups, "node long, fp long, shard long, part long")
        return found.select(*NODE, F.xxhash64("shard", "part").alias("key"))


def in_blocks(held: DataFrame) -> DataFrame:
    """Large groups (node, fp, key, n) with the number of their `blocks` and each text's `block`."""
    return held.withColumn("blocks", F.ceil(F.col("n") / CROWD).cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))


def with_one_in_common(held: DataFrame) -> DataFrame:
    """(node, fp, key): a key for each block, of which each has the same one text of its group."""
    least = held.groupBy("key", "blocks").agg(F.min(F.struct(*NODE)).alias("least"))
    middle = least.select("least.*", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return held.select(*NODE, "key", "block").unionByName(middle).distinct().select(*NODE, F.xxhash64("key", "block").alias("key"))


def apart(held: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of held, with their tops, of the keys whose nodes the links do not all connect."""
    tops = connected_components(links).withColumnRenamed("node", "fp")
    topped = held.join(tops, "fp", "left").withColumn("top", F.coalesce("top", "fp"))
    keys = topped.groupBy("key").agg((F.min("top") != F.max("top")).alias("apart")).where("apart").select("key")
    return cut(topped.join(cut(keys), "key"))


def links(found: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints of texts that are alike, of the rows that `marked` gives."""
    texts = Texts(found)
    own = F.col("fp").alias("top")
    keyed = texts.nodes.select(*NODE, F.explode("keys").alias("key"))
    shared = _shards(keyed)
    grouped = texts.by_sketch(keyed.join(shared.where(F.col("n") <= CROWDED).select("key"), "key"))
    out = []
    crowded = shared.where(F.col("n") > CROWDED)
    if not crowded.isEmpty():
        places = cut(keyed.join(crowded, "key").select(*NODE, "key", "n"))
        largest = places.groupBy(*NODE).agg(F.max(F.struct("n", "key")).alias("most")).select(*NODE, "most.*")
        first = cut(texts.linked(texts.by_sketch(with_one_in_common(in_blocks(largest))).withColumn("top", own)))
        out.append(first)
        left = apart(places, first)
        if not left.isEmpty():
            some = texts.sets.join(left.select("node").distinct(), "node", "left_semi").select(*NODE, "shingles")
            bands = cut(some.mapInArrow(_banded, "node long, fp long, keys array<bigint>")).select(*NODE, F.explode("keys").alias("key"))
            again = _shards(bands)
            grouped = grouped.unionByName(texts.by_sketch(bands.join(again.where(F.col("n") <= CROWDED).select("key"), "key")))
            # too many even for sketches: the shard is a group as it is
            grouped = grouped.unionByName(bands.join(again.where(F.col("n") > CROWDED).select("key"), "key").select(*NODE, "key"))
    grouped = cut(grouped)
    held = grouped.join(_shards(grouped), "key")
    small = held.where(F.col("n") <= CROWD).withColumn("top", own)
    large = held.where(F.col("n") > CROWD)
    if large.isEmpty():
        out.append(texts.linked(small))
    else:
        blocked = cut(in_blocks(large))
        first = cut(texts.linked(with_one_in_common(blocked).withColumn("top", own)))
        out.append(first)
        # of groups that are not yet connected, each block meets each other one
        pairs = apart(blocked, first).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key")
        out.append(texts.linked(small, pairs.select(*NODE, both, "top")))
    return reduce(DataFrame.unionByName, out)
