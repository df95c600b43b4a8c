"""Operators over the whole corpus: near copies, token files, chat, media, mixtures, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from inkmill.llm import chat, components, jpeg, media, mixture, simhash, tokens
from inkmill.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_filters import DOCS, ODD, empty_docs, odd_docs


def slow_fingerprint(text):
    import xxhash

    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values, radius=2):
    values = sorted(set(values))
    top = {v: v for v in values}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                top[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "one two", "ONE Two three", "É one", "a b c d " * 50, "x y"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    # Spark's own hash is the same one
    assert spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first().h == np.uint64(simhash.fingerprint("ONE two Three")).astype(np.int64)


def test_tree_search():
    random.seed(1)
    values = [random.getrandbits(12) for _ in range(200)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.within(q, 2)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 2]


@pytest.mark.parametrize("tree_nodes", [4096, 3])
def test_links_reach_all(spark, tree_nodes):
    random.seed(2)
    base = [random.getrandbits(64) for _ in range(30)]
    values = set(base)
    for b in base:
        for _ in range(8):
            values.add(b ^ sum(1 << k for k in random.sample(range(64), random.randint(1, 5))))
    dense = random.getrandbits(64)
    values |= {dense ^ 1 << k for k in range(40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tree_nodes)
    got = {r.node: r.top for r in components.connected_components(edges).collect()}
    groups = defaultdict(set)
    for v in signed:
        groups[got.get(v, v)].add(v)
    expected = defaultdict(set)
    for v, t in slow_components([v & (1 << 64) - 1 for v in signed]).items():
        expected[t].add(v - (1 << 64) if v >> 63 else v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_links_meet_across_tasks(spark, tmp_path):
    random.seed(8)
    halves = [[], []]
    for _ in range(200):
        v = random.getrandbits(64)
        halves[0].append(v)
        halves[1].append(v ^ 1 << random.randrange(64) ^ 1 << random.randrange(64))
    # files, so that the few shared shards are known to be small and their join is a broadcast
    for i, half in enumerate(halves):
        signed = np.array(half, np.uint64).astype(np.int64).tolist()
        spark.createDataFrame([(v,) for v in signed], "fp long").coalesce(1).write.parquet(str(tmp_path / f"part={i}"))
    found = simhash.links(spark.read.parquet(str(tmp_path)).select("fp"))
    linked = {frozenset(np.array([r.a, r.b], np.int64).astype(np.uint64).tolist()) for r in found.collect()}
    assert linked == {frozenset(p) for p in zip(*halves) if p[0] != p[1]}


def test_components_of_paths(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 202), (200, 202)]
    got = {r.node: r.top for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 200 for i in (200, 201, 202)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op3_simhash"](spark, data).collect()}
    prints = {i: slow_fingerprint(t) for i, t in rows}
    tops = slow_components(prints.values())
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(tops[p], i)
    assert got == {i: (f"{p:016x}", least[tops[p]]) for i, p in prints.items()}


def test_near_copies_of_other_ids_and_bytes(spark):
    texts = [b"one two three four", b"one \xff two \xc3( three", b"\x1c \xa0", None, b"ONE two\x0bthree\tfour"]
    raw = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text binary").select("doc_id", F.expr("cast(text as string)").alias("text"))
    got = {r.doc_id: r.fp for r in simhash.near_duplicates(raw).collect()}
    assert got == {i: int(np.uint64(simhash.fingerprint(t)).astype(np.int64)) for i, t in enumerate(texts)}
    assert got[0] == got[4] and got[3] == 0


def test_near_copies_in_odd_tables(spark):
    docs = odd_docs(spark)
    got = [tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id").collect()]
    assert len(got) == len(ODD)
    assert {c for i, c in got if i in (1, 2, 4)} == {1} and {c for i, c in got if i in (5, 6)} == {5} and (None, None) in got
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 5), (False, 7), (False, 8), (True, 0)]
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0 == simhash.keep_one(empty_docs(spark)).count()


# token files


def test_encoder_gives_the_tokenizers_ids():
    encoder = tokens.Encoder(tokenizer_path())
    random.seed(3)
    bits = ["a", "B", "é", "ß", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "don't", "1", "23", "²", "中", "—", " \n", "\x1c", "_", "<|endoftext|>", "ﬁ", "🙂", "\r\n", " ,"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 14))) for _ in range(3000)]
    assert encoder(texts) == [encoder.whole(t) + encoder.end for t in texts]
    assert encoder([None, ""]) == [encoder.end] * 2


@pytest.mark.parametrize("most,group", [(400_000, 8 << 20), (40, 500), (3, 1)])
def test_encoder_with_little_room(monkeypatch, most, group):
    monkeypatch.setattr(tokens, "CACHE_PIECES", most)
    monkeypatch.setattr(tokens, "GROUP_BYTES", group)
    encoder = tokens.Encoder(tokenizer_path())
    random.seed(5)
    bits = ["one", "Two", "é", "÷", "it's", "(a)", "7", "中文", "\x00", "\x1f", "\u3000", "\x85", "\t", "\n", "", "<|endoftext|>", "x" * 70, "\u200b"]
    texts = [random.choice(" \n").join(random.choices(bits, k=random.randint(0, 9))) for _ in range(400)] + [None]
    for given in (texts, pa.array(texts), pa.array(texts, pa.large_string()).slice(7)):
        assert encoder(given) == [encoder.whole(t or "") + encoder.end for t in (given if isinstance(given, list) else given.to_pylist())]
    for known in (encoder.pieces, encoder.words):
        assert len(known.strings) == len(known.start) == len(known.length) <= most
        assert all(len(s.encode()) <= tokens.LONGEST_PIECE for s in known.strings.to_pylist())


def test_a_worker_encodes_each_word_once():
    class Counting:
        def __init__(self, model):
            self.model, self.seen = model, Counter()

        def tokenize(self, word):
            self.seen[word] += 1
            return self.model.tokenize(word)

    tokens._loaded.cache_clear()
    first = tokens.worker_encoder(tokenizer_path())
    first.model = Counting(first.model)
    texts = [f"word{chr(97 + k % 26)} and, words\nand more" for k in range(200)]
    # of two tasks, the second finds what the first has met
    ids = first(texts[:120])
    assert ids + tokens.worker_encoder(tokenizer_path())(texts[120:]) == [first.whole(t) + first.end for t in texts]
    assert first.model.seen["Ġand"] == 1 and set(first.model.seen.values()) == {1}
    tokens._loaded.cache_clear()


def check_tokens(rows, docs):
    """Rows follow ascending doc_id and hold the tokenizer's ids of every document."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for i, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        expected[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(len(rows))]
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert keys == sorted(keys)


@pytest.mark.parametrize("docs_in_range,file_bytes", [(20_000, 32 << 20), (20, 2000)])
def test_token_files(spark, data, monkeypatch, docs_in_range, file_bytes):
    monkeypatch.setattr(tokens, "DOCS_IN_RANGE", docs_in_range)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check_tokens(tokens.op6(docs, tokenizer_path()).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_token_files_of_odd_tables(spark, monkeypatch):
    check_tokens(tokens.op6(odd_docs(spark), tokenizer_path()).collect(), ODD)
    assert tokens.op6(empty_docs(spark), tokenizer_path()).count() == 0
    # one doc_id that fills most ranges
    monkeypatch.setattr(tokens, "DOCS_IN_RANGE", 5)
    many = [*ODD, *((50, f"text {k % 7}") for k in range(40))]
    check_tokens(tokens.op6(odd_docs(spark, many[len(ODD) :]), tokenizer_path()).collect(), many)
    # most documents without a doc_id, and fewer ranges than that would take
    monkeypatch.setattr(tokens, "MOST_RANGES", 4)
    many += [(None, f"none {k}") for k in range(60)]
    check_tokens(tokens.op6(odd_docs(spark, many[len(ODD) :]), tokenizer_path()).collect(), many)


def test_one_document_is_read_alone(spark, tmp_path):
    docs = odd_docs(spark)
    dictionary = tokens.train_dictionary(docs, tokenizer_path())
    folder = f"file://{tmp_path}/t"
    name = tokens.write_tokens(docs, tokenizer_path(), folder, dictionary).first().name
    file = tokens.Reader(folder, name, dictionary)
    at = file.doc_id.tolist().index(8)
    assert file.ids(at).tobytes() == np.frombuffer(tokens.Encoder(tokenizer_path())(["a\x00b 中文 🙂"])[0], "<u2").astype("<u4").tobytes()
    with pytest.raises(ValueError, match="another dictionary"):
        tokens.Reader(folder, name, b"other one")


# chat


def test_chat_against_its_sql(spark, data):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{data}/conversations.parquet'")
    got = QUERIES["op7_chat"](spark, data).toPandas()
    want = con.sql(chat.SQL).df()[list(got.columns)]
    key = ["conv_id", "speaker", "part"]
    assert len(got) and got.sort_values(key).reset_index(drop=True).equals(want.sort_values(key).reset_index(drop=True))


def test_chat_by_hand(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo <|end|>"), (1, 2, None, None), (None, None, "ann", "x"), (1, 1, "bob", "yo <|end|>")]
    frame = spark.createDataFrame([(*t, "e", 1) for t in turns], "conv_id long, turn long, role string, text string, speaker string, part int")
    got = {(r.conv_id, r.speaker): r for r in chat.rotate(frame).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    r = got[1, "ann"]
    assert r.text == "<|assistant|>\nhi<|end|>\n" + "<|user name=bob|>\nyo < |end| ><|end|>\n" * 2 + "<|user name=unknown|>\n<|end|>\n"
    assert (r.n_turns, r.n_own, r.n_trained) == (4, 1, 10)
    runs = [tuple(map(int, x.split("*"))) for x in r.mask.split()]
    at, trained = 0, ""
    for kind, n in runs:
        trained += r.text[at : at + n] * kind
        at += n
    assert at == len(r.text) and trained == "hi<|end|>\n"
    parts = sorted((x.part, x.text) for x in chat.rotate(frame, 1).where("conv_id = 1 and speaker = 'ann'").collect())
    assert "".join(t for _, t in parts) == r.text and len(parts) == 3
    assert chat.op7(frame.limit(0)).count() == 0


def test_names_keep_to_their_headers(spark):
    frame = spark.createDataFrame([(1, 0, "a|>\nspoof", "hi"), (1, 1, None, "one"), (1, 2, "unknown", "two")], "conv_id long, turn long, role string, text string")
    got = {(r.speaker, r.unnamed): r.text for r in chat.rotate(frame).collect()}
    assert set(got) == {("a| > spoof", False), ("unknown", True), ("unknown", False)}
    said = "<|user name=a| > spoof|>\nhi<|end|>\n"
    assert got["unknown", True] == said + "<|assistant|>\none<|end|>\n<|user name=unknown|>\ntwo<|end|>\n"
    assert got["unknown", False] == said + "<|user name=unknown|>\none<|end|>\n<|assistant|>\ntwo<|end|>\n"
    con = duckdb.connect()
    con.register("conversations", frame.toPandas())
    a, b = chat.op7(frame).toPandas(), con.sql(chat.SQL).df()
    order = ["speaker", "unnamed"]
    pd.testing.assert_frame_equal(a.sort_values(order).reset_index(drop=True), b[a.columns].sort_values(order).reset_index(drop=True), check_dtype=False)


def test_draws_beyond_the_librarys_range():
    draw = mixture.Draw([3 * 10**9, 10**9, 5], 4096, 1)
    for shards in ((0, 3), (draw.shards - 1, draw.shards)):
        for shard, counts, before in draw(*shards):
            assert counts.sum() == min(4096, draw.total - 4096 * shard) and before.sum() == 4096 * shard
            assert (counts >= 0).all() and abs(counts[0] / counts.sum() - 0.75) < 0.08


def test_rows_with_maps(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i // 2} " * 9, "s", {"a": i // 4}) for i in range(8)], "doc_id long, text string, source string, more map<string,int>")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= set(range(8))
    assert mixture.mix_documents(docs).count() > 0


# media


def test_lossless_frames():
    rng = np.random.default_rng(0)
    for shape in ((2, 24, 24), (3, 7, 5), (1, 1, 1)):
        frames = rng.integers(0, 256, shape, dtype=np.uint8)
        frames[0, 0] = 255
        files = jpeg.encode_lossless(frames)
        assert (jpeg.decode_plain([jpeg.Frame(f) for f in files]) == frames).all()
        assert (jpeg._decode_lossless(jpeg.Frame(files[0])) == frames[0]).all()


def baseline(block):
    """A greyscale JPEG of one block of eight by eight, by plain formulas."""
    k = np.arange(8)
    c = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(1 / 8), 0.5)
    dct = np.rint(c @ (block - 128.0) @ c.T).astype(int).ravel()[jpeg.ZIGZAG]
    bits = ""

    def amount(v):
        s = abs(v).bit_length()
        return s, format(v if v > 0 else v + (1 << s) - 1, f"0{s}b") if s else ""

    # each symbol has a code of eight bits: its place in the table
    dc, ac = list(range(12)), [r << 4 | s for r in range(16) for s in range(1, 12)] + [0, 0xF0]
    s, b = amount(int(dct[0]))
    bits += format(dc.index(s), "08b") + b
    run = 0
    for v in dct[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            bits += format(ac.index(0xF0), "08b")
            run -= 16
        s, b = amount(int(v))
        bits += format(ac.index(run << 4 | s), "08b") + b
        run = 0
    if run:
        bits += format(ac.index(0), "08b")
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table = lambda kind, v: b"\xff\xc4" + (19 + len(v)).to_bytes(2, "big") + bytes([kind << 4]) + bytes([0] * 7 + [len(v)] + [0] * 8) + bytes(v)
    return b"\xff\xd8\xff\xdb" + (67).to_bytes(2, "big") + b"\0" + b"\1" * 64 + table(0, dc) + table(1, ac) + b"\xff\xc0\0\x0b\x08\0\x08\0\x08\x01\x01\x11\0" + b"\xff\xda\0\x08\x01\x01\0\0\x3f\0" + scan + b"\xff\xd9"


def test_baseline_frames():
    rng = np.random.default_rng(1)
    for _ in range(5):
        block = rng.integers(0, 256, (8, 8))
        assert np.abs(jpeg.decode(baseline(block)).astype(int) - block).max() <= 3


def test_shots_are_found():
    rng = np.random.default_rng(2)
    scenes = [rng.integers(lo, lo + 40, (n, 24, 24), dtype=np.uint8) for lo, n in ((0, 20), (100, 15), (200, 25))]
    film = np.concatenate(scenes)
    avi = media.write_avi(jpeg.encode_lossless(film), 24, 24, 10)
    got = media.read(avi)
    assert got["starts"] == [20, 35] and got["frames"] == 60 and got["rate"] == 10 and got["payload_sha256"] == hashlib.sha256(film.tobytes()).hexdigest()
    # without its index the frames are found in the list itself
    assert media.read(avi[: avi.rfind(b"idx1")])["starts"] == [20, 35]


def test_media_round_trip(spark):
    got = media.op8(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    left = Counter(ODD)
    for r in got:
        (key,) = [k for k in left if left[k] and k[0] == r.doc_id][:1]
        left[key] -= 1
        n, payload = media.payload_of(key[1])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert len(payload) % 576 == 0 < len(payload)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (5, 6)}) == 1
    assert media.op8(empty_docs(spark)).count() == 0


def test_clip_rows(spark):
    avi = media.write_avi(jpeg.encode_lossless(np.zeros((5, 24, 24), np.uint8)), 24, 24)
    rows = spark.createDataFrame([(1, bytearray(avi)), (2, None), (3, bytearray(b"RIFFxxxxAVI "))], "doc_id long, media binary")
    assert [tuple(r) for r in media.clips(rows).collect()] == [(1, 0, 0, 5, 0.0, 0.2)]


# mixtures


def test_targets():
    assert mixture.targets([100, 100, 100]) == pytest.approx([187.5, 75, 37.5])
    assert mixture.targets([10, 100, 0]) == pytest.approx([30, 80, 0])
    assert mixture.targets([]) == [] and mixture.targets([0, 0]) == [0, 0]


def test_permutations():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(mixture.permute(np.arange(n), n, n, (1, 2, 3)).tolist()) == list(range(n))
    assert mixture.permute(np.arange(5), 5, 4, (1,))[4] == 4


def test_draws_add_up():
    draw = mixture.Draw([100, 37, 0, 5], 16, 3)
    alone = [next(draw(k, k + 1)) for k in range(draw.shards)]
    together = list(draw(0, draw.shards))
    before = np.zeros(4, int)
    for (k, c, b), (k2, c2, b2) in zip(alone, together):
        assert k == k2 and (c == c2).all() and (b == b2).all() and (b == before).all()
        before = before + c
    assert before.tolist() == [100, 37, 0, 5]


def slow_taken(rows, block=mixture.BLOCK_WORDS):
    """Bounds on the words taken of each document, whatever the draw: whole rounds, and one more."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixture.targets([sizes[s] for s in order])))
    return sizes, target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mixture_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r for r in docs.collect()}
    runs = [sorted(map(tuple, QUERIES["op9_mixture"](spark, data).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    sizes, target = slow_taken([(i, r.source, words(r.text)) for i, r in texts.items()])
    taken = Counter()
    for doc_id, size, source_size, goal, got in runs[0]:
        r = texts[doc_id]
        assert size == words(r.text) and source_size == sizes[r.source] and goal == pytest.approx(target[r.source])
        assert int(goal // source_size) * size <= got <= min(3, int(goal // source_size) + 1) * size
        taken[r.source] += got
    assert all(abs(taken[s] - target[s]) <= mixture.BLOCK_WORDS for s in target)
    mixed = mixture.mix_documents(docs).collect()
    per = Counter()
    for r in mixed:
        per[r.doc_id] += words(r.text)
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (texts[r.doc_id].lang, texts[r.doc_id].source)
        assert set(r.text.split()) <= set(texts[r.doc_id].text.split())
    assert per == Counter({row[0]: row[4] for row in runs[0] if row[4]})


def test_mixture_of_odd_tables(spark):
    more = [(i, f"words {i} " * (i % 9)) for i in range(20, 60)]
    docs = odd_docs(spark, more).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "b").when(F.col("doc_id") % 3 == 1, "A"))
    got = mixture.op9(docs).collect()
    assert len(got) == len(ODD) + 40
    assert all(r.taken <= 3 * r["size"] for r in got)
    goal = {r.source_size: r.target for r in got}
    assert sum(goal.values()) == pytest.approx(sum(r["size"] for r in got))
    mixed = mixture.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(words(r.text) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixture.op9(empty_docs(spark)).count() == 0 == mixture.mix_documents(empty_docs(spark)).count()
    only_empty = spark.createDataFrame([(1, None, None, None, None, 1.0, "", "")], DOCS)
    assert [(r["size"], r.taken) for r in mixture.op9(only_empty).collect()] == [(0, 0)]


def test_small_chunks_and_shards_give_whole_mixes(spark, data, monkeypatch):
    monkeypatch.setattr(mixture, "ROWS_IN_CHUNK", 7)
    mix = mixture.Mixture(spark.read.parquet(f"{data}/documents.parquet"), 16, 50)
    spans = defaultdict(list)
    for r in mix.placed.where("size > 0").collect():
        spans[r["rank"]].append((r.start, r.start + r["size"]))
    for rank, found in spans.items():
        found.sort()
        assert found[0][0] == 0 and found[-1][1] == mix.sizes[rank] and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    slots = mix.slot_table().groupBy("rank", "round", "block").count()
    assert slots.agg(F.max("count")).first()[0] == 1
    assert {r["rank"]: r.n for r in slots.groupBy("rank").agg(F.count("*").alias("n")).collect()} == {i: n for i, n in enumerate(mix.slots) if n}


# the pipeline


def test_stages_against_their_operators(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == columns, name
        rows = out.collect()
        assert rows
        docs = spark.createDataFrame(rows, docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    check_tokens(last, [(r.doc_id, r.text) for r in docs.collect()])


def test_entry_has_all(spark):
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixture", "token_ids"]
