import random

import pytest
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.operators import masks, offsets, packing, plugins, records, scoring, vocabulary


def pool(documents, n, stride):
    """Windows as one growing pool gives them, document by document."""
    out, tokens, at = [], [], 0
    for d in documents:
        tokens += d
        while len(tokens) - at >= n:
            out.append(tokens[at : at + n])
            at = min(at + stride, len(tokens))
    return out


@pytest.mark.parametrize("n,stride", [(8, 4), (5, 5), (4, 1), (3, 7), (6, 20)])
def test_windows_against_a_pool(spark, n, stride):
    random.seed(n * stride)
    documents = [[f"{i}.{k}" for k in range(random.choice([0, 1, 2, 5, 9, 23]))] for i in range(25)]
    frame = spark.createDataFrame(list(enumerate(documents)), "k long, tokens array<string>")
    got = packing.windows(frame, "k", "tokens", n, stride).orderBy("w").collect()
    assert [r.tokens for r in got] == pool(documents, n, stride)
    assert list(packing.starts(map(len, documents), n, stride)) is not None
    assert [r.w for r in got] == list(range(len(got)))


def test_windows_by_group_and_guards(spark):
    frame = spark.createDataFrame([("a", 1, ["x"] * 5), ("b", 2, ["y"] * 2), ("a", 3, ["z"] * 4)], "g string, k long, tokens array<string>")
    got = {(r.g, r.w): "".join(r.tokens) for r in packing.windows(frame, "k", "tokens", 4, 4, ["g"]).collect()}
    assert got == {("a", 0): "xxxx", ("a", 1): "xzzz"}
    with pytest.raises(ValueError):
        packing.check(4, 0)
    assert packing.windows(frame.where("k > 9"), "k", "tokens", 4).count() == 0


def test_running_totals_over_ranges(spark):
    random.seed(5)
    rows = [(k, random.randint(0, 9)) for k in random.sample(range(1000), 200)]
    frame = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: r.s for r in offsets.running(frame, "k", "v", "s", rows=13).collect()}
    total = 0
    for k, v in sorted(rows):
        assert got[k] == total
        total += v
    numbered = offsets.numbered(frame, "k", "at", rows=7).orderBy("k").collect()
    assert [r["at"] for r in numbered] == list(range(200))


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "a", "b"]), (3, []), (4, None)], "k long, tokens array<string>")
    v = vocabulary.derive(docs, "tokens", 9)
    assert [(r.token, r.id) for r in v.where("id >= 7").orderBy("id").collect()] == [("b", 7), ("a", 8)]
    ids = {r.k: r.ids for r in vocabulary.encode(docs, "k", "tokens", v, 1).collect()}
    assert ids == {1: [7, 8, 7], 2: [1, 8, 7], 3: [], 4: None}
    encoded = spark.createDataFrame([(1, [7, 8, 99])], "k long, ids array<long>")
    assert vocabulary.decode(encoded, "k", "ids", v).first().tokens == ["b", "a", "<unk>"]
    twins = spark.createDataFrame([("x", 1, 0), ("y", 1, 1), ("z", 2, 2)], "token string, id long, line int")
    assert {r.id: r.token for r in vocabulary.token_of(twins).collect()} == {1: "<unk>", 2: "z"}
    assert {r.id: r.token for r in vocabulary.last_token_of(twins, "line").collect()} == {1: "y", 2: "z"}
    assert vocabulary.special_rows(("<pad>",), ("<z>", "<a>", "<pad>")) == [("<pad>", 0), ("<a>", 1), ("<z>", 2)]


def test_large_vocabulary_is_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["b", "a", "q"]), (3, [])], "k long, tokens array<string>")
    v = spark.createDataFrame([("a", 5), ("b", 6)], "token string, id long")
    monkeypatch.setattr(vocabulary, "BROADCAST_ROWS", 1)
    got = {r.k: r.ids for r in vocabulary.encode(docs, "k", "tokens", v, 1).collect()}
    assert got == {1: [6, 5, 1], 3: []}
    back = vocabulary.decode(spark.createDataFrame([(1, [6, 5, 9])], "k long, ids array<long>"), "k", "ids", v)
    assert back.first().tokens == ["b", "a", "<unk>"]


def test_word_pieces(spark):
    known = frozenset(["un", "##aff", "##able", "a"])
    cut = vocabulary.Pieces(known)
    assert cut("unaffable") == ["un", "##aff", "##able"]
    assert cut("unx") == ["<unk>"]
    assert cut("a" * 101) == ["<unk>"]
    docs = spark.createDataFrame([(1, ["unaffable", "a"]), (2, None)], "k long, t array<string>")
    assert [r.pieces for r in vocabulary.word_pieces(docs, "t", sorted(known)).orderBy("k").collect()] == [["un", "##aff", "##able", "a"], []]


def test_filters_files_and_meta(spark):
    rows = spark.createDataFrame([(i, list(range(i % 4))) for i in range(10)], "k long, ids array<int>")
    placed = records.with_input_files(rows, "k", "train", 3)
    judged = records.judged(placed, "ids", 2)
    assert records.rejects(judged).count() == 2
    files = {r.file: r.n for r in records.kept(judged).groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert files == {"train-0-of-4": 3, "train-1-of-4": 2, "train-2-of-4": 2, "train-3-of-4": 1}
    out = records.with_files(records.kept(judged), "k", 5)
    meta = records.meta(out, "ids", "file").first()
    assert (meta.padding_shape, meta["count"], meta.files) == (2, 8, ["00000000.tfrecord.gz", "00000001.tfrecord.gz"])
    twin = spark.createDataFrame([([1, 2], [3])], "ids array<int>, pinyin array<int>")
    assert records.judged(twin, "ids", 9, "pinyin").first().reason == records.MISALIGNED
    assert twin.select(records.repaired("ids", "pinyin").alias("p")).first().p == [0, 0]


def test_batches(spark):
    rows = spark.createDataFrame([(1, [1], [1]), (2, [1, 2], [1, 2, 3]), (3, [], [])], "k long, ids array<int>, labels array<int>")
    got = records.padded_batches(rows, "k", 2, ["ids"], "labels").orderBy("k").collect()
    assert [(r.ids, r.labels) for r in got] == [([0, 1], [1, -100, -100]), ([1, 2], [1, 2, 3]), ([], [])]


def test_first_and_regrouped(spark):
    rows = spark.createDataFrame([(3, "a", "x", "l3"), (1, "a", "y", "l1"), (2, "b", "z", None)], "pos long, id string, v string, label string")
    assert {(r.id, r.v) for r in records.first_by(rows, ["id"], "pos").collect()} == {("a", "y"), ("b", "z")}
    got = {r.id: (r.v, r.first, r.label) for r in records.regrouped(rows, ["id"], "pos", "label").collect()}
    assert got == {"a": ("y", 1, ["l1", "l3"]), "b": ("z", 2, None)}


def test_scoring(spark):
    rows = spark.createDataFrame([(1, 0, [0, 5], [5, -100], [0, 5, 7, 8, 9]), (1, 1, [5], [5], [5, 6]), (2, 2, [5], [6], [5])], "id long, pos long, input_ids array<int>, label_ids array<int>, generated_ids array<int>")
    got = {r.id: (r.input_ids, r.label_ids, r.generated_ids) for r in scoring.first_predictions(scoring.cleaned(rows)).collect()}
    assert got == {1: ([5], [5], [7]), 2: ([5], [6], [])}
    answers = spark.createDataFrame([("1+1", "2"), ("3(1/2)", "3.5"), ("50%", "0.5"), ("1/0", "1"), ("import os", "1")], "prediction string, label string")
    assert tuple(scoring.arithmetic_accuracy(answers).first()) == (3, 5, 0.6)
    assert tuple(scoring.arithmetic_accuracy(answers.where("label = 'none'")).first()) == (0, 0, None)
    some = spark.createDataFrame([("1", "1"), ("1", None)], "prediction string, label string")
    assert tuple(scoring.arithmetic_accuracy(some).first()) == (None, None, None)
    assert scoring.metric(None) is None and scoring.metric("arithmetic") is scoring.arithmetic_accuracy


def test_masks(spark):
    n, s, c = 20, 5, 2
    got = {r.q: r.n_visible for r in masks.visible(spark, n, s, c).collect()}
    assert got == {q: sum(1 for k in range(q + 1) if k // s == q // s or k % s >= s - c) for q in range(n)}
    for stride, last in ((None, 1), (s, c), (s, 9)):
        plain = [sum(1 for k in range(q + 1) if not stride or k // stride == q // stride or k % stride >= stride - last) for q in range(n)]
        places = spark.range(n).select(masks.visible_at(F.col("id"), stride, last).cast("long").alias("v"))
        assert [r.v for r in places.collect()] == plain
        rows = spark.createDataFrame([(k,) for k in (0, 1, 7, 19, 20, 21, 47)], "k long")
        assert [r.n_visible for r in masks.visible_in(rows, "k", n, stride, last).collect()] == [sum(plain[i % n] for i in range(k)) for k in (0, 1, 7, 19, 20, 21, 47)]
    import math

    row = spark.createDataFrame([([1.0, 2.0, 1000.0], 1)], "x array<double>, y int").select(masks.cross_entropy("x", "y").alias("l")).first()
    assert math.isclose(row.l, 998.0)


def test_plugins(spark):
    @plugins.register("twice", "TWICE")
    def twice(prompt):
        return {"text": prompt * 2, "n": len(prompt)}

    rows = spark.createDataFrame([(1, "ab", "say {TWICE}"), (2, None, "{TWICE}!")], "k long, prompt string, t string")
    assert [r.t for r in plugins.enrich(rows, "prompt", "t", "twice").orderBy("k").collect()] == ["say abab", "!"]
    known = spark.createDataFrame([("ab", "found")], "prompt string, text string")
    assert [r.t for r in plugins.enrich(rows, "prompt", "t", "twice", known).orderBy("k").collect()] == ["say found", "!"]


def test_tokens_of_running_text(spark):
    from inkmill.operators import tokenizer

    cut = tokenizer.Tokenizer()
    assert cut("我爱中国") == list("我爱中国")
    assert cut("Việt ά\r\nx１2⑴ don't\x00!") == ["viet", "α", "<sep>", "x", "１", "2", "⑴", "don", "'", "t", "!"]
    assert cut("a＋b, <unused1>B<sep>") == ["a＋b", ",", "<unused1>", "b", "<sep>"]
    assert cut(None) == cut("") == [] and cut("\n") == ["<sep>"]
    pieces = tokenizer.Tokenizer(["un", "##like", "##ly", "我"])
    assert pieces("Unlikely 我 zz") == ["un", "##like", "##ly", "我", "<unk>"] or pieces("Unlikely 我 zz")[-2:] == ["我", "<unk>"]
    frame = spark.createDataFrame([(["我b", "b", None],), (None,), ([],)], "x array<string>")
    got = [r[0] for r in frame.select(tokenizer.looked_up("x", {"b": 5, "我": 6, "我b": 7}, 1)).collect()]
    assert got == [[[7], [5], []], None, []]


def test_losses_leave_out_ignored_labels(spark):
    from inkmill.operators import masks

    frame = spark.createDataFrame([([0.0, 0.0], 1), ([0.0, 0.0], -100)], "x array<double>, y int")
    got = [r[0] for r in frame.select(masks.cross_entropy("x", "y")).collect()]
    assert abs(got[0] - 0.6931471805599453) < 1e-12 and got[1] is None


def test_ranges_hold_out_against_keys_far_away(spark):
    keys = [*range(0, 6000), 10**12, 10**12 + 5, -(10**9)]
    rows = spark.createDataFrame([(k, 1) for k in keys], "k long, n int").repartition(4).unionByName(spark.createDataFrame([(None, 1)], "k long, n int"))
    dealt = rows.withColumn("r", offsets.ranges(rows, "k", 500))
    sizes = {r.r: r["count"] for r in dealt.groupBy("r").count().collect()}
    assert max(sizes.values()) <= 1000 and sizes[-1] == 1 and len(sizes) > 10
    got = [r.at for r in offsets.numbered(rows.where("k is not null"), "k", "at", rows=500).orderBy("k").collect()]
    assert got == list(range(len(keys)))


def test_crowded_keys_and_copies(spark):
    """Equal and null keys are dealt on; copies are one row until their places are known; reruns agree."""
    rows = [(7, i % 50, [i % 50]) for i in range(3000)] + [(None, i, [i]) for i in range(2000)] + [(8, 1, [1])] * 2500 + [(i, 2, None) for i in range(40)]
    random.seed(2)
    random.shuffle(rows)
    frame = spark.createDataFrame(rows, "k long, v long, x array<int>").repartition(5)
    dealt, copies = offsets._dealt(frame, "k", 200)
    assert copies and max(r["count"] for r in dealt.groupBy("_range").count().collect()) <= 400
    assert dealt.count() == 50 + 2000 + 1 + 40 - 2 + 2
    got = offsets.running(frame, "k", "v", "at", rows=200).collect()
    assert sorted((r.k is not None, r.k or 0, r.v) for r in got) == sorted((k is not None, k or 0, v) for k, v, _ in rows)
    total = 0
    for r in sorted(got, key=lambda r: (r["at"], r.v)):
        assert r["at"] == total
        total += r.v
    order = [r.k if r.k is not None else -1 for r in sorted(got, key=lambda r: (r["at"] + r.v, r.v == 0))]
    assert order == sorted(order)
    again = offsets.running(frame.repartition(3), "k", "v", "at", rows=200).collect()
    as_rows = lambda g: sorted((r.k is None, r.k or 0, r.v, r["at"]) for r in g)
    assert as_rows(got) == as_rows(again)
    by = offsets.numbered(frame.withColumn("g", F.col("v") % 2), "k", "at", ["g"], rows=200).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("at").alias("d"), F.max("at").alias("m")).collect()
    assert all(r.n == r.d == r.m + 1 for r in by)


def test_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(offsets, "MOST_RANGES", 6)
    frame = spark.range(5000).withColumn("v", F.lit(1))
    assert offsets._dealt(frame, "id", 10)[0].select("_range").distinct().count() <= 6
    assert [r["at"] for r in offsets.numbered(frame, "id", "at", rows=10).orderBy("id").collect()] == list(range(5000))


@pytest.mark.parametrize("n,stride", [(3, 7), (6, 20), (8, 9), (1, 5), (10, 400)])
def test_sparse_windows_over_ranges(spark, n, stride):
    """Ranges of a few documents, each followed on its own from what those before it leave."""
    random.seed(n + stride)
    lengths = [random.choice([0, 0, 1, 2, 5, 9, 23, 90]) for _ in range(120)]
    documents, at = [], 0
    for k in lengths:
        documents.append([str(i) for i in range(at, at + k)])
        at += k
    frame = spark.createDataFrame(list(enumerate(documents)), "k long, tokens array<string>").repartition(3)
    got = packing._sparse_windows(frame, "k", "tokens", n, stride, [], 5).orderBy("w").collect()
    assert [r.tokens for r in got] == pool(documents, n, stride)
    assert [int(r.tokens[0]) for r in got] == list(packing.starts(lengths, n, stride))
    assert [r.w for r in got] == list(range(len(got)))


def longest_first(word, known):
    """Word pieces by trying every end."""
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (piece := ("##" if at else "") + word[at:end]) in known:
                out.append(piece)
                at = end
                break
        else:
            return ["<unk>"]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_pieces_on_random_vocabularies(seed):
    random.seed(seed)
    letters = "ab#" if seed % 2 else "abc"
    draw = lambda n: "".join(random.choices(letters, k=random.randint(1, n)))
    for _ in range(60):
        known = {random.choice(["", "##"]) + draw(5) for _ in range(random.randint(0, 25))} | ({"##"} if random.random() < 0.2 else set())
        cut = vocabulary.Pieces(known)
        for word in ["", *(draw(12) for _ in range(60))]:
            assert cut(word) == longest_first(word, known), (word, known)


def test_long_words_take_no_longer_by_letter():
    import time

    cut = vocabulary.Pieces(["a" * 50, *("##" + "a" * k for k in (1, 2, 49))], most=10**6)
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        cut("a" * n + "b")
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.05


def test_fast_chain_against_the_library():
    """Tokens and spans as the public library gives them for the same chain."""
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    from inkmill.operators import tokenizer

    pool_ = ["a", "b", "C", "é", "e\u0301", "ß", "Ä", " ", "  ", "\n", "\r", "\t", "\x0b", "\x00", "\u200b", "\ufffd", "1", "²", "Ⅳ", "½", "中", "国", "가", "，", "。", "!", "$", "+", "-", "<sep>", "<pad>", "＋", "°", "\xa0", "\u3000", "\u2028", "İ", "ά", "x", "yz", "unlikely", "🙂", "\x1c", "\x85"]
    words = ["a", "b", "##a", "##b", "un", "##like", "##ly", "##y", "z", "x", "y", "##z", "中", "<", "sep", ">", "1", "!", "e", "##e", "##x", "ss", "c", "##c", "ß"]
    vocabulary_ = {t: i for i, t in enumerate(["<unk>", "<sep>", "<pad>", "<cls>", "<mask>", "<|startoftext|>", "<|endoftext|>", *words])}
    for known in (None, words):
        lib = Tokenizer(models.WordPiece(vocab=vocabulary_, unk_token="<unk>", max_input_chars_per_word=100))
        lib.add_special_tokens(["<unk>", "<sep>", "<pad>", "<cls>", "<mask>", "<|startoftext|>", "<|endoftext|>"])
        lib.normalizer = normalizers.Sequence([normalizers.Replace("\n", "<sep>"), normalizers.BertNormalizer(handle_chinese_chars=True, strip_accents=None, lowercase=True)])
        lib.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.Punctuation(), pre_tokenizers.WhitespaceSplit()])
        random.seed(6)
        cut = tokenizer.FastTokenizer(known)
        for _ in range(1500):
            text = "".join(random.choices(pool_, k=random.randint(0, 14)))
            enc = lib.encode(text)
            mine = cut(text)
            if known is None:
                # without pieces: words end where the last of their pieces does
                assert {b for _, _, b in mine} <= {b for _, b in enc.offsets}, text
            else:
                assert [(t, a, b) for t, a, b in mine] == list(zip(enc.tokens, *zip(*enc.offsets))) if enc.tokens else not mine, text


def test_spans_of_odd_texts(spark):
    from inkmill.operators import tokenizer

    frame = spark.createDataFrame([(None,), ("",), ("Ab\n<sep>é",), ("ab ab",)], "t string")
    got = [[tuple(x) for x in r[0]] for r in frame.select(tokenizer.spans("t")).collect()]
    assert got == [[], [], [("ab", 0, 2), ("<", 2, 3), ("sep", 2, 3), (">", 2, 3), ("<sep>", 3, 8), ("e", 8, 9)], [("ab", 0, 2), ("ab", 3, 5)]]
    cut = [[tuple(x) for x in r[0]] for r in frame.select(tokenizer.spans("t", ["a", "##b"])).collect()]
    assert cut[3] == [("a", 0, 1), ("##b", 1, 2), ("a", 3, 4), ("##b", 4, 5)]


def test_readings_against_plain_ones(spark):
    """The longest phrase from the left, single readings else, other text as its tokens, as many as there are tokens."""
    from inkmill.operators import readings, tokenizer

    random.seed(8)
    letters = "我爱中国人"
    for _ in range(40):
        phrases = {p: [f"{p}{i}" for i in range(len(p))] for p in ("".join(random.choices(letters, k=random.randint(1, 4))) for _ in range(8))}
        singles = {c: c + "!" for c in letters[:3]}
        read = readings.Reader(phrases, singles)
        for _ in range(40):
            text = "".join(random.choices(letters + "a1， ", k=random.randint(0, 14)))
            plain, at = [], 0
            while at < len(text):
                best = max((p for p in phrases if text.startswith(p, at)), key=len, default="")
                if best:
                    plain += phrases[best]
                elif text[at] in letters:
                    plain.append(singles.get(text[at], text[at]))
                elif text[at] == "a" and at and text[at - 1] == "a":
                    plain[-1] += "a"
                elif text[at] != " ":
                    plain.append(text[at])
                at += max(1, len(best))
            assert read(text) == plain, text
            assert len(plain) == len(tokenizer.Tokenizer()(text))
    frame = spark.createDataFrame([(None,), ("",), ("中国\nB我",)], "t string")
    got = [r[0] for r in frame.select(readings.readings("t", {"中国": ["zhong", "guo"]}, {"我": "wo"})).collect()]
    assert got == [[], [], ["zhong", "guo", "<sep>", "b", "wo"]]
    with pytest.raises(ValueError):
        readings.Reader({"中国": ["zhong"]}, {})


def test_groups_in_chunks(spark):
    rows = [("a", i, f"l{i}" if i % 3 else None) for i in range(23)] + [(None, 5, "n")]
    frame = spark.createDataFrame(random.sample(rows, len(rows)), "g string, k long, label string")
    got = {(r.g, r.chunk): (r.first, r.label) for r in records.regrouped_in_chunks(frame, ["g"], "k", "label", 10).collect()}
    assert got == {("a", c): (10 * c, [f"l{i}" if i % 3 else None for i in range(10 * c, min(23, 10 * c + 10))]) for c in range(3)} | {(None, 0): (5, ["n"])}
