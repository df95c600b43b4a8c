"""Scores of the log-bilinear model against plain counts and a plain softmax."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inkmill.llm import neural
from inkmill.llm.queries import QUERIES
from tests.llm.test_filters import empty_docs, odd_docs

COLUMNS = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def slow_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def slow_counts(docs):
    return Counter(w for d, t in docs if d is not None and not is_held_out(d) for w in [*slow_words(t), None])


def slow_base(docs):
    c = slow_counts(docs)
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in docs:
        tokens = [*slow_words(t), None]
        out.append((d, is_held_out(d), len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), 6)))
    return sorted(out, key=str)


def base_of(frame):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in frame.collect()), key=str)


def made(seed, n=120):
    """Documents of two languages with words of Zipf's kind, and some with words of their own."""
    random.seed(seed)
    words = [[f"{a}{i}" for i in range(300)] for a in ("la", "ÖB")]
    out = []
    for i in range(n):
        text = " ".join(random.choices(words[i % 2], [1 / (k + 1) for k in range(300)], k=random.randint(0, 120)))
        out.append((i, text + (f" own{i} Own{i}\tx\x1cy z\x85z" if i % 3 == 0 else "")))
    return out


def test_words():
    texts = [None, "", " a  B\tc\n", "É é\x1cx", "\x0b\x0cq", "x" * 65 + " y", "a\x00b 　c"]
    words, n = neural.words_of(pa.array(texts))
    wanted = [[w if len(w.encode()) <= 64 else " " + hashlib.sha256(w.encode()).hexdigest() + w[-3:] for w in slow_words(t)] for t in texts]
    assert n.tolist() == [len(w) for w in wanted]
    assert [w.decode() for w in words.to_pylist()] == [w for ws in wanted for w in ws]


def test_buckets(spark):
    words = ["a", "ab", "abc", "abcd", "ñ", "zzé", "😀", "xß😀", ""]
    plain = [int.from_bytes(w.encode()[-3:], "big") * 40503 % 65521 % neural.BUCKETS for w in words]
    assert neural.buckets_of(pa.array([w.encode() for w in words], pa.binary())).tolist() == plain
    assert neural.buckets_of(pa.array([b"zz", *(w.encode() for w in words)], pa.binary())[1:]).tolist() == plain
    rows = spark.createDataFrame([(i, w.encode()) for i, w in enumerate(words) if w], "i int, word binary")
    assert [r.b for r in rows.select("i", neural.bucket_column(rows.word).alias("b")).orderBy("i").collect()] == plain[:-1]


@pytest.mark.parametrize("known", [65536, 40, 0])
def test_counts_against_plain_ones(spark, known, monkeypatch):
    """All words broadcast, some joined, all joined."""
    monkeypatch.setattr(neural, "KNOWN_WORDS", known)
    monkeypatch.setattr(neural, "train", lambda docs, classes, n: neural.Model(classes.frequency).flat())
    docs = made(1) + [(None, "la1 never"), (5, "la1 la1"), (5, "la1 la1"), (30, None), (20, "w" * 100)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = neural.op13(df)
    assert ", ".join(map(" ".join, got.dtypes)) == COLUMNS
    assert base_of(got) == slow_base(docs)


def test_scores_against_a_plain_softmax(spark, monkeypatch):
    """With any parameters, and words known and joined: probabilities over all words that sum up to one."""
    docs = made(2, 60) + [(None, "la1 never")]
    rng = np.random.default_rng(0)
    held = {}

    def parameters(teaching, classes, n):
        size = sum(int(np.prod(s)) for s in neural.Model(classes.frequency).shapes)
        held["classes"], held["flat"] = classes, rng.normal(0, 0.5, size)
        return held["flat"]

    monkeypatch.setattr(neural, "train", parameters)
    monkeypatch.setattr(neural, "KNOWN_WORDS", 60)
    monkeypatch.setattr(neural, "SHORTLIST", 30)
    got = sorted(((r.doc_id, r.score) for r in neural.op13(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=str)
    counts = slow_counts(docs)
    short = [w for w, _ in sorted(((w, c) for w, c in counts.items() if w), key=lambda x: (-x[1], x[0].encode()))[:30]]
    k = 1 + len(short) + neural.BUCKETS
    assert held["classes"].size == k and [w.decode() for w in held["classes"].shortlist] == short
    d, flat = neural.DIM, held["flat"]
    r, flat = flat[: (k + 1) * d].reshape(k + 1, d), flat[(k + 1) * d :]
    q, flat = flat[: k * d].reshape(k, d), flat[k * d :]
    c, bias = flat[: 2 * d * d].reshape(2, d, d), flat[2 * d * d :]

    def kind(w):
        return 0 if w is None else 1 + short.index(w) if w in short else 1 + len(short) + int.from_bytes(w.encode()[-3:], "big") * 40503 % 65521 % neural.BUCKETS

    members = {}
    for w in counts:
        members.setdefault(kind(w), []).append(w)

    def share(w):
        if w is None or w in short:
            return 1.0
        mine = members.get(kind(w), [])
        return (counts[w] + 0.1) / (sum(counts[x] for x in mine) + 0.1 * (len(mine) + 1))

    # words of a bucket and one that training has not seen
    mine = members[max(members)]
    assert abs(sum(map(share, mine)) + 0.1 / (sum(counts[x] for x in mine) + 0.1 * (len(mine) + 1)) - 1) < 1e-9

    def plain(text):
        out, before = 0.0, (k, k)
        for w in [*slow_words(text), None]:
            logits = (r[before[0]] @ c[0] + r[before[1]] @ c[1]) @ q.T + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            out += math.log10(p[kind(w)]) + math.log10(share(w))
            before = (kind(w), before[0])
        return out

    wanted = sorted(((i, plain(t)) for i, t in docs), key=str)
    assert [a for a, _ in got] == [a for a, _ in wanted]
    assert np.allclose([b for _, b in got], [b for _, b in wanted], rtol=1e-4, atol=1e-3)


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    k = 12
    model = neural.Model(rng.integers(1, 50, k).astype(float))
    before, kind, drawn = rng.integers(0, k + 1, (2, 30)), rng.integers(0, k, 30), rng.integers(0, k, 5)
    for name in ("contexts", "classes", "matrices", "bias"):
        setattr(model, name, rng.normal(0, 0.4, getattr(model, name).shape))
    d_contexts, d_classes, d_matrices, d_bias = model.gradients(before, kind, drawn)
    whole = [np.zeros(x.shape) for x in (model.contexts, model.classes, model.matrices, model.bias)]
    np.add.at(whole[0], before.ravel(), d_contexts)
    np.add.at(whole[1], np.r_[kind, drawn], d_classes)
    whole[2] += d_matrices
    np.add.at(whole[3], np.r_[kind, drawn], d_bias)
    for value, gradient in zip((model.contexts, model.classes, model.matrices, model.bias), whole):
        for at in rng.integers(0, value.size, 8):
            x = value.ravel()
            kept, losses = x[at], []
            for step in (1e-4, -1e-4):
                x[at] = kept + step
                losses.append(model.loss(before, kind, drawn))
            x[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-4 - gradient.ravel()[at]) < 1e-2 * max(1, abs(gradient.ravel()[at]))


def test_models_are_averaged(spark):
    rng = np.random.default_rng(0)
    rows = [(int(n), (x * n).tobytes(), x) for n, x in ((n, rng.normal(size=7)) for n in rng.integers(1, 90, 100))]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b, _ in rows], "tokens long, sums binary").repartition(70)
    wanted = sum(n * x for n, _, x in rows) / sum(n for n, _, _ in rows)
    assert np.allclose(neural._averaged(df), wanted)


def test_learns_from_the_words_before(spark, data):
    got = QUERIES["op13_lm_score"](spark, data).toPandas()
    held = got[got.held_out]
    assert len(held) and held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.05


def test_odd_rows(spark):
    got = {(r.doc_id, r.n_tokens): r for r in neural.op13(odd_docs(spark, [(8, "same text")])).collect()}
    assert got[1, 1].score == got[2, 1].score == got[4, 1].score < 0
    assert got[5, 4].score == got[6, 4].score and got[None, 4].held_out is False
    assert neural.op13(odd_docs(spark)).count() == 9
    out = neural.op13(empty_docs(spark))
    assert out.count() == 0 and ", ".join(map(" ".join, out.dtypes)) == COLUMNS
    nothing = neural.op13(spark.createDataFrame([(None, "a b"), (next(i for i in range(100) if is_held_out(i)), "c")], "doc_id long, text string"))
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in nothing.collect()) == [(2, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
