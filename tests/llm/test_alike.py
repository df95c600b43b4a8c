"""Near copies by shared shingles, against similarities worked out in full."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import alike, simhash
from inkmill.llm.components import connected_components
from tests.llm.test_filters import odd_docs


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def varied(words, n):
    out = list(words)
    for _ in range(n):
        out[random.randrange(len(out))] = f"x{random.randrange(10**6)}"
    return out


def corpus():
    """Texts on their own, near copies of various distance, and many texts around one passage."""
    random.seed(5)
    word = lambda: f"w{random.randrange(3000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(random.choice([6, 40, 150, 600]))]
        texts.append(base)
        texts += [varied(base, k) for k in (0, 1, len(base) // 60, len(base) // 8)]
    texts += [[*(word() for _ in range(50)), *passage, *(word() for _ in range(50))] for _ in range(40)]
    return [" ".join(t) for t in texts] + ["", None]


def test_sketches_estimate_similarity():
    random.seed(6)
    base = [f"w{random.randrange(3000)}" for _ in range(900)]
    for n in (0, 5, 15, 40):
        a, b = " ".join(base), " ".join(varied(base, n))
        one, two = (np.frombuffer(alike.sketch(t)[1], np.uint8) for t in (a, b))
        assert abs(alike.agreement(one, two[None])[0] - similarity(a, b)) < 0.16
    assert alike.sketch(None) == alike.sketch(" ") == ([], bytes(alike.BINS))
    keys, _ = alike.sketch("a b c")
    assert len(keys) == 1 and alike.sketch("A  b\nC")[0] == keys


def test_long_texts_of_middling_similarity_are_no_candidates():
    """The least hashes of long texts have equal leading bits; sketches tell them apart nevertheless."""
    rng = np.random.default_rng(8)
    sets = rng.integers(0, 1 << 32, (30, 100_000), np.uint32)
    for n, said in ((94_000, True), (33_000, False), (0, False)):
        one = alike.sketch_of(np.unique(sets[0]))
        got = [alike.candidates(one, alike.sketch_of(np.unique(np.r_[sets[0][:n], s[n:]]))[None])[0] for s in sets[1:]]
        assert got.count(said) >= 27


@pytest.mark.parametrize(("crowd", "crowded"), [(512, 4096), (3, 5)])
def test_links_join_what_is_alike(spark, monkeypatch, crowd, crowded):
    monkeypatch.setattr(alike, "CROWD", crowd)
    monkeypatch.setattr(alike, "CROWDED", crowded)
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = alike.marked(frame, F.lit(0).cast("long"))
    prints = {r.doc_id: r.fp for r in found.select("doc_id", "fp").collect()}
    tops = {r.node: r.top for r in connected_components(alike.links(found)).collect()}
    group = {i: tops.get(fp, fp) for i, fp in prints.items()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            s = similarity(a, b)
            if s >= 0.8:
                assert group[i] == group[j], (i, j, s)
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(i)
    for m in members.values():
        for i in m:
            others = [similarity(texts[i], texts[j]) for j in m if j != i]
            assert not others or max(others) >= 0.8 or not shingles(texts[i])


def test_one_of_each_group_stays(spark):
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("top", F.lit("clash")).withColumn("mark", F.lit(1))
    kept = {r.doc_id for r in simhash.keep_one(frame).collect()}
    for i, a in enumerate(texts):
        alone = all(similarity(a, b) < 0.6 for j, b in enumerate(texts) if j != i)
        if alone and shingles(a):
            assert i in kept
        if i not in kept:
            assert any(similarity(a, texts[j]) > 0.7 or simhash.fingerprint(a) == simhash.fingerprint(texts[j]) for j in range(i))


def test_a_large_group_is_one(spark):
    random.seed(7)
    base = [f"w{random.randrange(3000)}" for _ in range(200)]
    rows = [(i, " ".join(varied(base, 1))) for i in range(700)]
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_odd_rows(spark):
    assert alike.links(alike.marked(odd_docs(spark), F.lit(0).cast("long"))).count() == 0


def test_texts_whose_one_common_key_is_crowded_meet(spark, monkeypatch):
    monkeypatch.setattr(alike, "CROWD", 3)
    monkeypatch.setattr(alike, "CROWDED", 3)
    random.seed(9)
    word = lambda: f"w{random.randrange(10**6)}"
    start = next(t for _ in iter(int, 1) if len(alike.sketch(t := " ".join(word() for _ in range(8)))[0]) == 1)
    (key,), _ = alike.sketch(start)
    texts = [start]
    while len(texts) < 12:
        keys, _ = alike.sketch(t := f"{start} {word()}")
        if len(keys) == 2 and key in keys:
            texts.append(t)
    assert all(similarity(start, t) == 0.8 for t in texts[1:])
    found = alike.marked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(0).cast("long"))
    tops = {r.node: r.top for r in connected_components(alike.links(found)).collect()}
    assert len({tops.get(r.fp, r.fp) for r in found.collect()}) == 1


def test_a_repeated_line_hides_no_copy(spark):
    random.seed(10)
    base, line = [f"w{random.randrange(3000)}" for _ in range(200)], [f"l{i}" for i in range(8)]
    texts = [" ".join(base), " ".join([*base, *line * 60])]
    assert similarity(*texts) >= 0.9 and (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() > 16
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(frame).collect()] == [0]


def test_the_line_is_at_eight_tenths(spark):
    """Pairs just above 0.8 are linked and those just below are not."""
    random.seed(11)
    texts = []
    for shared in (885, 892) * 20:
        # sets of 1,000 shingles: 885 in common are 0.794, 892 are 0.805
        base, other = ([f"{c}{random.randrange(10**6)}" for _ in range(1004)] for c in "wy")
        texts += [" ".join(base), " ".join(base[: shared + 4] + other[shared + 4 :])]
    pairs = list(zip(texts[::2], texts[1::2]))
    exact = [similarity(*p) for p in pairs]
    assert all(0.77 < s < 0.83 for s in exact) and {s >= 0.8 for s in exact} == {True, False}
    found = alike.marked(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.lit(0).cast("long"))
    tops = {r.node: r.top for r in connected_components(alike.links(found)).collect()}
    group = {r.doc_id: tops.get(r.fp, r.fp) for r in found.collect()}
    assert [group[2 * i] == group[2 * i + 1] for i in range(len(pairs))] == [s >= 0.8 for s in exact]
