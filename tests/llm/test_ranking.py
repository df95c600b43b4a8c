"""Ranked lexical search against scores of all pairs."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from inkmill.llm import ranking
from inkmill.llm.queries import QUERIES, SQL
from tests.llm.test_filters import empty_docs, odd_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id long, score double, rank string"


def slow_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def slow_search(docs, items, k=10):
    bags = [(d, Counter(slow_terms(t))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        rows = []
        for d, bag, n in bags:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in set(slow_terms(text)) if t in bag)
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


def made(spark, docs, items):
    d = spark.createDataFrame([(i, t, None, None, None, 1.0, "m", "r") for i, t in docs], "doc_id long, text string, lang string, source string, n long, score double, term string, item_id string")
    return d, spark.createDataFrame([(i, t, None, None, None) for i, t in items], ITEMS)


def found(frame):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in frame.collect()), key=str)


def test_terms():
    for text in (None, "", "A-b c", "Éa É x y\x85z", "1a_B\x7f\x00c", "\x1cq　"):
        assert [t.decode() for t in ranking.terms_of(text)] == slow_terms(text)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_pairs(spark, seed):
    """Zipf words, many ties and copies; items of usual and rare words; in one block and in several."""
    random.seed(seed)
    words = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(random.choices(words, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(random.choice([i, i, 7, None]), draw(random.randint(0, 40))) for i in range(250)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]
    items = [(i, draw(random.randint(1, 15))) for i in range(25)] + [(3, "w1 w59 Nowhere"), (4, None), (5, ""), (6, "W1 w1"), (6, "W1 w1"), (6, "w2")]
    d, q = made(spark, docs, items)
    wanted = slow_search(docs, [x for x in items if x[1]])
    assert found(ranking.search(d.repartition(3), q)) == wanted
    if not seed:
        assert found(ranking.search(d.repartition(3), q, block_terms=40)) == wanted
        assert found(ranking.search(d, q, k=2)) == slow_search(docs, [x for x in items if x[1]], 2)


def test_odd_rows(spark):
    items = [(1, "same text here"), (None, "text id"), (2, "x" * 300_000 + " 中文"), (3, "\n")]
    docs = [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    d, q = made(spark, docs, items)
    assert found(ranking.search(odd_docs(spark), q)) == slow_search(docs, items)
    for a, b in ((empty_docs(spark), q), (odd_docs(spark), q.limit(0))):
        out = ranking.search(a, b)
        assert out.count() == 0 and out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_pairs_left_out_cannot_rank():
    """The join scores few pairs, and all that reach the threshold."""
    rng = np.random.default_rng(0)
    n, v = 400, 50
    weights = rng.integers(0, 9000, v)
    held = rng.random((n, v)) < np.linspace(0.6, 0.02, v)
    impact = held * rng.integers(100_000, 900_000, (n, v))
    items = [rng.choice(v, 12, replace=False).tolist() for _ in range(20)]
    ordered = -np.sort(-impact, axis=0)
    join = ranking.Join(items, weights, ordered[0], ordered[9])
    doc, term = np.nonzero(held)
    d, i, s = join.scores(doc, term, weights[term] * impact[doc, term], n)
    exact = np.stack([(impact[:, t] * weights[t]).sum(axis=1) for t in items], axis=1)
    assert (exact[d, i] == s).all() and len(d) < exact.size
    for j in range(20):
        tenth = np.sort(exact[:, j])[-10]
        assert join.threshold[j] <= tenth
        assert set(np.flatnonzero(exact[:, j] >= tenth)) <= set(d[i == j])


def test_agrees_with_sql(spark, data):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{data}/{name}.parquet'")
    got = QUERIES["op11_ranked_search"](spark, data).toPandas()
    wanted = con.sql(SQL["op11_ranked_search"]).df()
    columns = ["item_id", "rank", "doc_id", "score"]
    assert len(got) and sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, wanted[columns].values.tolist()))
