"""Operators that judge single documents: licences, languages, toxicity, quality, benchmark passages."""

import math
import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import decontaminate, language, licenses, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, mark string, row string"
ODD = [(1, None), (2, ""), (None, "text without id"), (4, " \n\t "), (5, "same text here"), (5, "same text here"), (6, "same text here"), (7, "x" * 300_000), (8, "a\x00b 中文 🙂")]


def odd_docs(spark, more=()):
    """Nulls in any column, empty and long texts, repeated rows, and columns that clash with inner names."""
    return spark.createDataFrame([(i, t, None, None, None, 1.0, "m", "r") for i, t in [*ODD, *more]], DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def read(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


# licences

MIT = """Some words. MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""


def found(text):
    return licenses.licences([n for _, n in licenses.identifiers(text)])


def test_licence_rules():
    assert found(MIT) == ["MIT"]
    assert found("\n".join("// " + line for line in MIT.split("\n"))) == ["MIT"]
    assert found("Here. Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.") == ["Apache-2.0", "MIT"]
    assert found("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0-only"]
    assert found("Released under the MIT License.\n\nReleased under the MIT License.") == ["MIT", "MIT"]
    assert found("not Released under the MIT Licence") == [] == found(None) == found("")


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ENDORSE = """
3. Neither the name of %s nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_licences_however_they_are_set():
    one_run = lambda t: " ".join(t.split())
    for name in ("Google Inc.", "the copyright holder", "Some University of the North"):
        for text in (BSD + ENDORSE % name, one_run(BSD + ENDORSE % name), "\n".join(f" * {x}" for x in (BSD + ENDORSE % name).split("\n"))):
            assert found(text) == ["BSD-3-Clause"], text
    assert found(BSD) == found(one_run(BSD)) == ["BSD-2-Clause"]
    advert = "\n3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement: This product includes it."
    assert found(BSD + advert + ENDORSE % "X") == ["BSD-4-Clause"]
    for text in (APACHE, one_run(APACHE), "\n".join(f"# {x}" for x in APACHE.split("\n")), APACHE.replace("\n\n", "\n")):
        assert found(text) == ["Apache-2.0"], text
    assert found(one_run(MIT)) == ["MIT"]
    assert found("Apache License\nVersion 2.0, January 2004") == ["Apache-2.0"]


def test_licences_by_name_and_identifier():
    for text, wanted in (
        ("License: MIT", ["MIT"]),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("/* SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND cc-by-nc-sa-4.0 */", ["GPL-2.0-or-later", "CC-BY-NC-SA-4.0"]),
        ('  "license": "ISC",', ["ISC"]),
        ("SPDX-License-Identifier: 0BSD", ["0BSD"]),
        ("SPDX-License-Identifier: CC-BY-NC-4.0", ["CC-BY-NC-4.0"]),
        ("<b>MIT License</b>", ["MIT"]),
        ("Artistic License 2.0", ["Artistic-2.0"]),
        ("The PostgreSQL Licence", ["PostgreSQL"]),
        ("WTFPL", ["WTFPL"]),
        ("This library is licensed under the GNU Lesser General Public License v2.1 or later.", ["LGPL-2.1-or-later"]),
        ("Our own code is available under the terms of the Mozilla Public License, version 2.0.", ["MPL-2.0"]),
        ("It is released under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
        ("Distributed under the GPLv3 or later.", ["GPL-3.0-or-later"]),
    ):
        assert found(text) == wanted, text
    for text in ("License: see below", "License: MIT or not", "SPDX-License-Identifier: MIT AND", "SPDX-License-Identifier: Foo-1.0", "vim", "curl", "MIT", "apache", "json", "He has a license: to kill", "we are under the mit", "a license for ruby", "SPDX-License-Identifier: (Zlib OR MIT", "the terms (MIT License) apply"):
        assert found(text) == [], text


def test_cuts_against_plain_ones():
    """Known sentences in a row, wrapped anywhere, between other sentences: all are found, in their order, and nothing else."""
    random.seed(4)
    known = [s for s in licenses.SENTENCES if len(s.split()) > 3 and "http" not in s]
    for _ in range(60):
        words, wanted = [], []
        for _ in range(random.randint(1, 5)):
            if random.random() < 0.5:
                words += [*random.choices(["one", "two", "three", "house"], k=random.randint(2, 9)), "end."]
            s = random.choice(known)
            wanted.append(licenses.SENTENCES[s])
            words += [*s.split()[:-1], s.split()[-1] + random.choice([".", "!", ";", ":"])]
        text = words[0] + "".join(random.choice([" ", " ", " ", " \n", "\n "]) + w for w in words[1:])
        got = [n for _, n in licenses.identifiers(text)]
        # a line of its own may hold a shorter known sentence
        rest = iter(got)
        assert all(w in rest for w in wanted), (text, got, wanted)
        assert len(got) <= len(wanted) + sum(text.count(x) for x in ("mit license", "apache license", "public license", "clause license"))


def test_licence_rules_against_plain_matching():
    random.seed(1)
    known = list(licenses.SENTENCES)
    for _ in range(200):
        picked = [random.choice(known) for _ in range(random.randint(0, 5))]
        names = [licenses.SENTENCES[s] for s in picked]
        assert [n for _, n in licenses.identifiers("\n\n".join(f"{s.capitalize()}." for s in picked))] == names
        out, at = [], 0
        while at < len(names):
            hit = next(((r, ids) for r, ids in licenses.RULES if names[at : at + len(ids)] == list(ids)), None)
            out, at = (out + [hit[0]], at + len(hit[1])) if hit else (out, at + 1)
        assert licenses.licences(names) == out


def test_licences_in_markup():
    for text in ("`MIT License`", "_MIT License_", "=== MIT License ===", "\u2022 MIT License", "\u201cMIT License\u201d", "This software is released under the MIT License.", "// SPDX-License-Identifier: MIT", " " * 5000 + "MIT License"):
        assert licenses.licences([n for _, n in licenses.identifiers(text)]) == ["MIT"], text
    text = "GNU LESSER GENERAL PUBLIC LICENSE\n    Version 2.1, February 1999\n\nSPDX-License-Identifier: AGPL-3.0-only\n"
    assert licenses.licences([n for _, n in licenses.identifiers(text)]) == ["LGPL-2.1-only", "AGPL-3.0-only"]


def test_licence_scan_of_odd_tables(spark):
    got = licenses.op1(odd_docs(spark, [(9, "Released under the MIT License.")])).collect()
    assert len(got) == len(ODD) + 1 and sum(r.n_sentences for r in got) == 1
    assert licenses.op1(empty_docs(spark)).count() == 0


# languages


def test_numbers_and_signs_are_no_letters():
    classify = language.Classifier([("en", b"some words of a text"), ("fr", b"quelques mots d'un texte")])
    for text in ("\u00bd \u00b2 \u2460 \u2167", "123 !?", "", None):
        assert classify(text)[0] == language.UNKNOWN
    assert classify("\u00bd cup")[0] in ("en", "fr")


def test_languages_of_long_texts_only(spark):
    rows = [(i, ("le mot et la chose " if i % 2 else "the word and the thing ") * 9000, "fr" if i % 2 else "en") for i in range(4)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(name for name, _ in model) == ["en", "fr"] and all(len(x) > language.SAMPLE_BYTES for _, x in model)


def test_language_of_odd_tables(spark, data):
    model = language.learn(read(spark, data, "documents"))
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(odd_docs(spark), model).collect()}
    assert {i for i, p, _ in got if p == "und"} == {1, 2, 4} and all(s == 0 for _, p, s in got if p == "und")
    assert len({(p, s) for i, p, s in got if i in (5, 6)}) == 1 and all(0 <= s <= 1 for _, _, s in got)
    assert language.op2(empty_docs(spark)).count() == 0
    assert {r.lang_pred for r in language.op2(odd_docs(spark)).collect()} == {"und"}


def test_language_accuracy_on_held_out_rows(spark, data):
    docs = read(spark, data, "documents")
    got = language.op2(docs).where("held_out").join(docs, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert got.n > 20 and got.a > 0.95


def test_language_ignores_what_it_must(spark, data):
    docs = read(spark, data, "documents")
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a, b = ({r.doc_id: r.lang_pred for r in language.op2(d).collect()} for d in (docs, changed))
    assert a == b


# toxicity


def spelt(word):
    data = f" {word} ".encode()
    return [data[max(0, i - 7) : i + 1] for i in range(1, len(data))]


def plain_evidence(rows):
    """Evidence of a word, by Kneser-Ney worked out straight from its definition, over rows (words, toxic)."""
    n = [Counter(), Counter()]
    for words, y in rows:
        for w in words:
            n[y].update(spelt(w))
    every = set(n[0]) | set(n[1])
    kinds = {m: {g[-m:] for g in every if len(g) >= m} for m in range(1, 9)}

    @cache
    def lower(g):
        def times(h):
            return sum(1 for x in kinds[len(h) + 1] if x[1:] == h)

        beside = [h for h in kinds[len(g)] if h[:-1] == g[:-1] and times(h)]
        below = lower(g[1:]) if len(g) > 1 else 1 / 256
        return (max(times(g) - 0.75, 0) + 0.75 * len(beside) * below) / sum(times(h) for h in beside)

    def top(g, counts, weight=0.0):
        beside = [counts[h] for h in every if h[:-1] == g[:-1] and counts[h]]
        return max(counts[g] - 0.75, 0), 0.75 * len(beside) + weight, sum(beside) + weight

    def word(w):
        total = 0.0
        for g in spelt(w):
            shared = 1.0  # of a byte that neither class has seen here, it cancels out
            if g in every:
                own, rest, all_ = top(g, n[0] + n[1])
                shared = (own + rest * lower(g[1:])) / all_
            for y, sign in ((1, 1), (0, -1)):
                own, rest, all_ = top(g, n[y], toxicity.SHARED_WEIGHT)
                total += sign * math.log((own + rest * shared) / all_ if all_ > toxicity.SHARED_WEIGHT else shared)
        return total

    return word


SAID = [("the cat and the other cat", 0), ("the idiot and another idiot", 1), ("ideas of idealists", 0), ("what idiots they are", 1), ("loweischaft über loweiöl", 1), ("they are the authors of a catalogue", 0)]


def test_grams():
    found, place = toxicity.grams(["ab", "abcdefghij"])
    as_bytes = [int(g).to_bytes(8, "big").lstrip(b"\0") for g in found]
    assert as_bytes == spelt("ab") + spelt("abcdefghij") and place.tolist() == [0] * 3 + [1] * 11
    assert [int(g) for g in toxicity.grams(["a"])[0]] == [0x2061, 0x206120]


def test_evidence_is_kneser_ney(spark):
    rows = spark.createDataFrame([(t, y) for t, y in SAID], "text string, mark int").repartition(3)
    counted = toxicity.counts(rows)
    plain = plain_evidence([(t.split(), y) for t, y in SAID])
    words = sorted({w for t, _ in SAID for w in t.split()} | {"idiotic", "lowei", "zzz", "catalogues", "thermos"})
    for tasks in (1, 5):
        toxicity_rows = toxicity.model_rows(counted, tasks * toxicity.GRAMS_IN_TASK)
        table = toxicity.Table(toxicity_rows.toArrow())
        np.testing.assert_allclose(table(words), [plain(w) for w in words], rtol=1e-4, atol=1e-5)
    assert plain("idiots") > max(0, plain("ideas"))


def test_toxicity_on_held_out_rows(spark, data):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity.op4(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    pairs = got.score[got.toxic == 1].to_numpy()[:, None] > got.score[got.toxic == 0].to_numpy()[None, :]
    assert pairs.mean() > 0.85
    assert (got.predicted[got.toxic == 1] == 1).mean() > 0.6
    assert got.predicted[got.toxic == 0].mean() < 0.03


def test_toxicity_of_odd_tables(spark):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(10, 130)] + [(5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    more = [(i, f"some words {'idiot' if i % 2 else 'friend'} here {i}") for i in range(10, 130)]
    docs = odd_docs(spark, more)
    got = toxicity.op4(docs, labels)
    rows = got.collect()
    assert len(rows) == len(ODD) + 120 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 4)}) == 1
    assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted == 0 for r in rows)
    assert {r.score for r in toxicity.op4(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.op4(empty_docs(spark), labels).count() == 0
    assert toxicity.drop_toxic(empty_docs(spark), labels).count() == 0


@pytest.mark.parametrize("n_toxic", [1, 2, 3, 6])
def test_few_toxic_rows(spark, n_toxic):
    """No table is too small: what a single toxic row says counts, and ordinary rows stay."""
    kind = ["friend", "tree", "house", "stone", "river", "bread"]
    said = lambda i, bad: f"the {kind[i % 6]} of my {kind[i % 5]} {'filthy vermin, filthy scum' if bad else kind[i % 4]} went away {i % 9}"
    free = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 != 1]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 3 == 1]
    bad = set(free[:n_toxic]) | set(held[:4])
    rows = [(i, said(i, i in bad)) for i in free[:60] + held[:30]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in bad)) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.op4(docs, labels).collect()}
    low = max(got[i].score for i, _ in rows if i not in bad)
    assert 0 < low < 0.7 and all(got[i].score > low for i in held[:4])
    if n_toxic > 1:
        assert all(got[i].predicted == 1 for i in held[:4])
        assert {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()} == set(got) - bad


def test_smallest_table_is_scored(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    got = toxicity.op4(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.nunique() > 10
    assert (got.predicted[got.toxic == 1] == 1).sum() >= 2
    assert got.predicted[got.toxic == 0].mean() <= 0.1


def test_scores_are_worked_out_again(spark):
    """op4 against plain Kneser-Ney evidence, plain parts and the condition of a least cost for the curve."""
    said = [(10 + i, t, y) for i, (t, y) in enumerate([*SAID, ("a cat went over the sea", 0), ("you idiot of idiots", 1)])]
    said = [(next(j for j in range(i * 100, i * 100 + 100) if zlib.crc32(str(j).encode()) % 3 != 1), t, y) for i, t, y in said]
    asked = next(j for j in range(5, 100) if zlib.crc32(str(j).encode()) % 3 == 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in said] + [(asked, "these idiots of the sea")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in said] + [(asked, 1)], "doc_id long, toxic int")
    order = {r.doc_id: r.h for r in docs.select("doc_id", toxicity.hash_order("doc_id", 41).alias("h")).collect()}
    folds = 4 if min(sum(y for *_, y in said), sum(1 - y for *_, y in said)) >= 4 else 3
    fold = {}
    for mark in (0, 1):
        for place, i in enumerate(sorted((i for i, _, y in said if y == mark), key=lambda i: (order[i], i)), 1):
            fold[i] = place % folds

    def figures(text, rows):
        word = plain_evidence([(t.split(), y) for _, t, y in rows])
        v = sorted(map(word, text.split()))
        return [sum(v) / len(v), math.log(sum(map(math.exp, v)) / len(v)), v[-2], 1.0]

    x = np.array([figures(t, [r for r in said if fold[r[0]] != fold[i]]) for i, t, _ in said])
    y = np.array([y for *_, y in said])
    model = toxicity.learn(docs.where(docs.doc_id != asked), labels)
    w, usual, pull = (np.array(v) for v in (model.curve, toxicity.USUAL_CURVE, toxicity.PULL))
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + pull * (w - usual)).max() < 1e-3
    wanted = {i: 1 / (1 + math.exp(-np.array(figures(t, said)) @ w)) for i, t in [(i, t) for i, t, _ in said] + [(asked, "these idiots of the sea")]}
    got = {r.doc_id: r.score for r in toxicity.op4(docs, labels).collect()}
    np.testing.assert_allclose([got[i] for i in sorted(got)], [wanted[i] for i in sorted(wanted)], rtol=1e-3)


def test_many_documents_set_some_aside(spark, monkeypatch):
    """Beyond the crossed tables the curve has rows of both classes, too, however few."""
    monkeypatch.setattr(toxicity, "CROSS_ROWS", 0)
    rows = [(i, f"{'idiot' if i < 3 else 'friend'} words {i % 7}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(300)], "doc_id long, toxic int")
    joined = docs.join(labels, "doc_id").withColumnRenamed("toxic", "mark")
    spare = joined.where(toxicity._spare(joined, {0: 297, 1: 3})).groupBy("mark").count().collect()
    assert {r.mark: r["count"] for r in spare} == {0: 74, 1: 1}
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, labels)).collect()}
    assert min(got[i] for i in range(3)) > max(got[i] for i in range(3, 300))


def test_many_labels_are_joined_without_broadcast(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"{'idiot' if i % 2 else 'friend'} words") for i in range(200)], "doc_id long, text string")
    a = {r.doc_id: r.score for r in toxicity.op4(docs, labels).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 1)
    assert {r.doc_id: r.score for r in toxicity.op4(docs, labels).collect()} == a


def test_large_models_are_joined(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    docs = odd_docs(spark, [(i, f"{'idiot' if i % 2 else 'friend'} words {i % 7} of idio{'t' * (i % 3)}") for i in range(10, 300)])
    small, large = (toxicity.learn(docs, labels, n) for n in (toxicity.MOST_GRAMS, 0))
    assert small.table is not None and large.table is None
    np.testing.assert_allclose(small.curve, large.curve, rtol=1e-5)
    a, b = (sorted((r.doc_id or -1, round(r.score, 6)) for r in toxicity.score(docs, m).collect()) for m in (small, large))
    assert a == b


# quality


def test_three_grades_keep_their_order():
    random.seed(2)
    slots = quality.Slots()
    words = (["bad", "awful", "junk"], ["plain", "usual", "fair"], ["fine", "good", "great"])
    rows = [(" ".join(random.choices(words[g] + ["the", "of"], k=20)), 3 * g) for g in range(3) for _ in range(40)]
    model = quality.Ordinal.fit([quality.features(slots, t) for t, _ in rows], np.array([g for _, g in rows]))
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 3, 6]
    got = [model(*quality.features(slots, " ".join([*w, "the", "of"] * 4)), 6) for w in words]
    assert got[0][0] < 1.5 < got[1][0] < 4.5 < got[2][0] and got[2][1] > 0.7 > 0.3 > got[0][1]
    assert quality.Ordinal.fit([], np.array([], int))(*quality.features(slots, "x"), 0) == (None, 1.0)
    assert quality.Ordinal.fit([quality.features(slots, "a")], np.array([4]))(*quality.features(slots, "x"), 4) == (4.0, 1.0)


def test_gradient_by_differences():
    """A step of the fit lowers the loss that plain formulas give."""
    slots = quality.Slots()
    rows = [("good fine", 2), ("good so", 1), ("bad so", 0), ("bad bad", 0), ("fine", 2)]
    feats = [quality.features(slots, t) for t, _ in rows]
    grades = np.array([g for _, g in rows])

    def loss(model):
        total = 0.0
        for (k, v), g in zip(feats, grades):
            t = np.r_[1, model.tails(k, v), 0]
            total -= np.log(t[g] - t[g + 1])
        return total

    flat = quality.Ordinal([0, 1, 2], np.zeros(1 << quality.BITS), np.array([-0.4, 0.4]))
    assert loss(quality.Ordinal.fit(feats, grades)) < 0.3 * loss(flat)


def test_quality_on_held_out_rows(spark):
    docs, labels = (read(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    got = quality.op10(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.keep == (got.quality == 1)).mean() > 0.95 and got.tail_probability.between(0, 1).all()


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 1), (1, None), (None, 1)], "doc_id long, quality int")
    got = quality.op10(odd_docs(spark), labels).collect()
    assert len(got) == len(ODD)
    assert quality.op10(empty_docs(spark), labels).count() == 0
    assert {r.expected_grade for r in quality.op10(odd_docs(spark), labels.where("quality > 5")).collect()} == {None}


# benchmark passages


def slow_distance(item, text):
    """Least edit distance of item to any passage of text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    random.seed(4)
    for _ in range(300):
        item = "".join(random.choices("abc ", k=random.randint(1, 70)))
        text = "".join(random.choices("abc ", k=random.randint(0, 90)))
        best = slow_distance(item, text)
        got = decontaminate.least_distance(item, text, len(item))
        assert best == len(item) if got is None else got[0] == best
        assert (decontaminate.least_distance(item, text, best - 1) is None) if best else True


def changed(text, n):
    out = list(text)
    for _ in range(n):
        at = random.randrange(len(out))
        random.choice([lambda: out.insert(at, random.choice("xyz")), lambda: out.pop(at), lambda: out.__setitem__(at, "q")])()
    return "".join(out)


def test_matches_against_all_distances():
    random.seed(6)
    letters = "abcdefghij  "
    items = [(i, decontaminate.normalise("".join(random.choices(letters, k=random.choice([8, 60, 150]))))) for i in range(12)]
    matcher = decontaminate.Matcher(items)
    for _ in range(60):
        parts = ["".join(random.choices(letters, k=40))]
        for i, t in random.sample(items, 2):
            parts += [changed(t, random.randint(0, 10)), "".join(random.choices(letters, k=30))]
        text = decontaminate.normalise(" ".join(parts))
        plain = sorted((i, d) for i, t in items if (d := slow_distance(t, text)) <= decontaminate.budget(t))
        assert matcher(text) == plain


def test_matches_in_odd_tables(spark):
    bench = spark.createDataFrame([(1, "The passage, that is planted here for the test of it all"), (2, None), (3, "?!"), (1, "The passage, that is planted here for the test of it all")], "item_id long, text string")
    docs = odd_docs(spark, [(9, "before THE PASSAGE that is plnted here; for the test of it all, after"), (10, "the passage that is not")])
    got = sorted(tuple(r) for r in decontaminate.op5(docs, bench).collect())
    assert got == [(9, 1, 1), (9, 1, 1)]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    assert decontaminate.op5(empty_docs(spark), bench).count() == 0 == decontaminate.op5(docs, bench.limit(0)).count()
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_CHARS", 60)
    bench = spark.createDataFrame([(i, f"item number {i} has these words of its own {i * 7919}") for i in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"xx item number {i} has these words of its own {i * 7919} yy") for i in range(5)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.op5(docs, bench).where("distance = 0").collect()} == {(i, i) for i in range(5)}
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


@pytest.mark.parametrize("mod,rest", [(4, 2), (3, 1)])
def test_held_out_rows(spark, mod, rest):
    from inkmill.llm._shared import held_out

    ids = [*range(50), -7, None]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = [r.h for r in frame.select(held_out("doc_id", mod, rest).alias("h")).collect()]
    assert got == [i is not None and zlib.crc32(str(i).encode()) % mod == rest for i in ids]
