import random
import re

import pytest
from pyspark.sql import functions as F

from inkmill.functions import arithmetic, arrays
from inkmill.functions import text as T


def values(spark, rows, expression, schema="x string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i long, {schema}")
    return [r.out for r in frame.select("i", expression.alias("out")).orderBy("i").collect()]


ODD = ["", " a  b ", "日　本 語", "a\x1cb\x85c", "x y\r\nz\n", "\n", "no"]


def test_white_space_as_python_has_it(spark):
    assert values(spark, ODD, T.despace("x")) == ["".join(s.split()) for s in ODD]
    assert values(spark, ODD, T.words("x")) == [s.split() for s in ODD]
    assert values(spark, ODD, T.trim("x")) == [s.strip() for s in ODD]
    assert values(spark, [*ODD[1:]], T.lines("x")) == [s.splitlines() for s in ODD[1:]]


def test_triples(spark):
    assert values(spark, ["a ||| b|||c ", "中|||文||| "], T.triple("x")) == [["a", "b", "c"], ["中", "文", ""]]
    with pytest.raises(Exception, match="three parts"):
        values(spark, ["a|||b"], T.triple("x"))


def test_tokens(spark):
    assert values(spark, ["Ab12, é!"], T.tokens("x")) == [["ab", "1", "2", ",", "é", "!"]]
    assert values(spark, ["a\n", "a\nb", "\n"], T.tokens_with_lines("x")) == [["a", "<sep>"], ["a", "<sep>", "b"], ["<sep>"]]
    assert values(spark, ["中a1²"], T.words(T.isolate("x"))) == [["中", "a", "1", "²"]]
    assert values(spark, ["中a⑴⒈⓪❶➀²"], T.words(T.isolate("x"))) == [["中", "a", *"⑴⒈⓪❶➀²"]]
    assert values(spark, ["Élève Ñandú", "Việt ά й Ạ", None], T.normalised("x")) == ["eleve nandu", "viet α и a", None]


def test_tokens_are_lowered_letter_by_letter(spark):
    assert values(spark, ["Aİb ΟΔΟΣ", "a\x0bb\r\n\f\t c", None], T.tokens("x")) == [["aib", "οδοσ"], ["a", "\x0b", "b", "c"], None]


def test_decoding_against_a_loop(spark):
    random.seed(3)
    rows = [[random.choice(["中", "a", "B", "##c", "1", ",", "##中"]) for _ in range(random.randint(1, 9))] for _ in range(60)]

    def slow(tokens):
        joined = " ".join(tokens).replace(" ##", "").strip()
        return re.sub(" (?![A-Za-z])", "", joined)

    assert values(spark, rows, T.decoded("x"), "x array<string>") == [slow(r) for r in rows]


def test_small_formats(spark):
    assert values(spark, ["x=1+2", "x=", "ab"], T.after("x", 2)) == ["1+2", "", ""]
    assert values(spark, [["a", "b"], ["a"]], T.listed(F.col("x")), "x array<string>") == ["a，b；", "a；"]
    assert values(spark, [{"k 1": "v 1", "k": "w"}], T.pairs("x"), "x map<string,string>") == ["k1：v1；k：w"]
    assert values(spark, ["abcdefghijkl", "abc"], T.preview("x")) == ["abcdefghij...", "abc"]
    assert values(spark, ["a<sep>b<sep><|endoftext|>c"], T.sample_text("x")) == ["a"]
    assert values(spark, ["2.10.1+cpu", "2.9"], T.version_parts("x")) == [[2, 10, 1], [2, 9]]
    assert values(spark, ["xcatx dog"], T.split_keeping("x", T.any_of(("cat", "d.g")))) == [["x", "cat", "x dog"]]
    assert values(spark, ["q"], T.prompt("x", "<", ">{N}", {"N": F.lit("7")})) == ["<|startoftext|><q>7"]


def test_edits(spark):
    edits = F.array(F.array(F.lit("1"), F.lit("好")), F.array(F.lit("3"), F.lit("X")))
    assert values(spark, ["中b文d"], T.edited("x", edits)) == ["好bXd"]
    assert values(spark, ["中b文d"], T.edit_script("x", edits)) == ["0:-中+好;2:-文+X"]


def test_arrays(spark):
    kind = "x array<int>"
    assert values(spark, [[1, 2], []], arrays.pad_right("x", 3), kind) == [[1, 2, 0], [0, 0, 0]]
    assert values(spark, [[1, 2], [1, 2, 3, 4]], arrays.pad_left("x", 3), kind) == [[0, 1, 2], [1, 2, 3, 4]]
    assert values(spark, [[1, 8, 2], [8], [1]], arrays.until_end("x"), kind) == [[1], [], [1]]
    assert values(spark, [[0, 1, 0, 2]], arrays.without("x"), kind) == [[1, 2]]
    assert values(spark, [[0, 0, 1, 1, 1], [1, 0, 1]], arrays.position_ids("x"), kind) == [[1, 1, 0, 1, 2], [0, 1, 1]]
    assert values(spark, [[5, 6, 7], []], arrays.shifted("x"), kind) == [[6, 7], []]
    assert values(spark, [[5, 6], [5], []], arrays.interleaved("x", F.lit(0)), kind) == [[5, 0, 6], [5], []]


HOSTILE = ["__import__('os').system('x')", "9**9**9**9", "1/0", "a+1", "", "(1", "1e400", "True", "[1]", "1 if 1 else 2", "9" * 3000]


def test_arithmetic():
    assert arithmetic.value_of("3+(1/2)") == 3.5
    assert arithmetic.value_of("-2**2") == -4
    assert all(arithmetic.value_of(x) in (None, float("inf")) for x in HOSTILE)


def test_rewriting(spark):
    assert values(spark, ["3[1/2]^2", "50%+5.5%=1=2", "60千米/小时"], arithmetic.rewritten("x")) == ["3+(1/2)**2", "(50/100)+(5.5/100)=1=2", "60"]
    left, right = arithmetic.sides("x")
    assert values(spark, ["a=b=c", "a"], left) == ["a", "a"]
    assert values(spark, ["a=b=c", "a"], right) == ["b=c", None]
    assert values(spark, ["1+1", "x", None], arithmetic.evaluated(F.col("x"))) [:1] == [2.0]
    near = arithmetic.close(F.col("x")[0], F.col("x")[1])
    assert values(spark, [[1.0, 1.000005], [1.0, 1.1], [float("inf"), float("inf")], [float("nan"), float("nan")]], near, "x array<double>") == [True, False, True, False]


def test_pretty_json():
    assert T.pretty({"a": ["é"], "b": {1: None}}) == '{\n  "a": [\n    "é"\n  ],\n  "b": {\n    "1": null\n  }\n}'
    assert T.pretty([{1}]) == '[\n  "{1}"\n]'


def test_split_keeping_has_no_sign_of_its_own(spark):
    texts = ["", "the", "xthe", "thex", "a\x01b the\x01the c", "thethe", "\nthe\n", "no", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(T.split_keeping("t", "the|no")).collect()]
    import re

    assert got == [re.split("(the|no)", t) if t is not None else None for t in texts]
