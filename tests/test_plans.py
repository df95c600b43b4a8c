import pytest
from pyspark.sql import functions as F

from inkmill.plans import builds, templates

B, E, P, S = "<|startoftext|>", "<|endoftext|>", "<unused1>", "<unused2>"


def trained(spark, rows, schema, name, number=0, **marks):
    frame = templates.reshaped(spark.createDataFrame(rows, f"pos long, {schema}"), name)
    return [[(p.text, p.is_label) for p in r.parts] for r in templates.training(frame, name, number, templates.Marks(**marks)).orderBy("pos").collect()]


def evaluated(spark, rows, schema, name, number=0, **marks):
    frame = templates.reshaped(spark.createDataFrame(rows, f"pos long, {schema}"), name, True)
    out = templates.evaluation(frame, name, number, templates.Marks(**marks)).orderBy("pos").collect()
    return [([p.text for p in r.prompt], None if r.labels is None else [p.text for p in r.labels]) for r in out]


def framed(*parts):
    return [(B, False), *parts, (E, True)]


def test_products(spark):
    schema = templates.SCHEMAS["cepsum2"]
    rows = [(0, {"材 质": "牛 皮"}, "bc", "好 包", ["短 评", "二"], 7), (1, {}, "cl", "衣", [], 8)]
    head = "商品种类：箱包；特征信息：材质：牛皮；商品描述：好包"
    assert trained(spark, rows, schema, "cepsum2") == [framed((head, False), (P, False), ("商品简介：", False), (t, True)) for t in ("短评", "二")]
    assert evaluated(spark, rows, schema, "cepsum2") == [([B, head, P, "商品简介："], ["短评"]), ([B, head, P, "商品简介："], ["二"]), ([B, "商品种类：衣服；特征信息：；商品描述：衣", P, "商品简介："], None)]
    with pytest.raises(Exception, match="unknown code"):
        trained(spark, [(0, {}, "??", "x", ["y"], 1)], schema, "cepsum2")


def test_summaries(spark):
    rows = [(0, "正文", "题"), (1, "正文", "")]
    schema = templates.SCHEMAS["lcsts"]
    assert trained(spark, rows[:1], schema, "lcsts") == [framed(("文本：正文", False), (P, False), ("摘要：", False), ("题", True))]
    assert evaluated(spark, rows, schema, "lcsts") == [([B, "文本：正文摘要："], ["题"]), ([B, "文本：正文摘要："], None)]
    assert evaluated(spark, rows, schema, "lcsts", 1)[0] == ([B, "文本：正文", P, "摘要："], ["题"])


def test_adverts(spark):
    rows = [(0, "T", ["红", "大"], [["长", "1"], ["宽", "2"]], "D"), (1, "", None, [], "D"), (2, "", [], [["a", "b"]], "D")]
    heads = ["标题信息：T；标签信息：红，大；特征信息：长：1，宽：2；", "特征信息；", "标签信息；特征信息：a：b；"]
    schema = templates.SCHEMAS["adgen"]
    assert [r[1][0] for r in trained(spark, rows, schema, "adgen")] == heads
    assert evaluated(spark, rows, schema, "adgen") == [([B, h + "商品描述："], ["D"]) for h in heads]
    assert evaluated(spark, rows, schema, "adgen", 1) == [([B, h, P, "商品描述："], ["D"]) for h in heads]


def test_questions(spark):
    rows = [(0, "谁?", " a ||| r||| b ", "b"), (1, "谁?", "", "")]
    schema = templates.SCHEMAS["kbqa"]
    assert trained(spark, rows[:1], schema, "kbqa") == [framed(("问题：谁?", False), (P, False), ("答案：", False), ("a", True), (S, True), ("r", True))]
    assert evaluated(spark, rows, schema, "kbqa") == [([B, "问题：谁?", P, "答案："], ["a", S, "r", S, "b"]), ([B, "问题：谁?", P, "答案："], None)]


def test_segmentation(spark):
    head = [("原始文本：我们", False), (P, False), ("分词结果：", False)]
    assert trained(spark, [(0, "我们", " 我  们　")], "text string, ans string", "segmentation") == [framed(*head, ("我", True), (S, True), ("们", True))]
    assert trained(spark, [(0, "我  们")], "value string", "segmentation-lines") == [framed(*head, ("我", True), (S, True), ("们", True))]
    assert evaluated(spark, [(0, "我们", "")], "text string, ans string", "segmentation") == [([B, "原始文本：我们", P, "分词结果："], [])]


def test_pairs_and_sums(spark):
    rows = [(0, " a\tb\t1\n"), (1, "a\tb\t0")]
    same = "句子一“a”与句子二“b”的意思是否相似？"
    assert trained(spark, rows, "value string", "lcqmc") == [framed((same, False), (P, False), (x, True)) for x in "是否"]
    assert evaluated(spark, rows, "value string", "lcqmc") == [([B, "“a”与“b”的意思是否矛盾？"], [x]) for x in "否是"]
    assert evaluated(spark, rows, "value string", "lcqmc", 1) == [([B, same, P], [x]) for x in "是否"]
    sums = [(0, "几?", "x=1+2", "3"), (1, "几?", "x=1", None)]
    schema = templates.SCHEMAS["math23k"]
    assert trained(spark, sums[:1], schema, "math23k") == [framed(("问题：几?", False), (P, False), ("答案：", False), ("1+2", True))]
    assert evaluated(spark, sums, schema, "math23k") == [([B, "问题：几?答案："], ["3"]), ([B, "问题：几?答案："], None)]
    assert evaluated(spark, sums, schema, "math23k", 1) == [([B, "问题：几?", P, "答案："], ["1+2"]), ([B, "问题：几?", P, "答案："], None)]


def test_spelling(spark):
    rows = [(0, "中b文", [["1", "好"], ["3", "x"]]), (1, "abc", [])]
    schema = templates.SCHEMAS["sighan15"]
    assert evaluated(spark, rows, schema, "sighan15") == [([B, "原始文本：中b文", P, "纠错后文本："], ["好bx"]), ([B, "原始文本：abc", P, "纠错后文本："], None)]
    assert evaluated(spark, rows, schema, "sighan15", 1)[0][1] == ["0:-中+好;2:-文+x"]
    assert evaluated(spark, rows, schema, "sighan15", 2) == [([B, "中b文", E], [B, "好bx", E]), ([B, "abc", E], [B, "abc", E])]


def test_entities(spark):
    schema = templates.SCHEMAS["cmeee"]
    found = [("dis", "癌"), ("sym", "痛"), ("bod", "癌")]
    rows = [(0, "癌痛x癌", found), (1, "无", []), (2, "无", None)]
    head = [("原始文本：癌痛x癌", False), (P, False), ("实体：", False)]
    assert trained(spark, rows[:1], schema, "cmeee") == [framed(*head, ("疾病：癌", True), (S, True), ("临床表现：痛", True), (S, True), ("身体：癌", True))]
    got = trained(spark, rows[:2], schema, "cmeee", 1, before_entity="[", after_entity="]")
    piece = lambda x: [("[", True), (x, True), ("]", True)]
    assert got[0] == framed(*head, ("", True), *piece("身体：癌"), ("", True), *piece("临床表现：痛"), ("x", True), *piece("身体：癌"), ("", True))
    assert got[1][4:-1] == [("无", True)]
    with pytest.raises(ValueError):
        trained(spark, rows, schema, "cmeee", 1)
    shown = evaluated(spark, rows, schema, "cmeee")
    assert shown[1][1] == [] and shown[2][1] is None
    assert evaluated(spark, rows, schema, "cmeee", 1, before_entity="[", after_entity="]")[2][1] is None


def test_training_build(spark):
    table = {t: i for i, t in enumerate([B, E, P, "文", "本", "：", "摘", "要", "a"], 20)}
    rows = spark.createDataFrame([(0, "a", "a"), (1, "a " * 50, "a"), (2, "a", "q")], "pos long, text string, summary string")
    made, lost = builds.build_training(rows, "lcsts", builds.id_lookup(table, 1), 30, items=2)
    got = {r.pos: r for r in made.collect()}
    assert [r.reason for r in lost.collect()] == ["too long"] and sorted(got) == [0, 2]
    assert got[2].data[-2:] == [1, 21] and got[2].label[-2:] == [1, 21] and set(got[2].label[:-2]) == {-100}
    assert got[2].file == "train-1-of-2" and len(got[0].attention_mask) == len(got[0].data)
    rows = spark.createDataFrame([(0, {"k": "v"}, "bc", "s", ["a", "a a"], 3)], f"pos long, {templates.SCHEMAS['cepsum2']}")
    refs = builds.build_evaluation(templates.reshaped(rows, "cepsum2", True), "cepsum2", builds.id_lookup(table, 1)).first()
    assert (refs.type, refs.id, refs.label_ids) == ("bc", 3, [[28], [1]])


def test_corpus_build_and_scores(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "k long, t string")
    v = spark.createDataFrame([("a", 5), ("b", 6), (B, 10), (E, 8)], "token string, id long")
    got = builds.pack_corpus(docs, "k", "t", v, 1, 3, 2).orderBy("w").collect()
    assert [r.data for r in got] == [[10, 5, 6], [6, 8, 10], [10, 1, 8]] and got[0].attention_mask == [1, 1, 1]
    names = spark.createDataFrame([(t, i) for i, t in enumerate(["<pad>", "1", "+", "2", "=", "3"])], "token string, id long")
    said = spark.createDataFrame([(0, 0, [9], [5], [9, 1, 2, 3, 8]), (0, 1, [9], [5], [9, 1]), (1, 2, [9], [3], [9, 1])], "id long, pos long, input_ids array<int>, label_ids array<int>, generated_ids array<int>")
    assert tuple(builds.score(said, names, "arithmetic").first()) == (1, 2, 0.5)
    assert builds.score(said, names, None) is None
