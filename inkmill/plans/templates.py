"""Templates: records of task datasets as parts of a training example, or as prompt and label parts.

A training template gives one array of parts (text, is_label), from the start to the end token. An
evaluation template gives prompt parts and label parts, which are null without a label. All are column
expressions; the headings below are fixed values of the formats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.functions.arrays import choice, closed, interleaved, part, started

# Codes of products and entities, and their names.
PRODUCTS = {"bc": "箱包", "cl": "衣服", "homea": "家具"}
ENTITIES = {"dis": "疾病", "sym": "临床表现", "dru": "药物", "equ": "医疗设备", "pro": "医疗程序", "bod": "身体", "ite": "医学检验项目", "mic": "微生物类", "dep": "科室"}
ARITHMETIC_SYMBOLS = tuple("%()*+-./0123456789[]^")
YES, NO = "是", "否"
NOTHING = "array<struct<text:string,is_label:boolean>>"


@dataclass(frozen=True)
class Marks:
    """Separators of the parts; the marks around entities have no default."""

    part: str = T.PART_SEPARATOR
    segment: str = T.SEGMENT_SEPARATOR
    before_entity: str | None = None
    after_entity: str | None = None


def named(code: Column, names: dict[str, str]) -> Column:
    """The name of a code; an unknown code is an error."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.raise_error(F.concat(F.lit("unknown code "), F.coalesce(code, F.lit("null")))))


def _sep(m: Marks) -> Column:
    return part(m.part)


def _labels(*texts: Column) -> Column:
    return F.array(*[part(t, True) for t in texts])


def _when(condition: Column, parts: Column) -> Column:
    return F.when(condition, parts)


def _some(x: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def _product() -> Column:
    return F.concat(F.lit("商品种类："), named(F.col("type"), PRODUCTS), F.lit("；特征信息："), T.pairs("feature"), F.lit("；商品描述："), T.despace("source"))


def _advert() -> Column:
    """Title, tags and features. A list without items eats its heading's colon, as its closing does the last comma."""
    title = F.when(_some(F.col("title")), F.concat(F.lit("标题信息："), F.col("title"), F.lit("；"))).otherwise("")

    def block(heading: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(heading + "："), T.listed(items))).otherwise(F.lit(heading + "；"))

    tags = F.when(F.col("tags").isNotNull(), block("标签信息", F.col("tags"))).otherwise("")
    features = block("特征信息", F.transform("feature", lambda f: F.concat(f[0], F.lit("："), f[1])))
    return F.concat(title, tags, features)


def _heading(heading: str, x: Column | str) -> Column:
    return F.concat(F.lit(heading), T.as_column(x))


def _segments(m: Marks, items: Column) -> Column:
    return interleaved(F.transform(items, lambda s: part(s, True)), part(m.segment, True))


def _entity_list(m: Marks) -> Column:
    one = F.transform("entities", lambda e: part(F.concat(named(e["type"], ENTITIES), F.lit("："), e["entity"]), True))
    return interleaved(one, part(m.segment, True))


def markup(text: str | None, entities: list | None, before: str, after: str) -> list[tuple[str, bool]]:
    """A text's pieces around its entities, each entity between marks and with its type before it.

    Of entities with one text the last type counts, at the first one's place; the first that fits at a
    place is taken. Without entities the text is one piece.
    """
    text = text or ""
    types: dict[str, str] = {}
    for e in entities or []:
        types[e["entity"]] = ENTITIES[e["type"]]
    if not types:
        return [(text, True)]
    out: list[tuple[str, bool]] = []
    at = 0

    def piece(x: str) -> None:
        if x in types:
            out.extend([(before, True), (f"{types[x]}：{x}", True), (after, True)])
        else:
            out.append((x, True))

    for hit in re.finditer("|".join(map(re.escape, types)), text):
        piece(text[at : hit.start()])
        piece(hit[0])
        at = hit.end()
    piece(text[at:])
    return out


def _markup(m: Marks) -> Column:
    if m.before_entity is None or m.after_entity is None:
        raise ValueError("marks around entities must be given")
    before, after = m.before_entity, m.after_entity

    # patterns differ from row to row, which no built-in expression takes
    @F.pandas_udf(NOTHING)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, entities in batches:
            yield pd.Series([[{"text": t, "is_label": y} for t, y in markup(x, None if e is None else list(e), before, after)] for x, e in zip(texts, entities)])

    return run(F.col("text"), F.col("entities"))


Template = Callable[[Marks], "Column | tuple[Column, Column]"]
TRAINING: dict[tuple[str, int], Template] = {}
EVALUATION: dict[tuple[str, int], Template] = {}


def _to(registry: dict, name: str, number: int):
    def add(f: Template) -> Template:
        registry[name, number] = f
        return f

    return add


def _none() -> Column:
    return F.lit(None).cast(NOTHING)


@_to(TRAINING, "cepsum2", 0)
def _(m):
    return closed(F.array(part(_product()), _sep(m), part("商品简介："), part(T.despace("target"), True)))


@_to(TRAINING, "lcsts", 0)
def _(m):
    return closed(F.array(part(_heading("文本：", "text")), _sep(m), part("摘要："), part(F.col("summary"), True)))


@_to(TRAINING, "adgen", 0)
def _(m):
    return closed(F.array(part(_advert()), _sep(m), part("商品描述："), part(F.col("desc"), True)))


@_to(TRAINING, "kbqa", 0)
def _(m):
    three = T.triple("triple")
    return closed(F.array(part(_heading("问题：", "question")), _sep(m), part("答案："), part(three[0], True), part(m.segment, True), part(three[1], True)))


def _segmented(m: Marks, text: Column, items: Column) -> tuple[Column, Column]:
    return F.array(part(_heading("原始文本：", text)), _sep(m), part("分词结果：")), _segments(m, items)


@_to(TRAINING, "segmentation", 0)
def _(m):
    head, labels = _segmented(m, F.col("text"), T.words("ans"))
    return closed(F.concat(head, labels))


@_to(TRAINING, "segmentation-lines", 0)
def _(m):
    head, labels = _segmented(m, T.drop_double_spaces("value"), T.words("value"))
    return closed(F.concat(head, labels))


def _similar() -> Column:
    return F.concat(F.lit("句子一“"), F.col("sentence1"), F.lit("”与句子二“"), F.col("sentence2"), F.lit("”的意思是否相似？"))


@_to(TRAINING, "lcqmc", 0)
def _(m):
    return closed(F.array(part(_similar()), _sep(m), part(choice(F.col("label"), NO, YES), True)))


@_to(TRAINING, "math23k", 0)
def _(m):
    return closed(F.array(part(_heading("问题：", "text")), _sep(m), part("答案："), part(T.after("equation", 2), True)))


def _entity_head(m: Marks) -> Column:
    return F.array(part(_heading("原始文本：", "text")), _sep(m), part("实体："))


@_to(TRAINING, "cmeee", 0)
def _(m):
    return closed(F.concat(_entity_head(m), _entity_list(m)))


@_to(TRAINING, "cmeee", 1)
def _(m):
    return closed(F.concat(_entity_head(m), _markup(m)))


@_to(EVALUATION, "cepsum2", 0)
def _(m):
    return started(F.array(part(_product()), _sep(m), part("商品简介："))), _when(_some(F.col("target")), _labels(T.despace("target")))


@_to(EVALUATION, "lcsts", 0)
def _(m):
    return started(F.array(part(F.concat(F.lit("文本："), F.col("text"), F.lit("摘要："))))), _when(_some(F.col("summary")), _labels(F.col("summary")))


@_to(EVALUATION, "lcsts", 1)
def _(m):
    return started(F.array(part(_heading("文本：", "text")), _sep(m), part("摘要："))), _when(_some(F.col("summary")), _labels(F.col("summary")))


@_to(EVALUATION, "adgen", 0)
def _(m):
    return started(F.array(part(F.concat(_advert(), F.lit("商品描述："))))), _labels(F.col("desc"))


@_to(EVALUATION, "adgen", 1)
def _(m):
    return started(F.array(part(_advert()), _sep(m), part("商品描述："))), _labels(F.col("desc"))


@_to(EVALUATION, "kbqa", 0)
def _(m):
    three = T.triple("triple")
    labels = _segments(m, F.array(three[0], three[1], three[2]))
    return started(F.array(part(_heading("问题：", "question")), _sep(m), part("答案："))), _when(_some(F.col("answer")), labels)


@_to(EVALUATION, "segmentation", 0)
def _(m):
    head, labels = _segmented(m, F.col("text"), T.words("ans"))
    return started(head), labels


@_to(EVALUATION, "segmentation-lines", 0)
def _(m):
    head, labels = _segmented(m, T.drop_double_spaces("value"), T.words("value"))
    return started(head), labels


@_to(EVALUATION, "lcqmc", 0)
def _(m):
    asked = F.concat(F.lit("“"), F.col("sentence1"), F.lit("”与“"), F.col("sentence2"), F.lit("”的意思是否矛盾？"))
    return started(F.array(part(asked))), _labels(choice(F.col("label"), YES, NO))


@_to(EVALUATION, "lcqmc", 1)
def _(m):
    return started(F.array(part(_similar()), _sep(m))), _labels(choice(F.col("label"), NO, YES))


@_to(EVALUATION, "math23k", 0)
def _(m):
    return started(F.array(part(F.concat(F.lit("问题："), F.col("text"), F.lit("答案："))))), _when(F.col("label").isNotNull(), _labels(F.col("label")))


@_to(EVALUATION, "math23k", 1)
def _(m):
    return started(F.array(part(_heading("问题：", "text")), _sep(m), part("答案："))), _when(F.col("label").isNotNull(), _labels(T.after("equation", 2)))


def _flawed() -> Column:
    return F.size("errors") > 0


@_to(EVALUATION, "sighan15", 0)
def _(m):
    return started(F.array(part(_heading("原始文本：", "text")), _sep(m), part("纠错后文本："))), _when(_flawed(), _labels(T.edited("text", "errors")))


@_to(EVALUATION, "sighan15", 1)
def _(m):
    return started(F.array(part(_heading("原始文本：", "text")), _sep(m), part("纠错："))), _when(_flawed(), _labels(T.edit_script("text", "errors")))


@_to(EVALUATION, "sighan15", 2)
def _(m):
    return closed(F.array(part(F.col("text")))), closed(_labels(T.edited("text", "errors")))


@_to(EVALUATION, "cmeee", 0)
def _(m):
    return started(_entity_head(m)), _when(F.col("entities").isNotNull(), _entity_list(m))


@_to(EVALUATION, "cmeee", 1)
def _(m):
    return started(_entity_head(m)), _when(F.col("entities").isNotNull(), _markup(m))


# What is to be read for each dataset.
SCHEMAS = {
    "cepsum2": "kb map<string,string>, type string, src string, tgt array<string>, idx bigint",
    "lcsts": "text string, summary string",
    "adgen": "title string, tags array<string>, feature array<array<string>>, desc string",
    "kbqa": "question string, triple string, answer string",
    "segmentation": "text string, ans string",
    "math23k": "text string, equation string, label string",
    "sighan15": "text string, errors array<array<string>>",
    "cmeee": "text string, entities array<struct<type:string,entity:string>>",
}
CANDIDATES = {"lcqmc": (YES, NO), "math23k": ARITHMETIC_SYMBOLS}


def _products(rows: DataFrame, keep_unlabelled: bool) -> DataFrame:
    """A row for each target; without targets none, or one with an empty target where such rows are kept."""
    targets = F.when(F.size("tgt") > 0, F.col("tgt")).otherwise(F.array(F.lit("")) if keep_unlabelled else F.array().cast("array<string>"))
    out = rows.select("*", F.posexplode(targets).alias("_at", "target"))
    return out.select("pos", F.col("_at").cast("long").alias("at"), F.col("kb").alias("feature"), "type", "target", F.col("src").alias("source"), F.col("idx").alias("id"))


def _sentence_pairs(rows: DataFrame) -> DataFrame:
    parts = F.split(T.trim("value"), "\t")
    return rows.select("pos", parts[0].alias("sentence1"), parts[1].alias("sentence2"), parts[2].cast("int").alias("label"))


def reshaped(rows: DataFrame, name: str, evaluation: bool = False) -> DataFrame:
    """Records as the templates of a dataset take them."""
    if name == "cepsum2":
        return _products(rows, evaluation)
    return _sentence_pairs(rows) if name == "lcqmc" else rows


def training(rows: DataFrame, name: str, number: int = 0, marks: Marks = Marks()) -> DataFrame:
    """rows with `parts`."""
    return rows.withColumn("parts", TRAINING[name, number](marks))


def evaluation(rows: DataFrame, name: str, number: int = 0, marks: Marks = Marks()) -> DataFrame:
    """rows with `prompt` and `labels`."""
    asked, labels = EVALUATION[name, number](marks)
    return rows.withColumn("prompt", asked).withColumn("labels", labels)
