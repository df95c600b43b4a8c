"""Queries over task records, each with the SQL that it must agree with: templates, builds, scores.

Records are made of the driver's tables. Parts of an example are shown one behind the other, `+` behind those to be learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.operators import masks, records, scoring
from inkmill.plans import builds, templates
from inkmill.queries import BOS, EOS, PIECE_SQL, TOK, joined, md5, query, table

B, E, P, S = BOS + "-", EOS + "+", T.PART_SEPARATOR + "-", T.SEGMENT_SEPARATOR + "+"
PLAIN = r"regexp_replace({}, '\s+', '', 'g')"


def shown(parts: Column | str) -> Column:
    return joined(F.transform(T.as_column(parts), lambda p: F.concat(p["text"], F.when(p["is_label"], "+").otherwise("-"))), "")


def trained(name: str, number: int = 0, **marks) -> Column:
    return shown(templates.TRAINING[name, number](templates.Marks(**marks)))


def asked(name: str, number: int = 0, **marks) -> tuple[Column, Column]:
    prompt, labels = templates.EVALUATION[name, number](templates.Marks(**marks))
    return shown(prompt), shown(labels)


def _part(spark, sf_dir, *columns) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), *columns)


def _products(spark, sf_dir) -> DataFrame:
    """A third of the parts have no target."""
    kind = F.element_at(F.array(*map(F.lit, templates.PRODUCTS)), (F.col("p_partkey") % 3 + 1).cast("int"))
    features = F.map_from_arrays(F.array(F.lit("br and"), F.lit("size")), F.array("p_brand", F.col("p_size").cast("string")))
    targets = F.when(F.col("p_partkey") % 3 == 1, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    return _part(spark, sf_dir, features.alias("kb"), kind.alias("type"), F.col("p_name").alias("src"), targets.alias("tgt"), F.col("p_partkey").alias("idx"))


def _product_sql(empty: str) -> str:
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(templates.PRODUCTS.values()))
    return f"""r AS (SELECT p_partkey AS pos, '商品种类：' || CASE p_partkey % 3 {names} END || '；特征信息：brand：' || {PLAIN.format("p_brand")} || '；size：' || p_size || '；商品描述：' || {PLAIN.format("p_name")} AS head, CASE WHEN p_partkey % 3 = 1 THEN {empty} ELSE string_split(p_name, ' ') END AS t FROM part),
x AS (SELECT pos, head, CAST(unnest(range(len(t))) AS BIGINT) AS place, unnest(t) AS target FROM r)"""


@query(f"WITH {_product_sql('[]')} SELECT pos, place, '{B}' || head || '-{P}商品简介：-' || target || '+{E}' AS parts FROM x")
def q_products_training(spark, sf_dir):
    rows = templates.reshaped(_products(spark, sf_dir), "cepsum2")
    return rows.select("pos", F.col("at").alias("place"), trained("cepsum2").alias("parts"))


@query(f"WITH {_product_sql(chr(91) + chr(39) * 2 + chr(93))} SELECT pos, place, '{B}' || head || '-{P}商品简介：-' AS prompt, CASE WHEN target <> '' THEN target || '+' END AS labels FROM x")
def q_products_evaluation(spark, sf_dir):
    prompt, labels = asked("cepsum2")
    return templates.reshaped(_products(spark, sf_dir), "cepsum2", True).select("pos", F.col("at").alias("place"), prompt.alias("prompt"), labels.alias("labels"))


@query(
    f"""SELECT p_partkey AS pos, '{B}文本：' || p_name || '摘要：-' AS prompt_0, '{B}文本：' || p_name || '-{P}摘要：-' AS prompt_1, s || '+' AS labels_0, s || '+' AS labels_1
FROM (SELECT *, CASE p_partkey % 3 WHEN 2 THEN p_type END AS s FROM part)"""
)
def q_summary_evaluation(spark, sf_dir):
    summary = F.when(F.col("p_partkey") % 3 == 1, "").when(F.col("p_partkey") % 3 == 2, F.col("p_type"))
    rows = _part(spark, sf_dir, F.col("p_name").alias("text"), summary.alias("summary"))
    return rows.select("pos", *[c.alias(f"{n}_{i}") for i in (0, 1) for n, c in zip(("prompt", "labels"), asked("lcsts", i))])


@query(
    f"""WITH h AS (SELECT p_partkey AS pos, p_name AS d, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '标题信息：' || p_type || '；' END || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '标签信息；' ELSE '标签信息：' || replace(p_name, ' ', '，') || '；' END ||
CASE WHEN p_partkey % 5 = 0 THEN '特征信息；' ELSE '特征信息：brand：' || p_brand || '，size：' || p_size || '；' END AS head FROM part)
SELECT pos, '{B}' || head || '-{P}商品描述：-' || d || '+{E}' AS parts, '{B}' || head || '商品描述：-' AS prompt_0, '{B}' || head || '-{P}商品描述：-' AS prompt_1, d || '+' AS labels_0, d || '+' AS labels_1 FROM h"""
)
def q_advert_templates(spark, sf_dir):
    key = F.col("p_partkey")
    title = F.when(key % 3 == 0, "").otherwise(F.col("p_type"))
    tags = F.when(key % 4 == 1, F.array().cast("array<string>")).when(key % 4 > 1, F.split("p_name", " "))
    features = F.when(key % 5 == 0, F.array().cast("array<array<string>>")).otherwise(F.array(F.array(F.lit("brand"), F.col("p_brand")), F.array(F.lit("size"), F.col("p_size").cast("string"))))
    rows = _part(spark, sf_dir, title.alias("title"), tags.alias("tags"), features.alias("feature"), F.col("p_name").alias("desc"))
    return rows.select("pos", trained("adgen").alias("parts"), *[c.alias(f"{n}_{i}") for i in (0, 1) for n, c in zip(("prompt", "labels"), asked("adgen", i))])


@query(f"SELECT p_partkey AS pos, '{B}问题：' || p_name || '-{P}答案：-' || p_type || '+{S}' || p_brand || '+{E}' AS parts FROM part")
def q_question_training(spark, sf_dir):
    rows = _part(spark, sf_dir, F.col("p_name").alias("question"), F.concat(F.lit(" "), F.concat_ws(" ||| ", "p_type", "p_brand", F.lit("x"))).alias("triple"))
    return rows.select("pos", trained("kbqa").alias("parts"))


@query(rf"""SELECT doc_id, md5('{B}原始文本：' || source || '-{P}分词结果：-' || CASE WHEN len(w) > 0 THEN array_to_string(w, '+{S}') || '+' ELSE '' END || '{E}') AS h FROM (SELECT doc_id, source, regexp_extract_all(text, '\S+') AS w FROM documents)""")
def q_segment_training(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("text"), F.col("text").alias("ans"))
    return rows.select("doc_id", md5(trained("segmentation")).alias("h"))


@query(f"SELECT p_partkey AS pos, '{B}原始文本：' || replace(p_name, ' ', '') || '-{P}分词结果：-' || replace(p_name, ' ', '+{S}') || '+{E}' AS parts, '{B}原始文本：' || replace(p_name, ' ', '') || '-{P}分词结果：-' AS prompt, replace(p_name, ' ', '+{S}') || '+' AS labels FROM part")
def q_segment_lines(spark, sf_dir):
    rows = _part(spark, sf_dir, F.replace("p_name", F.lit(" "), F.lit("  ")).alias("value"))
    prompt, labels = asked("segmentation-lines")
    return rows.select("pos", trained("segmentation-lines").alias("parts"), prompt.alias("prompt"), labels.alias("labels"))


@query(
    f"""SELECT p_partkey AS pos, '{B}句子一“' || p_name || '”与句子二“' || p_type || '”的意思是否相似？-{P}' || CASE p_partkey % 2 WHEN 1 THEN '是' ELSE '否' END || '+{E}' AS parts,
'{B}“' || p_name || '”与“' || p_type || '”的意思是否矛盾？-' AS prompt, CASE p_partkey % 2 WHEN 0 THEN '是+' ELSE '否+' END AS labels FROM part"""
)
def q_pair_lines(spark, sf_dir):
    line = F.concat(F.lit(" "), F.concat_ws("\t", "p_name", "p_type", (F.col("p_partkey") % 2).cast("string")), F.lit("\n"))
    rows = templates.reshaped(_part(spark, sf_dir, line.alias("value")), "lcqmc")
    prompt, labels = asked("lcqmc")
    return rows.select("pos", trained("lcqmc").alias("parts"), prompt.alias("prompt"), labels.alias("labels"))


@query(
    f"""SELECT p_partkey AS pos, '{B}问题：' || p_name || '-{P}答案：-' || p_size || '+1+{E}' AS parts, '{B}问题：' || p_name || '答案：-' AS prompt_0, CASE WHEN p_partkey % 4 > 0 THEN p_partkey || '+' END AS labels_0,
'{B}问题：' || p_name || '-{P}答案：-' AS prompt_1, CASE WHEN p_partkey % 4 > 0 THEN p_size || '+1+' END AS labels_1 FROM part"""
)
def q_sum_templates(spark, sf_dir):
    answer = F.when(F.col("p_partkey") % 4 > 0, F.col("p_partkey").cast("string"))
    rows = _part(spark, sf_dir, F.col("p_name").alias("text"), F.concat(F.lit("x="), F.col("p_size").cast("string"), F.lit("+1")).alias("equation"), answer.alias("label"))
    return rows.select("pos", trained("math23k").alias("parts"), *[c.alias(f"{n}_{i}") for i in (0, 1) for n, c in zip(("prompt", "labels"), asked("math23k", i))])


@query(f"SELECT p_partkey AS pos, '{B}' || p_name || '-{E}' AS prompt, '{B}' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE left(p_name, 1) || 'X' || substr(p_name, 3) END || '+{E}' AS labels FROM part")
def q_spelling_whole(spark, sf_dir):
    one = F.array(F.array(F.lit("2"), F.lit("X")))
    rows = _part(spark, sf_dir, F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 2 == 0, F.array().cast("array<array<string>>")).otherwise(one).alias("errors"))
    prompt, labels = asked("sighan15", 2)
    return rows.select("pos", prompt.alias("prompt"), labels.alias("labels"))


def _entities(spark, sf_dir) -> DataFrame:
    """The first word twice, of which the second time's type counts, and the second; every fifth part has none, every fifth no list."""
    word = lambda i: F.split("p_name", " ")[i]
    entity = lambda kind, i: F.struct(F.lit(kind).alias("type"), word(i).alias("entity"))
    found = F.array(entity("sym", 0), entity("dis", 1), entity("dis", 0))
    return _part(spark, sf_dir, F.col("p_name").alias("text"), F.when(F.col("p_partkey") % 5 > 1, found).when(F.col("p_partkey") % 5 == 1, F.slice(found, 1, 0)).alias("entities"))


ENTITY_SQL = f"""e AS (SELECT p_partkey AS pos, p_partkey % 5 AS r, '原始文本：' || p_name || '-{P}实体：-' AS head, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
l AS (SELECT *, CASE WHEN r > 1 THEN '临床表现：' || a || '+{S}疾病：' || b || '+{S}疾病：' || a || '+' WHEN r = 1 THEN '' END AS listed, CASE WHEN r > 1 THEN regexp_replace(p_name, '(' || a || '|' || b || ')', '[疾病：\\1]', 'g') ELSE p_name END AS marked FROM e)"""


@query(f"WITH {ENTITY_SQL} SELECT pos, '{B}' || head || listed || '{E}' AS parts, '{BOS}' || replace(head, '-', '') || marked || '{EOS}' AS marked FROM l WHERE r > 0")
def q_entity_training(spark, sf_dir):
    rows = _entities(spark, sf_dir).where("entities is not null")
    marked = templates.training(rows.select("pos", "text", "entities", trained("cmeee").alias("shown")), "cmeee", 1, templates.Marks(before_entity="[", after_entity="]"))
    return marked.select("pos", F.col("shown").alias("parts"), joined("parts.text", "").alias("marked"))


@query(f"WITH {ENTITY_SQL} SELECT pos, '{B}' || head AS prompt, listed AS labels, CASE WHEN r > 0 THEN marked END AS marked FROM l")
def q_entity_evaluation(spark, sf_dir):
    prompt, labels = asked("cmeee")
    rows = _entities(spark, sf_dir)
    made = templates.evaluation(rows.select("pos", "text", "entities", prompt.alias("shown"), labels.alias("listed")), "cmeee", 1, templates.Marks(before_entity="[", after_entity="]"))
    return made.select("pos", F.col("shown").alias("prompt"), F.col("listed").alias("labels"), joined("labels.text", "").alias("marked"))


@query(f"SELECT doc_id, CASE WHEN a = b THEN repeat('1', CAST(a AS INTEGER)) ELSE repeat('0', CAST(a AS INTEGER)) END AS pinyin FROM (SELECT doc_id, len({TOK}) AS a, len(regexp_extract_all(lower(strip_accents(text)), '[a-z]+|[0-9]|[^\\sa-z0-9]')) AS b FROM documents)")
def q_alignment_repair(spark, sf_dir):
    plain = F.regexp_extract_all(T.normalised("text"), F.lit(r"([a-z]+|[0-9]|[^\sa-z0-9])"), 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("ids"), F.transform(plain, lambda _: F.lit(1)).alias("pinyin"))
    return rows.select("doc_id", joined(records.repaired("ids", "pinyin").cast("array<string>"), "").alias("pinyin"))


@query("SELECT bool_or(p_partkey % 7 = 0) AS no_correct, bool_or(p_partkey % 7 = 0) AS no_total, bool_or(p_partkey % 7 = 0) AS no_accuracy FROM part")
def q_metric_without_labels(spark, sf_dir):
    size = F.col("p_size").cast("string")
    rows = _part(spark, sf_dir, size.alias("prediction"), F.when(F.col("p_partkey") % 7 > 0, size).alias("label"))
    return scoring.metric("arithmetic")(rows).select(*[F.col(c).isNull().alias(f"no_{c}") for c in ("correct", "total", "accuracy")])


@query(
    """WITH e AS (SELECT label, CASE WHEN label % 2 = 0 THEN ln(list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE))))) - CAST(embedding[label + 1] AS DOUBLE) END AS l FROM embeddings)
SELECT label, CAST(count(l) AS BIGINT) AS n, round(avg(l), 6) AS nll FROM e GROUP BY label"""
)
def q_ce_loss_ignored(spark, sf_dir):
    """Every other label is to be ignored."""
    wanted = F.when(F.col("label") % 2 == 0, F.col("label")).otherwise(T.IGNORE_ID)
    rows = table(spark, sf_dir, "embeddings").select("label", masks.cross_entropy(F.col("embedding"), wanted).alias("l"))
    return rows.groupBy("label").agg(F.count("l").alias("n"), F.round(F.avg("l"), 6).alias("nll"))


#: A vocabulary of single letters and digits, each a whole token, and of letters that go on a word.
LETTERS = {**{BOS: 10, EOS: 8, T.SEP: 2, T.PART_SEPARATOR: 11, T.SEGMENT_SEPARATOR: 12}, **{c: 100 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}, **{"##" + c: 200 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}}
#: Ids of a document's tokens by LETTERS: a word is its letters, if it has no others and is not too long.
LETTER_SQL = f"""t AS (SELECT doc_id, {PIECE_SQL} AS t FROM documents), k AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS x FROM t),
p AS (SELECT doc_id, i, CASE WHEN x = chr(1) THEN [2] WHEN regexp_full_match(x, '[0-9]') THEN [126 + CAST(x AS INTEGER)] WHEN regexp_full_match(x, '[a-z]+') AND length(x) <= 100 THEN list_transform(range(1, length(x) + 1), lambda j: ord(substr(x, j, 1)) - 97 + CASE WHEN j = 1 THEN 100 ELSE 200 END) ELSE [1] END AS ids FROM k),
d AS (SELECT documents.doc_id, coalesce(f.ids, []) AS ids FROM documents LEFT JOIN (SELECT doc_id, flatten(list(ids ORDER BY i)) AS ids FROM p GROUP BY doc_id) f USING (doc_id))"""


@query(
    f"""WITH {LETTER_SQL}, f AS (SELECT doc_id, list_concat(list_concat([10], ids), [8]) AS t FROM d), o AS (SELECT t, coalesce(sum(len(t)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, sum(len(t)) OVER () AS total FROM f),
g AS (SELECT total, off + unnest(range(len(t))) AS g, unnest(t) AS x FROM o)
SELECT CAST(g // 1024 AS BIGINT) AS w, md5(string_agg(x, ' ' ORDER BY g)) AS h FROM g WHERE (g // 1024 + 1) * 1024 <= total GROUP BY g // 1024"""
)
def q_build_corpus(spark, sf_dir):
    """A corpus packed with the tokenizer of running text and word pieces."""
    known = spark.createDataFrame([(t, i) for t, i in LETTERS.items()], "token string, id long")
    made = builds.pack_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", known, 1, 1024, 1024)
    return made.select("w", md5(joined(F.col("data").cast("array<string>"))).alias("h"))


#: `文本：` and `摘要：` are three unknown tokens each; the text of a record is its whole document.
@query(
    f"""WITH {LETTER_SQL}, n AS (SELECT doc_id, list_concat(list_concat(list_concat([10, 1, 1, 1], ids), [11, 1, 1, 1]), [123, 8]) AS data FROM d),
r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, doc_id, data, count(*) OVER () AS total FROM n)
SELECT doc_id, md5(array_to_string(data, ' ')) AS data, md5(repeat('-100 ', CAST(len(data) - 2 AS INTEGER)) || '123 8') AS label, 'train-' || lpad(CAST(i // 300 AS VARCHAR), CAST(length(CAST(CAST(ceil(total / 300.0) AS BIGINT) AS VARCHAR)) AS INTEGER), '0') || '-of-' || CAST(ceil(total / 300.0) AS BIGINT) AS file FROM r WHERE len(data) <= 4096"""
)
def q_build_training(spark, sf_dir):
    """Summaries as ids with labels, masks and files; those of more than 4096 ids are rejected."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", F.lit("x").alias("summary"))
    made, _ = builds.build_training(rows, "lcsts", builds.id_lookup(LETTERS, 1), 4096, items=300)
    return made.select(F.col("pos").alias("doc_id"), *[md5(joined(F.col(c).cast("array<string>"))).alias(c) for c in ("data", "label")], "file")


@query(f"WITH {LETTER_SQL} SELECT doc_id, md5(array_to_string(list_concat(list_concat([10, 1, 1, 1], ids), [11, 1, 1, 1]), ' ')) AS prompt, CASE WHEN doc_id % 2 = 0 THEN '123' END AS labels FROM d")
def q_build_evaluation(spark, sf_dir):
    """Prompts and labels as ids; every other record has no label."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", F.when(F.col("doc_id") % 2 == 0, "x").alias("summary"))
    made = builds.build_evaluation(rows, "lcsts", builds.id_lookup(LETTERS, 1), 1)
    return made.select(F.col("pos").alias("doc_id"), md5(joined(F.col("input_ids").cast("array<string>"))).alias("prompt"), joined(F.col("label_ids").cast("array<string>")).alias("labels"))
