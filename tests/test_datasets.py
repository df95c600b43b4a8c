import json

import pytest

from inkmill.plans import builds, datasets
from tests.test_sources import write


def test_names():
    assert len(datasets.NAMES) == 12 and datasets.family("LCQMC", True) == "lcqmc"
    with pytest.raises(ValueError):
        datasets.family("SIGHAN15", False)
    with pytest.raises(ValueError):
        datasets.family("nothing", True)
    assert datasets.Task("LCQMC", "x").candidates() == ("是", "否") and datasets.Task("KBQA", "x").candidates() is None


def test_tasks_from_files(spark, tmp_path):
    write(f"{tmp_path}/LCQMC/train.txt", "a\tb\t1\nc\td\t0\n")
    write(f"{tmp_path}/SIGHAN15/test.json", json.dumps({"1": {"text": "ab", "errors": [["1", "x"]]}, "0": {"text": "c", "errors": []}}))
    write(f"{tmp_path}/CEPSUM2-clothing/valid.jsonl", "\n".join(json.dumps({"kb": {"k": "v"}, "type": "cl", "src": "s", "tgt": t, "idx": i}) for i, t in enumerate((["p", "q"], ""))))
    encode = builds.id_lookup({"<|endoftext|>": 3, "是": 5, "否": 6, "x": 7, "b": 8, "p": 9, "q": 10}, 1)
    made, lost = datasets.Task("LCQMC", str(tmp_path)).training(spark, encode, items=1)
    assert [(r.label[-2], r.file) for r in made.orderBy("pos").collect()] == [(5, "train-0-of-2"), (6, "train-1-of-2")] and lost.count() == 0
    spelling = datasets.Task("SIGHAN15", str(tmp_path), "test")
    assert [r.label_ids for r in spelling.evaluation(spark, encode, f"{tmp_path}/cache").orderBy("pos").collect()] == [[1], None]
    products = datasets.Task("CEPSUM2-clothing", str(tmp_path), "valid")
    assert {r.id: r.label_ids for r in products.evaluation(spark, encode).collect()} == {0: [[9], [10]], 1: None}
