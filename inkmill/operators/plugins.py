"""Plugins: Python callables by name, applied to prompts in Arrow batches, and look-ups that replace calls."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Plugin = Callable[[str], "str | dict"]
REGISTRY: dict[str, tuple[str, Plugin]] = {}


def register(name: str, placeholder: str) -> Callable[[Plugin], Plugin]:
    """Makes a callable known under a name, with the placeholder that its answer replaces in prompts."""

    def add(f: Plugin) -> Plugin:
        REGISTRY[name] = (placeholder, f)
        return f

    return add


def call(name: str, prompt: Column | str) -> Column:
    """A struct of the plugin's answer (`text`) and, where it gives a dict, the other fields (`debug`)."""
    _, plugin = REGISTRY[name]

    @F.pandas_udf("struct<text string, debug map<string,string>>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        rows = []
        for p in prompts:
            answer = None if p is None else plugin(p)
            if isinstance(answer, dict):
                rows.append((answer.get("text"), {k: str(v) for k, v in answer.items() if k != "text"}))
            else:
                rows.append((answer, None))
        return pd.DataFrame(rows, columns=["text", "debug"])

    return run(prompt)


def enrich(rows: DataFrame, prompt: str, template: str, name: str, answers: DataFrame | None = None) -> DataFrame:
    """rows with the plugin's answer in place of its placeholder in the template.

    answers (prompt, text) may hold what is known already; then nothing is called.
    """
    placeholder, _ = REGISTRY[name]
    if answers is None:
        found = rows.withColumn("_answer", call(name, prompt)["text"])
    else:
        known = answers.select(F.col("prompt").alias("_prompt"), F.col("text").alias("_answer"))
        found = rows.join(known, F.col(prompt) == F.col("_prompt"), "left").drop("_prompt")
    return found.withColumn(template, F.replace(F.col(template), F.lit("{" + placeholder + "}"), F.coalesce("_answer", F.lit("")))).drop("_answer")


def json_field(text: Column | str, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(text, path), F.lit(default))
