"""Task datasets by name: where their files are, how they are read, which templates they take."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.plans import builds, templates
from inkmill.sources import files

# Names of datasets, and the family whose templates they take.
NAMES = {
    "CEPSUM2-cases-bags": "cepsum2",
    "CEPSUM2-clothing": "cepsum2",
    "CEPSUM2-home-appliances": "cepsum2",
    "LCSTS": "lcsts",
    "AdGen": "adgen",
    "KBQA": "kbqa",
    "WordSeg-Weibo": "segmentation",
    "ICWB-MSR": "segmentation-lines",
    "LCQMC": "lcqmc",
    "Math23K": "math23k",
    "SIGHAN15": "sighan15",
    "CMeEE": "cmeee",
}


def family(name: str, evaluation: bool) -> str:
    """The family of a dataset; a dataset without templates for the purpose is an error."""
    known = {n for n, _ in (templates.EVALUATION if evaluation else templates.TRAINING)}
    if NAMES.get(name) not in known:
        raise ValueError(f"unknown dataset {name}")
    return NAMES[name]


@dataclass(frozen=True)
class Task:
    """A dataset with its split and template."""

    name: str
    folder: str
    split: str = "train"
    template: int = 0
    marks: templates.Marks = templates.Marks()
    base: str | None = None

    def read(self, spark: SparkSession, evaluation: bool = False) -> DataFrame:
        """Records of the split's file as the templates take them, with `pos`."""
        kind = family(self.name, evaluation)
        path = files.split_file(spark, f"{self.folder}/{self.base or self.name}", self.split)
        schema = templates.SCHEMAS.get(kind)
        if kind == "cepsum2":
            # targets are an array, or an empty text where there are none
            loose = schema.replace("tgt array<string>", "tgt string")
            rows = files.load(spark, path, loose)
            rows = rows.withColumn("tgt", F.when(F.col("tgt") == "", F.array(F.lit(""))).otherwise(F.from_json("tgt", "array<string>")) if evaluation else F.from_json("tgt", "array<string>"))
        else:
            rows = files.load(spark, path, schema)
        return templates.reshaped(rows, kind, evaluation)

    def training(self, spark: SparkSession, encode: builds.Encode, **more) -> tuple[DataFrame, DataFrame]:
        """(examples, rejects) for fine-tuning."""
        return builds.build_training(self.read(spark), family(self.name, False), encode, number=self.template, marks=self.marks, split=self.split, **more)

    def evaluation(self, spark: SparkSession, encode: builds.Encode, cache: str | None = None, use_cache: bool = True) -> DataFrame:
        """Prompts and labels as ids, kept in a folder where one is given."""
        make = lambda: builds.build_evaluation(self.read(spark, True), family(self.name, True), encode, self.template, self.marks)
        return files.cached(spark, f"{cache}/{self.name}", self.split, self.template, make, use_cache) if cache else make()

    def candidates(self) -> tuple[str, ...] | None:
        """The only texts that an answer may be made of, where there are such."""
        return templates.CANDIDATES.get(NAMES[self.name])
