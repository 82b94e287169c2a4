"""Runs stages over a folder of tables: each table is a Parquet folder, written as a whole; what is there is not made again."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from stepwright.config import Config
from stepwright.plans.stages import STAGES, Stage


class Runner:
    """Stages over tables in a folder that all executors share.

    Tables of runs with other parameters are kept apart: a run's folder is named by the Config's signature.
    A table counts as made once Spark's commit has left _SUCCESS in its folder; a broken-off one is written again.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, sources: dict[str, DataFrame] | None = None):
        self.spark, self.config = spark, config or Config()
        self.folder = f"{folder.rstrip('/')}/{self.config.signature()[:16]}"
        self.sources = dict(sources or {})

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def made(self, table: str) -> bool:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/_SUCCESS")
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)

    def table(self, name: str) -> DataFrame:
        if name in self.sources:
            return self.sources[name]
        if not self.made(name):
            raise KeyError(f"no table {name} in {self.folder}")
        return self.spark.read.parquet(self.path(name))

    def run(self, stage: str | Stage, again: bool = False) -> dict[str, str]:
        """Make a stage's tables, unless they are there; returns made or kept for each."""
        s = STAGES[stage] if isinstance(stage, str) else stage
        if not again and all(map(self.made, s.makes)):
            return dict.fromkeys(s.makes, "kept")
        out = s.run({name: self.table(name) for name in s.reads}, getattr(self.config, s.part))
        report = {}
        for name in reversed(s.makes):  # the first table is written last: it says that the stage is done
            if again or not self.made(name):
                out[name].write.mode("overwrite").parquet(self.path(name))
            report[name] = "made"
        return report

    def resume_at(self, stages: Iterable[str | Stage]) -> str | None:
        """The first stage whose first table is not there."""
        for stage in stages:
            s = STAGES[stage] if isinstance(stage, str) else stage
            if not self.made(s.makes[0]):
                return s.name
        return None

    def run_all(self, stages: Iterable[str | Stage], from_scratch: bool = False) -> dict[str, dict[str, str]]:
        """Run stages in order; finished ones are kept unless from_scratch."""
        return {s if isinstance(s, str) else s.name: self.run(s, from_scratch) for s in stages}
