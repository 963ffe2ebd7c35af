"""Self-tests of a log: named steps whose outcome is a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.errors import classify


@dataclass
class SelfTest:
    """Built step by step; a step is a function that returns a message or None, or raises. Later steps run whatever came before."""

    steps: list[tuple[str, str, Callable[[], object]]] = field(default_factory=list)

    def step(self, name: str, run: Callable[[], object], severity: str = "error") -> SelfTest:
        self.steps.append((name, severity, run))
        return self

    def rows(self, name: str, broken: DataFrame, severity: str = "error") -> SelfTest:
        """A step that holds if a table of faults is empty."""

        def run():
            n = broken.count()
            if n:
                raise AssertionError(f"{n} rows")

        return self.step(name, run, severity)

    def run(self, spark: SparkSession) -> DataFrame:
        """Rows (position, step, severity, passed, domain, message)."""
        out = []
        for i, (name, severity, run) in enumerate(self.steps):
            try:
                out.append((i, name, "info", True, None, str(run() or "")))
            except Exception as e:
                out.append((i, name, severity, False, classify(e)[0], str(e)[:500]))
        return spark.createDataFrame(out, "position int, step string, severity string, passed boolean, domain string, message string")


def passed(report: DataFrame) -> bool:
    return not report.where(~F.col("passed") & (F.col("severity") == "error")).limit(1).count()


def warnings(report: DataFrame) -> DataFrame:
    return report.where(F.col("severity") == "warning")


def errors(report: DataFrame) -> DataFrame:
    return report.where(F.col("severity") == "error")
