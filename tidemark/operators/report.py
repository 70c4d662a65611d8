"""Error metrics over long predictions, all groupings from one pass, and wide views for export."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Evaluator(ABC):
    """A metric is one aggregate column over ``prediction`` and ``actual``; pairs with a null are skipped."""

    name: str

    @abstractmethod
    def compute(self) -> Column: ...

    def params(self) -> dict:
        return {}


class MAEEvaluator(Evaluator):
    name = "MAE"

    def compute(self) -> Column:
        return F.avg(F.abs(F.col("prediction") - F.col("actual")))


class RMSEEvaluator(Evaluator):
    name = "RMSE"

    def compute(self) -> Column:
        return F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("actual"), 2)))


class MAPEEvaluator(Evaluator):
    name = "MAPE"

    def compute(self) -> Column:
        return 100 * F.avg(F.abs((F.col("actual") - F.col("prediction")) / F.nullif(F.col("actual"), F.lit(0.0))))


class SMAPEEvaluator(Evaluator):
    name = "sMAPE"

    def compute(self) -> Column:
        return 100 * F.avg(2 * F.abs(F.col("prediction") - F.col("actual")) / F.nullif(F.abs(F.col("prediction")) + F.abs(F.col("actual")), F.lit(0.0)))


SETS = (("model",), ("model", "hour"), ("model", "horizon"), ("model", "hour", "horizon"), ("model", "year"), ("model", "year", "horizon"))


class EvaluationReport:
    def __init__(self, predictions: DataFrame, evaluators: Sequence[Evaluator] = (MAEEvaluator(),)):
        self.predictions = predictions.withColumn("year", F.year("target_date"))
        self.evaluators = list(evaluators)

    def _by(self, *keys: str) -> DataFrame:
        rows = self.predictions.dropna(subset=list(keys))
        return rows.groupBy("model", *keys).agg(*[e.compute().alias(e.name) for e in self.evaluators]).orderBy("model", *keys)

    def summary(self) -> DataFrame:
        return self._by()

    def by_hour(self) -> DataFrame:
        return self._by("hour")

    def by_horizon(self) -> DataFrame:
        return self._by("horizon")

    def by_year(self) -> DataFrame:
        return self._by("year")

    def by_hour_horizon(self) -> DataFrame:
        return self._by("hour", "horizon")

    def by_year_horizon(self) -> DataFrame:
        return self._by("year", "horizon")

    def tables(self) -> dict[str, list[dict]]:
        """The rows of all six groupings, from one pass over the predictions; they come to the driver, aggregates all."""
        out: dict[str, list[dict]] = {"_".join(s[1:]) or "summary": [] for s in SETS}
        for r in self.everything().collect():
            keys = r["grouping"].split("_")
            if all(r[k] is not None for k in keys):
                out["_".join(keys[1:]) or "summary"].append({k: r[k] for k in [*keys, *[e.name for e in self.evaluators]]})
        for name, rows in out.items():
            keys = ["model", *([] if name == "summary" else name.split("_"))]
            rows.sort(key=lambda r: tuple(r[k] for k in keys))  # noqa: B023
        return out

    def everything(self) -> DataFrame:
        """All six groupings by GROUPING SETS; ``grouping`` names the keys of a row."""
        keys = ["model", "hour", "horizon", "year"]
        metrics = [e.compute().alias(e.name) for e in self.evaluators]
        out = self.predictions.groupingSets([[F.col(c) for c in s] for s in SETS], *keys).agg(F.grouping_id().alias("gid"), *metrics)
        names = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s): "_".join(s) for s in SETS}
        label = F.coalesce(*[F.when(F.col("gid") == g, n) for g, n in names.items()])
        return out.withColumn("grouping", label).drop("gid")

    def pivot(self, key: str, metric: str, values: Sequence | None = None) -> DataFrame:
        rows = self._by(key)
        wide = rows.groupBy("model").pivot(key, list(values) if values else None).agg(F.first(metric))
        return wide.select("model", *[F.col(f"`{c}`").alias(f"{key}_{c}") for c in wide.columns if c != "model"])

    def matrix(self, row: str, column: str, metric: str, values: Sequence | None = None) -> DataFrame:
        return self._by(row, column).groupBy("model", row).pivot(column, list(values) if values else None).agg(F.first(metric)).orderBy("model", row)

    def details(self, models: Sequence[str]) -> DataFrame:
        """One row per task with each model's prediction, joined on the task's key."""
        keys = ["run_date", "target_date", "hour", "horizon", "day_in_test"]
        each = [F.max(F.when(F.col("model") == m, F.col("prediction"))).alias(f"prediction_{m}") for m in models]
        wide = self.predictions.groupBy(*keys).agg(F.max("actual").alias("actual"), *each)
        return wide.orderBy("target_date", "hour", "horizon")
