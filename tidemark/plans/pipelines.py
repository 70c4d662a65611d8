"""The two fluent pipelines: sources to one prepared frame, and models to one evaluated report."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..logs import get_logger

from ..operators.align import outer_align
from ..operators.models import RESULT, BaseModel
from ..operators.report import EvaluationReport, Evaluator, MAEEvaluator
from ..operators.transformers import LagTransformer, ResampleTransformer, TimezoneTransformer, Transformer
from ..operators.validators import ContinuityValidator, EdaValidator, NullCheckValidator, ValidationResult, Validator
from ..sources import files
from ..sources.base import DataSource
from ..sources.cache import RangeCache, config_key
from ..sources.calendar import CalendarSource
from ..sources.csv import CsvSource
from ..sources.market import EntsoeSource
from ..sources.weather import OpenMeteoSource

KNOWN = (
    CsvSource, CalendarSource, OpenMeteoSource, EntsoeSource, TimezoneTransformer, ResampleTransformer, LagTransformer,
    NullCheckValidator, ContinuityValidator, EdaValidator,
)
REGISTRY = {c.__name__: c for c in KNOWN}
logger = get_logger(__name__)


def instant(value, today: dt.datetime | None = None) -> str:
    if str(value) == "today":
        value = (today or dt.datetime.now(dt.timezone.utc)).replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    return dt.datetime.fromisoformat(str(value)).strftime("%Y-%m-%d %H:%M:%S")


class DataPipeline:
    def __init__(self, spark: SparkSession):
        self.spark, self.sources, self.transformers, self.validators = spark, [], [], []
        self.results: list[ValidationResult] = []

    def _add(self, where: list, item, kind: type) -> DataPipeline:
        if not isinstance(item, kind):
            raise TypeError(f"Expected a {kind.__name__}, got {type(item).__name__}")
        where.append(item)
        return self

    def add_source(self, source: DataSource) -> DataPipeline:
        return self._add(self.sources, source, DataSource)

    def add_transformer(self, transformer: Transformer) -> DataPipeline:
        return self._add(self.transformers, transformer, Transformer)

    def add_validator(self, validator: Validator) -> DataPipeline:
        return self._add(self.validators, validator, Validator)

    def run(self, start, end, cache: bool | str = False, cache_dir: str = ".cache") -> DataFrame:
        """``cache``: True for the range cache, or a ``.csv`` file or a folder that holds the aligned source data once written."""
        if not self.sources:
            raise ValueError("No sources")
        a, b = instant(start), instant(end)
        if b <= a:
            raise ValueError("end must be after start")
        if isinstance(cache, str):
            if files.exists(self.spark, cache):
                logger.info("Source data are read from %s", cache)
            else:
                self._keep(self._align(a, b, False, cache_dir), cache)
            df = self._kept(cache)
        else:
            df = self._align(a, b, cache, cache_dir)
        for t in self.transformers:
            df = t.transform(df)
        self.results = []
        if self.validators:
            df = df.persist()
            self.results = [v.validate(df) for v in self.validators]
            for v, result in zip(self.validators, self.results):
                for message in result.errors:
                    logger.warning("%s: %s", type(v).__name__, message)
                for message in result.warnings:
                    logger.info("%s: %s", type(v).__name__, message)
        return df

    def _keep(self, df: DataFrame, path: str) -> None:
        """Write source data as one CSV file, if the path ends so, or as a Parquet folder."""
        if not path.lower().endswith(".csv"):
            df.write.parquet(path)
            return
        folder = f"{path}-{uuid.uuid4().hex[:8]}"
        as_text = df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ssXXX")).orderBy("ts")
        as_text.coalesce(1).write.option("header", True).csv(folder)
        files.move(self.spark, files.only_part(self.spark, folder), path)
        store, found = files.at(self.spark, folder)
        store.delete(found, True)

    def _kept(self, path: str) -> DataFrame:
        """Source data as they were kept; the first column of a CSV file holds the instants."""
        if not path.lower().endswith(".csv"):
            return self.spark.read.parquet(path)
        df = self.spark.read.csv(path, header=True, inferSchema=True)
        first = df.columns[0]
        return df.select(F.col(f"`{first}`").cast("timestamp").alias("ts"), *[F.col(f"`{c}`") for c in df.columns[1:]])

    def _align(self, a: str, b: str, cache: bool, cache_dir: str) -> DataFrame:
        frames = []
        for s in self.sources:
            config = s.get_cache_config() if cache else None
            frames.append(RangeCache(self.spark, cache_dir, config).fetch(s, a, b) if config else s.fetch(self.spark, a, b))
        return outer_align(frames)

    def to_dict(self) -> dict:
        part = lambda items: [{"class": type(i).__name__, "params": i.params()} for i in items]
        return {"sources": part(self.sources), "transformers": part(self.transformers), "validators": part(self.validators)}

    def save(self, path: str) -> None:
        files.write_text(self.spark, path, yaml.safe_dump(self.to_dict(), sort_keys=False))

    @classmethod
    def from_dict(cls, spark: SparkSession, spec: dict, transports: dict[str, Callable] | None = None) -> DataPipeline:
        """``transports``: by class, what fetches for sources in place of their own HTTP. ``${NAME}`` as an API key is
        that environment variable."""
        out = cls(spark)
        for part, add in (("sources", out.add_source), ("transformers", out.add_transformer), ("validators", out.add_validator)):
            for item in spec.get(part) or []:
                if item["class"] not in REGISTRY:
                    raise ValueError(f"Unknown {part[:-1]}: {item['class']}")
                own = {"transport": transports[item["class"]]} if transports and item["class"] in transports else {}
                add(REGISTRY[item["class"]](**(item.get("params") or {}), **own))
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str, transports: dict[str, Callable] | None = None) -> DataPipeline:
        text = files.read_text(spark, path)
        if text is None:
            raise FileNotFoundError(path)
        return cls.from_dict(spark, yaml.safe_load(text), transports)


class ModelPipeline:
    def __init__(self):
        self.models, self.evaluators, self.exporters = [], [], []

    def add_model(self, model: BaseModel) -> ModelPipeline:
        self.models.append(model)
        return self

    def add_evaluator(self, evaluator: Evaluator) -> ModelPipeline:
        self.evaluators.append(evaluator)
        return self

    def add_exporter(self, exporter) -> ModelPipeline:
        self.exporters.append(exporter)
        return self

    def run(
        self, data: DataFrame, test_start: str, test_end: str, target: str = "price", horizon: int = 7,
        save_dir: str | None = None, save_format: str = "parquet",
    ) -> EvaluationReport:
        """All models' predictions evaluated. With ``save_dir`` finished tasks are stored and not run again, as
        ``parquet`` or, one task a line, as ``json``."""
        if not self.models:
            raise ValueError("No models")
        if save_format not in ("parquet", "json"):
            raise ValueError(f"Unknown format: {save_format}")
        parts = []
        for m in self.models:
            if save_dir:
                parts.append(ResultStore(data.sparkSession, save_dir, m, target, save_format).run(data, test_start, test_end, horizon))
            else:
                parts.append(m.run(data, test_start, test_end, target, horizon))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        # Every view reads the predictions; without a store they would be fitted anew for each.
        report = EvaluationReport((whole if save_dir else once(whole)).filter("error is null"), self.evaluators or [MAEEvaluator()])
        for e in self.exporters:
            e.export(report)
        return report


def once(df: DataFrame) -> DataFrame:
    """``df`` worked out one time: a table in the shared folder if the session names one, else kept by the executors."""
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not shared:
        return df.persist()
    path = f"{shared.rstrip('/')}/predictions-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ResultStore:
    """Predictions of one model and target on disk. What a model predicts depends on its settings, so each set of
    settings has a folder of its own; tasks are known by run date, hour and horizon, whatever test range they ran in."""

    def __init__(self, spark: SparkSession, root: str, model: BaseModel, target: str, kind: str = "parquet"):
        names = [p if isinstance(p, str) else [p(h) for h in range(1, 8)] for p in model.predictors]
        self.config = {"class": type(model).__name__, **model.params(), "predictors": names, "target": target}
        self.spark, self.model, self.target, self.kind = spark, model, target, kind
        self.path = f"{root.rstrip('/')}/{model.name.lower().replace(' ', '_')}-{config_key(self.config)}"

    def load(self) -> DataFrame | None:
        """All stored predictions; a task stored twice, by runs that were cut off, counts once."""
        if not files.exists(self.spark, self.path):
            return None
        return self.spark.read.schema(RESULT).format(self.kind).load(self.path).dropDuplicates(["run_date", "hour", "horizon"])

    def run(self, data: DataFrame, test_start: str, test_end: str, horizon: int) -> DataFrame:
        start, day = F.to_date(F.lit(test_start)), F.datediff("run_date", F.to_date(F.lit(test_start)))
        done = self.load()
        if done is not None:
            done = done.filter(F.col("run_date") >= start).withColumn("day_in_test", day)
        fresh = self.model.run(data, test_start, test_end, self.target, horizon, done)
        fresh.filter("error is null").write.mode("append").format(self.kind).save(self.path)
        inside = F.col("run_date").between(start, F.to_date(F.lit(test_end))) & (F.col("horizon") <= horizon)
        return self.load().filter(inside).withColumn("day_in_test", day)
