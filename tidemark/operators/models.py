"""Rolling-window regression: one fit for each (hour, horizon, test day), run as a grouped map.

A panel row has an instant, its positional day and its hour. A task (hour, horizon h, day d) trains on that hour's days
d-tw-h .. d-h-1 against the target h days later, scaled by the window's own mean and deviation, and predicts day d.
Groups are (hour, block of test days) with the days their windows need, so the work spreads beyond 24 groups.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .align import pending
from .transformers import TS, epoch, local_time

TEST_BLOCK = 32
RESULT = (
    "model string, run_date date, target_date date, hour int, horizon int, day_in_test int, prediction double, actual double, "
    "coefficients array<double>, error string"
)


def scale(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each column; columns of only 0, 1 and missing values stay as they are."""
    binary = is_binary(train)
    with np.errstate(invalid="ignore"):
        mean, std = np.nanmean(train, axis=0) if len(train) else np.zeros(train.shape[1]), np.nanstd(train, axis=0, ddof=1) if len(train) > 1 else np.ones(train.shape[1])
    std = np.where((std == 0) | np.isnan(std), 1.0, std)
    return np.where(binary, 0.0, mean), np.where(binary, 1.0, std)


def is_binary(train: np.ndarray) -> np.ndarray:
    """Which columns hold only 0, 1 and missing values."""
    with np.errstate(invalid="ignore"):
        return np.all(np.isnan(train) | (train == 0) | (train == 1), axis=0)


def with_calendar(df: DataFrame) -> DataFrame:
    """Adds the positional day and the hour of an hourly frame without gaps; hours are those of the frame's zone."""
    start = df.agg(F.min(epoch()).alias("__first"))
    return df.crossJoin(F.broadcast(start)).withColumn("__day", F.floor((epoch() - F.col("__first")) / 86400).cast("int")).withColumn("__hour", F.hour(local_time(df))).drop("__first")


def with_leads(df: DataFrame, target: str, horizon: int) -> DataFrame:
    """Adds ``{target}_d+h``, the value h days later at the same hour, for each h up to the horizon."""
    by_hour = Window.partitionBy(F.hour(local_time(df))).orderBy(TS)
    return df.select("*", *[F.lead(f"`{target}`", h).over(by_hour).alias(f"{target}_d+{h}") for h in range(1, horizon + 1)])


def train_days(days: np.ndarray, day: int, window: int, horizon: int) -> np.ndarray:
    """Places, in ascending ``days``, of those a task trains on."""
    return np.arange(np.searchsorted(days, day - window - horizon), np.searchsorted(days, day - horizon))


def training_slices(df: DataFrame, window: int, horizon: int) -> DataFrame:
    """(hour, horizon, day, first_train, last_train, train_rows) of each task that has rows to train on; days are positions."""

    def bounds(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        days, out = np.sort(rows["day"].to_numpy()), []
        for day in days:
            for h in range(1, horizon + 1):
                at = train_days(days, day, window, h)
                if len(at):
                    out.append((int(key[0]), h, day, days[at[0]], days[at[-1]], len(at)))
        return pd.DataFrame(out, columns=["hour", "horizon", "day", "first_train", "last_train", "train_rows"])

    slim = with_calendar(df).select(F.col("__hour").alias("hour"), F.col("__day").cast("long").alias("day"))
    return slim.groupBy("hour").applyInPandas(bounds, "hour int, horizon int, day long, first_train long, last_train long, train_rows long")


def window_scales(df: DataFrame, window: int, columns: Sequence[str]) -> DataFrame:
    """(ts, column, mean, std, binary) that ``scale`` finds over the ``window`` rows before each instant at its hour."""

    def stats(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values(TS, ignore_index=True), []
        values = rows[list(columns)].to_numpy(float)
        for i in range(window, len(rows)):
            mean, std = scale(values[i - window : i])
            binary = is_binary(values[i - window : i])
            out += [(rows[TS][i], c, mean[j], std[j], bool(binary[j])) for j, c in enumerate(columns)]
        return pd.DataFrame(out, columns=[TS, "column", "mean", "std", "binary"])

    slim = df.select(TS, F.hour(local_time(df)).alias("__hour"), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return slim.groupBy("__hour").applyInPandas(stats, "ts timestamp, column string, mean double, std double, binary boolean")


class BaseModel(ABC):
    """``predictors``: column names, templates with {horizon}, or functions of the horizon."""

    def __init__(self, predictors: Sequence[str | Callable[[int], str]], training_window: int = 365, name: str | None = None):
        if training_window < 2:
            raise ValueError("training_window must be 2 or more")
        self.predictors, self.training_window, self.name = list(predictors), training_window, name or type(self).__name__

    def params(self) -> dict:
        return {"predictors": [p if isinstance(p, str) else None for p in self.predictors], "training_window": self.training_window, "name": self.name}

    def expand(self, horizon: int) -> list[str]:
        return [p(horizon) if callable(p) else p.replace("{horizon}", str(horizon)) for p in self.predictors]

    @abstractmethod
    def fit_predict(self, x: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> tuple[float, np.ndarray]:
        """Fit scaled rows and predict one row: (value, coefficients)."""

    def run(self, df: DataFrame, test_start: str, test_end: str, target: str = "price", horizon: int = 7, done: DataFrame | None = None) -> DataFrame:
        """Predictions of all tasks but those in ``done``; a task that can't be fitted has its reason in ``error``."""
        spark, wanted = df.sparkSession, {h: self.expand(h) for h in range(1, horizon + 1)}
        used = list(dict.fromkeys(c for cs in wanted.values() for c in cs))
        if missing := sorted({target, *used} - set(df.columns)):
            raise ValueError(f"Predictors not found: {missing}")
        if leak := [c for c in used for h in wanted if c == f"{target}_d+{h}"]:
            raise ValueError(f"Predictors hold the target itself: {leak}")
        panel, date = with_calendar(df), F.to_date(local_time(df))
        ends = panel.filter(date.isin(F.to_date(F.lit(test_start)), F.to_date(F.lit(test_end))))
        days = ends.groupBy(date.alias("d")).agg(F.min_by("__day", TS).alias("n")).collect()
        at = {str(r["d"]): r["n"] for r in days}
        if test_start not in at or test_end not in at:
            raise KeyError(f"Test dates not in the data: {test_start}, {test_end}")
        first, n_days = at[test_start], at[test_end] - at[test_start] + 1
        number = lambda name, a, b: spark.range(a, b).select(F.col("id").cast("int").alias(name))
        tasks = number("day_in_test", 0, n_days).crossJoin(number("hour", 0, 24)).crossJoin(number("horizon", 1, horizon + 1))
        if done is not None:
            tasks = pending(tasks, done)
        tasks = tasks.withColumn("block", F.floor(F.col("day_in_test") / TEST_BLOCK))
        last_block, reach = (n_days - 1) // TEST_BLOCK, self.training_window + horizon
        in_test = F.col("__day") - first
        blocks = F.sequence(F.greatest(F.lit(0), F.floor((in_test - horizon) / TEST_BLOCK)), F.least(F.lit(last_block), F.floor((in_test + reach) / TEST_BLOCK)))
        slim = panel.filter((in_test >= -reach) & (in_test < n_days + horizon)).select(
            F.col("__hour").alias("hour"), F.col("__day").alias("day"), date.alias("date"), F.explode(blocks).alias("block"),
            F.col(f"`{target}`").cast("double").alias("__y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in used],
        )
        model = self

        def solve(key: tuple, todo: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return model._solve(todo, rows.sort_values("day", ignore_index=True), wanted, first)

        return tasks.groupBy("hour", "block").cogroup(slim.groupBy("hour", "block")).applyInPandas(solve, RESULT)

    def _solve(self, todo: pd.DataFrame, rows: pd.DataFrame, wanted: dict[int, list[str]], first: int) -> pd.DataFrame:
        by_day = {d: i for i, d in enumerate(rows["day"])}
        y_all = rows["__y"].to_numpy(float)
        x_all = {h: rows[c].to_numpy(float) for h, c in wanted.items()}
        days, out = rows["day"].to_numpy(), []
        for hour, h, nth in todo.sort_values(["day_in_test", "horizon"])[["hour", "horizon", "day_in_test"]].itertuples(index=False):
            d, tw = first + nth, self.training_window
            value = actual = None
            coefficients, error, date = None, None, None
            if d not in by_day:
                error = "no row for the test day"
            else:
                i = by_day[d]
                date = pd.Timestamp(rows["date"].iloc[i])
                train = train_days(days, d, tw, h)
                x, ahead = x_all[h][train], x_all[h][i]
                y = np.array([y_all[by_day[k + h]] if k + h in by_day else np.nan for k in days[train]])
                if d + h in by_day and not np.isnan(y_all[by_day[d + h]]):
                    actual = float(y_all[by_day[d + h]])
                if len(train) < 2:
                    error = "training window is empty"
                elif not (np.isfinite(x).all() and np.isfinite(ahead).all() and np.isfinite(y).all()):
                    error = "missing values in the training window"
                else:
                    m, s = scale(x)
                    my, sy = y.mean(), y.std(ddof=1) or 1.0
                    try:  # whatever goes wrong in one task, the others go on
                        value, coefficients = self.fit_predict((x - m) / s, (y - my) / sy, (ahead - m) / s)
                        value, coefficients = float(value * sy + my), [float(c) for c in coefficients]
                    except Exception as e:
                        value, coefficients, error = None, None, f"{type(e).__name__}: {e}"
            out.append((self.name, None if date is None else date.date(), None if date is None else (date + pd.Timedelta(days=h)).date(), hour, h, nth, value, actual, coefficients, error))
        return pd.DataFrame(out, columns=[re.split(r"\s", c.strip())[0] for c in RESULT.split(", ")])


class OLSModel(BaseModel):
    """Least squares without intercept on scaled data; the least-norm solution where it isn't unique."""

    def fit_predict(self, x, y, ahead):
        w = np.linalg.lstsq(x, y, rcond=None)[0]
        return float(ahead @ w), w


class LassoCVModel(BaseModel):
    """L1-penalised least squares with intercept; the penalty is chosen by contiguous folds from a log-spaced path."""

    def __init__(self, predictors, training_window: int = 365, name: str | None = None, cv: int = 5, max_iter: int = 10000, n_alphas: int = 100, eps: float = 1e-3, tol: float = 1e-4):
        super().__init__(predictors, training_window, name)
        self.cv, self.max_iter, self.n_alphas, self.eps, self.tol = cv, max_iter, n_alphas, eps, tol

    def params(self) -> dict:
        return {**super().params(), **{k: getattr(self, k) for k in ("cv", "max_iter", "n_alphas", "eps", "tol")}}

    def fit_predict(self, x, y, ahead):
        alphas, n = self._alphas(x, y), len(y)
        folds = np.array_split(np.arange(n), min(self.cv, n))
        # The folds' problems and the whole one run down the path side by side.
        parts = [np.setdiff1d(np.arange(n), fold) for fold in folds] + [np.arange(n)]
        mx, my = np.array([x[p].mean(0) for p in parts]), np.array([y[p].mean() for p in parts])
        paths = np.array(list(self.paths([x[p] - a for p, a in zip(parts, mx)], [y[p] - a for p, a in zip(parts, my)], alphas)))
        errors = sum(((y[f][:, None] - my[i] - (x[f] - mx[i]) @ paths[:, i].T) ** 2).mean(0) for i, f in enumerate(folds))
        w = paths[int(np.argmin(errors)), -1]
        return float((ahead - mx[-1]) @ w + my[-1]), w

    def _alphas(self, x, y):
        top = np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / len(y)
        return np.full(self.n_alphas, np.finfo(float).eps) if top <= 0 else np.geomspace(top, top * self.eps, self.n_alphas)

    def path(self, x, y, alphas):
        """Coefficients for each penalty in turn."""
        return [w[0] for w in self.paths([x], [y], alphas)]

    def paths(self, xs, ys, alphas):
        """For each penalty in turn, the coefficients of all problems: coordinate descent on their Gram matrices at once,
        with warm starts. A problem stops where its moves and its duality gap are small."""
        n = np.array([len(y) for y in ys], float)
        gram, xy, yy = np.array([x.T @ x for x in xs]), np.array([x.T @ y for x, y in zip(xs, ys)]), np.array([y @ y for y in ys])
        w, own = np.zeros(xy.shape), np.einsum("fjj->fj", gram)
        safe = np.where(own > 0, own, 1.0)
        for alpha in alphas:
            penalty, open_ = alpha * n, np.ones(len(xs), bool)
            for _ in range(self.max_iter):
                moved = np.zeros(len(xs))
                for j in range(w.shape[1]):
                    rho = xy[:, j] - (gram[:, j] * w).sum(1) + own[:, j] * w[:, j]
                    new = np.where(own[:, j] > 0, np.sign(rho) * np.maximum(np.abs(rho) - penalty, 0) / safe[:, j], 0.0)
                    new = np.where(open_, new, w[:, j])
                    moved, w[:, j] = np.maximum(moved, np.abs(new - w[:, j])), new
                small = moved <= self.tol * np.maximum(np.abs(w).max(1, initial=0), 1e-12)
                if small.any():
                    turned = np.einsum("fjk,fk->fj", gram, w)
                    pull, fit = xy - turned, yy - 2 * (w * xy).sum(1) + (w * turned).sum(1)
                    ratio = np.minimum(1.0, penalty / np.maximum(np.abs(pull).max(1, initial=0), 1e-300))
                    gap = 0.5 * fit + penalty * np.abs(w).sum(1) - (ratio * (yy - (w * xy).sum(1)) - 0.5 * ratio**2 * fit)
                    open_ &= ~(small & (gap <= self.tol * np.maximum(yy, 1e-300)))
                    if not open_.any():
                        break
            yield w.copy()
