"""Registered queries of the time-series engine and their SQL twins.

All run over whole tables. The hourly panel is built from ``events`` (price: mean value, load: rows of each hour), the daily
one from ``orders``. Queries named ``..._all`` take a panel of minutes, where gaps are real. Money is summed as decimals
and results are rounded the same way in both engines, so values compare exactly; instants are returned as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rounding import half_up
from ..operators import align, models, report, validators
from ..operators.transformers import LagTransformer, ResampleTransformer, TimezoneTransformer, local_time
from ..session import require_utc
from ..sources import market, weather
from ..sources.calendar import COUNTRIES, CalendarSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = lambda spark, sf_dir: function(require_utc(spark), sf_dir)
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    rows = table(spark, sf_dir, "events")
    money = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return rows.groupBy(F.date_trunc(unit, F.col("ts").cast("timestamp")).alias("ts")).agg((money / F.count("value")).alias("price"), F.count("*").alias("load"))


def text(df: DataFrame, *names: str) -> DataFrame:
    """Instants as text, doubles rounded."""
    cols = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else half_up(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*cols).select(*names) if names else df.select(*cols)


PANEL = """panel AS (SELECT date_trunc('hour', ts) AS ts, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS price, count(*) AS load FROM events GROUP BY 1)"""
#: All events by minute: many minutes have none, so there are gaps and no row is left out.
MINUTES = PANEL.replace("date_trunc('hour', ts)", "date_trunc('minute', ts)")
T = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def r4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


@query(f"WITH {PANEL} SELECT {T.format('ts')} AS ts, {r4('price')} AS price, load FROM panel")
def hourly_panel(spark, d):
    return text(hourly(spark, d))


@query(f"""WITH {PANEL}, l AS (SELECT ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Warsaw' AS w FROM panel)
SELECT {T.format('ts')} AS ts, CAST(hour(w) AS INT) AS local_hour, CAST(isodow(w) - 1 AS INT) AS local_weekday, CAST(month(w) AS INT) AS local_month FROM l""")
def tz_local_fields(spark, d):
    df = TimezoneTransformer("Europe/Warsaw")(hourly(spark, d))
    local = local_time(df)
    return text(df.select("ts", F.hour(local).alias("local_hour"), F.weekday(local).alias("local_weekday"), F.month(local).alias("local_month")))


def _resample_sql(method: str, step: int = 1, only_price: bool = False) -> str:
    size, unit, panel = step * 60, "MINUTE", MINUTES

    def fill(c: str) -> str:
        cast = f"CAST({c} AS DOUBLE)"
        if only_price and c == "load":
            return cast
        back = f"last_value({cast} IGNORE NULLS) OVER b"
        on = f"first_value({cast} IGNORE NULLS) OVER f"
        if method == "ffill":
            return back
        if method == "bfill":
            return on
        pt, nt = f"last_value(CASE WHEN {c} IS NOT NULL THEN s END IGNORE NULLS) OVER b", f"first_value(CASE WHEN {c} IS NOT NULL THEN s END IGNORE NULLS) OVER f"
        return f"CASE WHEN {c} IS NOT NULL THEN {cast} WHEN {on} IS NULL THEN {back} ELSE {back} + ({on} - {back}) * (s - {pt}) / ({nt} - {pt}) END"

    return f"""WITH {panel}, e AS (SELECT date_trunc('day', min(ts)) AS m, min(ts) AS a, max(ts) AS b FROM panel),
g AS (SELECT unnest(generate_series(m + to_seconds(CAST(epoch(a) - epoch(m) AS BIGINT) // {size} * {size}), b, INTERVAL {step} {unit})) AS ts FROM e),
j AS (SELECT g.ts, epoch(g.ts) AS s, price, load FROM g LEFT JOIN panel USING (ts)),
x AS (SELECT ts, {fill('price')} AS price, {fill('load')} AS load FROM j WINDOW b AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {T.format('ts')} AS ts, round_even(price * 1000, 0) / 1000 AS price, round_even(load * 1000, 0) / 1000 AS load FROM x"""


def _minutes(spark, d) -> DataFrame:
    return hourly(spark, d, unit="minute")


def _resampled(spark, d, **options):
    df = ResampleTransformer(**options)(_minutes(spark, d))
    return df.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "price", "load")


@query(_resample_sql("linear", 1))
def resample_linear_all(spark, d):
    return _resampled(spark, d, freq="1min", method="linear")


@query(_resample_sql("ffill", 1))
def resample_ffill_all(spark, d):
    return _resampled(spark, d, freq="1min", method="ffill")


@query(_resample_sql("bfill", 1))
def resample_bfill_all(spark, d):
    return _resampled(spark, d, freq="1min", method="bfill")


@query(_resample_sql("ffill", 2))
def resample_downsample_2min_all(spark, d):
    return _resampled(spark, d, freq="2min", method="ffill")


@query(_resample_sql("linear", 1, True))
def resample_subset_columns_all(spark, d):
    return _resampled(spark, d, freq="1min", columns="price")


def _lag_sql(hours: dict[str, int]) -> str:
    joins = " ".join(f"LEFT JOIN panel l{i} ON l{i}.ts = p.ts - to_hours({h})" for i, h in enumerate(hours.values()))
    cols = ", ".join(f'{r4(f"l{i}.price")} AS "{n}"' for i, n in enumerate(hours))
    return f"WITH {MINUTES} SELECT {T.format('p.ts')} AS ts, {cols} FROM panel p {joins}"


@query(_lag_sql({"price_h-1": 1, "price_h-3": 3}))
def lag_hour_all(spark, d):
    return text(LagTransformer("price", [1, 3], "1h")(_minutes(spark, d)), "ts", "`price_h-1`", "`price_h-3`")


@query(_lag_sql({"price_d-1": 24, "price_d-7": 168}))
def lag_day_all(spark, d):
    return text(LagTransformer("price", [1, 7], "1D")(_minutes(spark, d)), "ts", "`price_d-1`", "`price_d-7`")


@query(_lag_sql({"price_h+2": -2, "price_d+1": -24}))
def lag_forward_all(spark, d):
    return text(LagTransformer("price", [-2, -24], "1h")(_minutes(spark, d)), "ts", "`price_h+2`", "`price_d+1`")


@query(f"""WITH {PANEL} SELECT {T.format('ts')} AS ts, {r4('lead(price, 1) OVER w')} AS "price_d+1", {r4('lead(price, 2) OVER w')} AS "price_d+2" FROM panel
WINDOW w AS (PARTITION BY hour(ts) ORDER BY ts)""")
def target_leads(spark, d):
    return text(models.with_leads(hourly(spark, d), "price", 2).select("ts", "`price_d+1`", "`price_d+2`"))


@query("""WITH e AS (SELECT date_trunc('day', ts) AS ts, count(*) AS events FROM events GROUP BY 1),
o AS (SELECT date_trunc('day', o_orderdate) AS ts, count(*) AS orders FROM orders GROUP BY 1), l AS (SELECT date_trunc('day', l_shipdate) AS ts, count(*) AS shipped FROM lineitem GROUP BY 1)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, coalesce(events, -1) AS events, coalesce(orders, -1) AS orders, coalesce(shipped, -1) AS shipped FROM e FULL JOIN o USING (ts) FULL JOIN l USING (ts)""")
def outer_align_sources(spark, d):
    def daily(name, column, count):
        return table(spark, d, name).groupBy(F.date_trunc("day", F.col(column).cast("timestamp")).alias("ts")).agg(F.count("*").alias(count))

    return text(align.outer_align([daily("events", "ts", "events"), daily("orders", "o_orderdate", "orders"), daily("lineitem", "l_shipdate", "shipped")]).fillna(-1))


def _calendar(spark, d, **options):
    off = {"holidays": False, "weekday": False, "hour": False, "month": False}
    return text(CalendarSource("PL", timezone="Europe/Warsaw", **(off | options)).describe(hourly(spark, d).select("ts")))


LOCAL = f"WITH {PANEL}, l AS (SELECT ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Warsaw' AS w FROM panel) SELECT {T.format('ts')} AS ts, "
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@query(LOCAL + "CAST(isodow(w) - 1 AS INT) AS weekday, CAST(hour(w) AS INT) AS hour, CAST(month(w) AS INT) AS month FROM l")
def calendar_number(spark, d):
    return _calendar(spark, d, weekday="number", hour="number", month="number")


@query(LOCAL + "lower(dayname(w)) AS weekday_name, lower(monthname(w)) AS month_name FROM l")
def calendar_name(spark, d):
    return _calendar(spark, d, weekday="name", month="name")


@query(LOCAL + ", ".join([*[f"CAST(isodow(w) = {i + 1} AS INT) AS is_{n}" for i, n in enumerate(_DAYS)], *[f'CAST(hour(w) = {h} AS INT) AS "is_{h}"' for h in range(24)], *[f"CAST(month(w) = {i + 1} AS INT) AS is_{n}" for i, n in enumerate(_MONTHS)]]) + " FROM l")
def calendar_onehot(spark, d):
    return _calendar(spark, d, weekday="onehot", hour="onehot", month="onehot")


@query(LOCAL + "CAST(strftime(w, '%m-%d') IN ('01-01', '01-06', '05-01', '05-03', '08-15', '11-01', '11-11', '12-25', '12-26') OR CAST(w AS DATE) IN (DATE '2024-03-31', DATE '2024-04-01', DATE '2024-05-19', DATE '2024-05-30') AS INT) AS is_holiday FROM l")
def holiday_broadcast_join(spark, d):
    return _calendar(spark, d, holidays="binary")


_LAT, _LON = COUNTRIES["PL"][1:]


@query(f"""WITH {PANEL}, l AS (SELECT ts, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Warsaw' AS w FROM panel),
m AS (SELECT ts, (epoch(w) - epoch(ts)) / 3600.0 AS shift, radians((357.5291 + 0.98560028 * (date_diff('day', DATE '2000-01-01', CAST(w AS DATE)) - {_LON} / 360.0)) % 360) AS mean FROM l),
a AS (SELECT *, radians((degrees(mean) + 1.9148 * sin(mean) + 0.02 * sin(2 * mean) + 0.0003 * sin(3 * mean) + 180 + 102.9372) % 360) AS along FROM m),
t AS (SELECT *, 12 - {_LON} / 15.0 + 24 * (0.0053 * sin(mean) - 0.0069 * sin(2 * along)) AS noon, asin(sin(along) * sin(radians(23.44))) AS tilt FROM a),
h AS (SELECT *, degrees(acos((sin(radians(-0.833)) - sin(radians({_LAT})) * sin(tilt)) / (cos(radians({_LAT})) * cos(tilt)))) / 15 AS half FROM t)
SELECT {T.format('ts')} AS ts, {r4('floor((noon - half + shift) * 60) / 60')} AS sunrise, {r4('floor((noon + half + shift) * 60) / 60')} AS sunset, {r4('2 * half')} AS daylight_hours FROM h""")
def calendar_daylight(spark, d):
    return _calendar(spark, d, daylight=True)


@query(f"""WITH {MINUTES},
j AS (SELECT p.price, p.load, l.price AS lagged FROM panel p LEFT JOIN panel l ON l.ts = p.ts - INTERVAL 1 HOUR)
SELECT 'price' AS "column", count(*) - count(price) AS null_count FROM j UNION ALL SELECT 'load', count(*) - count(load) FROM j
  UNION ALL SELECT 'price_h-1', count(*) - count(lagged) FROM j""")
def null_check_all(spark, d):
    return validators.null_counts(LagTransformer("price", 1)(_minutes(spark, d)))


@query(f"""WITH {MINUTES},
g AS (SELECT lag(ts) OVER (ORDER BY ts) AS a, ts AS b FROM panel)
SELECT {T.format('a')} AS start, {T.format('b')} AS "end", CAST(epoch(b) - epoch(a) AS BIGINT) AS duration FROM g WHERE epoch(b) - epoch(a) > 60""")
def continuity_gaps_all(spark, d):
    return text(validators.gaps(_minutes(spark, d), "1min"))


def _eda_sql(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", count(*) - count({c}) AS null_count, {r4(f'100.0 * (count(*) - count({c})) / count(*)')} AS null_pct, {r4(f'min({x})')} AS min, {r4(f'max({x})')} AS max, {r4(f'avg({x})')} AS mean, {r4(f'stddev_samp({x})')} AS std, {r4(f'quantile_cont({x}, 0.25)')} AS q25, {r4(f'quantile_cont({x}, 0.5)')} AS q50, {r4(f'quantile_cont({x}, 0.75)')} AS q75 FROM panel"


@query(f"WITH {PANEL} {_eda_sql('price')} UNION ALL {_eda_sql('load')}")
def eda_stats(spark, d):
    return text(validators.describe(hourly(spark, d)))


@query(f"""SELECT {T.format('ts')} AS ts, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type
  FROM (SELECT date_trunc('hour', ts) AS ts, event_id, event_type FROM events) GROUP BY ts""")
def dedup_keep_first(spark, d):
    rows = table(spark, d, "events").select(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), "event_type", "event_id", F.col("event_id").alias("o"))
    return text(align.keep_first(rows, "o").drop("o"))


_FROM, _TO = "1995-01-01 00:00:00", "2001-12-31 00:00:00"


@query(f"""WITH c AS (SELECT date_trunc('day', o_orderdate) AS a, date_trunc('day', o_orderdate) + INTERVAL 1 DAY AS b FROM orders GROUP BY 1, 2),
e AS (SELECT a, b FROM c WHERE a < TIMESTAMP '{_TO}' AND b > TIMESTAMP '{_FROM}' UNION ALL SELECT TIMESTAMP '{_TO}', TIMESTAMP '{_TO}'),
r AS (SELECT a, greatest(coalesce(max(b) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TIMESTAMP '{_FROM}'), TIMESTAMP '{_FROM}') AS reach FROM e)
SELECT {T.format('reach')} AS start, {T.format('a')} AS "end" FROM r WHERE a > reach""")
def missing_ranges(spark, d):
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    cached = table(spark, d, "orders").select(day.alias("start"), (day + F.expr("interval 1 day")).alias("end")).distinct()
    return text(align.missing_ranges(cached, _FROM, _TO))


@query("""WITH t AS (SELECT CAST(h AS INT) AS hour, CAST(z AS INT) AS horizon, CAST(k AS INT) AS day_in_test FROM range(24) a(h), range(1, 8) b(z), range(30) c(k))
SELECT t.* FROM t LEFT JOIN (SELECT DISTINCT CAST(hour(ts) AS INT) AS hour, CAST(user_id % 7 + 1 AS INT) AS horizon, CAST(day(ts) - 1 AS INT) AS day_in_test FROM events) d USING (hour, horizon, day_in_test) WHERE d.hour IS NULL""")
def pending_tasks_anti(spark, d):
    ints = lambda *names: [F.col(n).cast("int").alias(n) for n in names]
    tasks = spark.range(24).toDF("hour").crossJoin(spark.range(1, 8).toDF("horizon")).crossJoin(spark.range(30).toDF("day_in_test")).select(*ints("hour", "horizon", "day_in_test"))
    ts = F.col("ts").cast("timestamp")
    done = table(spark, d, "events").select(F.hour(ts).alias("hour"), (F.col("user_id") % 7 + 1).cast("int").alias("horizon"), (F.day(ts) - 1).alias("day_in_test"))
    return align.pending(tasks, done)


#: Predictions that both engines can make: the price some days earlier, a day of the horizon each.
NAIVE = f"""{PANEL}, naive AS (SELECT 'naive' AS model, CAST(l.ts AS DATE) AS run_date, CAST(p.ts AS DATE) AS target_date, CAST(hour(p.ts) AS INT) AS hour, CAST(h AS INT) AS horizon, CAST(date_diff('day', DATE '2024-01-01', CAST(l.ts AS DATE)) AS INT) AS day_in_test,
CAST(floor(l.price * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS prediction, CAST(floor(p.price * 100 + 0.5) / 100 AS DECIMAL(18,2)) AS actual, CAST(year(p.ts) AS INT) AS year FROM range(1, 4) r(h) JOIN panel p ON true JOIN panel l ON l.ts = p.ts - to_days(CAST(h AS INT)))"""


def naive(spark, d) -> DataFrame:
    panel = hourly(spark, d)
    ahead = panel.select(F.col("ts").alias("t"), F.col("price").alias("p"))
    seen = panel.select(F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("horizon"), "ts", "price").withColumn("t", F.timestamp_seconds(F.unix_timestamp("ts") + 86400 * F.col("horizon")))
    return seen.join(ahead, "t").select(F.lit("naive").alias("model"), F.to_date("ts").alias("run_date"), F.to_date("t").alias("target_date"), F.hour("t").alias("hour"), "horizon", F.datediff("ts", F.lit("2024-01-01")).alias("day_in_test"), half_up(F.col("price"), 2).cast("decimal(18,2)").alias("prediction"), half_up(F.col("p"), 2).cast("decimal(18,2)").alias("actual"))


class ExactMAE(report.MAEEvaluator):
    """The same error over decimals, so that both engines sum exactly."""

    def compute(self):
        return F.sum(F.abs(F.col("prediction") - F.col("actual"))).cast("double") / F.count(F.col("prediction") - F.col("actual"))


MAE = "CAST(sum(abs(prediction - actual)) AS DOUBLE) / count(prediction - actual)"


def _mae(spark, d):
    return report.EvaluationReport(naive(spark, d), [ExactMAE()])


def _mae_sql(*keys: str) -> str:
    by = ", ".join(["model", *keys])
    return f'WITH {NAIVE} SELECT {by}, {r4(MAE)} AS "MAE" FROM naive GROUP BY {by}'


@query(_mae_sql())
def mae_summary(spark, d):
    return text(_mae(spark, d).summary())


@query(_mae_sql("hour"))
def mae_by_hour(spark, d):
    return text(_mae(spark, d).by_hour())


@query(_mae_sql("horizon"))
def mae_by_horizon(spark, d):
    return text(_mae(spark, d).by_horizon())


@query(_mae_sql("hour", "horizon"))
def mae_by_hour_horizon(spark, d):
    return text(_mae(spark, d).by_hour_horizon())


@query(_mae_sql("year"))
def mae_by_year(spark, d):
    return text(_mae(spark, d).by_year())


@query(_mae_sql("year", "horizon"))
def mae_by_year_horizon(spark, d):
    return text(_mae(spark, d).by_year_horizon())


@query(f"""WITH {NAIVE}, s AS (SELECT model, hour, horizon, year, grouping(model, hour, horizon, year) AS g, {r4(MAE)} AS "MAE" FROM naive
GROUP BY GROUPING SETS ((model), (model, hour), (model, horizon), (model, hour, horizon), (model, year), (model, year, horizon)))
SELECT model, coalesce(hour, -1) AS hour, coalesce(horizon, -1) AS horizon, coalesce(year, -1) AS year, "MAE", CASE g WHEN 7 THEN 'model' WHEN 3 THEN 'model_hour' WHEN 5 THEN 'model_horizon' WHEN 1 THEN 'model_hour_horizon' WHEN 6 THEN 'model_year' WHEN 4 THEN 'model_year_horizon' END AS grouping FROM s""")
def mae_grouping_sets(spark, d):
    return text(_mae(spark, d).everything()).fillna(-1, ["hour", "horizon", "year"])


@query(f"""WITH {NAIVE}, x AS (SELECT horizon, CAST(prediction AS DOUBLE) AS p, CAST(actual AS DOUBLE) AS a FROM naive)
SELECT 'naive' AS model, horizon, {r4('sqrt(avg((p - a) * (p - a)))')} AS "RMSE", {r4('100 * avg(abs((a - p) / nullif(a, 0)))')} AS "MAPE", {r4('100 * avg(2 * abs(p - a) / nullif(abs(p) + abs(a), 0))')} AS "sMAPE" FROM x GROUP BY horizon""")
def rmse_mape_smape(spark, d):
    rows = naive(spark, d).withColumns({c: F.col(c).cast("double") for c in ("prediction", "actual")})
    return text(report.EvaluationReport(rows, [report.RMSEEvaluator(), report.MAPEEvaluator(), report.SMAPEEvaluator()]).by_horizon())


@query(f"WITH {NAIVE} SELECT model, " + ", ".join(f"{r4(MAE.replace('sum(abs(prediction - actual))', f'sum(abs(prediction - actual)) FILTER (hour = {h})').replace('count(prediction - actual)', f'count(prediction - actual) FILTER (hour = {h})'))} AS hour_{h}" for h in range(24)) + " FROM naive GROUP BY model")
def pivot_hour(spark, d):
    return text(_mae(spark, d).pivot("hour", "MAE", range(24)))


@query(f"WITH {NAIVE}, m AS ({_mae_sql('hour', 'horizon').split(NAIVE)[1]}) SELECT model, hour, " + ", ".join(f'max("MAE") FILTER (horizon = {h}) AS "{h}"' for h in (1, 2, 3)) + " FROM m GROUP BY model, hour")
def matrix_hour_horizon(spark, d):
    return text(_mae(spark, d).matrix("hour", "horizon", "MAE", (1, 2, 3)))


@query(f"""WITH {NAIVE} SELECT strftime(run_date, '%Y-%m-%d') AS run_date, strftime(target_date, '%Y-%m-%d') AS target_date, hour, horizon, day_in_test,
  CAST(actual AS VARCHAR) AS actual, CAST(prediction AS VARCHAR) AS prediction_naive, CAST(prediction * 2 AS VARCHAR) AS prediction_double FROM naive""")
def details_wide(spark, d):
    rows = naive(spark, d)
    both = rows.unionByName(rows.withColumn("model", F.lit("double")).withColumn("prediction", (F.col("prediction") * 2).cast("decimal(18,2)")))
    wide = report.EvaluationReport(both).details(["naive", "double"])
    return wide.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("run_date", "target_date")], "hour", "horizon", "day_in_test", *[F.col(c).cast("string").alias(c) for c in ("actual", "prediction_naive", "prediction_double")])


TW, TEST = 14, ("2024-01-20", "2024-01-24")


def _backtest(spark, d) -> DataFrame:
    panel = ResampleTransformer("1h", "linear")(hourly(spark, d))
    frame = LagTransformer("price", 1, "1D")(panel)
    return models.OLSModel(["price_d-1"], TW, "ols").run(frame, *TEST, "price", 1)


BACKTEST = f"""{PANEL}, e AS (SELECT date_trunc('day', min(ts)) AS m, min(ts) AS a, max(ts) AS b FROM panel), g AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM e),
j AS (SELECT g.ts, epoch(g.ts) AS s, price FROM g LEFT JOIN panel USING (ts)),
i AS (SELECT ts, s, price, last_value(price IGNORE NULLS) OVER b AS p0, first_value(price IGNORE NULLS) OVER f AS p1, last_value(CASE WHEN price IS NOT NULL THEN s END IGNORE NULLS) OVER b AS s0, first_value(CASE WHEN price IS NOT NULL THEN s END IGNORE NULLS) OVER f AS s1 FROM j WINDOW b AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT ts, round_even(coalesce(price, p0 + (p1 - p0) * (s - s0) / (s1 - s0)) * 1000, 0) / 1000 AS price FROM i),
rows_ AS (SELECT f.ts, l.price AS x, n.price AS y FROM filled f LEFT JOIN filled l ON l.ts = f.ts - INTERVAL 1 DAY LEFT JOIN filled n ON n.ts = f.ts + INTERVAL 1 DAY),
fits AS (SELECT t.ts, any_value(t.x) AS x, any_value(t.y) AS actual, regr_intercept(r.y, r.x) AS b0, regr_slope(r.y, r.x) AS b1 FROM rows_ t JOIN rows_ r ON hour(r.ts) = hour(t.ts) AND r.ts BETWEEN t.ts - INTERVAL {TW + 1} DAY AND t.ts - INTERVAL 2 DAY
WHERE CAST(t.ts AS DATE) BETWEEN DATE '{TEST[0]}' AND DATE '{TEST[1]}' GROUP BY t.ts)"""


@query(f"""WITH {BACKTEST} SELECT strftime(ts, '%Y-%m-%d') AS run_date, CAST(hour(ts) AS INT) AS hour, round(b0 + b1 * x, 2) AS prediction, round(actual, 2) AS actual FROM fits""")
def rolling_ols_univariate(spark, d):
    return _backtest(spark, d).select(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "hour", F.round("prediction", 2).alias("prediction"), F.round("actual", 2).alias("actual"))


@query(f"WITH {BACKTEST} SELECT 'ols' AS model, CAST(1 AS INT) AS horizon, round(avg(abs(b0 + b1 * x - actual)), 3) AS \"MAE\" FROM fits")
def backtest_mae_by_horizon(spark, d):
    found = report.EvaluationReport(_backtest(spark, d)).by_horizon()
    return found.select("model", "horizon", F.round("MAE", 3).alias("MAE"))


@query()
def rolling_lasso_cv(spark, d):
    frame = LagTransformer("price", [1, 2, 7], "1D")(ResampleTransformer("1h", "linear")(hourly(spark, d)))
    model = models.LassoCVModel(["price_d-1", "price_d-2", "load"], TW, "lasso")
    return model.run(frame, *TEST, "price", 2).drop("coefficients")


@query(f"""WITH {PANEL}, w AS (SELECT ts, price, avg(price) OVER x AS m, stddev_samp(price) OVER x AS s, count(*) OVER x AS n, bool_and(load IN (0, 1)) OVER x AS binary_load FROM panel WINDOW x AS (PARTITION BY hour(ts) ORDER BY ts ROWS BETWEEN {TW} PRECEDING AND 1 PRECEDING))
SELECT {T.format('ts')} AS ts, {r4('m')} AS mean, {r4('s')} AS std, n AS window_rows, CAST(binary_load AS INT) AS binary_load FROM w WHERE n = {TW}""")
def scaler_stats(spark, d):
    found = models.window_scales(hourly(spark, d), TW, ["price", "load"])
    price = [F.max(F.when(F.col("column") == "price", F.col(c))).alias(c) for c in ("mean", "std")]
    wide = found.groupBy("ts").agg(*price, F.max(F.when(F.col("column") == "load", F.col("binary"))).cast("int").alias("binary_load"))
    return text(wide.select("ts", "mean", "std", F.lit(TW).cast("long").alias("window_rows"), "binary_load"))


@query(f"""WITH {PANEL}, x AS (SELECT hour(ts) AS h, row_number() OVER (PARTITION BY hour(ts) ORDER BY ts) - 1 AS day FROM panel)
SELECT CAST(t.h AS INT) AS hour, CAST(z AS INT) AS horizon, t.day AS day, min(r.day) AS first_train, max(r.day) AS last_train, count(*) AS train_rows
FROM x t JOIN range(1, 4) b(z) ON true JOIN x r ON r.h = t.h AND r.day BETWEEN t.day - {TW} - z AND t.day - z - 1 GROUP BY ALL""")
def training_slice_bounds(spark, d):
    return models.training_slices(hourly(spark, d), TW, 3)


@query(f"""WITH {PANEL}, n AS (SELECT ts, price, row_number() OVER (ORDER BY ts) AS x FROM panel) SELECT {T.format('a.ts')} AS ts, {r4('b.price')} AS "v_d+1", {r4('c.price')} AS "v_d+2" FROM n a LEFT JOIN n b ON b.x = a.x + 24 LEFT JOIN n c ON c.x = a.x + 48 WHERE b.price IS NOT NULL""")
def forecast_array_lookup(spark, d):
    # Documents of 28 days, each with the 7 days after it to look ahead into.
    day = F.floor(F.unix_timestamp("ts") / 86400)
    chunks = F.array_distinct(F.array(F.floor(day / 28), F.floor((day - 7) / 28)))
    rows = hourly(spark, d).select("ts", "price", F.explode(chunks).alias("chunk"))
    arrays = rows.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("ts", "price"))).alias("s"))
    arrays = arrays.select("chunk", F.transform("s", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.col("s.price").alias("v"))
    fields = F.struct("time", F.col("v").alias("v_previous_day1"), F.col("v").alias("v_previous_day2"))
    docs = arrays.select("chunk", F.to_json(F.struct(fields.alias("hourly"))).alias("doc"))
    return text(weather.merge_chunks(weather.parse_forecast(docs, ["v"], 2)))


def _documents(spark, d) -> DataFrame:
    """A market document for each day and production type, made from events."""
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, d, "events").groupBy(F.date_trunc("day", ts).alias("day"), F.hour(ts).alias("h"), "event_type").agg(F.count("*").alias("n"))
    point = F.concat(F.lit("<Point><position>"), F.col("h") + 1, F.lit("</position><quantity>"), F.col("n"), F.lit("</quantity></Point>"))
    days = rows.groupBy("day", "event_type").agg(F.concat_ws("", F.array_sort(F.collect_list(point))).alias("points"))
    stamp = F.date_format("day", "yyyy-MM-dd'T'HH:mm'Z'")
    whole = F.concat(F.lit("<M><TimeSeries><businessType>A01</businessType><MktPSRType><psrType>"), "event_type", F.lit("</psrType></MktPSRType><Period><timeInterval><start>"), stamp, F.lit("</start></timeInterval><resolution>PT60M</resolution>"), "points", F.lit("</Period></TimeSeries></M>"))
    return days.select(F.lit(0).alias("request"), whole.alias("doc"))


@query(f"SELECT {T.format('ts')} AS ts, psr, CAST(count(*) AS DOUBLE) AS value FROM (SELECT date_trunc('hour', ts) AS ts, event_type AS psr FROM events) GROUP BY ALL")
def xml_points_explode(spark, d):
    return text(market.parse_points(_documents(spark, d)).select("ts", "psr", "value"))


TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    f"WITH p AS (SELECT date_trunc('hour', ts) AS ts, event_type FROM events) SELECT {T.format('ts')} AS ts, "
    + ", ".join(f"CAST(nullif(count(*) FILTER (event_type = '{t}'), 0) AS DOUBLE) AS generation_{t}" for t in TYPES)
    + " FROM p GROUP BY ts"
)
def generation_pivot(spark, d):
    return text(market.generation_pivot(market.parse_points(_documents(spark, d)), TYPES))


@query(f"SELECT {T.format('ts')} AS ts, CAST(count(*) AS DOUBLE) AS value FROM (SELECT date_trunc('hour', ts) AS ts FROM events) GROUP BY ts")
def price_resolution_preference(spark, d):
    ts = F.col("ts").cast("timestamp")
    counts = table(spark, d, "events").groupBy(F.window(ts, "15 minutes").start.alias("ts")).agg(F.count("*").cast("double").alias("value")).withColumn("resolution", F.lit("PT15M"))
    whole = table(spark, d, "events").groupBy(F.date_trunc("hour", ts).alias("ts")).agg(F.count("*").cast("double").alias("value")).withColumn("resolution", F.lit("PT60M"))
    return text(market.prefer_hourly(counts.unionByName(whole)).select("ts", "value"))
