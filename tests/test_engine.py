import datetime as dt
import http.server
import json
import os
import threading
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.durations import lag_name, seconds
from tidemark.operators import align, exporters, models, report, validators
from tidemark.operators.transformers import LagTransformer, ResampleTransformer, TimezoneTransformer, local_time
from tidemark.plans.pipelines import DataPipeline, ModelPipeline, instant
from tidemark.sources import market, weather
from tidemark.sources.cache import RangeCache, config_key, uncovered
from tidemark.sources.calendar import COUNTRIES, CalendarSource
from tidemark.sources.csv import CsvSource, pattern_of
from tidemark.sources.holidays import HOLIDAYS, easter, holidays, orthodox_easter


def frame(spark, start, values, hours=1, name="value"):
    t = dt.datetime.fromisoformat(start)
    return spark.createDataFrame([(t + dt.timedelta(hours=hours * i), None if v is None else float(v)) for i, v in enumerate(values)], f"ts timestamp, {name} double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("ts").collect()]


def test_durations():
    assert (seconds("1h"), seconds("15min"), seconds("D"), seconds("2 days")) == (3600, 900, 86400, 172800)
    assert [lag_name("p", lag, 3600) for lag in (24, 1, -1, 0)] == ["p_d-1", "p_h-1", "p_h+1", "p_d-0"] and lag_name("p", 1, 90) == "p_s-90"
    for bad in ("x", "0h", ""):
        with pytest.raises(ValueError):
            seconds(bad)


def test_resample(spark):
    daily = frame(spark, "2024-01-01", [10, 20, 30], 24)
    got = values(ResampleTransformer()(daily))
    assert len(got) == 49 and got[12] == 15.0 and got[36] == 25.0
    gap = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), 1.0), (dt.datetime(2024, 1, 1, 4), None), (dt.datetime(2024, 1, 1, 5), 5.0), (dt.datetime(2024, 1, 1, 6), None)], "ts timestamp, value double")
    assert values(ResampleTransformer()(gap)) == [1.0, 2.0, 3.0, 4.0, 5.0, 5.0]
    assert values(ResampleTransformer(method="ffill")(gap)) == [1.0, 1.0, 1.0, 1.0, 5.0, 5.0]
    assert values(ResampleTransformer(method="bfill")(gap)) == [1.0, 5.0, 5.0, 5.0, 5.0, None]
    assert values(ResampleTransformer("2h")(frame(spark, "2024-01-01", [1, 2, 3, 4, 5]))) == [1.0, 3.0, 5.0]
    assert ResampleTransformer()(gap.limit(0)).count() == 0
    two = frame(spark, "2024-01-01", [1, 2], 12).withColumn("other", F.col("value"))
    assert values(ResampleTransformer(columns="value")(two), "other").count(None) == 11


def test_zone_and_lag(spark):
    df = TimezoneTransformer("Europe/Warsaw")(frame(spark, "2024-03-30T22:00", range(4)))
    assert [r[0] for r in df.orderBy("ts").select(F.hour(local_time(df))).collect()] == [23, 0, 1, 3]
    with pytest.raises(ValueError):
        TimezoneTransformer("Mars/Base")
    wide = LagTransformer("value", [1, -1, 24], "1h")(frame(spark, "2024-01-01", range(48)))
    assert values(wide, "value_h-1")[:3] == [None, 0, 1] and values(wide, "value_h+1")[-2:] == [47, None] and values(wide, "value_d-1").count(None) == 24
    with pytest.raises(ValueError):
        LagTransformer([])


def test_validators(spark):
    nulls = spark.createDataFrame([(1.0, 4.0), (None, 5.0), (3.0, None)], "a double, b double")
    got = validators.NullCheckValidator(["a", "z"]).validate(nulls)
    assert not got and got.info["null_counts"] == {"a": 1, "b": 1} and got.info["missing_columns"] == ["z"]
    assert validators.NullCheckValidator().validate(nulls.limit(0)).warnings
    gap = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in (0, 1, 5)] + [(dt.datetime(2024, 1, 3),)], "ts timestamp")
    assert validators.ContinuityValidator().validate(gap).info["gap_count"] == 2
    row = validators.describe(spark.createDataFrame([(x,) for x in (1.0, 2.0, None, None, 5.0)], "a double")).first()
    assert row["null_pct"] == 40.0 and row["q50"] == 2.0 and row["count"] == 3


def test_sources(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("datetime,price,load\n2024-01-01 02:00,2,20\n2024-01-01 00:00,0,1\n2024-01-01 01:00,1,10\n2024-01-02 00:00,9,9\n")
    got = CsvSource(str(path), prefix="m", columns=["price"]).fetch(spark, "2024-01-01", "2024-01-01 02:00")
    assert got.columns == ["ts", "m_price"] and values(got, "m_price") == [0, 1, 2]
    assert pattern_of("%d/%m/%Y %H:%M") == "dd/MM/yyyy HH:mm"
    with pytest.raises(ValueError):
        CsvSource(str(path)).fetch(spark, "2024-01-02", "2024-01-01")
    assert easter(2024) == dt.date(2024, 3, 31) and easter(2025) == dt.date(2025, 4, 20) and easter(2038) == dt.date(2038, 4, 25)
    cal = CalendarSource("PL", weekday="onehot", hour="onehot", month="name", daylight=True).fetch(spark, "2024-06-20", "2024-06-21")
    assert cal.count() == 25 and len([c for c in cal.columns if c.startswith("is_") and not c[3:].isdigit()]) == 8
    row = cal.orderBy("ts").first()
    assert row["month_name"] == "june" and abs(row["daylight_hours"] - 16.75) < 0.15
    body = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "t_previous_day1": [float(i) for i in range(26)]}})
    calls = []

    def transport(query):
        calls.append(query)
        return json.dumps({"error": True, "reason": "Minutely limit"}) if len(calls) == 1 else body

    naps: list = []
    source = weather.OpenMeteoSource(52, 21, 1, columns=["t"], transport=transport, clock=lambda: dt.datetime(2024, 2, 1), sleep=naps.append)
    assert values(source.fetch(spark, "2024-01-01", "2024-01-02"), "t_d+1") == [24.0, 25.0] and naps == [60]
    assert len(source.chunks(dt.date(2024, 1, 1), dt.date(2024, 12, 31))) == 5
    xml = "<D><TimeSeries><Period><timeInterval><start>2024-01-01T00:00Z</start></timeInterval><resolution>PT60M</resolution><Point><position>1</position><price.amount>1,000.5</price.amount></Point><Point><position>3</position><price.amount>7</price.amount></Point></Period></TimeSeries></D>"
    prices = market.EntsoeSource("pl", "k", ["price"], transport=lambda q: xml).fetch(spark, "2024-01-01", "2024-01-02")
    assert values(prices, "price") == [1000.5, 7.0]


def test_align_and_ranges(spark, tmp_path):
    a, b = frame(spark, "2024-01-01", range(5), name="a"), frame(spark, "2024-01-01T02:00", range(3), name="b")
    assert values(align.outer_align([a, b]), "b") == [None, None, 0, 1, 2]
    with pytest.raises(ValueError):
        align.outer_align([a, a])
    assert uncovered([("01", "03"), ("15", "17")], "01", "20") == [("03", "15"), ("17", "20")]
    fetched = []

    class Fake:
        def fetch(self, spark, start, end):
            fetched.append((start, end))
            return frame(spark, start, range(3))

    cache = RangeCache(spark, str(tmp_path), {"k": 1})
    for _ in range(2):
        assert values(cache.fetch(Fake(), "2024-01-01 00:00:00", "2024-01-01 02:00:00")) == [0, 1, 2]
    assert len(fetched) == 1 and len(config_key({"a": 1})) == 16


def panel(spark, days=60):
    rng, t = np.random.default_rng(42), dt.datetime(2023, 11, 1)
    n = days * 24
    rows = list(zip([t + dt.timedelta(hours=i) for i in range(n)], rng.normal(50, 10, n).tolist(), rng.normal(5000, 1000, n).tolist(), [float(i // 24 % 7 == 0) for i in range(n)]))
    return spark.createDataFrame(rows, "ts timestamp, price double, load double, monday double"), pd.DataFrame(rows, columns=["ts", "price", "load", "monday"])


def test_rolling_ols_matches_a_plain_loop(spark, tmp_path):
    df, pdf = panel(spark)
    model = models.OLSModel(["load", "monday"], 20, "ols")
    got = model.run(df, "2023-12-01", "2023-12-03", "price", 2).toPandas().sort_values(["hour", "horizon", "day_in_test"]).reset_index(drop=True)
    assert len(got) == 3 * 24 * 2 and got["error"].isna().all()
    for r in got.sample(12, random_state=0).itertuples():
        h = pdf[pdf.ts.dt.hour == r.hour].reset_index(drop=True)
        d = 30 + r.day_in_test
        train = range(d - 20 - r.horizon, d - r.horizon)
        x, y = h.loc[train, ["load", "monday"]].to_numpy(), h.loc[[k + r.horizon for k in train], "price"].to_numpy()
        m, s = np.array([x[:, 0].mean(), 0]), np.array([x[:, 0].std(ddof=1), 1])
        w = np.linalg.lstsq((x - m) / s, (y - y.mean()) / y.std(ddof=1), rcond=None)[0]
        want = (h.loc[d, ["load", "monday"]].to_numpy(float) - m) / s @ w * y.std(ddof=1) + y.mean()
        assert r.prediction == pytest.approx(want) and r.actual == pytest.approx(h.loc[d + r.horizon, "price"])
    pipe = ModelPipeline().add_model(model).add_evaluator(report.MAEEvaluator()).add_evaluator(report.RMSEEvaluator())
    first = pipe.run(df, "2023-12-01", "2023-12-02", "price", 1, str(tmp_path / "r"))
    assert first.predictions.count() == 48 and pipe.run(df, "2023-12-01", "2023-12-02", "price", 1, str(tmp_path / "r")).predictions.count() == 48
    assert "MAE" in exporters.TerminalExporter().render(first) and first.everything().count() == 1 + 24 + 1 + 24 + 1 + 1
    exporters.ExcelExporter(str(tmp_path / "o.xlsx")).export(first)
    assert len([n for n in zipfile.ZipFile(tmp_path / "o.xlsx").namelist() if "sheet" in n]) == 12
    with pytest.raises(ValueError):
        models.OLSModel(["nope_{horizon}"], 20).run(df, "2023-12-01", "2023-12-02")


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6))
    y = x @ np.array([2, 0, 0, -1, 0, 0]) + rng.normal(size=120) * 0.1
    model = models.LassoCVModel([], 10)
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha, w in zip((0.5, 0.05), model.path(xc, yc, [0.5, 0.05])):
        pull = xc.T @ (yc - xc @ w) / len(y)
        assert np.all(np.abs(pull) <= alpha + 1e-3) and np.allclose(pull[w != 0], alpha * np.sign(w[w != 0]), atol=1e-3)
    value, w = model.fit_predict(x, y, x[0])
    assert value == pytest.approx(x[0] @ [2, 0, 0, -1, 0, 0], abs=0.2) and abs(w[0] - 2) < 0.1


def test_pipeline_round_trip(spark, tmp_path):
    pipe = DataPipeline(spark).add_source(CalendarSource("PL", hour="number")).add_transformer(LagTransformer("hour", 1)).add_validator(validators.ContinuityValidator())
    pipe.save(str(tmp_path / "p.yaml"))
    again = DataPipeline.load(spark, str(tmp_path / "p.yaml"))
    assert again.to_dict() == pipe.to_dict() and again.run("2024-01-01", "2024-01-02").count() == 25 and all(again.results)
    with pytest.raises(TypeError):
        pipe.add_source("x")
    with pytest.raises(ValueError):
        DataPipeline.from_dict(spark, {"sources": [{"class": "Nope"}]})
    with pytest.raises(ValueError):
        DataPipeline(spark).run("2024-01-01", "2024-01-02")
    assert instant("today", dt.datetime(2024, 5, 6, 7)) == "2024-05-06 00:00:00"


def test_continuity_lists_every_gap(spark):
    got = validators.ContinuityValidator().validate(spark.range(1202).selectExpr("timestamp_seconds(id * 7200) AS ts"))
    assert len(got.info["gaps"]) == got.info["gap_count"] == got.stats.count() == 1201


def test_csv_formats_and_missing_files(spark, tmp_path):
    path = tmp_path / "y.CSV"
    path.write_text("when;price\n2024-01-01 02:30;2\n2024-01-01 00:15;1\n")
    source = CsvSource(str(path), "when", datetime_format="%Y-%m-%d %H:%M", separator=";")
    assert [str(r["ts"]) for r in source.fetch(spark, "2024-01-01", "2024-01-02").orderBy("ts").collect()] == ["2024-01-01 00:15:00", "2024-01-01 02:30:00"]
    path.write_text("when;price\n31/12/2023 02;2\n")
    assert CsvSource(str(path), "when", datetime_format="%d/%m/%Y %H", separator=";").fetch(spark, "2023-12-01", "2024-01-02").count() == 1
    with pytest.raises(FileNotFoundError):
        CsvSource(str(tmp_path / "none.csv"))
    (tmp_path / "z.txt").write_text("datetime\n")
    with pytest.raises(ValueError):
        CsvSource(str(tmp_path / "z.txt"))
    with pytest.raises(ValueError):
        CsvSource(str(path), "nope", separator=";").fetch(spark, "2023-12-01", "2024-01-02")


def test_holidays_of_all_countries(spark):
    assert set(HOLIDAYS) == set(COUNTRIES) and len(COUNTRIES) == 22
    assert [orthodox_easter(y) for y in (2016, 2023, 2024, 2025)] == [dt.date(2016, 5, 1), dt.date(2023, 4, 16), dt.date(2024, 5, 5), dt.date(2025, 4, 20)]
    count = {c: len(holidays(c, range(2024, 2025))) for c in HOLIDAYS}
    assert all(n >= 6 for c, n in count.items() if c != "CH") and count["CH"] == 4 and count["DE"] == 9 and count["FR"] == 11 and count["PL"] == 13
    has = lambda c, *day: dt.date(*day) in holidays(c, range(day[0], day[0] + 1))
    assert has("GR", 2024, 3, 18) and has("BG", 2024, 5, 3) and has("RO", 2024, 6, 24) and has("IE", 2024, 2, 5) and has("IE", 2024, 10, 28)
    assert has("GB", 2022, 1, 3) and has("GB", 2022, 12, 27) and has("GB", 2024, 5, 6) and not has("GB", 2020, 5, 4) and has("SE", 2024, 6, 22) and has("FI", 2024, 11, 2)
    assert has("DK", 2023, 5, 5) and not has("DK", 2024, 4, 26) and has("NL", 2025, 4, 26) and not has("NL", 2025, 4, 27) and has("PL", 2025, 12, 24) and not has("PL", 2024, 12, 24)
    names = CalendarSource("ie", holidays="name", weekday="name").fetch(spark, "2024-03-17", "2024-03-17 02:00:00")
    assert {tuple(r)[1:] for r in names.collect()} == {("Saint Patrick's Day", "sunday")}
    with pytest.raises(ValueError):
        holidays("XX", range(2024, 2025))


def test_market_tables_keys_and_transport(spark, monkeypatch):
    assert len(market.AREAS) >= 97 and {"DE", "GB", "NO_1", "SE_3", "IE_SEM", "IT_NORD", "HR", "SI", "BG"} <= set(market.AREAS)
    assert [r[0] for r in spark.createDataFrame([("B11",)], "c string").select(market.psr_name(F.col("c"))).collect()] == ["hydro_run-of-river_and_pondage"]
    for bad in (("zz", "k", ["load"]), ("PL", "", ["load"]), ("PL", "k", []), ("PL", "k", ["gas"])):
        with pytest.raises(ValueError):
            market.EntsoeSource(*bad)
    monkeypatch.setenv("ENTSOE_API_KEY", "secret")
    assert market.EntsoeSource("pl", "${ENTSOE_API_KEY}").api_key == "secret"
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            status = 400 if "none" in self.path else 500 if "broken" in self.path else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(b"No matching data found" if status == 400 else b'{"hourly": {}}')

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        for module in (market, weather):
            monkeypatch.setattr(module, "API_URL", f"http://127.0.0.1:{server.server_port}/api")
        assert market.http_transport({"area": "none"}) is None and market.http_transport({"area": "x"}) == '{"hourly": {}}'
        with pytest.raises(OSError):
            market.http_transport({"area": "broken"})
        assert weather.http_transport({"hourly": ["a", "b"]}) == '{"hourly": {}}' and "hourly=a%2Cb" in seen[-1] and "timezone=GMT" in seen[-1]
    finally:
        server.shutdown()


def test_overlapping_weather_chunks_are_merged_in_order(spark):
    assert len(weather.VARIABLES) == 14 and {"showers", "weather_code", "pressure_msl"} <= set(weather.VARIABLES)
    docs = [(1, {"time": ["2024-01-01T00:00"], "a_previous_day1": [9.0] * 25}), (0, {"time": ["2024-01-01T00:00"], "a_previous_day1": [1.0] * 25, "b_previous_day1": [None] * 25}), (2, {"time": ["2024-01-01T00:00"], "b_previous_day1": [5.0] * 25})]
    frame = spark.createDataFrame([(i, json.dumps({"hourly": h})) for i, h in docs], "chunk int, doc string").repartition(3)
    got = weather.merge_chunks(weather.parse_forecast(frame, ["a", "b"], 1)).collect()
    assert [(r["a_d+1"], r["b_d+1"]) for r in got] == [(1.0, 5.0)]


def test_duplicate_instants_fail(spark):
    a = frame(spark, "2024-01-01", range(3), name="a")
    with pytest.raises(Exception, match="Duplicate instant"):
        align.outer_align([a.union(a.limit(1)), frame(spark, "2024-01-01", range(3), name="b")]).collect()
    with pytest.raises(Exception, match="Duplicate instant"):
        ResampleTransformer()(a.union(a.limit(1))).collect()
    with pytest.raises(ValueError):
        ResampleTransformer(columns=["z"])(a)
    assert ResampleTransformer("1min")(frame(spark, "2024-01-01", [1, 2], 24 * 4)).count() == 4 * 1440 + 1


def test_a_failing_task_leaves_the_others(spark):
    class Fussy(models.OLSModel):
        def fit_predict(self, x, y, ahead):
            if len(y) % 2:
                raise KeyError("odd")
            return super().fit_predict(x, y, ahead)

    df, _ = panel(spark)
    got = Fussy(["load"], 29).run(df, "2023-12-01", "2023-12-02", "price", 1).collect()
    assert {(r["day_in_test"], r["error"]) for r in got} == {(0, "KeyError: 'odd'"), (1, "KeyError: 'odd'")}
    assert all(r["prediction"] is None for r in got) and len(got) == 48


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_stored_results_belong_to_their_settings(spark, tmp_path, kind):
    df, _ = panel(spark)

    def run(predictors, window, start="2023-12-05", end="2023-12-06", horizon=2):
        found = ModelPipeline().add_model(models.OLSModel(predictors, window, "ols")).run(df, start, end, "price", horizon, str(tmp_path), kind)
        return {(str(r["run_date"]), r["hour"], r["horizon"]): (r["prediction"], r["day_in_test"]) for r in found.predictions.collect()}

    first = run(["load"], 10)
    assert len(first) == 2 * 24 * 2 and run(["load"], 10) == first
    assert run(["load", "monday"], 10) != first and run(["load"], 12) != first
    assert {k: v[0] for k, v in run(["load"], 10, horizon=1).items()} == {k: v[0] for k, v in first.items() if k[2] == 1}
    later = run(["load"], 10, "2023-12-06", "2023-12-07")
    assert all(later[k][0] == v[0] and later[k][1] == v[1] - 1 for k, v in first.items() if k[0] == "2023-12-06")
    assert len(os.listdir(tmp_path)) == 3


def test_predictions_are_fitted_once(spark):
    df, _ = panel(spark)
    fits = spark.sparkContext.accumulator(0)

    class Counted(models.OLSModel):
        def fit_predict(self, x, y, ahead):
            fits.add(1)
            return super().fit_predict(x, y, ahead)

    found = ModelPipeline().add_model(Counted(["load"], 10)).run(df, "2023-12-05", "2023-12-05", "price", 1)
    exporters.TerminalExporter(exporters.VIEWS).render(found)
    assert found.by_hour().count() == 24 and fits.value == 24


def test_workbook_layout(spark, tmp_path):
    rows = [(m, dt.date(2024, 1, 1), dt.date(2024, 1, 1 + h), hour, h, 0, float(hour + h + i), float(hour)) for i, m in enumerate(("one", "two")) for hour in range(3) for h in (1, 2)]
    schema = "model string, run_date date, target_date date, hour int, horizon int, day_in_test int, prediction double, actual double"
    found = report.EvaluationReport(spark.createDataFrame(rows, schema), [report.MAEEvaluator()])
    sheets = {s.name: s for s in exporters.ExcelExporter("x").pages(found)}
    assert list(sheets) == ["Summary", "hour_MAE", "horizon_MAE", "HourHorizon_MAE", "year_MAE", "YearHorizon_MAE", "Details"]
    assert sheets["Summary"].scales == ["B2:B3"] and sheets["hour_MAE"].scales == ["B2:D3"] and sheets["horizon_MAE"].scales == ["B2:B3", "C2:C3"]
    both = sheets["HourHorizon_MAE"]
    assert (both.cells[1, 1], both.cells[1, 5], both.cells[2, 2], both.cells[2, 7], both.cells[3, 5]) == ("one", "two", "horizon_1", "horizon_2", "hour_0")
    assert both.cells[4, 3] == 2.0 and both.cells[4, 7] == 3.0 and both.scales == ["B3:C5", "F3:G5"]
    details = sheets["Details"].cells
    assert [details[1, c] for c in range(1, 9)] == ["run_date", "target_date", "hour", "horizon", "day_in_test", "actual", "prediction_one", "prediction_two"]
    assert [exporters.letters(n) for n in (1, 26, 27, 52, 53, 702, 703)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    exporters.ExcelExporter(str(tmp_path / "w.xlsx")).export(found)
    assert b"YearHorizon_MAE" in zipfile.ZipFile(tmp_path / "w.xlsx").read("xl/workbook.xml")


def test_source_data_kept_as_csv_and_yaml_with_transport(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("ENTSOE_API_KEY", "secret")
    xml = "<D><TimeSeries><Period><timeInterval><start>2024-01-01T00:00Z</start></timeInterval><resolution>PT60M</resolution><Point><position>1</position><price.amount>5.5</price.amount></Point></Period></TimeSeries></D>"
    calls = []
    pipe = DataPipeline(spark).add_source(market.EntsoeSource("PL", "secret", ["price"])).add_source(CalendarSource("PL", weekday="name"))
    pipe.save(str(tmp_path / "p.yaml"))
    assert "secret" not in (tmp_path / "p.yaml").read_text()
    again = DataPipeline.load(spark, str(tmp_path / "p.yaml"), {"EntsoeSource": lambda q: calls.append(q) or xml})
    assert again.sources[0].api_key == "secret"
    for path in (str(tmp_path / "kept.csv"), str(tmp_path / "kept")):
        first = [tuple(r) for r in again.run("2024-01-01", "2024-01-02", cache=path).select("ts", "price", "weekday_name").orderBy("ts").collect()]
        n = len(calls)
        second = [tuple(r) for r in again.run("2024-01-01", "2024-01-02", cache=path).select("ts", "price", "weekday_name").orderBy("ts").collect()]
        assert first == second and len(first) == 25 and first[0][1] == 5.5 and len(calls) == n
    assert (tmp_path / "kept.csv").is_file() and (tmp_path / "kept").is_dir()


def test_verify_and_logger(capsys):
    import tidemark
    from tidemark.logs import get_logger

    found = tidemark.verify()
    assert {"tidemark", "Python", "GIL", "CPU cores", "PySpark"} <= set(found) and tidemark.__version__ in capsys.readouterr().out
    assert get_logger("tidemark.x") is get_logger("tidemark.x") and len(get_logger("tidemark.x").handlers) == 1


def test_library_views_agree_with_the_models(spark):
    df, pdf = panel(spark)
    seen = {(r["hour"], r["horizon"], r["day"]): (r["first_train"], r["last_train"], r["train_rows"]) for r in models.training_slices(df, 20, 2).collect()}
    assert seen[5, 2, 30] == (8, 27, 20) and seen[5, 1, 3] == (0, 1, 2) and (5, 1, 2) in seen and (5, 1, 1) not in seen
    leads = {r["ts"]: r["price_d+2"] for r in models.with_leads(df, "price", 2).collect()}
    assert leads[pdf.ts[7].to_pydatetime()] == pdf.price[55]
    scales = {(r["ts"], r["column"]): r for r in models.window_scales(df, 14, ["price", "monday"]).collect()}
    own = pdf[pdf.ts.dt.hour == 3].reset_index(drop=True)
    got = scales[own.ts[20].to_pydatetime(), "price"]
    assert got["mean"] == pytest.approx(own.price[6:20].mean()) and got["std"] == pytest.approx(own.price[6:20].std()) and not got["binary"]
    assert scales[own.ts[20].to_pydatetime(), "monday"]["binary"]


def test_streaming_panel_counts_late_rows_within_the_watermark(spark, tmp_path):
    from tidemark.streaming.panel import hourly_panel

    def put(name, *rows):
        spark.createDataFrame([(dt.datetime.fromisoformat(t), v) for t, v in rows], "ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    put("a", ("2024-01-01 00:10", 1.0), ("2024-01-01 01:10", 5.0))
    stream = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def run():
        query = hourly_panel(stream, "2 hours").writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    put("b", ("2024-01-01 00:50", 3.0), ("2024-01-01 03:30", 7.0))
    run()
    put("c", ("2024-01-01 00:55", 99.0), ("2024-01-01 09:00", 0.0))
    run()
    put("d", ("2024-01-01 12:00", 0.0))
    run()
    got = {str(r["ts"]): (r["price"], r["load"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01 00:00:00"] == (2.0, 2) and got["2024-01-01 01:00:00"] == (5.0, 1) and got["2024-01-01 03:00:00"] == (7.0, 1)


def test_lags_over_many_buckets_and_odd_instants(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(t + dt.timedelta(hours=i, milliseconds=250 * (i % 2)), float(i)) for i in range(24 * 20) if i % 5] + [(None, 7.0)]
    wide = LagTransformer("value", [1, 24, 170, -30], "1h")(spark.createDataFrame(rows, "ts timestamp, value double").repartition(7))
    known = {a: v for a, v in rows if a}
    got = wide.collect()
    assert len(got) == len(rows)
    for r in got:
        for lag, name in ((1, "value_h-1"), (24, "value_d-1"), (170, "value_h-170"), (-30, "value_h+30")):
            assert r[name] == (known.get(r["ts"] - dt.timedelta(hours=lag)) if r["ts"] else None)
    with pytest.raises(ValueError):
        LagTransformer("value", [])


def market_xml(points, psr=None, business="A01", step="PT60M", tag="quantity"):
    kind = f"<MktPSRType><psrType>{psr}</psrType></MktPSRType>" if psr else ""
    body = "".join(f"<Point><position>{i}</position><{tag}>{v}</{tag}></Point>" for i, v in points)
    return f"<TimeSeries><businessType>{business}</businessType>{kind}<Period><timeInterval><start>2024-01-01T00:00Z</start></timeInterval><resolution>{step}</resolution>{body}</Period></TimeSeries>"


def test_market_load_and_generation(spark):
    def transport(query):
        kind = query["documentType"], query["processType"]
        series = {
            ("A65", "A16"): market_xml([(1, 10), (2, 11)]),
            ("A65", "A01"): market_xml([(1, 20), (3, 22)]),
            ("A65", "A31"): market_xml([(1, 5)], business="A60") + market_xml([(1, 50)], business="A61"),
            ("A75", "A16"): market_xml([(1, 1), (2, 2)], "B11") + market_xml([(1, 7)], "B16") + market_xml([(2, 9)], "ZZ"),
            ("A69", "A01"): market_xml([(1, 3)], "B19"),
        }[kind]
        return f"<D>{series}</D>"

    got = market.EntsoeSource("PL", "k", ["load", "generation"], transport=transport).fetch(spark, "2024-01-01", "2024-01-02").orderBy("ts").collect()
    assert len(got) == 3
    first, second, third = (r.asDict() for r in got)
    assert (first["load_actual"], first["load_forecast"], first["load_forecast_daily_min"], first["load_forecast_daily_max"]) == (10, 20, 5, 50)
    assert (first["generation_hydro_run-of-river_and_pondage"], first["generation_solar"], first["generation_wind_onshore_forecast"], second["generation_zz"]) == (1, 7, 3, 9)
    assert third["load_forecast"] == 22 and third["load_actual"] is None
    with pytest.raises(Exception, match="Unknown resolution"):
        market.parse_points(spark.createDataFrame([(0, f"<D>{market_xml([(1, 1)], step='PT5M')}</D>")], "request int, doc string")).collect()
    fine = market.EntsoeSource("PL", "k", ["price"], transport=lambda q: f"<D>{market_xml([(i, i) for i in range(1, 5)], step='PT15M', tag='price.amount')}</D>")
    assert values(fine.fetch(spark, "2024-01-01", "2024-01-02"), "price") == [1, 2, 3, 4]


def test_predictors_reports_and_cache_info(spark, tmp_path):
    model = models.OLSModel(["load", "price_d-{horizon}", lambda h: f"temp_d+{h}"], 10)
    assert model.expand(3) == ["load", "price_d-3", "temp_d+3"] and model.name == "OLSModel"
    with pytest.raises(ValueError):
        models.OLSModel(["load"], 1)
    rows = [(m, dt.date(2024, 1, 1), dt.date(2024, 1, 2), h, 1, 0, float(h), 0.0) for m in ("b", "a") for h in (5, 3)]
    found = report.EvaluationReport(spark.createDataFrame(rows, "model string, run_date date, target_date date, hour int, horizon int, day_in_test int, prediction double, actual double"))
    assert [(r["model"], r["hour"]) for r in found.by_hour().collect()] == [("a", 3), ("a", 5), ("b", 3), ("b", 5)]
    assert [r["hour"] for r in found.details(["a", "b"]).collect()] == [3, 5] and found.details(["a"]).columns[0] == "run_date"
    assert [[r["model"] for r in t] for t in found.tables().values()] == [["a", "b"], ["a", "a", "b", "b"], ["a", "b"], ["a", "a", "b", "b"], ["a", "b"], ["a", "b"]]
    cache = RangeCache(spark, str(tmp_path / "c"), {"source": "x"})
    cache.write(frame(spark, "2024-01-01", range(3)), "2024-01-01 00:00:00", "2024-01-01 02:00:00")
    cache.write(frame(spark, "2024-01-01", []), "2024-01-02 00:00:00", "2024-01-02 02:00:00")
    info = RangeCache(spark, str(tmp_path / "c"), {"source": "x"}).info()
    assert [r["filename"] is None for r in info["cached_ranges"]] == [False, True] and info["source_config"] == {"source": "x"}
    assert cache.missing("2024-01-01 01:00:00", "2024-01-02 01:00:00") == [("2024-01-01 02:00:00", "2024-01-02 00:00:00")]


@pytest.mark.parametrize("country, day, rise, fall", [("PL", "2024-06-21", 4.23, 21.02), ("GB", "2024-12-21", 8.05, 15.88), ("ES", "2024-03-20", 7.38, 19.52)])
def test_sunrise_and_sunset_are_those_of_almanacs(spark, country, day, rise, fall):
    row = CalendarSource(country, holidays=False, weekday=False, daylight=True).fetch(spark, f"{day} 10:00:00", f"{day} 11:00:00").first()
    assert row["sunrise"] == pytest.approx(rise, abs=0.1) and row["sunset"] == pytest.approx(fall, abs=0.1)
    assert row["daylight_hours"] == pytest.approx(row["sunset"] - row["sunrise"], abs=0.05)
