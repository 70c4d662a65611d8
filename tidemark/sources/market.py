"""Market documents in XML: load, generation and prices, fetched by an injected transport."""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import outer_align
from .base import DataSource
from .http import get

#: Production types by code.
PSR = {
    "B01": "Biomass",
    "B02": "Fossil Brown coal/Lignite",
    "B04": "Fossil Gas",
    "B05": "Fossil Hard coal",
    "B06": "Fossil Oil",
    "B09": "Geothermal",
    "B10": "Hydro Pumped Storage",
    "B11": "Hydro Run-of-river and pondage",
    "B12": "Hydro Water Reservoir",
    "B13": "Marine",
    "B14": "Nuclear",
    "B15": "Other renewable",
    "B16": "Solar",
    "B17": "Waste",
    "B18": "Wind Offshore",
    "B19": "Wind Onshore",
    "B20": "Other",
}
#: Areas by country or zone code.
AREAS = {
    "AL": "10YAL-KESH-----5",
    "AT": "10YAT-APG------L",
    "BA": "10YBA-JPCC-----D",
    "BE": "10YBE----------2",
    "BG": "10YCA-BULGARIA-R",
    "BY": "10Y1001A1001A51S",
    "CH": "10YCH-SWISSGRIDZ",
    "CWE": "10YDOM-REGION-1V",
    "CY": "10YCY-1001A0003J",
    "CZ": "10YCZ-CEPS-----N",
    "CZ_DE_SK": "10YDOM-CZ-DE-SKK",
    "DE": "10Y1001A1001A83F",
    "DE_50HZ": "10YDE-VE-------2",
    "DE_AMPRION": "10YDE-RWENET---I",
    "DE_AMP_LU": "10Y1001C--00002H",
    "DE_AT_LU": "10Y1001A1001A63L",
    "DE_LU": "10Y1001A1001A82H",
    "DE_TENNET": "10YDE-EON------1",
    "DE_TRANSNET": "10YDE-ENBW-----N",
    "DK": "10Y1001A1001A65H",
    "DK_1": "10YDK-1--------W",
    "DK_1_NO_1": "46Y000000000007M",
    "DK_2": "10YDK-2--------M",
    "DK_CA": "10Y1001A1001A796",
    "EE": "10Y1001A1001A39I",
    "ES": "10YES-REE------0",
    "FI": "10YFI-1--------U",
    "FR": "10YFR-RTE------C",
    "GB": "10YGB----------A",
    "GB_ELECLINK": "11Y0-0000-0265-K",
    "GB_IFA": "10Y1001C--00098F",
    "GB_IFA2": "17Y0000009369493",
    "GB_NIR": "10Y1001A1001A016",
    "GE": "10Y1001A1001B012",
    "GR": "10YGR-HTSO-----Y",
    "HR": "10YHR-HEP------M",
    "HU": "10YHU-MAVIR----U",
    "IE": "10YIE-1001A00010",
    "IE_SEM": "10Y1001A1001A59C",
    "IS": "IS",
    "IT": "10YIT-GRTN-----B",
    "IT_BRNN": "10Y1001A1001A699",
    "IT_CALA": "10Y1001C--00096J",
    "IT_CNOR": "10Y1001A1001A70O",
    "IT_CSUD": "10Y1001A1001A71M",
    "IT_FOGN": "10Y1001A1001A72K",
    "IT_GR": "10Y1001A1001A66F",
    "IT_MACRO_NORTH": "10Y1001A1001A84D",
    "IT_MACRO_SOUTH": "10Y1001A1001A85B",
    "IT_MALTA": "10Y1001A1001A877",
    "IT_NORD": "10Y1001A1001A73I",
    "IT_NORD_AT": "10Y1001A1001A80L",
    "IT_NORD_CH": "10Y1001A1001A68B",
    "IT_NORD_FR": "10Y1001A1001A81J",
    "IT_NORD_SI": "10Y1001A1001A67D",
    "IT_PRGP": "10Y1001A1001A76C",
    "IT_ROSN": "10Y1001A1001A77A",
    "IT_SACO_AC": "10Y1001A1001A885",
    "IT_SACO_DC": "10Y1001A1001A893",
    "IT_SARD": "10Y1001A1001A74G",
    "IT_SICI": "10Y1001A1001A75E",
    "IT_SUD": "10Y1001A1001A788",
    "LT": "10YLT-1001A0008Q",
    "LU": "10YLU-CEGEDEL-NQ",
    "LU_BZN": "10Y1001A1001A82H",
    "LV": "10YLV-1001A00074",
    "MD": "10Y1001A1001A990",
    "ME": "10YCS-CG-TSO---S",
    "MK": "10YMK-MEPSO----8",
    "MT": "10Y1001A1001A93C",
    "NL": "10YNL----------L",
    "NO": "10YNO-0--------C",
    "NO_1": "10YNO-1--------2",
    "NO_1A": "10Y1001A1001A64J",
    "NO_2": "10YNO-2--------T",
    "NO_2A": "10Y1001C--001219",
    "NO_2_NSL": "50Y0JVU59B4JWQCU",
    "NO_3": "10YNO-3--------J",
    "NO_4": "10YNO-4--------9",
    "NO_5": "10Y1001A1001A48H",
    "PL": "10YPL-AREA-----S",
    "PL_CZ": "10YDOM-1001A082L",
    "PT": "10YPT-REN------W",
    "RO": "10YRO-TEL------P",
    "RS": "10YCS-SERBIATSOV",
    "RU": "10Y1001A1001A49F",
    "RU_KGD": "10Y1001A1001A50U",
    "SE": "10YSE-1--------K",
    "SE_1": "10Y1001A1001A44P",
    "SE_2": "10Y1001A1001A45N",
    "SE_3": "10Y1001A1001A46L",
    "SE_4": "10Y1001A1001A47J",
    "SI": "10YSI-ELES-----O",
    "SK": "10YSK-SEPS-----K",
    "TR": "10YTR-TEIAS----W",
    "UA": "10Y1001C--00003F",
    "UA_BEI": "10YUA-WEPS-----0",
    "UA_DOBTPP": "10Y1001A1001A869",
    "UA_IPS": "10Y1001C--000182",
    "UK": "10Y1001A1001A92E",
    "XK": "10Y1001C--00100H",
}
#: Seconds of each resolution.
STEPS = {"PT60M": 3600, "PT30M": 1800, "PT15M": 900, "P1D": 86400, "P7D": 604800}
API_URL = "https://web-api.tp.entsoe.eu/api"
#: The service's answer where it has nothing for a request.
NOTHING = "No matching data found"


def http_transport(query: dict) -> str | None:
    """The document that the service gives for a query, or None where it has no data."""
    status, body = get(API_URL, query)
    if NOTHING in body:
        return None
    if status >= 400:
        raise OSError(f"The market service refused a request with status {status}")
    return body


def parse_points(docs: DataFrame, value: str = "quantity") -> DataFrame:
    """Rows of XML ``doc``: (ts, value, resolution, psr, business) of every point; unknown resolutions raise."""
    point = "struct<position:int,quantity:string,`price.amount`:string>"
    period = f"struct<timeInterval:struct<start:string,end:string>,resolution:string,Point:array<{point}>>"
    fields = f"TimeSeries array<struct<businessType:string,MktPSRType:struct<psrType:string>,Period:array<{period}>>>"
    series = docs.select("*", F.from_xml("doc", fields).alias("x")).select(*docs.columns, F.explode("x.TimeSeries").alias("s"))
    periods = series.select(*docs.columns, "s.businessType", F.col("s.MktPSRType.psrType").alias("psr"), F.explode("s.Period").alias("p"))
    points = periods.select(*docs.columns, "businessType", "psr", "p.resolution", F.col("p.timeInterval.start").alias("begin"), F.explode("p.Point").alias("q"))
    step = F.create_map(*[F.lit(x) for kv in STEPS.items() for x in kv])[F.col("resolution")]
    step = F.coalesce(step, F.raise_error(F.concat(F.lit("Unknown resolution: "), F.col("resolution"))).cast("int"))
    ts = F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.regexp_replace("begin", "Z$", ""), "yyyy-MM-dd'T'HH:mm[:ss]")) + (F.col("q.position") - 1) * step)
    number = F.regexp_replace(F.col("q")[value], ",", "").cast("double")
    return points.select(*[c for c in docs.columns if c != "doc"], ts.alias("ts"), number.alias("value"), "resolution", "psr", F.col("businessType").alias("business"))


def first_value(points: DataFrame, *keys: str) -> DataFrame:
    """One value for each instant (and key), the first request's."""
    order = "request" if "request" in points.columns else "ts"
    return points.groupBy("ts", *keys).agg(F.min_by("value", order).alias("value"))


def prefer_hourly(points: DataFrame) -> DataFrame:
    """Hourly points if there are any, else those of quarter hours; others are left out."""
    has = points.agg((F.count_if(F.col("resolution") == "PT60M") > 0).alias("hourly"))
    return points.crossJoin(F.broadcast(has)).filter(F.col("resolution") == F.when(F.col("hourly"), "PT60M").otherwise("PT15M")).drop("hourly")


def psr_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in PSR.items() for x in kv])
    return F.regexp_replace(F.lower(F.coalesce(names[code], code, F.lit("unknown"))), "[ /]", "_")


def generation_pivot(points: DataFrame, codes: Sequence[str] | None = None, suffix: str = "") -> DataFrame:
    """One column generation_{type} for each production type."""
    named = points.withColumn("column", F.concat(F.lit("generation_"), psr_name(F.col("psr")), F.lit(suffix)))
    values = None if codes is None else [f"generation_{PSR.get(c, c).lower().replace(' ', '_').replace('/', '_')}{suffix}" for c in codes]
    order = "request" if "request" in points.columns else "ts"
    return named.groupBy("ts").pivot("column", values).agg(F.min_by("value", order))


def resolved(value: str) -> str:
    """``${NAME}`` stands for that environment variable."""
    name = re.fullmatch(r"\$\{(\w+)\}", value or "")
    return os.environ.get(name[1], "") if name else value


class EntsoeSource(DataSource):
    """``transport`` gets a dict of query parameters and returns the XML, or None if there are no data."""

    def __init__(self, country_code: str, api_key: str, type: Sequence[str] = ("load",), transport: Callable[[dict], str | None] | None = None):
        if country_code.upper() not in AREAS:
            raise ValueError(f"Unknown area: {country_code}")
        if not resolved(api_key):
            raise ValueError("The API key is empty")
        if not type:
            raise ValueError("At least one type is needed")
        if unknown := sorted(set(type) - {"load", "generation", "price"}):
            raise ValueError(f"Unknown types: {unknown}")
        self.country_code, self.api_key, self.type, self.transport = country_code.upper(), resolved(api_key), list(type), transport or http_transport
        self.area_code = AREAS[self.country_code]

    def params(self) -> dict:
        return {"country_code": self.country_code, "api_key": "${ENTSOE_API_KEY}", "type": self.type}

    def get_cache_config(self) -> dict:
        return {"source_type": "entsoe", "area_code": self.area_code, "types": self.type}

    def _points(self, spark: SparkSession, start: dt.datetime, end: dt.datetime, value: str = "quantity", **query) -> DataFrame:
        docs, at = [], start
        while at < end:
            month = at.year * 12 + at.month - 1 + 3
            last = min(at.replace(year=month // 12, month=month % 12 + 1, day=min(at.day, 28)), end)
            body = self.transport({**query, "area": self.area_code, "securityToken": self.api_key, "periodStart": at.strftime("%Y%m%d%H00"), "periodEnd": last.strftime("%Y%m%d%H00")})
            if body and NOTHING not in body:
                docs.append((len(docs), body))
            at = last
        frame = spark.createDataFrame(docs, "request int, doc string")
        return parse_points(frame, value).filter(F.col("ts").between(F.to_timestamp(F.lit(str(start))), F.to_timestamp(F.lit(str(end)))))

    def fetch(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        a, b = (dt.datetime.fromisoformat(str(x)).replace(tzinfo=None) for x in (start, end))
        if b <= a:
            raise ValueError("end must be after start")
        frames: list[DataFrame] = []
        if "load" in self.type:
            for process, names in (("A16", {None: "load_actual"}), ("A01", {None: "load_forecast"}), ("A31", {"A60": "load_forecast_daily_min", "A61": "load_forecast_daily_max"})):
                points = self._points(spark, a, b, documentType="A65", processType=process)
                frames += [first_value(points if code is None else points.filter(F.col("business") == code)).withColumnRenamed("value", name) for code, name in names.items()]
        if "generation" in self.type:
            frames.append(generation_pivot(self._points(spark, a, b, documentType="A75", processType="A16")))
            frames.append(generation_pivot(self._points(spark, a, b, documentType="A69", processType="A01"), suffix="_forecast"))
        if "price" in self.type:
            frames.append(first_value(prefer_hourly(self._points(spark, a, b, "price.amount", documentType="A44"))).withColumnRenamed("value", "price"))
        return outer_align(frames)
