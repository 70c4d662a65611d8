"""Mixing sources to target weights by a time-varying curriculum.

Each source has a target (its share of all words) and a weight schedule over training time 0..1, piecewise linear. The
schedule's integral is the source's cumulative demand. A document's place in its source is the number of words before
it, in an order by hash; the inverse of the demand at that place is the time at which it is trained on. A source whose
target exceeds its size runs through its documents again, up to the cap. Documents are finally range-sorted by time.

Whole documents seldom add up to a target. So each source corrects what it takes by one document, taken once more or
once less: the one whose size is nearest to what is missing or too much, if that helps.

Running sums go over (source, block) with a bounded number of documents each, then over block totals, so a source with
a third of all rows is no hot spot. Sources are configuration: one row for each is brought to the driver, and more than
``MOST_SOURCES`` are refused.

Defined cases: a null text has size 0 and is never taken, nor is an empty one. A null source is a source of its own,
the last. Null and repeated ids are rows like others; ties of the hash are broken by id, then by row. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import words_of
from .shared import settle, text_or_empty

BLOCK_ROWS = 8192
CAP = 3
#: What bounds the tables of one row for each source that are sent to all tasks.
MOST_SOURCES = 100_000
#: Schedules dealt to sources in turn, as (time, relative weight) knots. Rising, even, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def targets(sizes: Sequence[float], weights: Sequence[float], cap: float = CAP) -> list[float]:
    """Shares of the total by weight; what exceeds ``cap`` times a source's size is reshared by weight, again and again."""
    total = float(sum(sizes))
    most = [cap * float(s) for s in sizes]
    out = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        rest = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        share = {i: rest * weights[i] / weight for i in free} if weight else dict.fromkeys(free, 0.0)
        over = {i for i in free if share[i] > most[i]}
        for i in free:
            out[i] = most[i] if i in over else share[i]
        if not over:
            break
        free -= over
    return out


def segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """(demand before, time, weight, slope) of each piece of a schedule, scaled so that its whole integral is 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    out, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((before, t0, w0 / area, (w1 - w0) / area / (t1 - t0)))
        before += (t1 - t0) * (w0 + w1) / 2 / area
    return out


def time_of(demand: Column, pieces: Column) -> Column:
    """The time at which a schedule's integral reaches ``demand`` (0..1): the root of a quadratic in its piece."""
    piece = F.element_at(F.filter(pieces, lambda p: p["before"] <= demand), -1)
    need, w, k = demand - piece["before"], piece["weight"], piece["slope"]
    return piece["time"] + F.when(F.abs(k) < 1e-12, need / w).otherwise(2 * need / (w + F.sqrt(F.greatest(w * w + 2 * k * need, F.lit(0.0)))))


def plan(
    docs: DataFrame, weight_of: Callable[[int, str | None], float] | None = None,
    schedule_of: Callable[[int, str | None], Sequence[tuple[float, float]]] | None = None, cap: float = CAP,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """For each row, what the mix does with it: (id, source, row, size, source_size, target, copies, taken, first_time,
    pieces, place). ``weight_of`` and ``schedule_of`` get a source's number (by code point, null last) and name."""
    weight_of = weight_of or (lambda i, _: i % 3 + 1.0)
    schedule_of = schedule_of or (lambda i, _: SCHEDULES[i % len(SCHEDULES)])
    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words_of(text_or_empty(text_col))).cast("long").alias("size"))
    sized = settle(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"More than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    target = targets([r["size"] for r in found], [weight_of(i, r["source"]) for i, r in enumerate(found)], cap)
    rows = [
        (i, r["source"], r["size"], target[i], max(1, -(-r["n"] // BLOCK_ROWS)), [tuple(map(float, s)) for s in segments(schedule_of(i, r["source"]))])
        for i, r in enumerate(found)
    ]
    kinds = spark.createDataFrame(rows, "sid int, name string, source_size long, target double, blocks int, pieces array<struct<before:double,time:double,weight:double,slope:double>>")
    h = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(2**31))
    keyed = sized.join(F.broadcast(kinds), F.col("source").eqNullSafe(F.col("name"))).withColumn("h", h)
    keyed = keyed.withColumn("block", F.floor(F.col("h") * F.col("blocks") / F.lit(2**31)))
    sums = keyed.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "block", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("sid", "block").orderBy("h", "id", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(sums, ["sid", "block"]).withColumn("place", F.col("ahead") + F.sum("size").over(inside) - F.col("size") / 2)
    copies = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.ceil((F.col("target") - F.col("place")) / F.col("source_size")))).otherwise(0).cast("long")
    rough = settle(placed.withColumn("copies", F.least(copies, F.lit(int(cap)))), "rough")
    out = _corrected(rough, int(cap))
    demand = F.least(F.col("place") / F.col("target"), F.lit(1.0))
    first = F.when(F.col("copies") > 0, time_of(demand, F.col("pieces")))
    return out.select("id", "source", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), first.alias("first_time"), "pieces", "place")


def _corrected(rough: DataFrame, cap: int) -> DataFrame:
    """The plan with one document of each source taken once more or once less where that brings it nearer to its target."""
    gaps = rough.groupBy("sid").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    near = rough.join(F.broadcast(gaps), "sid")
    step = F.signum("gap")
    left = F.abs(F.col("gap") - step * F.col("size"))
    may = (F.col("size") > 0) & (left < F.abs("gap")) & F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
    best = near.filter(may).groupBy("sid").agg(F.min(F.struct(left.alias("left"), "id", "row", step.cast("long").alias("step"))).alias("best"))
    best = best.select(F.col("best.row").alias("row"), F.col("best.step").alias("step"))  # a row for each source at most
    return rough.join(F.broadcast(best), "row", "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: all columns of ``docs``, each row as often as it is taken, range-sorted by training time.

    Rows that repeat an id take the copies planned for that id one each, so the mix's totals stay the same.
    """
    planned = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    demand = lambda j: F.least((F.col("place") + j * F.col("source_size")) / F.col("target"), F.lit(1.0))
    copies = F.transform(F.sequence(F.lit(0), F.col("copies").cast("int") - 1), lambda j: time_of(demand(j), F.col("pieces")))
    turns = settle(planned.filter("copies > 0").select("id", F.col("source").alias("from"), "size", "row", F.explode(copies).alias("at")), "turns")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    same = F.col("r")[id_col].eqNullSafe(F.col("id"))
    if turns.groupBy("id").agg(F.countDistinct("row").alias("n")).filter("n > 1").isEmpty() and planned.groupBy("id").count().filter("count > 1").isEmpty():
        joined = rows.join(turns, same)
    else:  # ids repeat: pair each of their rows with one planned row
        of = [F.col("r")[id_col], F.col("r")[source_col].cast("string"), F.size(words_of(F.coalesce(F.col("r")[text_col], F.lit(""))))]
        rows = rows.withColumn("serial", F.row_number().over(Window.partitionBy(*of).orderBy("r")))
        numbered = planned.select("row", F.row_number().over(Window.partitionBy("id", "source", "size").orderBy("row")).alias("number"))
        joined = rows.join(turns.join(numbered, "row"), same & of[1].eqNullSafe(F.col("from")) & (of[2] == F.col("size")) & (F.col("serial") == F.col("number")))
    return joined.repartitionByRange("at", "row").sortWithinPartitions("at", "row").select("r.*")
