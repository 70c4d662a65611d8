import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm import mixing

COLUMNS = "doc_id long, text string, source string, size long, at string"


def rows_of(n):
    return [(i, "w " * (i * 7 % 23), f"s{i % 4}" if i % 9 else None, 1, "x") for i in range(n)]


def test_targets_stop_at_the_cap():
    got = mixing.targets([100, 10, 50], [1, 2, 3])
    assert got[1] == 30 and sum(got) == pytest.approx(160) and got[2] == pytest.approx(97.5)
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_plan_meets_targets_and_repeats(spark):
    rows = rows_of(400)
    docs = spark.createDataFrame(rows, COLUMNS)
    got = mixing.plan(docs).collect()
    assert len(got) == 400 and sorted(map(str, mixing.plan(docs.repartition(3)).drop("row").collect())) == sorted(map(str, mixing.plan(docs).drop("row").collect()))
    size, taken, most = defaultdict(int), defaultdict(int), max(len(r[1].split()) for r in rows)
    for r in got:
        assert r["size"] == len(rows[r["id"]][1].split()) and r["taken"] <= 3 * r["size"] and (r["first_time"] is None) == (r["taken"] == 0)
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    names = sorted((s for s in size if s), key=str) + [None]
    want = dict(zip(names, mixing.targets([size[s] for s in names], [1, 2, 3, 1, 2])))
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= most for s in names)


def test_schedule_sets_when_a_source_is_trained(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "rise" if i % 2 else "fall") for i in range(4000)], "doc_id long, text string, source string")
    knots = {"rise": ((0, 0.5), (1, 1.5)), "fall": ((0, 1.5), (0.5, 1.0), (1, 0.5))}
    got = mixing.plan(docs, weight_of=lambda i, s: 1.0, schedule_of=lambda i, s: knots[s]).collect()
    early = Counter(r["source"] for r in got if r["first_time"] is not None and r["first_time"] < 0.5)
    assert early["rise"] / 2000 == pytest.approx(0.375, abs=0.01) and early["fall"] / 2000 == pytest.approx(0.625, abs=0.01)


def test_mix_repeats_rows_in_order(spark):
    rows = rows_of(120) + [rows_of(120)[5]] * 2 + [(None, "a b c", "s1", 2, "y"), (None, "a b c", "s1", 2, "y"), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    planned = mixing.plan(docs).collect()
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    want = Counter()
    for r in planned:
        want[r["id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in got.collect()) == +want
    assert mixing.mix(docs.limit(0)).count() == 0
    unique = spark.createDataFrame(rows_of(120), COLUMNS)
    times = {r["id"]: r["first_time"] for r in mixing.plan(unique).collect()}
    order = [r["doc_id"] for r in mixing.mix(unique).collect()]
    firsts = [times[i] for i in dict.fromkeys(order)]
    assert firsts == sorted(firsts)


def test_one_document_corrects_a_source_with_long_texts(spark):
    rng = random.Random(5)
    rows = [(i, "w " * (rng.choice([4000, 9000]) if i % 40 == 0 else rng.randint(1, 60)), f"s{i % 4}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(docs).collect()
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        taken, target = sum(r["taken"] for r in own), own[0]["target"]
        assert abs(taken - target) <= 0.01 * target, (s, taken, target)
        assert all(r["copies"] <= mixing.CAP for r in own)
    mixed = mixing.mix(docs).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in mixed} == {r["id"]: r["copies"] for r in got if r["copies"]}


def test_too_many_sources_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 3)
    docs = spark.createDataFrame([(i, "a", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.plan(docs)
    assert mixing.plan(docs.filter("doc_id < 3")).count() == 3
