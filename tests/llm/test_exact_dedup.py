import hashlib
import re
from collections import defaultdict

import pytest

from tidemark.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, kept long"


def rows_of(texts):
    return [(i, t, "x", 1) for i, t in texts]


CASES = [(3, "a  b"), (1, "a b"), (2, "a\tb"), (7, None), (6, ""), (None, "a b"), (None, "only"), (5, "dup"), (5, "dup"), (9, " a b"), (11, "z" * 100000), (10, "z" * 100000)]


@pytest.mark.parametrize("batches", [0, 1, 2, 5])
def test_assign_matches_brute_force(spark, batches):
    docs = spark.createDataFrame(rows_of(CASES), SCHEMA)
    groups = defaultdict(list)
    for i, t in CASES:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    index = exact_dedup.new_index(docs)
    got = (exact_dedup.assign_in_batches(docs, index, batches) if batches else exact_dedup.assign(docs, index, "all")).collect()
    assert index.table().count() == len(groups) and index.table().select("batch").distinct().count() >= min(batches, 2)
    assert len(got) == len(CASES) and sum(r.kept for r in got) == len(groups)
    for text, ids in groups.items():
        digest = hashlib.sha256(text.encode()).digest()
        own = [r for r in got if r.digest == digest]
        least = min((i for i in ids if i is not None), default=None)
        assert len(own) == len(ids) and {r.keep_id for r in own} == {least} and {r.group_size for r in own} == {len(ids)}
        assert [r.doc_id for r in own if r.kept] == [least]


def test_keep_first_keeps_columns_and_one_of_each(spark):
    docs = spark.createDataFrame(rows_of(CASES), SCHEMA)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 5, 6, 9, 10)] + [(True, 0)]
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


def test_index_persists_over_batches(spark):
    first = spark.createDataFrame(rows_of([(10, "a"), (11, "b")]), SCHEMA)
    second = spark.createDataFrame(rows_of([(1, "a"), (2, "c"), (3, "c")]), SCHEMA)
    index = exact_dedup.new_index(first)
    exact_dedup.assign(first, index, "monday")
    again = exact_dedup.DigestIndex(spark, index.path, buckets=index.buckets)
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.assign(second, again, "tuesday").collect()}
    assert got == {1: (10, False), 2: (2, True), 3: (2, False)}
    assert again.table().count() == 3
    # A batch that is run again decides as before; the same texts as new data are copies.
    assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.assign(second, again, "tuesday").collect()} == got
    assert all(r.kept for r in exact_dedup.assign(first, again, "monday").collect()) and again.table().count() == 3
    assert not any(r.kept for r in exact_dedup.assign(second, again, "wednesday").collect()) and again.table().count() == 3
    again.drop()
    assert not spark.catalog.tableExists(again.name)


def test_hot_group_is_joined_whole(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    got = exact_dedup.assign_in_batches(docs, exact_dedup.new_index(docs))
    assert got.count() == 6000 and got.filter("kept").count() == 2001 and got.filter("group_size = 4000").count() == 4000


def test_other_ids_are_one_batch_and_clashing_names_stay(spark):
    docs = spark.createDataFrame([("b", "x", 1), ("a", "x", 2), (None, "y", 3)], "doc_id string, text string, __id long")
    assert sorted((r["doc_id"] or "", r["__id"]) for r in exact_dedup.keep_first(docs).collect()) == [("", 3), ("a", 2)]
    assert exact_dedup.assign_in_batches(docs.limit(0), exact_dedup.new_index(docs)).count() == 0
