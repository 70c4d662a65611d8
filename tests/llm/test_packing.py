import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, packing, token_counts


def check(rows, room):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=200))
def test_best_fit_leaves_no_two_bins_that_fit_together(sizes):
    sizes = np.sort(np.asarray(sizes, np.int64))[::-1]
    where, offset, fill = packing.best_fit(sizes, 64)
    assert (fill <= 64).all() and (len(fill) < 2 or np.sort(fill)[:2].sum() > 64)


def test_tree_packs_whole_and_tight(spark):
    sizes = np.random.default_rng(1).integers(1, 2048, 5000)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, length long")
    got = packing.place(items, part_items=200, fan_in=4).join(items, "uid").withColumnRenamed("bin", "sequence_id").collect()
    assert len(got) == 5000 and len({r["uid"] for r in got}) == 5000
    assert check(got, 2048) <= 1.04 * sizes.sum() / 2048 + 1


def test_pack_covers_every_token(spark):
    texts = [None, "", "one two", "one two", "long text " * 3000, "word " * 2047, "exact"] + [f"text {i} " * (i % 40) for i in range(60)]
    docs = spark.createDataFrame([(i if i != 6 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, bin string")
    got = packing.pack(docs, keep_ids=True).collect()
    coder, by = bpe.Bpe(*bpe.default_paths()), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        assert zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for i, t in enumerate(texts):
        own = sorted(by[i if i != 6 else None], key=lambda r: r["piece"])
        ids = coder.whole.encode(t or "", add_special_tokens=False).ids + [0]
        assert [x for r in own for x in r["ids"]] == ids and all(r["length"] == 2048 for r in own[1:])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
    check(got, 2048)
    assert packing.pack(docs.limit(0)).count() == 0


def test_token_counts_match_brute_force(spark):
    texts = [None, "", "a b c", "a b c", "x " * 5000, "y " * 1500] + [f"w{i} " * i for i in range(50)]
    docs = spark.createDataFrame([(t, 5) for t in texts], "text string, length int")
    coder = bpe.Bpe(*bpe.default_paths())
    true = np.array([len(coder.whole.encode(t or "", add_special_tokens=False).ids) for t in texts])
    histogram = token_counts.lengths(docs)
    for r in token_counts.with_suffix_sums(histogram).collect():
        k = r["length"]
        assert r["n_docs"] == (true == k).sum() and r["docs_at_least"] == (true >= k).sum() and r["tokens_at_least"] == true[true >= k].sum()
        assert r["truncated_total"] == np.minimum(true, k).sum() and abs(r["share_at_most"] - (true <= k).mean()) < 1e-12
    got = token_counts.answer(histogram, [1, 100, 10**6], [0.5, 1.0])
    assert got["tokens"] == true.sum() and got["truncated"] == {k: np.minimum(true, k).sum() for k in (1, 100, 10**6)} and got["quantiles"][1.0] == true.max()
    assert token_counts.with_suffix_sums(token_counts.lengths(docs.limit(0))).count() == 0
    assert docs.select(F.count("*")).first()[0] == len(texts)
