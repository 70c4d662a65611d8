import math
import os
import random
import re
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline
from test_near_dedup import brute as near_classes
from test_packing import check

from tidemark.llm import bpe, mixing, shared

COMMON = "the of and to in that is was for it with as on be at by this had not are but from or have an they which one you were".split()


def documents():
    """Good texts with exact copies, near copies and repeated ids, and texts that break a rule."""
    rng, rows = random.Random(4), []
    pool = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    for i in range(70):
        words = [rng.choice(COMMON) if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(80, 200))]
        rows.append((10 * i, " ".join(words), "abc"[i % 3]))
        if i % 5 == 0:
            rows.append((10 * i + 1, "  ".join(words), "abc"[i % 2]))
        if i % 7 == 0:
            rows.append((10 * i + 2, " ".join([*words[:-1], "ending"]), "abc"[i % 3]))
        if i % 11 == 0:  # the same id with another text of as many words
            rows.append((10 * i, " ".join(rng.choice(COMMON) if rng.random() < 0.3 else rng.choice(pool) for _ in words), "abc"[i % 3]))
    rows.append(rows[0])
    bad = [(9001, None, "a"), (9002, "", "b"), (9003, "x y", None), (9004, "### " * 100, "c"), (9005, " ".join(["same old words here again"] * 40), "a")]
    return rows, bad


def first_of(rows):
    kept = {}
    for r in sorted(rows):
        kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    return sorted(kept.values())


def near_first(rows):
    groups = near_classes(list(range(len(rows))), [r[1] for r in rows])
    return sorted(min((rows[i] for i in g), key=lambda r: r[0]) for g in groups)


def mixed(spark, rows):
    """How often each id is taken."""
    ids = spark.createDataFrame([(r[0],) for r in rows], "id long").distinct().selectExpr("id", "pmod(xxhash64(cast(id AS string)), 2147483648) AS h").collect()
    place_of, own, out = dict(ids), defaultdict(list), Counter()
    for r in rows:
        own[r[2]].append((place_of[r[0]], r[0], len(r[1].split())))
    size = [sum(x[2] for x in own[s]) for s in sorted(own)]
    for s, whole, target in zip(sorted(own), size, mixing.targets(size, [i % 3 + 1.0 for i in range(len(size))])):
        before, plan = 0, []
        for _, i, n in sorted(own[s]):
            plan.append([i, n, min(int(mixing.CAP), max(0, math.ceil((target - before - n / 2) / whole)))])
            before += n
        gap = target - sum(n * k for _, n, k in plan)
        step = 1 if gap > 0 else -1
        near = [(abs(gap - step * x[1]), x[0], x) for x in plan if abs(gap - step * x[1]) < abs(gap) and (x[2] < mixing.CAP if gap > 0 else x[2] > 0)]
        if near:
            min(near)[2][2] += step
        for i, _, k in plan:
            out[i] += k
    return +out


def test_stages_and_run_match_a_plain_version(spark, tmp_path):
    good, bad = documents()
    mess = good + bad
    random.Random(1).shuffle(mess)
    spark.createDataFrame(mess, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, found = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.settle(stage(spark, docs, str(tmp_path)), name.replace(" ", "_"))
        found[name] = docs
    rows = lambda name: sorted(tuple(r) for r in found[name].select("doc_id", "text", "source").collect())
    assert rows("quality rules") == sorted(good)
    single = first_of(good)
    assert [(i, " ".join(t.split())) for i, t, _ in rows("exact dedup")] == [(i, " ".join(t.split())) for i, t, _ in single]
    apart = near_first(rows("exact dedup"))
    assert rows("near dedup") == apart and len(apart) < len(single) < len(good)
    taken = mixed(spark, apart)
    mix = rows("mixing")
    assert Counter(r[0] for r in mix) == taken and max(taken.values()) > 1 and {r for r in mix} <= set(apart)
    coder = bpe.Bpe(*bpe.default_paths())
    lengths = Counter((i, len(coder.whole.encode(t, add_special_tokens=False).ids) + 1) for i, t, _ in mix)
    for packed in (found["packing"], corpus_pipeline.run(spark, str(tmp_path))):
        pieces = packed.collect()
        assert Counter((r["doc_id"], r["length"]) for r in pieces) == lengths and all(r["piece"] == r["start"] == 0 for r in pieces)
        total = sum(n * k for (_, n), k in lengths.items())
        assert check(pieces, 2048) <= 1.1 * total / 2048 + 1


EXTRA = ["lang", "n_chars", "row__", "digest__", "__id", "kept_id__", "quality__", "node", "label", "at", "size", "copies", "uid"]


def test_every_stage_takes_nulls_ties_clashing_names_and_empty_tables(spark, tmp_path):
    """Rows with nulls in every column, twice the same row, an empty and a long text, and columns named as the operators'."""
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(COMMON) if rng.random() < 0.4 else f"word{rng.randrange(900)}" for _ in range(n))
    one, two, three = text(60), text(90), text(4000)
    rows = [(1, one, "a"), (1, one, "a"), (None, two, None), (None, two, None), (4, three, "b"), (5, None, "a"), (6, "", None), (None, None, None), (2, one + " ", "b"), (3, one + " more", "a")]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in EXTRA)
    docs = spark.createDataFrame([(*r, *([f"x{i}"] * len(EXTRA) if i % 2 else [None] * len(EXTRA))) for i, r in enumerate(rows)], schema)
    want = {
        "quality rules": [(1, one), (1, one), (2, one + " "), (3, one + " more"), (4, three), (None, two), (None, two)],
        "exact dedup": [(1, one), (2, one + " "), (3, one + " more"), (4, three), (None, two)],
        "near dedup": [(1, one), (4, three), (None, two)],
    }
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for name, stage in corpus_pipeline.STAGES:
        found = shared.settle(stage(spark, docs, str(tmp_path)), "stage")
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name == "packing":
            assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns) and found.count() >= 3
            break
        assert found.columns == docs.columns and empty.columns == docs.columns
        got = sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=key)
        if name == "mixing":
            assert set(got) <= set(want["near dedup"]) and max(Counter(got).values()) <= 3
        else:
            assert got == want[name], name
        docs = found


def test_run_leaves_no_scratch_tables_but_its_result(spark, tmp_path):
    good, bad = documents()
    spark.createDataFrame(good + bad, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    mark = shared.marked()
    found = corpus_pipeline.run(spark, str(tmp_path))
    left = shared._SCRATCH[mark:]
    assert found.count() > 0 and not any("quality" in p or "signed" in p or "digests" in p for p in left)
    shared.clear(spark, mark)
    assert len(shared._SCRATCH) == mark
