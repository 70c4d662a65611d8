import hashlib
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import substring_dedup as sub
from tidemark.llm import words


def brute(rows, k=13):
    least = defaultdict(lambda: float("inf"))
    split = [(float("inf") if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - k + 1):
            g = tuple(w[a : a + k])
            least[g] = min(least[g], i)
    out = []
    for i, w in split:
        gone = {a + j for a in range(len(w) - k + 1) if least[tuple(w[a : a + k])] < i for j in range(k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((None if i == float("inf") else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(n, seed=3):
    rng = random.Random(seed)
    passages = [" ".join(f"p{j}_{i}" for i in range(rng.choice([12, 13, 14, 60]))) for j in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(["the", "of", "a", "xyz"]) for _ in range(rng.randint(0, 40))) for _ in range(3)]
        rows.append((i * 3, "\n".join([parts[0], rng.choice(passages), parts[1], "same passage in every document of this corpus with more than thirteen words in it", parts[2]])))
    rows += [(7, rows[5][1]), (8, rows[5][1]), (8, rows[5][1]), (None, rows[9][1]), (None, None), (10**15 + 1, ""), (10**15 + 2, "é " * 40), (10**15 + 3, "é " * 50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chars", [1 << 30, 900])
def test_matches_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(sub, "CHUNK_CHARS", chars)
    monkeypatch.setattr(sub, "GROUP_CHARS", chars)
    monkeypatch.setattr(sub, "sizes", lambda c: (max(1, c // chars), max(1, c // chars)))
    rows = corpus(60)
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, chunk string, width int").repartition(5)
    got = sub.remove_repeats(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert sub.remove_repeats(docs.limit(0)).count() == 0


def test_heavy_prefixes_are_lengthened(spark):
    text = "the of " * 4000 + " ".join(f"w{i}" for i in range(2000))
    docs = spark.createDataFrame([(text,), (text,)], "text string")
    heavy = sub.heavy_prefixes(docs, 8, share_of=1)
    assert len(heavy[1]) == 2 and len(heavy[2]) == 2
    w = words.fingerprint([text])
    at = sub.starts(w, 13)
    assert len(np.unique(sub.prefixes(w, at, 13, heavy))) >= len(np.unique(sub.prefixes(w, at, 13, {})))


@pytest.mark.parametrize("n, kind", [(1, "int"), (3, "long"), (40, "int"), (300, "long")])
def test_chunks_and_groups_hash_apart(spark, n, kind):
    keys = sub._apart(spark, n, kind)
    assert len(keys) == n and keys == sorted(set(keys))
    parts = spark.createDataFrame([(k,) for k in keys], f"key {kind}").selectExpr(f"pmod(hash(key), {sub._parts_of(spark, n)}) AS part")
    assert parts.distinct().count() >= 0.97 * n


def test_codes_pack_and_unpack():
    codes = np.sort(np.random.default_rng(0).integers(0, 2**40, 1000, dtype=np.uint64) // np.uint64(3))
    codes[5] = codes[4]
    for some in (codes, codes[:1], np.zeros(2, np.uint64)):
        assert (sub._unpack(*sub._pack(some)) == some).all()


def test_false_alarms_of_fingerprints_remove_nothing(spark, monkeypatch):
    """With fingerprints of 2 bits all suffixes go to the trees, where words decide."""
    monkeypatch.setattr(sub, "CODE_BITS", 2)
    monkeypatch.setattr(sub, "sizes", lambda c: (4, 3))
    rows = [(i, t) for i, t in corpus(30) if i is not None]
    got = sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(brute(rows))
    code = sub._pack(np.array([0, 1, 1, 3], np.uint64))
    parts = pd.DataFrame([(5, *code), (2, *sub._pack(np.array([2, 3], np.uint64)))], columns=["chunk", "n", "width", "data"])
    bits = {c: np.unpackbits(np.frombuffer(b, np.uint8))[:4].tolist() for c, b in sub._again(parts)}
    assert bits == {5: [0, 1, 1, 1], 2: [0, 1, 0, 0]}


def test_each_group_is_told_of_a_fingerprint_that_windows_share_by_chance(monkeypatch):
    at, code = sub.fingerprints(w := words.fingerprint([" ".join(f"w{i % 70}" for i in range(200))]), 13)
    few = code & np.uint64(1)
    monkeypatch.setattr(sub, "fingerprints", lambda w, k: (at, few))
    own = sub._Codes([w.raw.decode()], 13, {}, 7)
    told = [(c, group) for group, places in own.parts() for c in own.code[places].tolist()]
    assert sorted(told) == sorted(set(zip(few.tolist(), sub._groups(w, at, 13, {}, 7).tolist())))
    assert (own.code[own.node] == few).all() and (own.group[own.node] == sub._groups(w, at, 13, {}, 7)).all()


def test_rows_come_in_another_order_at_each_reading(spark, monkeypatch):
    """As a shuffle among several executors gives them."""
    monkeypatch.setattr(sub, "sizes", lambda c: (4, 3))

    def shaken(texts, n_chunks, dealt=sub._dealt):
        out = dealt(texts, n_chunks)
        return out.mapInPandas(lambda parts: (p.sample(frac=1, random_state=random.SystemRandom().randrange(2**32)) for p in parts), out.schema)

    monkeypatch.setattr(sub, "_dealt", shaken)
    rows = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = sub.remove_repeats(docs).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_string_ids_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(sub, "sizes", lambda c: (4, 3))
    rows = [(None if i is None else f"doc-{i % 10**9:04d}", t) for i, t in corpus(40)]
    order = {d: n for n, d in enumerate(sorted({d for d, _ in rows if d}))}
    want = sorted((d or "~", *r[1:]) for (d, _), r in zip(rows, brute([(order.get(d), t) for d, t in rows])))
    got = sub.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r["doc_id"] or "~", r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_deep_nodes_of_a_small_tree():
    suffixes = [b"a b c", b"a b c", b"a b c d", b"a b x", b"a c", b"b c d e", b"b c d f", b"c"]
    assert sub.deep_nodes(suffixes, 2) == [(2, 0, 4), (3, 0, 3), (3, 5, 7)]
    assert sub.deep_nodes(suffixes, 1) == [(1, 0, 5), (2, 0, 4), (3, 0, 3), (3, 5, 7)]
    assert sub.top_nodes([b"a b", b"a b", b"a b c", b"a c", b"b"], 2).tolist() == [0, 0, 0, 1, 2]


def brute_repeats(texts, k):
    found = defaultdict(list)
    for t in texts:
        w = (t or "").split()
        for a in range(len(w)):
            for b in range(a + k, len(w) + 1):
                found[tuple(w[a:b])].append((w[a - 1] if a else None, w[b] if b < len(w) else None))
    wide = lambda x: len(set(x)) > 1 or None in x
    return {(" ".join(s), len(s), len(o)) for s, o in found.items() if len(o) > 1 and wide([x for x, _ in o]) and wide([y for _, y in o])}


@pytest.mark.parametrize("parts", [(1, 1), (3, 4)])
def test_maximal_repeats_match_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(sub, "sizes", lambda c: parts)
    rng = random.Random(7)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(12)]
    passage = " ".join(f"p{i}" for i in range(9))
    texts += [f"x {passage} y", f"z {passage}", f"x {passage} w", f"{passage} {passage}", None, ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = {(r["words"], r["n_words"], r["occurrences"]) for r in sub.maximal_repeats(docs, 4, 30).collect()}
    assert got == brute_repeats(texts, 4)
    cut = sub.maximal_repeats(docs, 4, 6).filter("is_cut").collect()
    assert cut and all(r["n_words"] == 6 for r in cut) and sub.maximal_repeats(docs.limit(0)).count() == 0
