import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lm_score


def corpus(n=500):
    rng, out = random.Random(2), []
    follow = {w: rng.sample([f"w{i}" for i in range(40)], 3) for w in [f"w{i}" for i in range(40)]}
    for i in range(n):
        w, text = f"w{rng.randrange(40)}", []
        for _ in range(rng.randint(0, 60)):
            text.append(w.upper() if rng.random() < 0.1 else w)
            w = rng.choice(follow[w])
        out.append((i, " ".join(text) + (f" rare{i} é" if i % 5 == 0 else "")))
    return [*out, (n, None), (n + 1, ""), (n + 1, "w1 w2"), (None, "w1 w2"), (n + 2, "w3 " * 20000)]


def words_of(text):
    return [*bytes(text or "", "utf-8").lower().split(), None]


def test_base_matches_brute_force_and_model_beats_it(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    got = lm_score.train_and_score(docs, groups=5, table_words=35).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in words_of(t))
    total = sum(c.values())
    want = Counter()
    for i, t in rows:
        w = words_of(t)
        want[(i, out(i), len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)
    assert lm_score.train_and_score(docs.limit(0)).count() == 0


def net_of(groups=3, each=4, **options):
    rng = np.random.default_rng(5)
    return lm_score.LogBilinear(np.arange(0, groups * each + 1, each), rng.integers(1, 90, groups * each).astype(float), **options)


def plain_log_p(net, context, leaf):
    """The leaf's log-probability by loops: group given context, then leaf given group and context."""
    p, h = net.parts, [sum(float(net.parts["q"][c][d] * net.parts["c"][j][d]) for j, c in enumerate(context)) for d in range(net.dim)]

    def scores(vectors, biases):
        return [sum(x * float(y) for x, y in zip(h, v)) + float(b) for v, b in zip(vectors, biases)]

    def chance(all_scores, i):
        return all_scores[i] - math.log(sum(math.exp(s) for s in all_scores))

    g = int(net.group[leaf])
    lo, hi = int(net.ptr[g]), int(net.ptr[g + 1])
    return chance(scores(p["r"], p["b"]), g) + chance(scores(p["s"][lo:hi], p["a"][lo:hi]), leaf - lo)


def test_leaf_probabilities_match_loops_and_sum_to_one():
    net = net_of(seed=4, context=2)
    for context in ([0, 12], [3, 7], [12, 12]):
        h = net.predicted(np.array([context] * net.leaves))
        got = net.log_p(h, np.arange(net.leaves))
        assert got == pytest.approx([plain_log_p(net, context, i) for i in range(net.leaves)], abs=1e-4)
        assert np.exp(got).sum() == pytest.approx(1, abs=1e-5)


def test_training_learns_a_bigram():
    leaf, net = np.tile([0, 5, 10], 20000), net_of(context=1)
    net.train(leaf, np.array([0, len(leaf)]), {}, np.random.default_rng(0))
    assert np.exp(net.log_p(net.predicted(np.array([[0]])), np.array([5])))[0] > 0.8


def test_model_grows_with_the_corpus(spark):
    def fitted(n):
        return lm_score.fit(spark.createDataFrame([(f"v{i} v{i} u{i}",) for i in range(n)], "text string"), groups=10, leaves=2)

    few, many = fitted(50), fitted(5000)
    assert few.net.leaves >= 2 * 100**0.5 and many.net.leaves >= 2 * 10000**0.5
    assert many.net.parts["q"].shape[0] == many.net.leaves + 1


def test_frequent_words_are_cut_at_one_frequency(spark):
    counts = spark.createDataFrame([(i, 0, 1 + i // 10) for i in range(1000)], "code long, ending int, n long").repartition(7)
    top = lm_score._frequent(counts, 35)
    assert 0 < len(top) <= 35 and top[:, 2].min() > max(1 + i // 10 for i in range(1000) if i not in set(top[:, 0].tolist()))
    assert len(lm_score._frequent(counts, 1000)) == 1000 and len(lm_score._frequent(counts, 5)) == 0


def test_score_matches_a_plain_version_and_sums_to_one(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 900}{rng.choice('xyz')}" for _ in range(20)) for _ in range(150)]
    fitted = lm_score.fit(spark.createDataFrame([(t,) for t in texts], "text string"), groups=4, leaves=1, table_words=60)
    net, count = fitted.net, Counter(w for t in texts for w in words_of(t))
    vocabulary = sorted(w for w in count if w)
    asked = [*(w.decode() for w in vocabulary), "", "neverseen", "w1x W2Y zzz w1x", "w5z " * 300]
    got = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), fitted).collect()}
    code, ending, _ = lm_score.tokens(next(lm_score.runs([" ".join(asked)], lower=True)))
    of = dict(zip([*" ".join(asked).lower().encode().split(), None], zip(code, ending)))
    leaf_of = {w: int(fitted.placed(np.array([c]), np.array([e]))[1][0]) for w, (c, e) in of.items()}
    singles = {leaf: w for w, leaf in leaf_of.items() if leaf != net.ptr[net.group[leaf] + 1] - 1}
    tail = {g: [0, 0] for g in range(net.groups)}
    for w, n in count.items():
        if singles.get(leaf_of[w]) != w:
            tail[int(net.group[leaf_of[w]])][0] += n
            tail[int(net.group[leaf_of[w]])][1] += 1
    n1, n2 = sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values())
    discount = min(0.9, max(0.1, n1 / max(n1 + 2 * n2, 1)))

    def inside(w):
        if singles.get(leaf_of[w]) == w:
            return 1.0
        tokens, distinct = tail[int(net.group[leaf_of[w]])]
        return (count[w] - discount) / tokens if count[w] else discount * distinct / tokens if tokens else 1.0

    def plain(text):
        before, total = [net.leaves] * net.context, 0.0
        for w in words_of(text):
            total += plain_log_p(net, before, leaf_of[w]) / math.log(10) + math.log10(inside(w))
            before = [leaf_of[w], *before[:-1]]
        return total

    assert len(singles) > 5 and len(vocabulary) > 100
    for i in [*range(0, len(vocabulary), 9), len(vocabulary), len(vocabulary) + 1, len(vocabulary) + 2]:
        assert got[i] == pytest.approx(plain(asked[i]), abs=1e-3)
    start = [net.leaves] * net.context
    first = {w: 10 ** (plain_log_p(net, start, leaf_of[w]) / math.log(10)) * inside(w) for w in [*vocabulary, None]}
    unseen = sum(math.exp(plain_log_p(net, start, int(net.ptr[g + 1]) - 1)) * (discount * d / n if n else 1.0) for g, (n, d) in tail.items())
    assert sum(first.values()) + unseen == pytest.approx(1, abs=1e-4)
