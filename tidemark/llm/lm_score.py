"""LM scoring with a log-bilinear neural model trained by noise-contrastive estimation in numpy.

Token counts cover the whole training corpus. The vocabulary is a tree of two levels. Words with like endings form
``GROUPS`` groups of about the same number of tokens. Within a group each frequent word is a leaf of its own, all others
share the group's last leaf. Leaves number ``LEAVES`` times the root of the number of distinct words, so the model grows
with the corpus; words never seen have a group and a leaf by their ending. Groups have vectors as targets, leaves as
targets and as context. The model predicts a word's vector from those of the words before it, each scaled by its
position's diagonal matrix. Both levels are trained by noise-contrastive estimation: groups against noise shared by a
minibatch, leaves against noise of their own group. Every task trains on its own texts from common weights; weights are
averaged over tasks by tokens, in a tree, after each fold of the corpus.

Scoring normalises each level by batched matrix products, over groups and over one group's leaves. In a shared leaf,
words follow their counts less a discount (absolute discounting), which goes to the words never seen; as in the base
score these are one outcome. So probabilities sum to 1. The discount is estimated from the words that occur once and
twice.

The most frequent words' counts (``table_words``, a fixed bound) go to every task; all rarer words of a document meet
their counts in a shuffle join. The driver gets these words, one row for each ending and the model, nothing that grows
further. Every task draws its own noise, so scores depend on how the input is split, counts and ``base_score`` don't.

Defined cases: a null text counts as an empty one and still has its end token. A null id is not held out. Rows that
repeat an id are scored each. Extra columns are ignored. With no training text every count is 0. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .words import Lookup, Words, runs

#: The end token's fingerprint; it is no word's but by chance.
END = np.uint64(0x0E4D0E4D0E4D0E4D)
FOLDS, FOLD_RATE = 2, 0.2
GROUPS, LEAVES, TABLE_WORDS, CONTEXT, DIM = 128, 4.0, 1 << 18, 4, 16
BATCH, NOISE, LEAF_NOISE = 2048, 64, 1
BLOCK = 16384
ENDINGS = 4096


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and endings of all tokens, each text's words then the end token, and where each text's begin."""
    ptr = words.ptr + np.arange(len(words.ptr))
    code, ending = np.empty(ptr[-1], np.uint64), np.zeros(ptr[-1], np.int32)
    is_end = np.zeros(len(code), bool)
    is_end[ptr[1:] - 1] = True
    code[is_end], code[~is_end] = END, words.code
    ending[~is_end] = endings(words)
    return code, ending, ptr


def endings(words: Words) -> np.ndarray:
    """A number below ``ENDINGS`` from each word's last two bytes (A-Z folded): the last one's six bits, then the other's."""
    if not len(words.end):
        return np.zeros(0, np.int32)
    data = np.frombuffer(words.raw, np.uint8)
    last = _FOLD[data[words.end - 1]]
    other = np.where(words.end - words.start > 1, _FOLD[data[np.maximum(words.end - 2, 0)]], 0)
    return (last * 64 + other).astype(np.int32)


_FOLD = np.arange(256) % 64
_FOLD[65:91] = _FOLD[97:123]


@dataclass
class LogBilinear:
    """Group g has the leaves ``ptr[g]:ptr[g + 1]``; as a context, the number of leaves is the beginning of a text.

    ``mass``: each leaf's tokens, from which noise is drawn and biases start.
    """

    ptr: np.ndarray
    mass: np.ndarray
    seed: int = 0
    dim: int = DIM
    context: int = CONTEXT
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.leaves, self.groups = int(self.ptr[-1]), len(self.ptr) - 1
        self.group = np.repeat(np.arange(self.groups), np.diff(self.ptr))
        mass = np.maximum(self.mass, 0.5)
        self.upto = np.concatenate([[0], np.cumsum(mass)])
        in_group = np.add.reduceat(mass, self.ptr[:-1])
        self.noise, self.leaf_noise = np.log(in_group / mass.sum()).astype(np.float32), np.log(mass / in_group[self.group]).astype(np.float32)
        if not self.parts:
            rng = np.random.default_rng(self.seed)
            self.parts = {
                "q": rng.normal(0, 0.3, (self.leaves + 1, self.dim)).astype(np.float32),
                "r": rng.normal(0, 0.1, (self.groups, self.dim)).astype(np.float32),
                "s": rng.normal(0, 0.1, (self.leaves, self.dim)).astype(np.float32),
                "c": np.ones((self.context, self.dim), np.float32),
                "b": self.noise.copy(),
                "a": self.leaf_noise.copy(),
            }

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[k].ravel() for k in sorted(self.parts)])

    def filled(self, flat: np.ndarray) -> LogBilinear:
        parts, at = {}, 0
        for k in sorted(self.parts):
            parts[k] = flat[at : at + self.parts[k].size].reshape(self.parts[k].shape).astype(np.float32)
            at += self.parts[k].size
        return LogBilinear(self.ptr, self.mass, self.seed, self.dim, self.context, parts)

    def contexts(self, leaf: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """The leaves before each token, nearest first."""
        place = np.arange(len(leaf)) - np.repeat(ptr[:-1], np.diff(ptr))
        out = np.full((len(leaf), self.context), self.leaves, np.int32)
        for j in range(self.context):
            ok = np.flatnonzero(place > j)
            out[ok, j] = leaf[ok - j - 1]
        return out

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        out = np.take(self.parts["q"] * self.parts["c"][0], contexts[:, 0], axis=0)
        for j in range(1, self.context):
            out += np.take(self.parts["q"] * self.parts["c"][j], contexts[:, j], axis=0)
        return out

    def train(self, leaf: np.ndarray, ptr: np.ndarray, squares: dict, rng: np.random.Generator, rate: float = FOLD_RATE) -> None:
        """One pass of noise-contrastive estimation with AdaGrad over these tokens, in shuffled minibatches."""
        contexts, order, p = self.contexts(leaf, ptr), rng.permutation(len(leaf)), self.parts
        shift, leaf_shift, rate = np.float32(np.log(NOISE)), np.float32(np.log(LEAF_NOISE)), np.float32(rate)
        for k in p:
            squares.setdefault(k, np.ones(p[k].shape, np.float32))

        def move(k: str, which: np.ndarray | slice, g: np.ndarray) -> None:
            square = squares[k][which] + g * g
            squares[k][which] = square
            p[k][which] += rate * g / np.sqrt(square)

        for begin in range(0, len(order), BATCH):
            some = order[begin : begin + BATCH]
            ctx, target = np.take(contexts, some, axis=0).T, leaf[some]
            group, before = self.group[target], np.take(p["q"], ctx, axis=0)
            h = np.einsum("jnd,jd->nd", before, p["c"])
            false = self.group[self._leaf_at(rng.random(NOISE, np.float32) * self.upto[-1])]
            r_true, r_false = np.take(p["r"], group, axis=0), p["r"][false]
            up = 1 - _sigmoid(np.einsum("nd,nd->n", h, r_true) + p["b"][group] - self.noise[group] - shift)
            down = -_sigmoid(h @ r_false.T + (p["b"][false] - self.noise[false] - shift))
            to_h = up[:, None] * r_true + down @ r_false
            lo, hi = self.upto[self.ptr[group]], self.upto[self.ptr[group + 1]]
            other = self._leaf_at(lo[:, None] + rng.random((len(some), LEAF_NOISE), np.float32) * (hi - lo)[:, None], self.ptr[group + 1][:, None] - 1)
            s_true, s_false = np.take(p["s"], target, axis=0), np.take(p["s"], other, axis=0)
            leaf_up = 1 - _sigmoid(np.einsum("nd,nd->n", h, s_true) + p["a"][target] - self.leaf_noise[target] - leaf_shift)
            leaf_down = -_sigmoid(np.einsum("nd,nkd->nk", h, s_false) + p["a"][other] - self.leaf_noise[other] - leaf_shift)
            to_h += leaf_up[:, None] * s_true + np.einsum("nk,nkd->nd", leaf_down, s_false)
            sums = _Sums(np.concatenate([group, false]), self.groups)
            move("r", sums.which, sums.of(np.concatenate([up[:, None] * h, down.T @ h])))
            move("b", sums.which, sums.of(np.concatenate([up, down.sum(0)])))
            sums = _Sums(np.concatenate([target, *other.T]), self.leaves)
            pushes = [leaf_up, *leaf_down.T]
            move("s", sums.which, sums.of(np.concatenate([x[:, None] * h for x in pushes])))
            move("a", sums.which, sums.of(np.concatenate(pushes)))
            sums = _Sums(ctx.ravel(), self.leaves + 1)
            move("q", sums.which, sums.of((to_h[None] * p["c"][:, None]).reshape(-1, self.dim)))
            move("c", slice(None), np.einsum("nd,jnd->jd", to_h, before))

    def _leaf_at(self, at: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        return np.minimum(np.searchsorted(self.upto, at, side="right") - 1, self.leaves - 1 if most is None else most)

    def log_p_of(self, leaf: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token of some texts, in blocks that stay in cache."""
        contexts, out = self.contexts(leaf, ptr), np.empty(len(leaf))
        for a in range(0, len(leaf), BLOCK):
            out[a : a + BLOCK] = self.log_p(self.predicted(contexts[a : a + BLOCK]), leaf[a : a + BLOCK])
        return out

    def log_p(self, h: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural log-probability of each leaf after its context's predicted vector."""
        p, group = self.parts, self.group[leaf]
        one = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1)
        of_groups, of_leaves = (np.concatenate([p[k], p[b][:, None]], 1) for k, b in (("r", "b"), ("s", "a")))
        out = np.einsum("nd,nd->n", one, np.take(of_groups, group, axis=0) + np.take(of_leaves, leaf, axis=0)).astype(float)
        most = max(np.einsum("nd,nd->n", y, y).max() for y in (of_groups, of_leaves))
        is_safe = np.einsum("nd,nd->n", one, one).max() * most <= 80**2  # then no score exceeds 80
        out -= _log_sums(one, of_groups, is_safe)
        order = np.argsort(_narrow(group, self.groups), kind="stable")
        cut = np.searchsorted(group[order], np.arange(self.groups + 1))
        for g in np.flatnonzero(np.diff(cut)):
            mine = order[cut[g] : cut[g + 1]]
            out[mine] -= _log_sums(np.take(one, mine, axis=0), of_leaves[self.ptr[g] : self.ptr[g + 1]], is_safe)
        return out


def _log_sums(x: np.ndarray, y: np.ndarray, is_safe: bool) -> np.ndarray:
    """Log of the sum of exp(x @ y.T) over each row."""
    scores = x @ y.T
    if is_safe:
        return np.log(np.exp(scores, out=scores) @ np.ones(len(y), np.float32))
    shift = scores.max(1)
    scores -= shift[:, None]
    return np.log(np.exp(scores, out=scores) @ np.ones(len(y), np.float32)) + shift


def _narrow(index: np.ndarray, size: int) -> np.ndarray:
    """Short integers sort by radix."""
    return index.astype(np.uint16) if size <= 1 << 16 else index


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Sums:
    """Sums of rows with equal indices; ``which``: the distinct ones."""

    def __init__(self, index: np.ndarray, size: int):
        self.order = np.argsort(_narrow(index, size), kind="stable")
        ranked = index[self.order]
        self.first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        self.which = ranked[self.first]

    def of(self, rows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.take(rows, self.order, axis=0), self.first, axis=0)


@dataclass
class Fitted:
    """A trained model with its corpus counts: ``counts`` is a table (code, ending, n), the arrays hold its top rows by
    code. ``leaf``: a word's leaf; ``group_of``: an ending's group. ``tail``: tokens and distinct words of each group's
    shared leaf, its last."""

    counts: DataFrame
    total: int
    distinct: int
    discount: float
    code: np.ndarray
    n: np.ndarray
    leaf: np.ndarray
    group_of: np.ndarray
    tail: np.ndarray
    net: LogBilinear

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.code)

    def placed(self, code: np.ndarray, ending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's row in the table of frequent words (-1: none) and its leaf."""
        outside = self.net.ptr[self.group_of[ending] + 1] - 1
        row = self.lookup.find(code)
        return row, np.where(row < 0, outside, self.leaf[row]) if len(self.leaf) else outside

    def within(self) -> tuple[np.ndarray, np.ndarray]:
        """Log10 of the chances in its leaf: of each word of the table, and of a word never seen in each group."""
        whole = np.maximum(self.tail[:, 0], 1)
        unseen = np.where(self.tail[:, 0] > 0, self.discount * self.tail[:, 1] / whole, 1.0)
        group = self.net.group[self.leaf]
        shared = self.leaf == self.net.ptr[group + 1] - 1
        seen = np.where(shared, np.maximum(self.n - self.discount, 1e-9) / whole[group], 1.0)
        return np.log10(seen), np.log10(unseen)


def held_out(id_col: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def count_tokens(texts: DataFrame) -> DataFrame:
    """(code, ending, n) of every token of these texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words in runs(batch["text"].tolist(), lower=True):
                found, ending, _ = tokens(words)
                code, at, n = np.unique(found, return_index=True, return_counts=True)
                yield pd.DataFrame({"code": code.view(np.int64), "ending": ending[at], "n": n})

    return texts.mapInPandas(count, "code long, ending int, n long").groupBy("code").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> np.ndarray:
    """The most frequent words, ``most`` at most: rows of code, ending, n. Words are cut at one frequency for all, found
    from a histogram, so no task sends more than its share."""
    level = F.floor(F.log2("n") * 32)
    seen, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 32 * 63 rows
        seen += r["count"]
        if seen > most:
            break
        least = r["level"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"data": [batch.to_numpy(np.int64).tobytes()]})

    if least is None:
        return np.zeros((0, 3), np.int64)
    rows = counts.filter(level >= least).select("code", F.col("ending").cast("long"), "n").mapInPandas(pack, "data binary").collect()
    top = np.concatenate([np.zeros((0, 3), np.int64), *[np.frombuffer(r["data"], np.int64).reshape(-1, 3) for r in rows]])
    return top[np.lexsort((top[:, 0], -top[:, 2]))]


def fit(texts: DataFrame, groups: int = GROUPS, leaves: float = LEAVES, table_words: int = TABLE_WORDS, folds: int = FOLDS, seed: int = 0) -> Fitted:
    """Count and train on all rows of ``texts`` (text); fold f of the corpus trains turn f."""
    counts = settle(count_tokens(texts), "counts")
    once = [F.sum((F.col("n") == i).cast("long")) for i in (1, 2)]
    rows = counts.groupBy("ending").agg(F.sum("n"), F.count("*"), *once).collect()  # at most ENDINGS rows
    by_ending = np.zeros((ENDINGS, 4), np.int64)
    for r in rows:
        by_ending[r[0]] = r[1:]
    total, distinct, n1, n2 = map(int, by_ending.sum(0))
    discount = min(0.9, max(0.1, n1 / max(n1 + 2 * n2, 1)))
    before = np.cumsum(by_ending[:, 0]) - by_ending[:, 0]
    group_of = np.unique(before * groups // max(total, 1), return_inverse=True)[1]
    n_groups = int(group_of.max()) + 1
    top = _frequent(counts, table_words)
    own = np.arange(len(top)) < int(np.ceil(leaves * np.sqrt(distinct)))
    group = group_of[top[:, 1]]
    n_own = np.bincount(group[own], minlength=n_groups)
    ptr = np.concatenate([[0], np.cumsum(n_own + 1)])
    leaf = ptr[group + 1] - 1
    by_group = np.argsort(group[own], kind="stable")
    leaf[by_group] = ptr[group[own][by_group]] + np.arange(len(by_group)) - np.repeat(np.cumsum(n_own) - n_own, n_own)
    tail = np.zeros((n_groups, 2), np.int64)
    np.add.at(tail, group_of, by_ending[:, :2])
    np.subtract.at(tail, group[own], np.stack([top[own, 2], np.ones(own.sum(), np.int64)], 1))
    mass = np.zeros(ptr[-1])
    mass[ptr[1:] - 1] = tail[:, 0]
    mass[leaf[own]] = top[own, 2]
    code = top[:, 0].view(np.uint64)
    by_code = np.argsort(code)
    out = Fitted(counts, total, distinct, discount, code[by_code], top[by_code, 2], leaf[by_code], group_of, tail, LogBilinear(ptr, mass, seed))
    for turn in range(folds if total else 0):
        out.net = _train(texts.filter(F.pmod(F.xxhash64("text"), F.lit(folds)) == turn), out, turn)
    return out


def _train(texts: DataFrame, state: Fitted, turn: int) -> LogBilinear:
    start, model = state.net.flat(), _without_table(state)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, squares, seen = model.net.filled(start), {}, 0
        rng = np.random.default_rng([turn, TaskContext.get().partitionId() if TaskContext.get() else 0])
        for batch in batches:
            for words in runs(batch["text"].tolist(), lower=True):
                code, ending, ptr = tokens(words)
                own.train(model.placed(code, ending)[1], ptr, squares, rng)
                seen += len(code)
        if seen:
            yield pd.DataFrame({"weight": [float(seen)], "flat": [own.flat().astype("<f4").tobytes()]})

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(len(start)), 0.0
        for batch in batches:
            for w, data in zip(batch["weight"], batch["flat"]):
                total, weight = total + w * np.frombuffer(data, "<f4"), weight + w
        if weight:
            yield pd.DataFrame({"weight": [weight], "flat": [(total / weight).astype("<f4").tobytes()]})

    schema, spark = "weight double, flat binary", texts.sparkSession
    some = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    merged = texts.mapInPandas(train, schema).repartition(some).mapInPandas(average, schema).repartition(1).mapInPandas(average, schema)
    found = merged.collect()  # one row, the model itself
    return state.net.filled(np.frombuffer(found[0]["flat"], "<f4")) if found else state.net


def _without_table(fitted: Fitted) -> Fitted:
    """A copy that can be sent to tasks."""
    return replace(fitted, counts=None)


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; scores are log10 probabilities of the text."""
    whole, discount, model = fitted.total + fitted.distinct + 1, fitted.discount, _without_table(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        net, (seen, unseen) = model.net, model.within()
        base_of = np.log10((model.n + 1) / whole)
        tokens_in = np.log10(np.maximum(model.tail[:, 0], 1))
        for batch in batches:
            for words in runs(batch["text"].tolist(), lower=True):
                found, ending, ptr = tokens(words)
                count = len(ptr) - 1
                row, leaf = model.placed(found, ending)
                group, known = net.group[leaf], row >= 0
                logs = net.log_p_of(leaf, ptr) / np.log(10)
                logs[known] += seen[row[known]]
                base = np.zeros(len(found))
                base[known] = base_of[row[known]]
                owner = np.repeat(np.arange(count), np.diff(ptr))
                rare = np.flatnonzero(~known)
                by = np.lexsort((found[rare], owner[rare]))
                o, f, g = owner[rare][by], found[rare][by], group[rare][by]
                first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (f[1:] != f[:-1])])) if len(o) else np.zeros(0, np.int64)
                times, cut = np.diff(np.append(first, len(o))), np.searchsorted(o[first], np.arange(count + 1))
                codes, g = f[first].view(np.int64), g[first]
                # What a rare word's leaf adds to the score, were it never seen; the difference if it was comes with its count.
                logs_of = np.bincount(owner, logs, count) + np.bincount(o[first], times * unseen[g], count)
                more = (-tokens_in - unseen)[g].astype(np.float32)
                yield pd.DataFrame(
                    {
                        "uid": serial + np.arange(count),
                        "id": batch["id"].iloc[words.first : words.first + count].to_numpy(),
                        "n_tokens": np.diff(ptr),
                        "known": np.bincount(owner[known], minlength=count),
                        "base": np.bincount(owner, base, count),
                        "logs": logs_of,
                        "codes": [codes[a:b] for a, b in zip(cut, cut[1:])],
                        "times": [times[a:b] for a, b in zip(cut, cut[1:])],
                        "more": [more[a:b] for a, b in zip(cut, cut[1:])],
                    }
                )
                serial += count

    some = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    schema = "uid long, id string, n_tokens long, known long, base double, logs double, codes array<long>, times array<int>, more array<float>"
    scored = settle(some.mapInPandas(run, schema), "scored")
    pairs = scored.select("uid", F.explode(F.arrays_zip("codes", "times", "more")).alias("p")).select("uid", F.col("p.codes").alias("code"), "p.times", "p.more")
    met = pairs.join(fitted.counts.select("code", "n"), "code", "left").select("uid", "times", "more", F.coalesce("n", F.lit(0)).alias("n"))
    rest = met.groupBy("uid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known_more"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(whole)))).alias("base_more"),
        F.sum(F.when(F.col("n") > 0, F.col("times") * (F.log10(F.col("n") - F.lit(discount)) + F.col("more")))).alias("logs_more"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.join(rest, "uid", "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_tokens", (F.col("known") + zero("known_more")).alias("n_known"),
        (F.col("base") + zero("base_more")).alias("base_score"), (F.col("logs") + zero("logs_more")).alias("score"),
    )


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learn from the documents that are not held out and score all of them."""
    texts = docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).alias("text"))
    fitted = fit(texts.select(F.coalesce("text", F.lit("")).alias("text")), **options)
    found = score(docs, fitted, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "n_tokens", "n_known", F.lit(fitted.total).cast("long").alias("train_tokens"), "base_score", "score")
