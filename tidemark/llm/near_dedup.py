"""MinHash near-dedup by DartMinHash signatures and banded joining.

Each weighted element (a shingle of five words) owns a region of weight by rank. Darts fall into it as a Poisson
process that depends on the element alone. A document keeps the darts under its elements' weights and up to a rank that
yields enough of them; each dart is hashed to a coordinate, and each coordinate keeps its earliest dart. Two documents
agree at a coordinate with the probability of their weighted Jaccard similarity, at a cost of elements plus darts.

Documents with equal shingle sets are one node. Nodes that agree in a band of coordinates meet in a bucket. No bucket
emits its pairs: each member is compared with the bucket's leader, links merge components, and only buckets whose
members still lie in several components go on, without leaders already compared with all. What is left of small
buckets is compared in many tasks, each with the sets of its own buckets' members, by matrix products that give all
intersections of a bucket. Buckets led by the same node are one task's, so its sets travel once. Larger buckets take further rounds with up to twice as many leaders each time. So each pair of a bucket
is compared or known to be connected. Similarities are exact; a pair at 0.8 shares a band with probability 0.9996.

With ``weighted`` a shingle weighs its count and similarity is that of multisets; each occurrence is then an element.

Defined cases: null, empty and blank texts have no shingles; each is a class of its own. Texts of under five words are
one shingle. Repeated rows are copies. A null id sorts last; of a class the smallest id stays. Extra columns are
ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT_SHARE, free_name, join_groups, look_up, settle
from .words import Words, mix, runs

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
#: What one task takes at most: links to connect; and, about, members of small buckets and their sets' bytes.
SMALL_LINKS, PART_MEMBERS, PART_BYTES = 1 << 19, 4096, 32 << 20
#: Members of a small bucket, leaders of a bucket in one round, which bounds what is broadcast, and columns of a product.
FEW, MOST_LEADERS, COLUMNS = 4096, 1024, 2048
_GOLD, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text: (text, shingle, count). A shorter text is one shingle."""
    code, whole = words.windows(k)
    at = np.flatnonzero(whole)
    count = words.count
    short = np.flatnonzero((count > 0) & (count < k))
    owner, value = words.owner()[at], code[at]
    if len(short):
        with np.errstate(over="ignore"):
            weight = np.multiply.accumulate(np.full(k, _GOLD))
            few = [mix(np.uint64((words.code[a:b] * weight[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a))) for a, b in zip(words.ptr[short], words.ptr[short + 1])]
        owner, value = np.concatenate([owner, short]), np.concatenate([value, np.array(few, np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return owner[first], value[first], np.diff(np.append(first, len(owner)))


def occurrences(owner: np.ndarray, value: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each occurrence of a shingle as an element of its own, sorted by text and value; the first is the shingle itself."""
    which = np.repeat(np.arange(len(owner)), count)
    nth = (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    with np.errstate(over="ignore"):
        each = np.where(nth > 0, mix(value[which] + nth * _ODD), value[which])
    order = np.lexsort((each, owner[which]))
    return owner[which][order], each[order]


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signature (n x k) of each of n weighted sets, given as sorted owners with elements and weights."""
    out = np.zeros((n, k), np.uint64)
    todo, darts = np.unique(owner), k * (np.log(k) + 3)
    while len(todo):
        mine = np.isin(owner, todo)
        found, full = _throw(owner[mine], element[mine], weight[mine].astype(float), n, k, darts)
        done = todo[full[todo]]
        out[done] = found[done]
        todo, darts = todo[~full[todo]], darts * 2
    return out


def _throw(owner, element, weight, n, k, darts):
    total = np.bincount(owner, weights=weight, minlength=n)
    limit = darts / np.maximum(total, 1e-300)
    cells = np.maximum(np.ceil(weight), 1).astype(np.int64)  # one for each unit of weight
    which = np.repeat(np.arange(len(owner)), cells)
    unit = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    with np.errstate(over="ignore"):
        cell = mix(element[which] + unit.astype(np.uint64) * _ODD)
    part = weight[which] - unit
    own, rank = owner[which], np.zeros(len(which))
    best = np.full(n * k, np.inf)
    kept: list[tuple] = []
    turn = np.uint64(0)
    while len(cell):
        with np.errstate(over="ignore"):
            turn += np.uint64(1)
            dart = mix(cell + turn * _GOLD)
        rank = rank - np.log(((dart >> np.uint64(11)).astype(float) + 1) / 2.0**53)
        here = rank <= limit[own]
        cell, own, rank, part, dart = cell[here], own[here], rank[here], part[here], dart[here]
        spot = mix(dart ^ _ODD)
        hit = np.flatnonzero((spot >> np.uint64(40)).astype(float) / 2.0**24 < part)
        at = own[hit] * k + (spot[hit] % np.uint64(k)).astype(np.int64)
        np.minimum.at(best, at, rank[hit])
        kept.append((at, rank[hit], dart[hit]))
    found = np.zeros(n * k, np.uint64)
    for at, r, dart in kept:
        first = best[at] == r
        found[at[first]] = dart[first]
    return found.reshape(n, k), np.isfinite(best).reshape(n, k).all(1)


def bands(signature: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A bucket for each band of each signature."""
    split = signature.reshape(len(signature), n_bands, rows)
    out = np.arange(n_bands, dtype=np.uint64)[None, :] * _ODD
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out + split[:, :, j] * _GOLD)
    return out


def _nodes_of(words: Words, owner, value) -> np.ndarray:
    """A fingerprint of each text's set of shingles."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(words.ptr) - 1, np.uint64)
        if len(owner):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            total[owner[first]] = np.add.reduceat(mix(value), first)
    return mix(total + _GOLD)


def sign(docs: DataFrame, weighted: bool = False, n_bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (uid, id, node, n, buckets). ``weighted``: shingles weigh their counts, not 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            for words in runs(batch["text"].tolist()):
                size = len(words.ptr) - 1
                owner, value, count = shingles(words)
                signed = signatures(owner, value, count if weighted else np.ones(len(count)), size, n_bands * rows)
                if weighted:
                    owner, value = occurrences(owner, value, count)
                n = np.bincount(owner, minlength=size)
                keys = bands(signed, n_bands, rows).view(np.int64)
                yield pd.DataFrame(
                    {
                        "uid": serial + np.arange(size),
                        "id": batch["id"].iloc[words.first : words.first + size].to_numpy(),
                        "node": _nodes_of(words, owner, value).view(np.int64),
                        "n": n,
                        "buckets": [list(k) if m else [] for k, m in zip(keys, n)],
                    }
                )
                serial += size

    some = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    signed = some.mapInPandas(run, "uid long, id string, node long, n long, buckets array<long>")
    return signed.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def _sets(texts: DataFrame, weighted: bool) -> DataFrame:
    """Shingle sets of some texts: (node, data), data being the sorted elements' bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words in runs(batch["text"].tolist()):
                owner, value, count = shingles(words)
                if weighted:
                    owner, value = occurrences(owner, value, count)
                cut = np.searchsorted(owner, np.arange(len(words.ptr)))
                data = [value[a:b].tobytes() for a, b in zip(cut, cut[1:])]
                yield pd.DataFrame({"node": _nodes_of(words, owner, value).view(np.int64), "data": data})

    return texts.mapInPandas(run, "node long, data binary")


def _linked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b), settled, whose sets have a Jaccard similarity of ``least`` or more.

    A leader b can be in most pairs: the few that are in over 1/1000 of them, whatever the input's size, are salted, and
    their sets repeated, so that no task gets more than about 1/1000.
    """
    share = F.lit(max(pairs.count(), HOT_SHARE) / HOT_SHARE)
    hot = pairs.groupBy("b").agg(F.count("*").alias("size")).filter(F.col("size") > share)
    hot = F.broadcast(hot.select("b", F.ceil(F.col("size") / share).cast("int").alias("salts")))
    salted = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(0)).alias("salt"))
    led = sets.select(F.col("node").alias("b"), F.col("data").alias("y")).join(hot, "b", "left")
    led = led.select("b", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1)).alias("salt"))
    both = salted.join(sets.select(F.col("node").alias("a"), F.col("data").alias("x")), "a").join(led, ["b", "salt"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = same >= least * (len(x) + len(y) - same) - 1e-9
            yield batch.loc[ok, ["a", "b"]]

    return both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _union_find(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The least node that each node of these edges is connected to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of some links (a, b): the least node that each is connected to.

    In each turn every node moves to its least neighbour and links are redrawn between the places moved to. Once their
    number is within ``SMALL_LINKS``, which bounds the task, one task ends the work.
    """
    edges = settle(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while (n := edges.count()) > SMALL_LINKS:
        ways = edges.union(edges.select("b", "a"))
        moves = settle(ways.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"), F.count("*").alias("degree")), "moves")
        step = moves.select("a", "to")
        label = step.toDF("node", "label") if label is None else _moved(label, step.toDF("label", "to"))
        half = settle(join_groups(edges, moves, "a", "degree").select("b", F.col("to").alias("x")), "half")
        ends = join_groups(half, moves.select(F.col("a").alias("b"), F.col("to").alias("y"), "degree"), "b", "degree").filter("x <> y")
        edges = settle(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        label = settle(label, "label")

    def end(_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = _union_find(zip(part["a"].tolist(), part["b"].tolist()))
        return pd.DataFrame({"node": list(found), "label": list(found.values())}, dtype="int64")

    last = edges.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(end, "node long, label long") if n or label is None else None
    if label is None:
        return last
    return _moved(label, last.toDF("label", "to")) if last is not None else label


def _moved(label: DataFrame, step: DataFrame) -> DataFrame:
    """Labels (node, label), settled, after some of them have moved (label, to). A label may be that of most nodes."""
    return look_up(label, step, "label").select("node", F.coalesce("to", "label").alias("label"))


def _finish(active: DataFrame, sets: DataFrame, least: float) -> DataFrame | None:
    """All links (a, b) that join components of small buckets (bucket, node, n, label), if there are any buckets.

    Buckets are dealt to tasks whose number grows with their members and the members' sets.
    """
    rows, elements = active.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not rows:
        return None
    n_parts = max(1, -(-rows // PART_MEMBERS), -(-8 * elements // PART_BYTES))
    first = active.groupBy("bucket").agg(F.min("node").alias("first")).select("bucket", F.pmod(F.xxhash64("first"), F.lit(n_parts)).alias("part"))
    dealt = settle(active.select("bucket", "node", "label").join(first, "bucket"), "dealt")
    data = settle(sets.join(dealt.select("part", "node").distinct(), "node"), "data")
    return dealt.groupBy("part").cogroup(data.groupBy("part")).applyInPandas(lambda members, known: _compare_all(members, known, least), "a long, b long")


def _compare_all(members: pd.DataFrame, data: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links that join components, bucket after bucket; one whose members are connected by then is passed over."""
    known = {n: np.frombuffer(d, np.uint64) for n, d in zip(data["node"].tolist(), data["data"])}
    parent: dict[int, int] = {}
    links = []

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for _, own in members.sort_values(["bucket", "node"]).groupby("bucket"):
        nodes, labels = own["node"].tolist(), own["label"].tolist()
        if len({find(x) for x in labels}) == 1:
            continue
        for i, j in _alike([known[n] for n in nodes], least):
            a, b = find(labels[i]), find(labels[j])
            if a != b:
                parent[a] = b
                links.append((nodes[i], nodes[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _alike(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """All pairs of these sets (sorted elements) with a Jaccard similarity of ``least`` or more."""
    m, size = len(sets), np.array([len(x) for x in sets], np.float32)
    if m == 2:
        same = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]])
    else:
        owner = np.repeat(np.arange(m), size.astype(int))
        _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[element] > 1
        _, column = np.unique(element[shared], return_inverse=True)
        owner, order = owner[shared], np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        same = np.zeros((m, m), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [a, a + COLUMNS])
            has = np.zeros((m, COLUMNS), np.float32)
            has[owner[lo:hi], column[lo:hi] - a] = 1
            same += has @ has.T
    linked = same >= least * (size[:, None] + size[None, :] - same) - 1e-6
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1)))))


def classes(
    docs: DataFrame, least: float = LEAST, weighted: bool = False, n_bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text", few: int = FEW,
) -> DataFrame:
    """One row per document: (uid, id, class_id, class_size, kept). Documents of a class are connected by links of
    similarity ``least`` or more; the one with the smallest id is kept. ``few``: members of a small bucket."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = settle(sign(docs, weighted, n_bands, rows, "id"), "signed")
    keyed = signed.withColumn("top", F.struct(F.col("id").isNull().alias("last"), "id", "uid"))
    firsts = [F.min("top").alias("top"), F.count("*").alias("docs"), F.first("n").alias("n"), F.first("buckets").alias("buckets")]
    nodes = settle(keyed.filter("n > 0").groupBy("node").agg(*firsts), "nodes")
    spread = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    busy = settle(spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "busy")
    members = settle(join_groups(spread, busy, "bucket", "size").select("bucket", "node", "n"), "members")
    some = settle(members.select("node").distinct(), "some")
    reps = nodes.join(some, "node", "left_semi").select("top.id")
    texts = docs.join(reps.select(F.col("id").alias("of")), F.col("id").eqNullSafe(F.col("of")), "left_semi").select("text")
    sets = settle(_sets(texts, weighted).join(some, "node", "left_semi").groupBy("node").agg(F.first("data").alias("data")), "sets")
    label = _rounds(members, settle(some.select("node", F.col("node").alias("label")), "label"), sets, least, few)
    named = settle(nodes.join(label, "node", "left").select("node", "top", "docs", F.coalesce("label", "node").alias("label")), "named")
    groups = named.groupBy("label").agg(F.min("top").alias("first"), F.sum("docs").alias("class_size"), F.count("*").alias("size"))
    of_node = join_groups(named, settle(groups, "groups"), "label", "size").select("node", "docs", "first", "class_size")
    found = join_groups(signed.filter("n > 0").select("uid", "id", "node"), settle(of_node, "of_node"), "node", "docs")
    found = found.select("uid", "id", F.col("first.id").alias("class_id"), "class_size", (F.col("first.uid") == F.col("uid")).alias("kept"))
    blank = signed.filter("n = 0").select("uid", "id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return found.unionByName(blank)


def _rounds(members: DataFrame, label: DataFrame, sets: DataFrame, least: float, few: int) -> DataFrame:
    """Labels (node, label) after all due comparisons within buckets."""
    turn = 0
    while True:
        placed = settle(members.join(label, "node"), "placed")
        state = placed.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"))
        state = settle(state.filter("lo <> hi").select("bucket", "size"), "state")
        if state.isEmpty():
            return label
        active = settle(join_groups(placed, state, "bucket", "size"), "active")
        if turn:
            links = _finish(active.filter(F.col("size") <= few), sets, least)
            label = label if links is None else _merge(label, settle(links, "links"))
            active = active.filter(F.col("size") > few)
        active = active.select("bucket", "node", "n", "label")
        if active.isEmpty():
            return label
        leaders = settle(leaders_of(active, turn), "leaders")
        links = settle(_linked(settle(_met(active, leaders, least), "pairs"), sets, least), "links")
        members = active.join(leaders.select("bucket", F.col("b").alias("node")), ["bucket", "node"], "left_anti").drop("label")
        label = _merge(label, links)
        turn += 1


def leaders_of(active: DataFrame, turn: int) -> DataFrame:
    """Leaders (bucket, b, m, of, size) of this turn: one for each part of a bucket's members, ``size`` being the part's."""
    n_parts = min(1 << turn, MOST_LEADERS)
    part = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(n_parts)).alias("part")
    found = active.groupBy("bucket", part).agg(F.min(F.struct("node", "n", "label")).alias("leader"), F.count("*").alias("size"))
    return found.select("bucket", F.col("leader.node").alias("b"), F.col("leader.n").alias("m"), F.col("leader.label").alias("of"), "size")


def _met(active: DataFrame, leaders: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of members with all their bucket's leaders that are not connected and may be alike."""
    met = join_groups(active, leaders, "bucket", "size", parts=True)
    alike = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    pairs = met.filter((F.col("label") != F.col("of")) & alike).select(F.col("node").alias("a"), "b")
    # Two leaders of a bucket meet twice.
    return pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).dropDuplicates(["lo", "hi"]).drop("lo", "hi")


def _merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """Settled labels after links between nodes."""
    if links.isEmpty():
        return label
    of = lambda side: label.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    ends = links.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    return settle(_moved(label, components(ends).toDF("label", "to")), "label")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays for each class."""
    ids = docs.agg(F.count("*"), F.countDistinct(id_col)).first()
    if ids[0] != ids[1]:  # null or repeated ids: number the rows
        row = free_name(docs, "row__")
        numbered = settle(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        first = numbered.select(F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col(row).alias("row")).alias("key"), F.col(text_col).alias("text"), row)
        found = classes(first.select(F.col(row).alias("doc_id"), "text"), **options)
        ranked = found.join(first.select("key", F.col(row).alias("id")), "id").groupBy("class_id").agg(F.min("key").alias("key"))
        return numbered.join(ranked.select(F.col("key.row").alias(row)), row, "left_semi").drop(row)
    of = free_name(docs, "kept_id__")
    kept = classes(docs, id_col=id_col, text_col=text_col, **options).filter("kept").select(F.col("id").alias(of))
    return docs.join(kept, F.col(id_col) == F.col(of), "left_semi")
