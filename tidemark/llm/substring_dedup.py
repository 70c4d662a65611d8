"""Substring dedup by prefix-partitioned suffix trees.

A suffix is the text from one word on. Suffixes are dealt to groups by word prefixes of variable length: a prefix is
lengthened, word by word, where its suffixes would exceed a group's memory. A group sorts its suffixes by their words,
cut at a depth of k words or more, and takes the common prefixes of neighbours: the intervals of neighbours that share k
words or more are the deep internal nodes of its subtree, the repeats. Matches are matches of words.

Suffixes that occur once can't be below a deep node, and most do. So a first round finds those that may occur again: a
chunk of documents sends short fingerprints of its suffixes' first k words, and the groups answer with one bit for
each, set where the fingerprint occurs twice. Only these suffixes go to the trees, as words, once for each chunk; a
false alarm costs space, nothing else. Documents are dealt to chunks by ranges of their ids, so the smallest chunk below
a node holds its first document, and the group answers each chunk with one bit for each of its suffixes: whether a
smaller chunk is below the same node. A passage that a third of all documents share costs one suffix for each chunk.
Texts are shuffled once; a document of any length stays whole. A chunk is read three times, and a shuffle gives its
rows in another order each time, so each reading puts them in order first: places of words mean the same in all.

Defined cases: null and empty texts have no words and lose none. A null id counts as the largest; rows that share an
id are one document's, so none of them is 'smaller'. Texts of under k words are left alone. Ids are of any type that
sorts. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .shared import text_or_empty
from .words import _STEP, Words, mix, runs

K = 13
#: Text of one chunk and of one group's suffixes, about; see ``sizes``.
CHUNK_CHARS = 12 << 20
GROUP_CHARS = 10 << 20
MAX_CHUNK_CHARS = 48 << 20
#: Bits of the first round's fingerprints: of a group's suffixes, about 1 in 300 has another's by chance.
CODE_BITS = 29
#: One text in so many is looked at for frequent prefixes, which only say how suffixes are dealt to groups.
PREFIX_SHARE = 8


def sizes(chars: int) -> tuple[int, int]:
    """Numbers of chunks and groups. Chunks grow with the root of the input, so that a chunk's part in a group, one
    row of the shuffle, keeps some hundred suffixes."""
    chunk = min(max(CHUNK_CHARS, int((chars * 2048) ** 0.5)), MAX_CHUNK_CHARS)
    return max(1, -(-chars // chunk)), max(1, -(-chars // GROUP_CHARS))


# Suffixes of a chunk


def _in_order(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A chunk's rows by id, then text, whatever order they came in, and the ranks of their ids."""
    rank, texts = _ranks(part["id"].to_numpy(), part["no_id"].to_numpy()), part["text"].tolist()
    each = rank.tolist()
    order = sorted(range(len(texts)), key=lambda i: (each[i], texts[i]))
    return part.iloc[order].reset_index(drop=True), rank[order]


def _ranks(ids: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Numbers in order of the ids; equal ids have one number, null ids the largest."""
    out = np.full(len(ids), len(ids))
    out[~none] = np.unique(ids[~none], return_inverse=True)[1]
    return out


def starts(words: Words, k: int) -> np.ndarray:
    """Where suffixes of k words or more begin."""
    room = np.repeat(words.ptr[1:], words.count) - np.arange(len(words.code)) >= k
    return np.flatnonzero(room[: max(len(words.code) - k + 1, 0)])


def fingerprints(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where suffixes of k words or more begin, and 60 bits of their first k words."""
    code, whole = words.windows(k)
    at = np.flatnonzero(whole)
    return at, code[at] >> np.uint64(4)


def prefixes(words: Words, at: np.ndarray, k: int, heavy: dict[int, np.ndarray]) -> np.ndarray:
    """The prefix by which each suffix is dealt to a group.

    ``heavy``: by length, the sorted prefixes that are too frequent for one group and so are lengthened.
    """
    total, weight = words.code[at], np.uint64(1)
    key, left = mix(total), np.arange(len(at))
    with np.errstate(over="ignore"):
        for p in range(1, k):
            left = left[_among(key[left], heavy.get(p))]
            if not len(left):
                break
            weight = weight * _STEP
            total[left] += words.code[at[left] + p] * weight
            key[left] = mix(total[left] + np.uint64(p))
    return key


def _among(values: np.ndarray, some: np.ndarray | None) -> np.ndarray:
    if some is None or not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _groups(words: Words, at: np.ndarray, k: int, heavy: dict[int, np.ndarray], n_groups: int) -> np.ndarray:
    """The group of each suffix; short integers sort by radix."""
    return (prefixes(words, at, k, heavy) % np.uint64(n_groups)).astype(np.uint16 if n_groups <= 1 << 16 else np.uint32)


def heavy_prefixes(texts: DataFrame, n_groups: int, k: int = K, depth: int = 6, share_of: int = PREFIX_SHARE) -> dict[int, np.ndarray]:
    """Prefixes of more than half a group's share of all suffixes; there are at most 2 * n_groups for each length.

    They are found in one text of ``share_of``, and only balance groups: results are the same whatever they are. Tasks
    leave out prefixes that are rare in their own run of text, so a frequency can fall short by half a group.
    """
    if n_groups == 1:
        return {}
    share = 0.5 / n_groups

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for words in runs(batch["text"].tolist()):
                at = starts(words, k)
                total, weight, least = words.code[at].copy(), np.uint64(1), max(2, int(len(at) * share / 2))
                key, index = mix(total), np.arange(len(at))
                yield pd.DataFrame({"p": [0], "code": [0], "n": [len(at)]})
                with np.errstate(over="ignore"):
                    for p in range(1, depth + 1):
                        found, which, n = np.unique(key, return_inverse=True, return_counts=True)
                        often = n >= least
                        if not often.any():
                            break
                        yield pd.DataFrame({"p": p, "code": found[often].view(np.int64), "n": n[often]})
                        index = index[often[which]]
                        weight = weight * _STEP
                        total[index] += words.code[at[index] + p] * weight
                        key = mix(total[index] + np.uint64(p))

    some = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share_of)) == 0) if share_of > 1 else texts
    counted = some.mapInPandas(count, "p int, code long, n long").groupBy("p", "code").agg(F.sum("n").alias("n"))
    whole = counted.filter("p = 0").agg(F.sum("n")).first()[0] or 0
    rows = counted.filter((F.col("p") > 0) & (F.col("n") > F.lit(max(1.0, whole * share)))).select("p", "code").collect()
    return {p: np.sort(np.array([r["code"] for r in rows if r["p"] == p], np.int64).view(np.uint64)) for p in range(1, depth + 1)}


class _Codes:
    """The distinct fingerprints of one chunk's suffixes, with their groups."""

    def __init__(self, texts: list, k: int, heavy: dict[int, np.ndarray], n_groups: int):
        places, codes, keys, base = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)], 0
        for words in runs(texts):
            at, code = fingerprints(words, k)
            places.append(at + base)
            codes.append(code)
            keys.append(_groups(words, at, k, heavy, n_groups))
            base += len(words.code)
        self.place, self.words, code, group = np.concatenate(places), base, np.concatenate(codes), np.concatenate(keys)
        order = np.argsort(code)
        ranked, dealt = code[order], group[order]
        if ((ranked[1:] == ranked[:-1]) & (dealt[1:] != dealt[:-1])).any():  # by chance: each group is told
            order = np.lexsort((group, code))
            ranked, dealt = code[order], group[order]
        first = np.ones(len(ranked), bool)
        first[1:] = (ranked[1:] != ranked[:-1]) | (dealt[1:] != dealt[:-1])
        self.node = np.empty(len(code), np.int64)  # each suffix's fingerprint among the distinct ones
        self.node[order] = np.cumsum(first) - 1
        self.code, self.group = ranked[first], dealt[first]
        self.by_group = np.argsort(self.group, kind="stable")

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each group with its fingerprints' places, in order."""
        yield from _cut(self.group[self.by_group], self.by_group)


def _cut(group: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted groups, each with its part of ``places``."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    for a, b in zip(edge, np.append(edge[1:], len(group))):
        yield int(group[a]), places[a:b]


def _pack(codes: np.ndarray) -> tuple[int, int, bytes]:
    """Sorted values as their differences, in the fewest bits that hold the largest: (number, bits, data)."""
    step = np.diff(codes, prepend=np.uint64(0))
    width = max(1, int(step.max()).bit_length())
    return len(codes), width, np.packbits((step[:, None] >> np.arange(width, dtype=np.uint64)).astype(np.uint8) & 1).tobytes()


def _unpack(n: int, width: int, data: bytes) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.cumsum(bits @ (np.uint64(1) << np.arange(width, dtype=np.uint64)), dtype=np.uint64)


def _again(parts: pd.DataFrame) -> Iterator[tuple[int, bytes]]:
    """For each chunk's fingerprints in this group: whether they occur twice here."""
    values = [_unpack(*x) for x in zip(parts["n"], parts["width"], parts["data"])]
    codes = np.concatenate(values)
    order = np.argsort(codes)
    ranked, again = codes[order], np.zeros(len(codes), bool)
    same = ranked[1:] == ranked[:-1]
    again[order[1:]] |= same
    again[order[:-1]] |= same
    at = 0
    for chunk, v in zip(parts["chunk"], values):
        bits = again[at : at + len(v)]
        at += len(v)
        if bits.any():
            yield chunk, np.packbits(bits).tobytes()


class _Suffixes:
    """Suffixes at some places of a chunk's texts, as words joined by spaces, up to ``depth`` words or the text's end.

    Equal ones are one, numbered by group, then by words. ``number``: each place's; ``ptr``: where texts begin.
    """

    def __init__(self, texts: list, chosen: np.ndarray, k: int, heavy: dict[int, np.ndarray], n_groups: int, depth: int):
        seen: dict[bytes, int] = {}
        numbers, keys, places, ptr, base = [], [], [], [np.zeros(1, np.int64)], 0
        for words in runs(texts):
            n = len(words.code)
            ptr.append(words.ptr[1:] + base)
            at = np.flatnonzero(chosen[base : base + n])
            if len(at):
                plain, ends = _plain(words)
                last = np.minimum(at + depth, np.repeat(words.ptr[1:], words.count)[at]) - 1
                known, found = len(seen), []
                for a, b in zip((ends[at] - (words.end - words.start)[at]).tolist(), ends[last].tolist()):
                    found.append(seen.setdefault(plain[a:b], len(seen)))
                found = np.array(found, np.int64)
                new, where = np.unique(found, return_index=True)
                where = where[new >= known]
                keys.append(_groups(words, at[where], k, heavy, n_groups))
                numbers.append(found)
                places.append(at + base)
            base += n
        self.ptr, none = np.concatenate(ptr), np.zeros(0, np.int64)
        group, strings = np.concatenate([none.astype(np.uint16), *keys]), list(seen)
        order = []
        by_group = np.argsort(group, kind="stable")
        for _, mine in _cut(group[by_group], by_group):
            order += sorted(mine.tolist(), key=strings.__getitem__)
        rank = np.empty(len(strings), np.int64)
        rank[order] = np.arange(len(strings))
        self.place, self.number = np.concatenate([none, *places]), rank[np.concatenate([none, *numbers])]
        self.group = group[order]
        self.strings = [strings[i] for i in order]

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        yield from _cut(self.group, np.arange(len(self.group)))


def _plain(words: Words) -> tuple[bytes, np.ndarray]:
    """The words joined by one space each, and where each ends."""
    return b" ".join(words.raw.split()), np.cumsum(words.end - words.start + 1) - 1


# Subtrees of a group


def common_words(a: bytes, b: bytes) -> int:
    """Number of words that two suffixes share from the start."""
    if a == b:
        return a.count(b" ") + 1
    n = 0
    for x, y in zip(a.split(b" "), b.split(b" ")):
        if x != y:
            break
        n += 1
    return n


def deep_nodes(suffixes: list[bytes], k: int) -> list[tuple[int, int, int]]:
    """Internal nodes of depth k or more of the tree of these sorted suffixes: (depth, first, behind the last), each
    before those below it. Equal suffixes are a node of their own length."""
    out, stack = [], []  # of open intervals: (depth, first)
    for i in range(1, len(suffixes) + 1):
        shared = common_words(suffixes[i - 1], suffixes[i]) if i < len(suffixes) else 0
        begin = i - 1
        while stack and stack[-1][0] > shared:
            depth, begin = stack.pop()
            out.append((depth, begin, i))
        if shared >= k and (not stack or stack[-1][0] < shared):
            stack.append((shared, begin))
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def top_nodes(suffixes: list[bytes], k: int) -> np.ndarray:
    """For each of these sorted suffixes the number of its deepest-reaching group of neighbours that share k words: the
    node of depth k or more nearest to the root. Suffixes here have k words, or more."""
    heads = [s if s.count(b" ") < k else b" ".join(s.split(b" ", k)[:k]) for s in suffixes]
    new = np.fromiter((a != b for a, b in zip(heads[1:], heads)), bool, max(len(heads) - 1, 0))
    return np.concatenate([[0], np.cumsum(new)]) if len(heads) else np.zeros(0, np.int64)


def _later(parts: pd.DataFrame, k: int) -> Iterator[tuple[int, bytes]]:
    """For each chunk's suffixes in this group: whether a smaller chunk has one below the same deep node."""
    parts = parts.sort_values("chunk")
    unpack = zstandard.ZstdDecompressor()
    each = [unpack.decompress(d).split(b"\n") for d in parts["data"]]
    chunk = np.repeat(parts["chunk"].to_numpy(), [len(e) for e in each])
    flat = [s for e in each for s in e]
    order = sorted(range(len(flat)), key=flat.__getitem__)  # runs are sorted already, and of equals the smallest chunk is first
    node = top_nodes([flat[i] for i in order], k)
    order = np.array(order, np.int64)
    owner = np.full(int(node[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(owner, node, chunk[order])
    later = np.zeros(len(flat), bool)
    later[order] = owner[node] < chunk[order]
    at = 0
    for c, e in zip(parts["chunk"], each):
        bits = later[at : at + len(e)]
        at += len(e)
        if bits.any():
            yield c, np.packbits(bits).tobytes()


# The jobs


def _parts_of(spark: SparkSession, n: int) -> int:
    """Partitions for ``n`` keys, each to have its own."""
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _apart(spark: SparkSession, n: int, kind: str = "int") -> list[int]:
    """``n`` ascending numbers that Spark's hash deals to a partition each, or nearly."""
    n_parts = _parts_of(spark, n)
    tried = spark.range(n_parts * (8 + n_parts.bit_length())).select(F.col("id").cast(kind).alias("key"))
    first = tried.groupBy(F.pmod(F.hash("key"), F.lit(n_parts)).alias("part")).agg(F.min("key").alias("key"))
    found = {r["key"] for r in first.orderBy("key").limit(n).collect()}
    for key in range(n):
        if len(found) < n:
            found.add(key)
    return sorted(found)


def _dealt(texts: DataFrame, n_chunks: int) -> DataFrame:
    """(chunk, no_id, id, text): chunks are ranges of ids, null ids in the last; each has a partition of its own.

    The numbers of chunks ascend with the ids, and are such that no two chunks hash to one partition.
    """
    spark, id_type = texts.sparkSession, texts.schema["id"].dataType
    known = texts.filter("id is not null").select("id")
    bounds: list = []
    if n_chunks > 1:  # the largest id of each range but the last
        ranges = known.repartitionByRange(n_chunks, "id").select("id", F.spark_partition_id().alias("p"))
        bounds = sorted(r["most"] for r in ranges.groupBy("p").agg(F.max("id").alias("most")).collect())[:-1]
    chunk = F.lit(0)
    if bounds:
        table, steps = F.array(*[F.lit(b).cast(id_type) for b in bounds]), [1 << b for b in reversed(range(len(bounds).bit_length()))]

        def search(at: Column, step: Column) -> Column:  # how many bounds are smaller than the id
            return F.when((at + step <= len(bounds)) & (F.get(table, at + step - 1) < F.col("id")), at + step).otherwise(at)

        chunk = F.when(F.col("id").isNull(), F.lit(len(bounds))).otherwise(F.aggregate(F.lit(steps), F.lit(0), search))
    chunk = F.get(F.lit(_apart(spark, len(bounds) + 1)), chunk)
    # pandas would make floats of numbers with nulls among them.
    id_ = F.coalesce("id", F.lit(0).cast(id_type)) if isinstance(id_type, NumericType) else F.col("id")
    dealt = texts.select(chunk.alias("chunk"), F.col("id").isNull().alias("no_id"), id_.alias("id"), "text")
    return dealt.repartition(_parts_of(spark, len(bounds) + 1), "chunk")


def _by_group(sent: DataFrame, n_groups: int):
    """Messages by group; groups are named so that no two hash to one partition."""
    return sent.repartition(_parts_of(sent.sparkSession, n_groups), "group").groupBy("group")


def _suspects(dealt: DataFrame, k: int, heavy: dict[int, np.ndarray], names: list[int]) -> DataFrame:
    """(chunk, group, bits): which of a chunk's fingerprints occur again in their group."""
    drop = np.uint64(60 - CODE_BITS)

    def send(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        own = _Codes(_in_order(part)[0]["text"].tolist(), k, heavy, len(names))
        out = [(names[group], int(key[0]), *_pack(own.code[places] >> drop)) for group, places in own.parts()]
        return pd.DataFrame(out, columns=["group", "chunk", "n", "width", "data"])

    def match(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(chunk, int(key[0]), bits) for chunk, bits in _again(parts)], columns=["chunk", "group", "bits"])

    sent = dealt.groupBy("chunk").applyInPandas(send, "group long, chunk int, n int, width int, data binary")
    return _by_group(sent, len(names)).applyInPandas(match, "chunk int, group long, bits binary")


def _chosen(texts: list, told: pd.DataFrame, k: int, heavy: dict[int, np.ndarray], names: list[int]) -> np.ndarray:
    """For each word of a chunk, whether the suffix from it on goes to the trees."""
    own = _Codes(texts, k, heavy, len(names))
    again, bits = np.bincount(own.node, minlength=len(own.code)) > 1, dict(zip(told["group"], told["bits"]))
    for group, places in own.parts():
        if names[group] in bits:
            again[places] |= np.unpackbits(np.frombuffer(bits[names[group]], np.uint8), count=len(places)).astype(bool)
    chosen = np.zeros(own.words, bool)
    chosen[own.place[again[own.node]]] = True
    return chosen


def remove_repeats(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Remove every word covered by a k-word window that also starts in a document with a smaller id.

    Columns: the id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space), ``spans`` (runs of
    removed words, end exclusive) and, if asked for, the kept ``text``.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    rows, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_chunks, n_groups = sizes(chars)
    heavy = heavy_prefixes(texts.select("text"), n_groups, k)
    dealt, names = _dealt(texts, min(n_chunks, max(rows, 1))), _apart(docs.sparkSession, n_groups, "long")

    def send(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """The chunk's suffixes for the trees by group, and for itself, as a group below 0, which they are."""
        texts, chunk = _in_order(part)[0]["text"].tolist(), int(key[0])
        chosen = _chosen(texts, told, k, heavy, names)
        own, packer = _Suffixes(texts, chosen, k, heavy, n_groups, k), zstandard.ZstdCompressor(level=3)
        out = [(names[group], chunk, packer.compress(b"\n".join(own.strings[places[0] : places[-1] + 1]))) for group, places in own.parts()]
        return pd.DataFrame([*out, (-1 - chunk, chunk, packer.compress(np.packbits(chosen).tobytes()))], columns=["group", "chunk", "data"])

    def grow(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        found = zip(parts["chunk"], parts["data"]) if group < 0 else _later(parts, k)
        return pd.DataFrame([(chunk, group, bits) for chunk, bits in found], columns=["chunk", "group", "bits"])

    def cut(part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        part, rank = _in_order(part)
        texts, bits = part["text"].tolist(), dict(zip(told["group"], told["bits"]))
        mask = bits.get(-1 - int(part["chunk"].iloc[0]))
        chosen = np.zeros(0, bool) if mask is None else np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(mask), np.uint8)).astype(bool)
        own = _Suffixes(texts, chosen, k, heavy, n_groups, k)
        later = np.zeros(len(own.strings), bool)
        for group, places in own.parts():
            if names[group] in bits:
                later[places] = np.unpackbits(np.frombuffer(bits[names[group]], np.uint8), count=len(places)).astype(bool)
        covered = _covered(own, later, rank, k)
        out = []
        for i, text in enumerate(texts):
            mine = covered[own.ptr[i] : own.ptr[i + 1]]
            words = text.encode("utf-8", "surrogatepass").split()
            kept = b" ".join(compress(words, (~mine).tolist()) if mine.any() else words)
            turn = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(turn[0::2], turn[1::2])]
            out.append((len(words), int(mine.sum()), hashlib.sha256(kept).hexdigest(), spans, *([kept.decode("utf-8", "surrogatepass")] if with_text else [])))
        columns = ["n_words", "n_removed", "kept_sha256", "spans", *(["text"] if with_text else [])]
        return pd.concat([part[["no_id", "id"]], pd.DataFrame(out, columns=columns)], axis=1)

    suspects = _suspects(dealt, k, heavy, names)
    sent = dealt.groupBy("chunk").cogroup(suspects.groupBy("chunk")).applyInPandas(send, "group long, chunk int, data binary")
    told = _by_group(sent, n_groups).applyInPandas(grow, "chunk int, group long, bits binary")
    schema = f"no_id boolean, id {id_type}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + (", text string" if with_text else "")
    done = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(cut, schema)
    return done.select(F.when(~F.col("no_id"), F.col("id")).alias(id_col), *[c for c in done.columns if c not in ("no_id", "id")])


def _covered(own: _Suffixes, later: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """For each word, whether a window covers it that also starts in a document before its own: in another chunk
    (``later``) or in this one."""
    owner = rank[np.searchsorted(own.ptr, own.place, side="right") - 1]
    least = np.full(len(own.strings), len(rank) + 1)
    np.minimum.at(least, own.number, owner)
    gone = own.place[later[own.number] | (least[own.number] < owner)]
    size = int(own.ptr[-1]) + 1
    edge = np.bincount(gone, minlength=size).astype(np.int32) - np.bincount(gone + k, minlength=size).astype(np.int32)
    return np.cumsum(edge)[:-1] > 0


def maximal_repeats(docs: DataFrame, k: int = K, depth: int = 64, text_col: str = "text") -> DataFrame:
    """All maximal repeats of k words or more: (words, n_words, occurrences, is_cut).

    A repeat occurs twice or more, and no word before it or behind it is the same at all its occurrences. Trees are cut
    at ``depth`` words: a repeat of that length may go on (``is_cut``), and then stands for all repeats that begin so.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("id"), text_or_empty(text_col).alias("text"))
    rows, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    n_chunks, n_groups = sizes(chars)
    heavy = heavy_prefixes(texts.select("text"), n_groups, k)
    dealt, names = _dealt(texts, min(n_chunks, max(rows, 1))), _apart(docs.sparkSession, n_groups, "long")

    def send(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        texts, chunk = _in_order(part)[0]["text"].tolist(), int(key[0])
        own = _Suffixes(texts, _chosen(texts, told, k, heavy, names), k, heavy, n_groups, depth)
        before = _words_before(texts, own)
        out = []
        for group, places in own.parts():
            lines = [b"%s\t%d\t%s" % (own.strings[i], *before[i]) for i in places.tolist()]
            out.append((names[group], chunk, zstandard.ZstdCompressor(level=3).compress(b"\n".join(lines))))
        return pd.DataFrame(out, columns=["group", "chunk", "data"])

    def grow(parts: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        lines = sorted(tuple(x.split(b"\t")) for d in parts["data"] for x in unpack.decompress(d).split(b"\n"))
        found = [(w.decode("utf-8", "surrogatepass"), n, times, n == depth) for w, n, times in repeats(lines, k)]
        return pd.DataFrame(found, columns=["words", "n_words", "occurrences", "is_cut"])

    suspects = _suspects(dealt, k, heavy, names)
    sent = dealt.groupBy("chunk").cogroup(suspects.groupBy("chunk")).applyInPandas(send, "group long, chunk int, data binary")
    return _by_group(sent, n_groups).applyInPandas(grow, "words string, n_words int, occurrences long, is_cut boolean")


#: Stands for different words before a suffix, or none; no word has a space.
MANY = b" "


def _words_before(texts: list, own: _Suffixes) -> list[tuple[int, bytes]]:
    """For each distinct suffix, how often it occurs and the word before it, or ``MANY``."""
    words = [w for t in texts for w in t.encode("utf-8", "surrogatepass").split()]
    begins, out = set(own.ptr.tolist()), [(0, b"")] * len(own.strings)
    for place, i in zip(own.place.tolist(), own.number.tolist()):
        before = MANY if place in begins else words[place - 1]
        n, known = out[i]
        out[i] = (n + 1, before if n == 0 or known == before else MANY)
    return out


def repeats(lines: list[tuple[bytes, bytes, bytes]], k: int) -> list[tuple[bytes, int, int]]:
    """The maximal repeats (words, number of words, occurrences) among sorted suffixes (words, occurrences, word before):
    the deep nodes of their tree that different words precede."""
    each = [line for line in lines for _ in range(min(int(line[1]), 2))]  # a suffix that occurs twice is a node
    times = [int(t) for _, t, _ in lines for _ in (range(1) if t == b"1" else range(2))]
    first = np.cumsum([0, *[n if i == 0 or each[i] is not each[i - 1] else 0 for i, n in enumerate(times)]])
    out = []
    for depth, a, b in deep_nodes([x[0] for x in each], k):
        before = {x[2] for x in each[a:b]}
        if len(before) > 1 or MANY in before:
            out.append((b" ".join(each[a][0].split(b" ")[:depth]), depth, int(first[b] - first[a])))
    return out
