"""Best-fit packing: hierarchical residual packing of token pieces into sequences of fixed room.

Pieces are dealt to parts of bounded size. Each part packs its pieces best-fit, longest first, and closes its bins but
the emptiest few. These become items of the parent part, where best-fit runs again, up to one root. After best-fit no
two bins of a part fit together, so at most one is half empty or more; a parent of f parts can then merge at most f
bins, and passing on the f + 1 emptiest of each loses nothing.

Defined cases: a null text counts as an empty one and still has its end token. Repeated rows are packed as often as
they occur. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_paths, shared_bpe
from .shared import settle

ROOM = 2048
PART_ITEMS = 16384
FAN_IN = 8


def pieces(docs: DataFrame, room: int = ROOM, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """Token pieces of all texts: (uid, id, piece, start, length, ids_crc32) and the ids themselves if asked for."""
    paths = paths or default_paths()
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, serial = shared_bpe(*paths), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            keys = batch["id"].tolist()
            for first, flat, ptr in coder.encode(batch["text"].tolist()):
                rows: list[tuple] = []
                for i in range(len(ptr) - 1):
                    ids = np.append(flat[ptr[i] : ptr[i + 1]], np.uint32(end_id)).astype("<u4")
                    head = len(ids) % room or min(room, len(ids))
                    bounds = [0, *range(head, len(ids) + 1, room)]
                    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        own = [ids[a:b].astype(np.int64)] if keep_ids else []
                        rows.append((serial, keys[first + i], k, a, b - a, zlib.crc32(ids[a:b].tobytes()), *own))
                        serial += 1
                yield pd.DataFrame(rows, columns=["uid", "id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])

    schema = "uid long, id string, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    # Ids as text: with a null among them pandas would make them floats.
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, schema)
    return found.withColumn("id", F.col("id").cast(id_type))


def best_fit(sizes: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit in the order given: bin and offset of each item, and how full each bin is."""
    where, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]  # by room left
    mask = 0
    for i, size in enumerate(sizes.tolist()):
        ahead = mask >> size
        if ahead:
            left = size + (ahead & -ahead).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                mask &= ~(1 << left)
        else:
            left, b = room, len(fill)
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += size
        left -= size
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return where, offset, np.asarray(fill, np.int64)


def _pack_part(room: int, carry: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        where, offset, fill = best_fit(part["length"].to_numpy(), room)
        names = part["uid"].to_numpy()[np.unique(where, return_index=True)[1]]  # a bin is named after its first item
        up = np.zeros(len(fill), bool)
        up[np.argsort(fill, kind="stable")[:carry]] = True
        up &= fill < room
        return pd.DataFrame({"uid": part["uid"], "bin": names[where], "shift": offset, "fill": fill[where], "up": up[where], "part": int(key[0])})

    return run


def place(items: DataFrame, room: int = ROOM, part_items: int = PART_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Pack settled items (uid, length) with length under ``room``: (uid, bin, offset)."""
    n_parts = max(1, -(-items.count() // part_items))
    out = "uid long, bin long, shift long, fill long, up boolean, part long"
    dealt = items.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(n_parts)).alias("part"))
    placed = settle(dealt.groupBy("part").applyInPandas(_pack_part(room, fan_in + 1), out), "packed")
    result = placed.select("uid", "bin", F.col("shift").alias("offset"))
    moved, level = placed.filter("up").groupBy("bin").agg(F.first("fill").alias("length"), F.first("part").alias("part")), n_parts
    final = None
    while level > 1:
        level = -(-level // fan_in)
        merged = moved.select(F.col("bin").alias("uid"), "length", F.floor(F.col("part") / fan_in).alias("part")).groupBy("part").applyInPandas(_pack_part(room, fan_in + 1), out)
        merged = settle(merged, "merged")
        step = merged.select(F.col("uid").alias("from"), F.col("bin").alias("to"), F.col("shift").alias("by"))
        if final is None:
            final = step.select(F.col("from").alias("bin"), F.col("to").alias("root"), F.col("by").alias("add"))
        else:
            chained = final.join(step, final["root"] == step["from"], "left")
            final = settle(chained.select("bin", F.coalesce("to", "root").alias("root"), (F.col("add") + F.coalesce("by", F.lit(0))).alias("add")), "chain")
        moved = merged.filter("up").groupBy("bin").agg(F.first("fill").alias("length"), F.first("part").alias("part"))
    if final is None:
        return result
    return result.join(final, "bin", "left").select("uid", F.coalesce("root", "bin").alias("bin"), (F.col("offset") + F.coalesce("add", F.lit(0))).alias("offset"))


def pack(docs: DataFrame, room: int = ROOM, **options) -> DataFrame:
    """All pieces with their place: (id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    id_col = options.get("id_col", "doc_id")
    cut = settle(pieces(docs, room, **options), "pieces")
    full = cut.filter(F.col("length") == room).select("*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut.filter(F.col("length") < room)
    placed = place(short.select("uid", "length"), room)
    rest = short.join(placed, "uid").withColumnRenamed("bin", "sequence_id")
    return full.unionByName(rest).drop("uid").withColumnRenamed("id", id_col)
