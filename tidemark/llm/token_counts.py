"""Exact token counts: a histogram of encoded lengths whose suffix sums answer every context limit.

Each batch of texts is encoded and reduced to (length, documents) at once, so the shuffle carries at most one row for
each distinct length and batch. Suffix sums run over blocks of lengths, then inside each block.

Defined cases: a null text has length 0, as an empty one. Ids and other columns are ignored. An empty table gives an
empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_paths, shared_bpe
from .shared import settle

BLOCK = 1024


def lengths(docs: DataFrame, text_col: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """Histogram (length, n_docs) of the number of ids of each text."""
    paths = paths or default_paths()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = shared_bpe(*paths)
        for batch in batches:
            found = [np.diff(ptr) for _, _, ptr in coder.encode(batch["text"].tolist())]
            size, n = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            yield pd.DataFrame({"length": size.astype(np.int64), "n_docs": n.astype(np.int64)})

    some = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "length long, n_docs long")
    return some.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens in texts of L ids or more, the total if texts are cut at L, and the
    share of texts of at most L ids (L is that quantile's value)."""
    block = F.floor(F.col("length") / BLOCK)
    # Read twice, so it is written first: else every text would be encoded twice. It has one row for each length.
    rows = settle(histogram.withColumn("block", block).withColumn("tokens", F.col("length") * F.col("n_docs")), "histogram")
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    sums = sums.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t"),
        F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, "block").withColumn("docs_at_least", F.col("d") + F.sum("n_docs").over(inside)).withColumn("tokens_at_least", F.col("t") + F.sum("tokens").over(inside))
    shorter = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    return out.select(
        "length", "n_docs", F.col("tokens").alias("n_tokens"), "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_total"),
        (shorter / F.col("all_docs")).alias("share_at_most"), "all_docs", "all_tokens",
    )


def answer(histogram: DataFrame, limits: list[int] = (), quantiles: list[float] = ()) -> dict:
    """Totals, truncated totals at the given limits and lengths at the given quantiles, of an (n_docs, length) histogram.

    Only one row for each limit or quantile reaches the driver.
    """
    sums = with_suffix_sums(histogram)
    total = histogram.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0))).first()
    asks = [F.sum(F.least(F.col("length"), F.lit(k)) * F.col("n_docs")).alias(f"cut_{i}") for i, k in enumerate(limits)]
    cut = histogram.agg(*asks).first() if asks else []
    at = [F.min(F.when(F.col("share_at_most") >= q, F.col("length"))) for q in quantiles]
    values = sums.agg(*at).first() if at else []
    return {"docs": total[0], "tokens": total[1], "truncated": {k: v or 0 for k, v in zip(limits, cut)}, "quantiles": dict(zip(quantiles, values))}
