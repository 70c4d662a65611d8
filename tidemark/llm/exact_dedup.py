"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest, a sort-merge anti-join
against the index leaves the digests not yet seen, and these are appended. Only digests and ids are shuffled, never
texts. Rows of the index carry their batch: a batch that is run again, after an output was lost, finds what it appended
itself as new, keeps the same documents and appends nothing twice.

Defined cases: a null text counts as an empty one. A null id sorts after all others. Rows that repeat both id and text
are copies too: one of them stays. Columns other than the id and the text are ignored. An empty batch appends nothing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .shared import SPACE_RX, free_name, join_groups, remove, scratch_path, settle, text_or_empty


def normal_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text in UTF-8 with each run of white space replaced by one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, SPACE_RX, " "), 256))


class DigestIndex:
    """Digests seen so far, each with the id that stays and the batch that brought it, in ``buckets`` sorted buckets at
    ``path``.

    The files outlive the session: opening the same path later finds them again.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def seen(self, batch: str) -> DataFrame:
        """Digests of other batches (digest, keep_id)."""
        return self.table().filter(F.col("batch") != batch).select("digest", "keep_id")

    def append(self, new: DataFrame, batch: str) -> None:
        """Add rows (digest, keep_id) of a batch, but those that an earlier run of the batch has added."""
        own = self.table().filter(F.col("batch") == batch).select("digest")
        new = new.select("digest", "keep_id")
        if not own.isEmpty():
            new = new.join(own.hint("merge"), "digest", "left_anti")
        new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "digest").write.insertInto(self.name)

    def drop(self) -> None:
        """Forget the index and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Settled (id, digest, tie) of every row."""
    found = docs.select(F.col(id_col).alias("id"), normal_digest(text_or_empty(text_col)).alias("digest"))
    return settle(found.withColumn("tie", F.monotonically_increasing_id()), "digests")


def _groups(rows: DataFrame) -> DataFrame:
    """(digest, group_size, first_id, first_tie, n_same): the row that stays is the first by id; ``n_same`` rows are as it."""
    same = rows.groupBy("digest", "id").agg(F.count("*").alias("n_same"), F.min("tie").alias("tie"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "tie", "n_same")).alias("first")
    groups = same.groupBy("digest").agg(first, F.sum("n_same").alias("group_size"))
    return groups.select("digest", "group_size", F.col("first.id").alias("first_id"), F.col("first.tie").alias("first_tie"), F.col("first.n_same").alias("n_same"))


def admit(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The batch's groups, settled, with ``fresh`` (no other batch has the digest) and ``keep_id``; fresh ones are appended."""
    groups, seen = _groups(rows), index.seen(batch)
    fresh = groups.join(seen.hint("merge"), "digest", "left_anti").select("*", F.lit(True).alias("fresh"), F.col("first_id").alias("keep_id"))
    known = groups.join(seen.hint("merge"), "digest").select(*groups.columns, F.lit(False).alias("fresh"), "keep_id")
    groups = settle(fresh.unionByName(known), "groups")
    index.append(groups.filter("fresh"), batch)
    return groups


def _assigned(rows: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    out = join_groups(rows, groups, "digest", "group_size")
    return out.select(F.col("id").alias(id_col), "digest", "keep_id", "group_size", "n_same", (F.col("fresh") & (F.col("tie") == F.col("first_tie"))).alias("kept"))


def assign(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch against the index, append what is new, and return one row per document.

    Columns: the id, ``digest`` (binary), ``keep_id`` (the id that stays, perhaps of another batch), ``group_size``
    (equal texts in this batch), ``n_same`` (rows equal in id and text), ``kept``. ``batch`` names this data: a new name
    for new data, the same name to run again.
    """
    rows = digests(docs, id_col, text_col)
    return _assigned(rows, admit(rows, index, batch), id_col)


def assign_in_batches(docs: DataFrame, index: DigestIndex, n_batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``assign`` for a whole table that goes through the index in batches by ascending id, as data that
    arrive over time do; ``group_size`` counts the whole table.

    Batches are cut at quantiles of numeric ids (null ids are in the last); a table of other ids is one batch.
    """
    rows = digests(docs, id_col, text_col)
    cuts: list = []
    if n_batches > 1 and isinstance(rows.schema["id"].dataType, NumericType):
        cuts = rows.agg(F.percentile_approx("id", [i / n_batches for i in range(1, n_batches)])).first()[0] or []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + F.when(F.col("id") <= cut, 0).otherwise(1)
    admitted = None
    for i in range(len(set(cuts)) + 1):
        groups = admit(rows.filter(number == i) if cuts else rows, index, f"part-{i}")
        admitted = groups if admitted is None else admitted.unionByName(groups)
    # Of each digest one batch is fresh; its row and id stay, and all batches count.
    fresh = F.max_by(F.struct("first_tie", "n_same", "keep_id", "fresh"), F.col("fresh").cast("int"))
    whole = admitted.groupBy("digest").agg(fresh.alias("f"), F.sum("group_size").alias("group_size"))
    return _assigned(rows, settle(whole.select("digest", "group_size", "f.*"), "whole"), id_col)


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batch: str = "all", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of equal texts the one with the smallest id.

    Without an index the documents are a corpus of their own: its index is deleted again.
    """
    own = index or new_index(docs, id_col)
    found = assign(docs, own, batch, id_col, text_col) if index else assign_in_batches(docs, own, 2, id_col, text_col)
    kept = settle(found.filter("kept").select(F.col(id_col).alias("__id"), F.col("digest").alias("__digest"), "n_same"), "kept")
    if not index:
        own.drop()
    key = free_name(docs, "digest__")
    named = docs.withColumn(key, normal_digest(text_or_empty(text_col)))

    def pick(some: DataFrame) -> DataFrame:
        return named.join(some, named[id_col].eqNullSafe(some["__id"]) & (named[key] == some["__digest"]), "left_semi")

    out = pick(kept.filter("n_same = 1")).drop(key)
    if kept.filter("n_same > 1").isEmpty():
        return out
    again = pick(kept.filter("n_same > 1")).groupBy(id_col, key).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return out.unionByName(again.select("row.*"))


def new_index(docs: DataFrame, id_col: str = "doc_id") -> DigestIndex:
    """An empty index in the shared folder, with as many buckets as the session has shuffle partitions."""
    spark = docs.sparkSession
    return DigestIndex(spark, scratch_path(spark, "index"), docs.schema[id_col].dataType.simpleString(), int(spark.conf.get("spark.sql.shuffle.partitions")))
