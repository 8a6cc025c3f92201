"""What the operators of this subpackage share: joins whose frequent keys are
dealt over several tasks, copies numbered in blocks, and word hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, qualified, saved, shared_folder, steps

__all__ = ["BROADCAST_ROWS", "WordHash", "copies_numbered", "discard", "hot_keys", "in_small_batches", "mixed", "ngram_hashes", "qualified", "salted", "saved", "shared_folder", "small", "steps"]

#: Rows of ids that may be broadcast (8 bytes each); above it joins shuffle.
BROADCAST_ROWS = 1_000_000
#: A key is hot if more rows have it than both ``HOT_ROWS`` and one in
#: ``HOT_SHARE`` of all rows, so there are at most ``HOT_SHARE`` hot keys.
HOT_ROWS, HOT_SHARE = 1_000, 2_000

#: Text that goes to a Python worker at once.
BATCH_BYTES = 2 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Lets the session send Python workers no more than ``BATCH_BYTES`` at once,
    where it still has Spark's own bound of 64 MB: texts take several times
    their size there.  The setting stays, as plans run after they are made."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == f"{64 << 20}b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (narrow, already saved), marked for broadcast if it has at most
    ``limit`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """``keys, salts`` of the hot keys in ``counts`` (``keys, c``; ``total`` is
    the sum of ``c``), or None if none is hot."""
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = counts.filter(F.col("c") > most).select(*keys, F.ceil(F.col("c") / most).cast("int").alias("salts"))
    hot = saved(hot, "hot-keys")
    return None if hot.isEmpty() else hot


def salted(many: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row or a few for each key.  Rows
    of ``many`` with a hot key are dealt over its salts by ``by``, and the rows
    of ``one`` repeated for each salt, so no task gets all rows of a key."""
    if hot is None:
        return many.join(one, keys, how)
    known = F.broadcast(hot)  # HOT_SHARE rows at most
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")), F.lit(0)).cast("int")
    many = many.join(known, keys, "left").withColumn("salt", salt).drop("salts")
    one = one.join(known, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return many.join(one, [*keys, "salt"], how).drop("salt")


#: Rows that one row is made into at a time.
BLOCK_COPIES = 1 << 16


def copies_numbered(df: DataFrame, first: Column, end: Column, name: str) -> DataFrame:
    """``df`` with a row for each number from ``first`` to ``end`` - 1 as
    ``name``.  Ranges are cut into blocks that are dealt over the tasks before
    they are counted out, so one row of many copies is no task's work alone."""
    blocks = F.sequence(first.cast("long"), end.cast("long") - 1, F.lit(BLOCK_COPIES).cast("long"))
    cut = df.withColumn("_end", end.cast("long")).withColumn("_block", F.explode(blocks))
    cut = cut.repartition(*(c for c in df.columns), "_block")
    each = F.explode(F.sequence(F.col("_block"), F.least(F.col("_end"), F.col("_block") + BLOCK_COPIES) - 1))
    return cut.withColumn(name, each).drop("_block", "_end")


class WordHash(dict):
    """64-bit hashes of words, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly (xor-shift and multiply rounds)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of ``n`` word hashes; empty if there are fewer."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
    return mixed(out)
