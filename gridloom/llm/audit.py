"""How filters act together: what each removes, and what others would have.

Each row gets a mask with a bit for each filter that it fails.  Four filters
judge the row by itself, by native expressions; the fifth fails copies of an
earlier text, which the least id of each text's digest tells.  Rows are summed
to at most 32 cells for each part, and from the cells follows every order of the
filters: what is left after a set of filters are the cells without its bits.

Null text and null source are empty; a row without an id neither is nor has an
earlier copy; rows of one id and text are copies of later ones, not of each
other.  A row's labels are those of its id (good or toxic if any label row says
so); a row without an id or label is neither.  Very long texts are read whole;
texts are the same if their SHA-256 is.  An empty table gives no rows.  Other
columns of ``docs`` are not read and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hot_keys, salted, saved, small, steps

#: Texts with copies that may be broadcast (a digest and an id each).
BROADCAST_TEXTS = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Whether a row fails a filter, from its text and its words.
ROW_FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
    "C": lambda text, words: 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 2 * F.length(text).cast("long"),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPIES = "E"


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", limit: int = BROADCAST_TEXTS) -> DataFrame:
    """``doc_id, part, mask, n``: rows of each id, part and text with the filters
    that they fail, bit 0 being that of the first."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))
    mask = F.lit(0)
    for bit, fails in enumerate(ROW_FILTERS.values()):
        mask = mask + F.when(fails(F.col("text"), F.col("words")), 1 << bit).otherwise(0)
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("own"))
    rows = saved(rows.groupBy("doc_id", "part", "digest", "own").agg(F.count("*").alias("n")), "audit-rows")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("c"))
    copied = saved(least.filter("least < most"), "audit-copies")
    firsts = small(copied.select("digest", "least"), limit)
    if copied.count() <= limit:
        met = rows.join(firsts, "digest", "left")
    else:
        met = salted(rows, firsts, ["digest"], hot_keys(copied.select("digest", "c"), ["digest"], rows.count()), "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("least"), 1 << len(ROW_FILTERS)).otherwise(0)
    return met.select("doc_id", "part", (F.col("own") + copy).alias("mask"), "n")


def cells(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: the rows of each part by mask, and how
    many of them the labels call good or toxic."""
    says = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(name)
    told = saved(labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(says("quality"), says("toxic")), "audit-labels")
    named = small(told)
    with_id, without = failed.filter("doc_id IS NOT NULL"), failed.filter("doc_id IS NULL")
    if told.count() > BROADCAST_TEXTS:
        with_id = saved(with_id.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")), "audit-masks")
        of_id = with_id.groupBy("doc_id").agg(F.count("*").alias("c"))
        met = salted(with_id, named, ["doc_id"], hot_keys(of_id, ["doc_id"], with_id.count()), "part", "left")
    else:
        met = with_id.join(named, "doc_id", "left")
    met = met.unionByName(without.withColumns({"quality": F.lit(False), "toxic": F.lit(False)}))
    counted = lambda name: F.sum(F.when(F.col(name), F.col("n")).otherwise(0))
    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("quality").alias("good"), counted("toxic").alias("toxic"))


def interactions(histogram: DataFrame, letters: str = "".join(ROW_FILTERS) + COPIES) -> DataFrame:
    """Every order of the filters over the cells of each part (2 to the number of
    filters at most): ``part, filter_order, step`` and the counts of that step."""
    k = len(letters)
    own = histogram.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    added = lambda keep, value: F.aggregate(F.filter("cells", keep), F.lit(0).cast("long"), lambda s, c: s + value(c))
    left = lambda applied, name: added(lambda c: c["mask"].bitwiseAND(applied) == 0, lambda c: c[name])
    sets = F.sequence(F.lit(0), F.lit((1 << k) - 1))
    # what is left after each set of filters
    own = own.withColumn("left", F.transform(sets, lambda s: F.struct(*(left(s, name).alias(name) for name in ("n", "good", "toxic")))))

    fails = lambda bit: lambda c: c["mask"].bitwiseAND(F.lit(1 << bit)) != 0
    alone = lambda bit: lambda c: c["mask"] == F.lit(1 << bit)
    # in one order of as many as the filters that a row fails, the filter is the first of those
    share = F.array(*(F.lit(math.factorial(k) // j if j else 0) for j in range(k + 1))).cast("array<bigint>")
    first = lambda c: c["n"] * share[F.bit_count(c["mask"])]
    own = own.select(
        "part", "left",
        F.array(*(added(alone(b), lambda c: c["n"]) for b in range(k))).alias("alone"),
        F.array(*(added(fails(b), first) for b in range(k))).alias("shapley"),
    )
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    rows = own.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    place = [F.instr(F.col("filter_order"), c) for c in letters]
    before, bit = F.lit(0), F.lit(0)
    for b, at in enumerate(place):
        before = before + F.when(at < F.col("step"), 1 << b).otherwise(0)
        bit = bit + F.when(at == F.col("step"), b).otherwise(0)
    rows = rows.withColumns({"before": before, "bit": bit}).withColumn("flag", F.expr("shiftleft(1, bit)"))
    was, now = F.col("left")[F.col("before")], F.col("left")[F.col("before") + F.col("flag")]
    everything, without = F.col("left")[0], F.col("left")[F.col("flag")]
    removed = was["n"] - now["n"]
    return rows.select(
        "part", "filter_order", "step", now["n"].alias("kept"), removed.alias("removed"),
        (everything["n"] - without["n"] - removed).alias("redundant"), F.col("alone")[F.col("bit")].alias("unique_fails"),
        (was["good"] - now["good"]).alias("good_lost"), (was["toxic"] - now["toxic"]).alias("toxic_lost"), F.col("shapley")[F.col("bit")].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs``."""
    with steps() as keep:
        histogram = keep(saved(cells(failures(docs), labels), "audit-cells"))
    return interactions(histogram)
