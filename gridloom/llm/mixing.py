"""Mixing sources to target weights by weighted fair queueing.

A source's documents stand in a queue, shuffled by a digest of their keys, once
for each time that the mix may take them.  The virtual finish time of a document
is the words of its source up to its own end, divided by the source's weight.
Sorted by that time over all sources, the queue is served in proportion to the
weights, a source that has run out leaves its share to the others, and what
comes before the budget is spent is the mix.

Sums along a source's queue take two steps, so no task holds a source: the
digest deals each source's documents into buckets, the buckets' sums are added
up in order, and rows are summed within their bucket.  There are as many buckets
as the square root of the rows, so neither a bucket nor the list of a source's
buckets grows faster than that.
Likewise over the sorted mix: ranges first, then the one range in which the
budget ends.  Order, and so the result, depends on the rows alone.

Null text has no words and null is a source of its own, the last; documents
without words take none.  A null id is keyed as ``null``.  Repeated rows are
documents of their own, numbered as copies, and spread by their numbers.  Very
long texts are counted whole; what one document can miss of a target is its own
size.  An empty table gives no rows.  Other columns of ``docs`` are not read and
may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameters
from ..operators.adapter import add_row_id
from .shared import BROADCAST_ROWS, copies_numbered, hot_keys, salted, saved, small, steps

#: Weights of the sources in turn, the budget as a share of all words, and how
#: often a document is taken at most (fixed values).
WEIGHTS, SHARE, TIMES = (3, 1, 2), 1.5, 2
#: Bits of a document's place in the shuffle.
BITS = 60


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, no_source, source, size, copies``: the documents by id, source
    and words, repeated ones counted.  A null source is an empty one that says so."""
    source = F.col(source_col).cast("string")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def targets(counted: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = TIMES) -> DataFrame:
    """``no_source, source, source_size, copies, rank, weight, target`` of each
    source.  What a source can't take of its share goes to the others by weight,
    again and again until none is above its bound; each turn is two sums."""
    own = counted.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("copies"))
    own = add_row_id(own, "rank", ["no_source", "source"])
    own = saved(own.withColumn("weight", F.array(*map(F.lit, weights))[(F.col("rank") % len(weights)).cast("int")].cast("long")), "mix-sources")
    bound = F.col("source_size") * times
    sums = own.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    budget, left, weight, full = share * (sums.words or 0), share * (sums.words or 0), sums.weight or 1, F.lit(False)
    while True:
        fair = F.lit(float(left)) * F.col("weight") / F.lit(float(weight))
        above = full | (fair > bound)
        turn = own.agg(F.sum(F.when(above, bound)).alias("bounds"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count_if(above & ~full).alias("new")).first()
        if not turn.new:
            return own.withColumn("target", F.when(full, bound.cast("double")).otherwise(fair))
        left, weight, full = budget - turn.bounds, turn.weight or 1, above


def queued(counted: DataFrame, sources: DataFrame, seed: int = 1, bits: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A row for each document with its source's columns, its place ``h`` in the
    shuffle, and ``until``: the words of its source's queue up to its end."""
    keys = ["no_source", "source"]
    n = sources.agg(F.sum("copies").alias("n")).first().n or 0
    bits = n.bit_length() // 2 if bits is None else bits
    rows = copies_numbered(counted, F.lit(0), F.col("copies"), "copy").drop("copies")
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"), F.col("copy"))
    rows = rows.withColumn("h", F.conv(F.substring(F.sha2(key, 256), 1, BITS // 4), 16, 10).cast("long"))
    if sources.count() <= limit:
        rows = rows.join(F.broadcast(sources.drop("copies")), keys)
    else:
        rows = salted(rows, sources.drop("copies"), keys, hot_keys(sources.select(*keys, F.col("copies").alias("c")), keys, n), "h")
    rows = saved(rows.withColumn("bucket", F.shiftright("h", BITS - bits)), "mix-documents")
    buckets = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row a bucket
    buckets = saved(buckets.select("rank", "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead")), "mix-buckets")
    within = F.sum("size").over(Window.partitionBy("rank", "bucket").orderBy("h", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.join(small(buckets, limit), ["rank", "bucket"]).withColumn("until", F.col("ahead") + within)
    return saved(out.drop("bucket", "ahead"), "mix-queue")


#: What orders the mix; all of it is needed only where finish times are equal.
ORDER = ["finish", "rank", "turn", "h", "doc_id", "size", "copy"]


def mix(queue: DataFrame, budget: float, times: int = TIMES) -> tuple[DataFrame, Row | None]:
    """The mix and its last row (None if there is none): rows of ``queue`` with
    their ``turn`` (from 0) and virtual ``finish`` time, in files sorted by range."""
    served = queue.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    served = served.withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("until")) / F.col("weight"))
    ranged = served.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ranged = saved(ranged.withColumn("part", F.spark_partition_id()), "mix-ranges")
    parts = ranged.groupBy("part").agg(F.sum("size").alias("words"))
    ends = F.sum("words").over(Window.orderBy("part"))  # one row a range
    over = parts.withColumn("ends", ends).filter(F.col("ends") > budget).orderBy("part").first()
    if over is None:
        taken = ranged
    else:
        last = ranged.filter(F.col("part") == over.part)  # one range alone
        spent = F.sum("size").over(Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(over.ends - over.words)
        taken = ranged.filter(F.col("part") < over.part).unionByName(last.withColumn("spent", spent).filter(F.col("spent") <= budget).drop("spent"))
    ends_with = taken.orderBy(*(F.col(c).desc() for c in ORDER)).select(*ORDER).first()
    taken = taken.drop("part")
    taken._saved_at = ranged._saved_at
    return taken, ends_with


def _not_after(turn: int, last: Row) -> Column:
    """Whether a queued document's entry of that turn stands before or at ``last``."""
    mine = {"finish": (turn * F.col("source_size") + F.col("until")) / F.col("weight"), "turn": F.lit(turn)}
    pairs = []
    for name in ORDER:
        value = mine.get(name, F.col(name))
        if name == "doc_id":  # null comes first
            pairs.append((value.isNotNull(), F.lit(last.doc_id is not None)))
        if last[name] is not None:
            pairs.append((value, F.lit(last[name])))
    return reduce(lambda later, p: (p[0] < p[1]) | ((p[0] == p[1]) & later), reversed(pairs), F.lit(True))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, times: int = TIMES, seed: int = 1,
) -> DataFrame:
    """For each row of ``docs``: ``doc_id, source`` (null if it is), ``size,
    source_size, target`` (of its source) and ``taken``, its words in the mix."""
    if share > times or min(weights, default=0) < 1:
        raise InvalidParameters("weights are whole numbers from 1, and the share is at most the times that a document may be taken")
    with steps() as keep:
        counted = saved(word_counts(docs, id_col, text_col, source_col), "mix-counts")
        sources = targets(counted, weights, share, times)
        queue = keep(queued(counted, sources, seed))
        total = sources.agg(F.sum("source_size").alias("n")).first().n or 0
        _, last = mix(queue, share * total, times)
    often = reduce(lambda a, b: a + b, (F.when(_not_after(t, last), 1).otherwise(0) for t in range(times))) if last else F.lit(0)
    return queue.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", (F.col("size") * often).cast("long").alias("taken"),
    )
