"""MinHash near-dedup with bottom-k sketches.

One hash function orders all shingles; a document's sketch is its ``k`` lowest
shingle hashes.  Inverted lists of retained values generate candidates, the
sketch of a pair's union estimates its similarity, and the full sets confirm it.

How the lists stay short without losing a link
    Two sets of similarity ``s`` or more share at least ``T`` retained values:
    always, if both sets fit their sketches, else but for a chance below 1e-10
    (a hypergeometric tail: 64 draws, 48 shared expected, 22 asked for).  So if
    each sketch is put in order of how many documents retain a value, its
    ``T - 1`` most frequent values can stay out of the lists.  That removes the
    passages that many documents share; a document made of such a passage keeps
    some of them, and needs to.

How large groups of copies stay linear
    Equal sets are one node from the start.  Each list then links its members
    to a hub, its most typical member, and what is left of the list to a second
    one.  Documents of lists that still hold different components are compared
    by their full sets, again in order of frequency: two similar sets first meet
    at a position from which enough elements are left in both.  A document that
    differs from its group's hub by more than a link allows has more elements
    of its own than that, so it doesn't meet the group's common elements at all.

How hot keys are split
    A value, hub or digest that many documents have is dealt over salts before
    a join.  Lists that are still compared pair by pair first lose each entry
    whose size and position leave no partner in that list, and long ones are
    compared block by block, one task a pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WordHash, discard, hot_keys, in_small_batches, ngram_hashes, salted, saved, small

SKETCH_SIZE = 64
#: Least count of shared retained values of two similar sets over 48 shingles.
LEAST_SHARED = 22


def shingle_hashes(text: str | None, n: int, words: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of the whole sequence
    if it is shorter; none without words."""
    h = words.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return np.empty(0, np.int64)
    return np.unique(ngram_hashes(h, min(n, len(h))).view(np.int64))


def _sketches(n: int, k: int):
    @F.pandas_udf("n long, d1 long, d2 long, sketch array<long>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        words, rows = WordHash(), []
        for text in texts:
            full = shingle_hashes(text, n, words)
            digest = xxhash.xxh3_128_intdigest(full.tobytes())
            d = np.array([digest >> 64, digest & (2**64 - 1)], np.uint64).view(np.int64)
            rows.append((len(full), d[0], d[1], full[:k]))
        return pd.DataFrame(rows, columns=["n", "d1", "d2", "sketch"])

    return sketch


def _full_sets(n: int):
    @F.pandas_udf("array<long>")
    def full(texts: pd.Series) -> pd.Series:
        words = WordHash()
        return pd.Series([shingle_hashes(text, n, words) for text in texts], dtype=object)

    return full


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; the root is the least
    node that can be reached.  Alternating star contraction: each round is two
    groupings and joins, and the number of rounds grows with the logarithm of
    the longest path."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = saved(e, "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            roots = saved(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).distinct(), "roots")
            discard(e)
            return roots
        before = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large.filter("u <> v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        lower = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, saved(lower.union(least.select("u", "m")).distinct(), "small-star")
        discard(old, large)


class _Links:
    """Finds and confirms the links between the representatives."""

    def __init__(self, texts: DataFrame, sketches: DataFrame, n: int, k: int, percent: int, broadcast_rows: int):
        self.texts, self.sketches, self.n, self.k, self.percent, self.limit = texts, sketches, n, k, percent, broadcast_rows
        self.hot: DataFrame | None = None  # retained values
        self.scratch: list[DataFrame] = []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written, to be discarded with this object's other tables."""
        self.scratch.append(saved(df, name))
        return self.scratch[-1]

    def near(self, a: str, b: str) -> Column:
        """Whether sets of these sizes can be similar enough."""
        return F.expr(f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})")

    def least_shared(self, n: str) -> Column:
        exact = self.k * self.percent // 100
        return F.expr(f"CASE WHEN {n} <= {exact} THEN ceil({self.percent} * {n} / 100) ELSE {min(LEAST_SHARED, exact)} END")

    def counted(self, counts: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
        """``counts`` (with ``value, c``) written, and its hot values."""
        counts = self.saved(counts, name)
        hot = hot_keys(counts, ["value"], counts.agg(F.sum("c")).first()[0] or 0)
        return counts, hot

    def index(self) -> DataFrame:
        """``(value, id, n)``: of each sketch the values that its list entries need."""
        entries = self.sketches.select("id", "n", F.explode("sketch").alias("value"))
        counts, self.hot = self.counted(entries.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1"), "value-counts")
        typical = (F.sum(F.log2("c")) / F.least("n", F.lit(self.k))).alias("typical")
        met = salted(entries, counts, ["value"], self.hot, "id")
        shared = met.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("vs"), typical)
        keep = shared.withColumn("keep", (F.size("vs") - self.least_shared("n") + 1).cast("int")).filter("keep > 0")
        each = keep.select("id", "n", "typical", F.explode(F.slice("vs", F.lit(1), F.col("keep"))).alias("x"))
        return self.saved(each.select(F.col("x.value").alias("value"), "id", "n", "typical"), "index")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs(a, b)`` that are similar enough by their full sets; ``a``
        may be in very many of them."""
        hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("c")), ["a"], pairs.count())
        ids = self.saved(pairs.select("a").union(pairs.select("b")).distinct().toDF("id"), "ids")
        sketches = self.sketches.join(small(ids, self.limit), "id", "left_semi").select("id", "sketch")
        side = lambda x: sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"s{x}"))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, self.k)
        likely = salted(pairs.join(side("b"), "b"), side("a"), ["a"], hot, "b").select("a", "b", union.alias("u"), F.array_intersect("sa", "sb").alias("both"))
        enough = 100 * self.k * F.size(F.array_intersect("u", "both")) >= min(LEAST_SHARED, self.k) * 100 * F.size("u")
        likely = self.saved(likely.filter(enough).select("a", "b").distinct(), "likely")
        few = likely.count() <= self.limit
        put = F.broadcast if few else (lambda x: x)
        full = _full_sets(self.n)
        members = self.texts.join(put(likely.withColumnRenamed("b", "id")), "id").select("a", F.col("id").alias("b"), full("text").alias("fb"))
        hubs = self.texts.join(put(likely.select(F.col("a").alias("id")).distinct()), "id").select(F.col("id").alias("a"), full("text").alias("fa"))
        both = salted(members, hubs, ["a"], hot, "b").withColumn("i", F.size(F.array_intersect("fa", "fb")))
        links = self.saved(both.filter(100 * F.col("i") >= self.percent * (F.size("fa") + F.size("fb") - F.col("i"))).select("a", "b"), "links")
        discard(ids, likely, hot)
        return links

    def _open(self, index: DataFrame, roots: DataFrame) -> DataFrame:
        """The entries of lists that hold several components, with ``root``."""
        rows = index.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        lists = rows.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("value")
        return self.saved(salted(rows, lists, ["value"], self.hot, "id"), "open-lists")

    def _by_full_sets(self, ids: DataFrame) -> DataFrame:
        """Candidates ``(a, b)`` among ``ids(id, root)`` of different roots.

        A value that one component alone holds is shared by no pair, so it comes
        first in the order of each set, and in no list.
        """
        full = self.texts.join(small(ids, self.limit), "id").select("id", "root", _full_sets(self.n)("text").alias("s"))
        full = self.saved(full.withColumn("n", F.size("s")), "full-sets")
        each = full.select("id", "root", "n", F.explode("s").alias("value"))
        several = lambda df, *more: df.groupBy("value").agg(F.count("*").alias("c"), F.min("root").alias("x"), F.max("root").alias("y"), *more).filter("x <> y").drop("x", "y")
        counts, hot = self.counted(several(each), "full-counts")
        own = Window.partitionBy("id", "n")
        at = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "value"))
        entries = salted(each, counts, ["value"], hot, "id").withColumn("left", F.col("n") - at + 1)
        entries = self.saved(entries.filter(100 * F.col("left") >= self.percent * F.col("n")).select("value", "id", "root", "n", "left"), "full-index")
        # sets a and b have at most min(left a, left b) in common from here on
        reach = lambda left, n: (100 + self.percent) * left >= self.percent * n
        lists, hot = self.counted(several(entries, F.min("n").alias("shortest")), "full-lists")
        rows = salted(entries, lists, ["value"], hot, "id").filter(reach(F.col("left"), F.col("n") + F.col("shortest")))
        rows = self.saved(rows.drop("shortest", "c"), "full-rows")
        counts, hot = self.counted(several(rows), "full-row-counts")
        if hot is None:
            left, right, one_way = rows, rows, F.col("id") < F.col("id2")
            keys = ["value"]
        else:
            dealt = rows.join(F.broadcast(hot), "value", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
            dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
            left = dealt.withColumns({"low": F.col("block"), "high": F.explode(F.sequence(F.col("block"), F.col("salts") - 1))}).drop("block", "salts")
            right = dealt.withColumns({"high": F.col("block"), "low": F.explode(F.sequence(F.lit(0), F.col("block")))}).drop("block", "salts")
            keys, one_way = ["value", "low", "high"], (F.col("low") < F.col("high")) | (F.col("id") < F.col("id2"))
        other = right.select(*keys, *(F.col(c).alias(f"{c}2") for c in ("id", "root", "n", "left")))
        enough = reach(F.least("left", "left2"), F.col("n") + F.col("n2"))
        met = left.join(other, keys).filter(one_way & (F.col("root") != F.col("root2")) & self.near("n", "n2") & enough)
        return met.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()

    def all(self, same: DataFrame) -> DataFrame:
        """``(node, root)`` of all representatives that have a link; ``same``
        holds pairs that are one document anyway."""
        index, tested = self.index(), None
        roots = components(same)
        for last in (False, False, True):
            rows = self._open(index, roots)
            if last:
                pairs = self._by_full_sets(self.saved(rows.select("id", "root").distinct(), "open-ids"))
            else:
                hubs = rows.groupBy("value").agg(F.min(F.struct((-F.col("typical")).alias("by"), "id", "n", "root")).alias("h"))
                hubs = self.saved(hubs.select("value", F.col("h.id").alias("id2"), F.col("h.n").alias("n2"), F.col("h.root").alias("root2")), "hubs")
                met = salted(rows, hubs, ["value"], self.hot, "id").filter((F.col("root") != F.col("root2")) & self.near("n", "n2"))
                pairs = met.select(F.col("id2").alias("a"), F.col("id").alias("b")).distinct()
                # a hub has been compared with all of its list
                index = rows.select("value", "id", "n", "typical").join(hubs.select("value", F.col("id2").alias("id")), ["value", "id"], "left_anti")
            if tested is not None:
                pairs = pairs.join(tested, ["a", "b"], "left_anti")
            pairs = self.saved(pairs, "candidates")
            if pairs.isEmpty():
                continue
            links = self.confirmed(pairs)
            both_ways = pairs.union(pairs.select("b", "a"))
            tested = both_ways if tested is None else tested.union(both_ways)
            old, roots = roots, components(links.union(roots.select("root", "node")))
            discard(old)
        discard(*self.scratch, self.hot)
        return roots


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, k: int = SKETCH_SIZE, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_shingles``,
    ``component_id`` (the least id that can be reached over links) and ``kept``
    (its own id is that least id).

    Words are runs of anything but the six ASCII space characters, with A-Z in
    lower case; a link is a similarity of ``percent`` / 100 or more.  Null or
    empty text: no shingles, linked with nothing.  A very long text is one set
    as any other, as large as its distinct shingles.  Null id: takes part with
    its text, is never a component's id, and is kept only if its component has
    no id.  Rows of one id and text share their verdict, so if one is kept all
    are; rows of one id and different texts each have that of their text.
    Further columns of ``docs`` are not read.  Empty input: no rows.
    """
    in_small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = _sketches(shingle, k)
    rows = saved(base.select("id", sketch("text").alias("s")).select("id", "s.*"), "sketches")
    filled, digest = rows.filter("n > 0"), ["d1", "d2"]
    sets = saved(filled.groupBy(*digest).agg(F.min("id").alias("rep"), F.count("*").alias("c")), "sets")
    hot = hot_keys(sets, digest, rows.count())
    told = salted(filled.select("id", "n", *digest), sets.select(*digest, "rep"), digest, hot, "id")
    told = saved(told.select("id", "n", "rep"), "representatives-of")
    first = sets.filter("rep IS NOT NULL").select(*digest, F.col("rep").alias("id"))
    reps = saved(filled.join(first, [*digest, "id"], "left_semi").dropDuplicates(digest).select("id", "n", "sketch"), "representatives")
    # an id with several texts makes their sets one document
    several = told.filter("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("id", "a")
    same = saved(told.join(several, "id").select("a", F.col("rep").alias("b")).distinct(), "same-id")
    links = _Links(base.filter("id IS NOT NULL"), reps, shingle, k, percent, broadcast_rows)
    roots = links.all(same)
    hot_reps = None if hot is None else saved(sets.join(F.broadcast(hot), digest).filter("rep IS NOT NULL").select("rep", "salts"), "hot-representatives")
    linked = salted(told, roots.select(F.col("node").alias("rep"), "root"), ["rep"], hot_reps, "id", "left")
    out = linked.select("id", "n", F.coalesce("root", "rep").alias("component")).union(rows.filter("n = 0").select("id", "n", F.col("id").alias("component")))
    discard(sets, reps, same, hot)
    out = out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
