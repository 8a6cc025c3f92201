"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces no longer than the largest permitted length and
dealt into groups of about ``GROUP_PIECES`` by a hash, so groups are packed in
parallel and each fits a task.  In a group, pieces are placed by decreasing
length: each into the open bin whose free space fits it best.  Where none fits,
a bin opens, and all permitted lengths compete for it: each is filled on trial
from the pieces that no other open bin counts on, and the one that costs least
for each token that it would hold wins.  At the end each bin takes the smallest permitted length
that holds its contents.  The same with the smallest length that fits is done
beside it, and the cheaper of both results taken.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import copies_numbered, saved

#: Permitted sequence lengths, in tokens.
CAPACITIES = (2048, 4096, 8192, 16384)
GROUP_PIECES = 20_000
#: What starting a sequence costs, in tokens of the linear layers.
LAUNCH = 256


def cost(capacity: int) -> float:
    """Of training on one sequence: its start, the linear layers, and attention,
    which takes as much as they do at 65,536 tokens."""
    return LAUNCH + capacity * (1 + capacity / 65_536)


class Pool:
    """The lengths of the pieces that no open bin counts on yet."""

    def __init__(self, lengths: list[int]):
        self.left = Counter(lengths)
        self.promised: Counter[int] = Counter()
        self.lengths = sorted(self.left)

    def filling(self, length: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
        """The tokens of a bin of that capacity with a piece of that length and,
        longest first, what fits of the others; and those, as (length, count)."""
        used, taken, i = length, [], len(self.lengths)
        while used < capacity and (i := bisect_right(self.lengths, capacity - used, 0, i)) > 0:
            i -= 1
            n = self.lengths[i]
            count = min(self.left[n], (capacity - used) // n)
            if count:
                used += count * n
                taken.append((n, count))
        return used, taken

    def promise(self, taken: list[tuple[int, int]]) -> None:
        for n, count in taken:
            self.promised[n] += count
            self._take(n, count)

    def remove(self, length: int, opens: bool) -> None:
        """A piece has come: it is one of those promised, or if it opens a bin
        one of the others, as far as there are such."""
        if self.left[length] and (opens or not self.promised[length]):
            self._take(length, 1)
        else:
            self.promised[length] -= 1

    def _take(self, n: int, count: int) -> None:
        self.left[n] -= count
        if not self.left[n]:
            del self.lengths[bisect_left(self.lengths, n)]


def cheapest(pool: Pool, length: int, capacities: tuple[int, ...]) -> int:
    """The bin size to open for a piece: that of the least cost for a token in
    the trials, with the bin as small as its contents then allow; the larger of
    equals, whose spare room takes what finds no place elsewhere and is given
    back at the end.  The pieces of that trial are promised to the bin."""
    best = None
    for c in capacities[bisect_left(capacities, length) :]:
        used, taken = pool.filling(length, c)
        per_token = cost(capacities[bisect_left(capacities, used)]) / used
        if best is None or per_token <= best[0]:
            best = per_token, c, taken
    pool.promise(best[2])
    return best[1]


def smallest(pool: Pool, length: int, capacities: tuple[int, ...]) -> int:
    return capacities[bisect_left(capacities, length)]


def placed(lengths: list[int], capacities: tuple[int, ...], opened: Callable[[Pool, int, tuple[int, ...]], int]) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Best fit with bins of the size that ``opened`` says: ``(bin, offset)`` of
    each piece, and the sizes as opened and the contents of the bins."""
    pool = Pool(lengths)
    free: list[tuple[int, int]] = []  # (free tokens, bin), ordered
    sizes: list[int] = []
    used: list[int] = []
    out: list[tuple[int, int]] = []
    for length in lengths:
        i = bisect_left(free, (length, -1))
        pool.remove(length, i == len(free))
        if i < len(free):
            room, b = free.pop(i)
        else:
            room, b = opened(pool, length, capacities), len(used)
            sizes.append(room)
            used.append(0)
        out.append((b, used[b]))
        used[b] += length
        if room > length:
            insort(free, (room - length, b))
    return out, sizes, used


def packed(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> list[tuple[int, int, int]]:
    """``(bin, offset, capacity)`` of each piece, given by decreasing length."""
    capacities = tuple(sorted(capacities))
    tried = []
    for opened in (cheapest, smallest):
        places, _, used = placed(lengths, capacities, opened)
        tried.append((places, [capacities[bisect_left(capacities, u)] for u in used]))
    places, final = min(tried, key=lambda t: sum(map(cost, t[1])))
    return [(b, offset, final[b]) for b, offset in places]


def pieces(docs: DataFrame, id_col: str, length_col: str, largest: int) -> DataFrame:
    """``(doc_id, piece, start, length)``, one row for each piece."""
    length = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), length.alias("total")).filter("total > 0")
    rows = rows.select("doc_id", "total", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(largest).cast("long"))).alias("piece", "start"))
    return rows.select("doc_id", F.col("piece").cast("long").alias("piece"), "start", F.least(F.lit(largest).cast("long"), F.col("total") - F.col("start")).alias("length"))


def pack(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length`` (tokens within
    the document), ``bin_id`` (of all bins), ``capacity`` (of that bin) and
    ``offset`` (of the piece in it).

    Null or negative length counts as 0, and a length of 0 has no piece; a very
    long document is many pieces, dealt over the groups.  A null id is packed as
    any other.  Repeated rows are packed each by itself; ties
    in length go by id and start, so the result depends on the rows alone and
    not on how they were partitioned.  Further columns are not read.  Empty
    input: no rows.
    """
    capacities = tuple(sorted(set(capacities)))
    rows = saved(pieces(docs, id_col, length_col, capacities[-1]), "pieces")
    groups = max(1, math.ceil(rows.count() / group_pieces))
    # equal rows are counted and numbered, so that they spread over groups too
    equal = rows.groupBy("doc_id", "piece", "start", "length").agg(F.count("*").alias("copies"))
    each = copies_numbered(equal, F.lit(0), F.col("copies"), "copy")
    dealt = each.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "length", "copy"), F.lit(groups))).drop("copies")

    def grouped(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(doc_id=group["doc_id"].astype("Int64"))
        group = group.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        got = packed(group["length"].tolist(), capacities)
        first = int(group["group"].iloc[0]) << 32
        bins, offsets, sizes = zip(*got, strict=True)
        return group.assign(bin_id=[first + b for b in bins], capacity=sizes, offset=offsets)[OUT]

    return dealt.groupBy("group").applyInPandas(grouped, ", ".join(f"{c} long" for c in OUT))


OUT = ["doc_id", "piece", "start", "length", "bin_id", "capacity", "offset"]


def byte_tokens(docs: DataFrame, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with its length in byte-level tokens: one a UTF-8 byte and one
    that ends the document (so null or empty text has one)."""
    return docs.withColumn(name, F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 1)
