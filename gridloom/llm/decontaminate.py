"""Benchmark decontamination by winnowing.

Of every ``w`` consecutive k-gram hashes of a text the least is kept (the last
one of equals), so two texts that share ``w + k - 1`` words in a row share a
kept hash.  The fingerprints of the test items are joined with those of the
documents, and each meeting point is extended in both directions over the
windows that hold it: one that is equal to a window of an item is contamination.
With k = 5 and w = 6 every window of 10 words is found.  Items shorter than the
window count as one window; their lengths are few, so each is looked up at
every position.

Equal windows of different items are one class with a set of items, so a window
that many items share costs no more than another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WordHash, hot_keys, in_small_batches, ngram_hashes, salted, saved, small

WINDOW, GRAM = 10, 5
#: Words of all test items up to which they are sent to every task (about 30
#: bytes a word); above it windows are joined by a shuffle.
ITEM_WORDS = 4_000_000
#: Bits of the filter of item prints that documents' prints pass before they are
#: shuffled (16 MB, whatever the benchmark's size): a power of two.
FILTER_BITS = 1 << 27

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    """Runs of digits, a-z (A-Z in lower case) and characters above 0x7F."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def kept_positions(grams: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash (the last of equals) of every ``w`` in a row;
    of all of them if there are fewer."""
    n = len(grams)
    if not n:
        return np.empty(0, np.int64)
    w = min(w, n)
    m = n - w + 1
    least, at = grams[:m].copy(), np.arange(m)
    for i in range(1, w):
        lower = grams[i : i + m] <= least
        least = np.where(lower, grams[i : i + m], least)
        at = np.where(lower, np.arange(i, i + m), at)
    return np.unique(at)


def _least(grams: np.ndarray, w: int) -> np.ndarray:
    """The least hash of every ``w`` in a row."""
    out = grams[: len(grams) - w + 1].copy()
    for i in range(1, w):
        np.minimum(out, grams[i : i + len(out)], out=out)
    return out


def _near(positions: np.ndarray, w: int, n: int) -> np.ndarray:
    """The starts below ``n`` of windows of ``w`` grams that hold a position."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.maximum(positions - w + 1, 0), 1)
    np.add.at(edges, np.minimum(positions + 1, n), -1)
    return np.flatnonzero(np.cumsum(edges)[:n] > 0)


def _marked(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a run of ``size`` from one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return np.cumsum(edges)[:n] > 0


class Items:
    """The windows of test items: fingerprints, and for each class of equal
    windows the set of its items."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.names = [name for name, _ in items]
        prints, windows, short = [], ([], []), {}
        for k, (_, w) in enumerate(items):
            if len(w) >= window:
                prints.append(_least(ngram_hashes(w, gram), window - gram + 1))
            if len(w):
                size = min(len(w), window)
                hashes, owners = windows if size == window else short.setdefault(size, ([], []))
                own = np.unique(ngram_hashes(w, size))
                hashes.append(own)
                owners.append(np.full(len(own), k, np.int32))
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, np.uint64)
        self.sets: list[tuple[int, ...]] = [(k,) for k in range(len(items))]
        known: dict[tuple[int, ...], int] = {}
        self.windows = self._classes(*windows, known)
        self.short = {size: self._classes(*s, known) for size, s in sorted(short.items())}
        self.told: dict[bytes, tuple[int, str]] = {}

    def _classes(self, hashes: list[np.ndarray], owners: list[np.ndarray], known: dict[tuple[int, ...], int]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes in order, and the set of each."""
        if not hashes:
            return np.empty(0, np.uint64), np.empty(0, np.int32)
        h, k = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((k, h))
        h, k = h[order], k[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sets = k[first]
        ends = np.append(first[1:], len(h))
        for i in np.flatnonzero(ends - first > 1):
            own = tuple(k[first[i] : ends[i]].tolist())
            if own not in known:
                known[own] = len(self.sets)
                self.sets.append(own)
            sets[i] = known[own]
        return h[first], sets

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words lie in a window of an item, and the sets found."""
        n, hit, found = len(words), np.zeros(len(words), bool), []
        if n >= self.window and len(self.prints):
            grams, w = ngram_hashes(words, self.gram), self.window - self.gram + 1
            met = np.flatnonzero(_among(grams, self.prints))
            if len(met):
                met = np.intersect1d(met, kept_positions(grams, w))
                starts = _near(met, w, n - self.window + 1)
                self._look(words, self.window, starts, *self.windows, hit, found)
        for size, classes in self.short.items():
            self._look(words, size, np.arange(max(0, n - size + 1)), *classes, hit, found)
        return hit, np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)

    @staticmethod
    def _look(words: np.ndarray, size: int, starts: np.ndarray, hashes: np.ndarray, sets: np.ndarray, hit: np.ndarray, found: list[np.ndarray]) -> None:
        if not len(starts):
            return
        own = ngram_hashes(words, size)[starts]
        same = _among(own, hashes)
        if same.any():
            hit |= _marked(starts[same], size, len(words))
            found.append(np.unique(sets[np.searchsorted(hashes, own[same])]))

    def listed(self, sets: np.ndarray) -> tuple[int, str]:
        """The count of the named items of these sets, and their digest; told
        again from memory, as common passages come with the same sets."""
        key = sets.tobytes()
        if key not in self.told:
            names = {str(self.names[k]) for s in sets.tolist() for k in self.sets[s] if self.names[k] is not None}
            if len(self.told) >= 10_000:
                self.told.clear()
            self.told[key] = len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        return self.told[key]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered) or not len(values):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judge(items: Items):
    def judge(texts: pd.Series) -> pd.DataFrame:
        words, rows = WordHash(), []
        for text in texts:
            h = words.of(item_words(text))
            hit, sets = items.hits(h)
            n = int(hit.sum())
            rows.append((len(h), n, *items.listed(sets), n > 0))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return F.pandas_udf(judge, RESULT)


def _hashed(items: list[tuple[int | None, str | None]]) -> list[tuple[int | None, np.ndarray]]:
    words = WordHash()
    return [(name, words.of(item_words(text))) for name, text in items]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_words_limit: int = ITEM_WORDS) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_words``, ``n_hit`` (words
    inside a window of an item), ``n_items`` (items with such windows),
    ``items_sha256`` (of their ids) and ``contaminated`` (n_hit > 0).

    Null or empty text has no words, an item without words no window.  Rows of
    one item id are one item; an item with a null id marks words but isn't
    counted or listed.  Null or repeated document ids change nothing; very long
    texts are read whole; further columns are not read.  An empty benchmark
    finds nothing; empty ``docs``: no rows.
    """
    in_small_batches(docs.sparkSession)
    name = "_found"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text"))
    if _fit_in_memory(items, item_words_limit):
        judge = _judge(Items(_hashed([(r.item, r.text) for r in items.collect()])))
        return rows.select("doc_id", judge("text").alias(name)).select("doc_id", f"{name}.*")
    rows = saved(rows.select("doc_id", "text", F.expr("uuid()").alias("row")), "decontaminate-rows")
    return _joined(rows, items).drop("row")


def _fit_in_memory(items: DataFrame, limit: int) -> bool:
    # a word and its separator take two bytes at least
    return (items.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) <= 2 * limit


def _windows_of(whole: bool, window: int, gram: int, lengths: list[int]):
    """UDF: of an item's text all windows, as ``(print, hash)``; of a document's
    those of a short item's length, with their start.  A window's print is its
    least gram, of a short one its length."""

    def run(texts: pd.Series) -> pd.Series:
        words, out = WordHash(), []
        for text in texts:
            h = words.of(item_words(text))
            if whole and len(h) >= window:
                prints = _least(ngram_hashes(h, gram), window - gram + 1)
                parts = [(prints, ngram_hashes(h, window))]
            else:
                sizes = [len(h)] if whole and len(h) else [] if whole else [n for n in lengths if n <= len(h)]
                parts = [(np.full(len(h) - n + 1, n, np.uint64), ngram_hashes(h, n)) for n in sizes]
            out.append([{"print": int(p), "hash": int(x), "start": i} for prints, hashes in parts for i, (p, x) in enumerate(zip(prints.view(np.int64), hashes.view(np.int64), strict=True))])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<print:long,hash:long,start:long>>")


def _filter_of(prints: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each low part of a ``print`` there is, made in the tasks by
    stretches of 32,768 bits: ``bits`` / 8 bytes however many prints there are.
    Of 10 million prints it lets 7 % of strange ones pass."""
    at = prints.select((F.pmod("print", F.lit(bits)) + 1).alias("at"))
    made = at.groupBy(F.bitmap_bucket_number("at").alias("stretch")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(-(-bits // (1 << 15)) << 12, np.uint8)
    for r in made.toLocalIterator():
        out[(r.stretch - 1) << 12 : r.stretch << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def _passing(prints: np.ndarray, known: np.ndarray, bits: int) -> np.ndarray:
    at = prints & np.uint64(bits - 1)
    return known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _prints_of(window: int, gram: int, known: Broadcast, bits: int):
    """UDF: the kept grams of a text that pass the filter, and their positions."""

    def run(texts: pd.Series) -> pd.Series:
        words, out = WordHash(), []
        for text in texts:
            h = words.of(item_words(text))
            grams = ngram_hashes(h, gram) if len(h) >= window else np.empty(0, np.uint64)
            at = kept_positions(grams, window - gram + 1)
            at = at[_passing(grams[at], known.value, bits)]
            out.append([{"print": int(p), "at": int(i)} for p, i in zip(grams[at].view(np.int64), at, strict=True)])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<print:long,at:long>>")


def _windows_near(window: int, gram: int):
    """UDF: of a text the windows that hold one of the positions met."""

    def run(texts: pd.Series, positions: pd.Series) -> pd.Series:
        words, out = WordHash(), []
        for text, at in zip(texts, positions, strict=True):
            h, w = words.of(item_words(text)), window - gram + 1
            starts = _near(np.array(at, np.int64), w, len(h) - window + 1)
            prints, hashes = _least(ngram_hashes(h, gram), w)[starts].view(np.int64), ngram_hashes(h, window)[starts].view(np.int64)
            out.append([{"print": int(p), "hash": int(x), "start": int(i)} for p, x, i in zip(prints, hashes, starts, strict=True)])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<print:long,hash:long,start:long>>")


def _joined(rows: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The same for a benchmark of any size: fingerprints that pass a filter of
    the items' meet them in a shuffled join, frequent ones dealt over salts, and of the documents that met one the windows around it are looked up
    among the classes of item windows.  ``rows`` are saved ones of ``doc_id,
    text, row``; the key ``row`` of each is returned with it."""
    key = ["print", "hash"]
    own = items.select("item", F.explode(_windows_of(True, window, gram, [])("text")).alias("x")).select("item", "x.print", "x.hash")
    names = F.sort_array(F.collect_set(F.col("item").cast("string")))
    classes = own.groupBy(*key).agg(names.alias("names")).withColumn("set", F.md5(F.to_json("names")))
    classes = saved(classes, "decontaminate-windows")
    sets = classes.select("set", "names").dropDuplicates(["set"])
    lengths = [r[0] for r in classes.filter(f"print > 0 AND print < {window}").select("print").distinct().collect()]  # below ``window`` different ones

    prints = classes.select("print").distinct()
    known = rows.sparkSession.sparkContext.broadcast(_filter_of(prints, FILTER_BITS))
    kept = rows.select("row", F.explode(_prints_of(window, gram, known, FILTER_BITS)("text")).alias("x"))
    kept = saved(kept.select("row", "x.print", "x.at"), "decontaminate-prints")
    frequent = hot_keys(kept.groupBy("print").agg(F.count("*").alias("c")), ["print"], kept.count())
    met = salted(kept, prints, ["print"], frequent, "row")
    met = met.groupBy("row").agg(F.collect_set("at").alias("at"))
    near = rows.join(met, "row").select("row", F.explode(_windows_near(window, gram)("text", "at")).alias("x"))
    if lengths:
        near = near.union(rows.select("row", F.explode(_windows_of(False, window, gram, lengths)("text")).alias("x")))
    near = saved(near.select("row", "x.print", "x.hash", "x.start"), "decontaminate-near")
    hot = hot_keys(near.groupBy(*key).agg(F.count("*").alias("c")), key, near.count())
    size = F.when(F.col("print").isin(lengths), F.col("print")).otherwise(window) if lengths else F.lit(window)
    hits = salted(near, classes.select(*key, "set"), key, hot, "row").select("row", "start", (F.col("start") + size).alias("end"), "set")
    hits = saved(hits.distinct(), "decontaminate-hits")

    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("end").over(before), F.lit(0))
    spans = hits.select("row", "start", "end").distinct()
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest("start", covered))).groupBy("row").agg(F.sum("new").alias("n_hit"))
    # rows with the same sets have the same list of items, made once
    found = saved(hits.groupBy("row").agg(F.sort_array(F.collect_set("set")).alias("sets")).withColumn("of", F.md5(F.to_json("sets"))), "decontaminate-sets")
    each = found.select("of", "sets").dropDuplicates(["of"]).select("of", F.explode("sets").alias("set"))
    listed = each.join(sets, "set").groupBy("of").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    listed = small(saved(listed.select("of", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256")), "decontaminate-lists"))
    out = rows.select("row", "doc_id", _count("text").alias("n_words")).join(spans, "row", "left").join(found.select("row", "of").join(listed, "of"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    nothing = F.sha2(F.lit(""), 256)
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _count(text: str) -> Column:
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(item_words(t)) for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(text)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_words_limit: int = ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` without any window of ``benchmark``, with all their
    columns.  Each row is judged by its own text, whatever its id; rows without
    words stay, as do repeated ones."""
    in_small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").alias("item"), F.col("text").cast("string").alias("text"))
    if _fit_in_memory(items, item_words_limit):
        judge = _judge(Items(_hashed([(r.item, r.text) for r in items.collect()])))
        name = "_found"
        while name in docs.columns:
            name += "_"
        return docs.withColumn(name, judge(F.col(text_col).cast("string"))).filter(~F.col(f"{name}.contaminated")).drop(name)
    key = "_row"
    while key in docs.columns:
        key += "_"
    keyed = saved(docs.withColumn(key, F.expr("uuid()")), "decontaminate-rows")
    rows = keyed.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(key).alias("row"))
    marked = _joined(rows, items).filter("contaminated").select(F.col("row").alias(key))
    return keyed.join(marked, key, "left_anti").select(docs.columns)
