"""Fill-in-the-middle: a text's prefix, suffix and middle in the order in which
a model learns to infill.

Where a text is cut is told in units: code points, words with the blanks after
them, or lines.  Whether a unit starts at a byte follows from that byte and the
one before it.  So the texts of a batch are divided into chunks that overlap by
one byte, all chunks count their units in one vector operation, sums over the
chunks before give each text's units and the chunk that owns each cut, and only
those chunks are scanned again for the place.  Texts go to Python once and only
counts and places come back; native expressions assemble and restore.

Null or empty text gives ``plain`` and empty output; so does a text that holds a
sentinel, as it is.  A null id is keyed as ``null``; repeated rows are cut alike;
very long texts are counted whole, in slabs of ``SLAB`` bytes; an empty table
gives no rows.  Other columns of ``docs`` are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidParameters
from .shared import in_small_batches

#: Bytes of a chunk, and of the chunks that are counted at once.
CHUNK, SLAB = 4096, 4 << 20

#: Marks of prefix, suffix and middle; shares of a hundred (fixed values).
SENTINELS = ("<P>", "<S>", "<M>")
INFILLED, SUFFIX_FIRST = 90, 20


def _blank(b: np.ndarray) -> np.ndarray:
    return (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))


#: Whether a unit starts at a byte, from the byte before it and itself (UTF-8).
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "code_point": lambda before, at: (at & 0xC0) != 0x80,
    "word": lambda before, at: _blank(before) & ~_blank(at),
    "line": lambda before, at: before == 0x0A,
}


class Chunks:
    """The texts ``data[offsets[i]:offsets[i + 1]]``, cut into chunks of ``size``
    bytes that end with their text, and the units that start in each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "code_point", size: int = CHUNK, slab: int = SLAB):
        self.data, self.offsets, self.starts_unit = data, offsets, UNITS[unit]
        number = -(-np.diff(offsets) // size)
        self.first = np.concatenate([[0], np.cumsum(number)])  # of each text; then the number of all
        text = np.repeat(np.arange(len(number)), number)
        self.begin = offsets[text] + (np.arange(len(text)) - self.first[text]) * size
        self.end = np.minimum(self.begin + size, offsets[text + 1])
        self.opens = self.begin == offsets[text]
        counts = np.zeros(len(text), np.int64)
        step = max(1, slab // size)
        for i in range(0, len(text), step):
            counts[i : i + step] = np.add.reduceat(self._marks(i, min(i + step, len(text))), self.begin[i : i + step] - self.begin[i], dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.units = self.before[self.first[1:]] - self.before[self.first[:-1]]

    def _marks(self, i: int, j: int) -> np.ndarray:
        """Whether a unit starts at each byte of the chunks ``i`` to ``j`` - 1;
        the byte before the first is the overlap."""
        low, high = self.begin[i], self.end[j - 1]
        at = self.data[low:high]
        before = self.data[low - 1 : high - 1] if low else np.concatenate([[np.uint8(0)], at[:-1]])
        marks = self.starts_unit(before, at)
        marks[self.begin[i:j][self.opens[i:j]] - low] = True  # a text's first byte, whatever is before it
        return marks

    def places(self, ranks: np.ndarray) -> np.ndarray:
        """For each text, the bytes before its unit of that rank; all of them if
        the rank is the number of units."""
        out = np.diff(self.offsets)
        inner = np.flatnonzero(ranks < self.units)
        wanted = self.before[self.first[inner]] + ranks[inner]
        owner = np.searchsorted(self.before, wanted, "right") - 1
        for t, k, c in zip(inner.tolist(), (wanted - self.before[owner]).tolist(), owner.tolist(), strict=True):
            out[t] = self.begin[c] + np.flatnonzero(self._marks(c, c + 1))[k] - self.offsets[t]
        return out


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings without nulls, and the offsets."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    where = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, kind)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), where.astype(np.int64)


_CUTS = pa.struct([(name, pa.int64()) for name in ("n", "low", "high", "low_byte", "high_byte")])


def _cut(unit: str, chunk: int):
    @F.arrow_udf("n long, low long, high long, low_byte long, high_byte long")
    def cut(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        chunks = Chunks(*_buffers(texts), unit, chunk)
        ranks = np.sort([h.to_numpy(zero_copy_only=False) % (chunks.units + 1) for h in (h1, h2)], axis=0)
        columns = [chunks.units, *ranks, chunks.places(ranks[0]), chunks.places(ranks[1])]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_CUTS))

    return cut


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """An output can be taken apart if no sentinel can begin within another one:
    then one that reaches from a part into a mark, or over one, can't occur."""
    first = {s[:1] for s in sentinels}
    if len(set(sentinels)) < 3 or "" in first or any(c in s[1:] for c in first for s in sentinels):
        raise InvalidParameters("sentinels are three different strings whose first characters stand nowhere else in them")
    return sentinels


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits for each key, from a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "code_point", sentinels: tuple[str, str, str] = SENTINELS,
    infilled: int = INFILLED, suffix_first: int = SUFFIX_FIRST, seed: int = 1, chunk: int = CHUNK,
) -> DataFrame:
    """For each row ``doc_id, text, n`` (units), ``form`` (plain, psm or spm),
    ``prefix_units, middle_units`` (null if plain) and ``output``.

    ``infilled`` texts of a hundred are cut, ``suffix_first`` of a hundred of
    those put the suffix first; the id's digest decides, so reruns agree.
    """
    if unit not in UNITS:
        raise InvalidParameters(f"no such unit: {unit}")
    p, s, m = (F.lit(x) for x in _checked(tuple(sentinels)))
    in_small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.array(*draws(F.col(id_col), seed)).alias("h"))
    rows = rows.withColumn("cut", _cut(unit, chunk)(F.col("text"), F.col("h")[0], F.col("h")[1]))
    marked = F.lit(False)
    for x in (p, s, m):
        marked |= F.contains(F.col("text"), x)
    plain = (F.col("text") == "") | marked | (F.col("h")[2] % 100 >= infilled)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    raw = F.col("text").cast("binary")
    part = lambda low, high: F.substring(raw, (low + 1).cast("int"), (high - low).cast("int")).cast("string")
    low, high = F.col("cut.low_byte"), F.col("cut.high_byte")
    prefix, middle, suffix = part(F.lit(0), low), part(low, high), part(high, F.octet_length("text"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .otherwise(F.concat(s, suffix, p, prefix, m, middle))
    )
    units = lambda c: F.when(F.col("form") != "plain", c)
    return rows.withColumn("form", form).select(
        "doc_id", "text", F.col("cut.n").alias("n"), "form",
        units(F.col("cut.low")).alias("prefix_units"), units(F.col("cut.high") - F.col("cut.low")).alias("middle_units"), output.alias("output"),
    )


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    p, s, m = _checked(tuple(sentinels))
    between = lambda after, until: F.substring_index(F.substring_index(output, after, -1), until, 1)
    middle = F.substring_index(output, m, -1)
    psm, spm = F.concat(between(p, s), middle, between(s, m)), F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(rows: DataFrame) -> DataFrame:
    """What ``fill_in_middle`` gives over code points, with digests in place of
    the texts."""
    back = restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
