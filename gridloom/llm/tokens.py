"""Token ids in files, in Simple-8b coding.

A 64-bit word holds a 4-bit selector and 60 bits of ids, all as wide as the
selector says; the largest count that fits is taken.  Selector 0 is an escape:
the next word is one value of up to 64 bits as it is.

A file is ``MAGIC``, blocks of words, a footer and a trailer.  Each block codes
``BLOCK_IDS`` ids (the last one the rest) from a word of its own, so blocks are
decoded alone, all words of one selector at a time.  The footer has the blocks'
word offsets, then for each document its id, whether the id is null, and its
count of tokens; the trailer has the three counts and ``MAGIC`` again.  All
numbers are little-endian.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import opened, written_file
from .shared import in_small_batches, qualified, saved, shared_folder

MAGIC = b"GLOOM8B1"
BLOCK_IDS = 1 << 16
#: (ids, bits) of a word by selector; 0 is the escape.
LAYOUT = [(1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([n for n, _ in LAYOUT] + [0])
#: Of each value how many layouts, from the narrowest on, are too narrow for it.
_BOUNDS = np.array([1 << bits for _, bits in LAYOUT[1:]], np.uint64)
_WIDTH = np.searchsorted(_BOUNDS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def encode(ids: np.ndarray) -> np.ndarray:
    """The words (uint64) that code ``ids`` (uint64)."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    width = _WIDTH[padded.astype(np.uint16)] if int(ids.max()) < 1 << 16 else np.searchsorted(_BOUNDS, padded, "right").astype(np.uint8)
    choice = np.zeros(n, np.int8)  # what no layout fits stays an escape
    for selector in range(len(LAYOUT) - 1, 0, -1):
        count = LAYOUT[selector][0]
        wide = width >= selector
        if not wide[:n].any():
            choice[:] = selector
            continue
        over = np.zeros(n + 61, np.int32)
        np.cumsum(wide, out=over[1:])
        fits = over[count : count + n] == over[:n]
        if not fits.any():
            break  # shorter runs don't fit, so longer ones can't
        choice[fits] = selector
    step = COUNTS[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts)
    own = choice[starts]
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(own == 0)[:-1]])
    words = np.zeros(len(starts) + int((own == 0).sum()), np.uint64)
    for selector in np.unique(own):
        count, bits = LAYOUT[selector]
        at, to = starts[own == selector], place[own == selector]
        if not selector:
            words[to + 1] = padded[at]
            continue
        word = np.full(len(at), int(selector) << 60, np.uint64)
        for j in range(count):
            word |= padded[at + j] << np.uint64(j * bits)
        words[to] = word
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids that ``words`` code."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = -1
    for i in np.flatnonzero(selectors == 0):
        if i == raw or i + 1 >= len(words):
            continue  # a value, not a selector
        raw = i + 1
        selectors[raw] = len(LAYOUT)  # holds no ids by itself
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(max(int(ends[-1]) if len(ends) else 0, n), np.uint64)
    for selector in np.unique(selectors):
        if selector == len(LAYOUT):
            continue
        at = np.flatnonzero(selectors == selector)
        first = ends[at] - counts[at]
        if not selector:
            out[first] = words[at + 1]
            continue
        count, bits = LAYOUT[selector]
        own, mask = words[at], np.uint64((1 << bits) - 1)
        for j in range(count):
            out[first + j] = (own >> np.uint64(j * bits)) & mask
    return out[:n]


class Writer:
    """Writes documents to one file."""

    def __init__(self, stream):
        self.stream, self.held, self.n_held = stream, [], 0
        self.blocks, self.docs, self.sizes, self.words, self.total = [], [], [], 0, 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK_IDS:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        held = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        end = len(held) if all_ else len(held) // BLOCK_IDS * BLOCK_IDS
        for a in range(0, end, BLOCK_IDS):
            words = encode(held[a : min(a + BLOCK_IDS, end)])
            self.stream.write(words.astype("<u8").tobytes())
            self.blocks.append(self.words)
            self.words += len(words)
        self.held, self.n_held = [held[end:]], len(held) - end

    def close(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.docs], np.uint8)
        for a in (np.array(self.blocks, "<i8"), np.array([d or 0 for d in self.docs], "<i8"), null, np.array(self.sizes, "<i8")):
            self.stream.write(a.tobytes())
        self.stream.write(struct.pack("<qqqq", len(self.docs), len(self.blocks), self.words, self.total) + MAGIC)


def read_documents(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file and their ids (uint32), decoded by blocks."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("no token file")
    n_docs, n_blocks, n_words, total = struct.unpack("<qqqq", data[-40:-8])
    words = np.frombuffer(data, "<u8", n_words, 8)
    at = 8 + 8 * n_words
    blocks = np.frombuffer(data, "<i8", n_blocks, at)
    docs = np.frombuffer(data, "<i8", n_docs, at + 8 * n_blocks)
    null = np.frombuffer(data, np.uint8, n_docs, at + 8 * (n_blocks + n_docs))
    sizes = np.frombuffer(data, "<i8", n_docs, at + 8 * (n_blocks + n_docs) + n_docs)
    ready, block = np.empty(0, np.uint32), 0
    for doc, is_null, size in zip(docs.tolist(), null.tolist(), sizes.tolist(), strict=True):
        parts, missing = [], size
        while missing > len(ready):
            parts.append(ready)
            missing -= len(ready)
            end = blocks[block + 1] if block + 1 < n_blocks else n_words
            ready = decode(words[blocks[block] : end], min(BLOCK_IDS, total - block * BLOCK_IDS)).astype(np.uint32)
            block += 1
        parts.append(ready[:missing])
        ready = ready[missing:]
        yield None if is_null else doc, parts[0] if len(parts) == 1 else np.concatenate(parts)


#: Memory of the pieces that a worker remembers, and the longest piece kept.
CACHE_BYTES, PIECE_CHARS = 320 << 20, 64
#: Characters that are looked up together, and pieces that are coded together:
#: few, as the library's own structures then stay in the processor's cache.
BLOCK_CHARS, CODED_TOGETHER = 1 << 18, 256


class CachedTokenizer:
    """The ids that a byte-level BPE tokenizer gives texts, piece by piece.

    Such a tokenizer cuts a text before each space that a visible character
    follows, and codes the pieces by themselves; so short pieces met before need
    no coding again.  A piece not met before is looked up by its parts where the
    tokenizer's pattern cuts it further; a part of ASCII letters, which that
    pattern and the byte level leave as they are, goes to the library's model
    without them.  A text with other white space after a space, or with the
    string of a special token, is coded whole.

    A piece stands without the space before it; ``MARK``, which no piece begins
    with, begins one that has no space before it.
    """

    OTHER = re.compile(r" (?:\s|$)")
    MARK = "\n"
    #: What GPT-2's pattern (ByteLevel's own) cuts apart wherever it stands:
    #: letters, marks but for the apostrophe of contractions, single line ends.
    PART = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[!-&(-/:-@[-`{-~]+|\n(?!\\s)")

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # pieces met lately, and those before them, which come back if met again
        self.limit, self.known, self.before, self.held = limit, {self.MARK: b""}, {}, 0

        cuts = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        if self.tokenizer.normalizer is None and cuts and cuts["type"] == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"]:
            self.words = Tokenizer.from_file(path)
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of each token: one a character of its name
        self.bytes[list(vocabulary.values())] = list(map(len, vocabulary))

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _has_special(self, text: str) -> bool:
        return any(map(text.__contains__, self.special))

    def _parts(self, piece: str) -> list[str]:
        """The pieces that ``piece`` is coded by."""
        if self.words is None:
            return [piece]
        word = piece.rstrip(".,;:!?")
        if word.isascii() and word.isalpha():
            return [word, self.MARK + piece[len(word) :]]
        mark, body = (self.MARK, piece[1:]) if piece[0] == self.MARK else ("", piece)
        parts = self.PART.findall(body)
        if sum(map(len, parts)) < len(body):
            return [piece]
        return [mark + parts[0], *(self.MARK + p for p in parts[1:])]

    def _cut(self, ids: np.ndarray, pieces: list[str], sizes: Iterable[int]) -> Iterator[tuple[str, bytes]]:
        """``ids`` of pieces in one go; they part where their bytes do."""
        ends = np.cumsum(self.bytes[ids])
        cuts = np.searchsorted(ends, np.cumsum(np.fromiter(sizes, np.int64, len(pieces))), "left") + 1
        raw, start = ids.tobytes(), 0
        for p, cut in zip(pieces, (4 * cuts).tolist(), strict=True):
            yield p, raw[start:cut]
            start = cut

    def _coded(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        words, spaced = [], []
        for p in pieces:
            body = p.removeprefix(self.MARK)
            if self.words is not None and body.isascii() and body.isalpha():
                words.append(p)
            elif p[0] == self.MARK:
                yield p, self._whole(body).tobytes()
            else:
                spaced.append(p)
        for a in range(0, len(words), CODED_TOGETHER):
            some = words[a : a + CODED_TOGETHER]
            names = [p[1:] if p[0] == self.MARK else "\u0120" + p for p in some]  # the byte level's name of a space
            ids = np.array(self.words.encode(" ".join(names), add_special_tokens=False).ids, np.uint32)
            yield from self._cut(ids, some, map(len, names))
        for a in range(0, len(spaced), CODED_TOGETHER):
            some = spaced[a : a + CODED_TOGETHER]
            text = " " + " ".join(some)
            if self._has_special(text):  # of several pieces
                yield from ((p, self._whole(f" {p}").tobytes()) for p in some)
            else:
                yield from self._cut(self._whole(text), some, (len(p.encode("utf-8")) + 1 for p in some))

    def _learn(self, pieces: set[str]) -> list[str]:
        """Makes all ``pieces`` known; returns those too long to be kept."""
        if self.held > self.limit // 2:
            self.known, self.before, self.held = {self.MARK: b""}, self.known, 0
        known, before, new, composed = self.known, self.before.get, {}, []
        for p in pieces.difference(known):
            raw = before(p)
            if raw is not None:
                self._keep(p, raw)
            elif p.isascii() and p.isalpha():
                new[p] = None
            else:
                parts = self._parts(p)
                for q in parts:
                    if q not in known:
                        new[q] = before(q)
                if len(parts) > 1:
                    composed.append((p, parts))
        for p, raw in new.items():
            if raw is not None:
                self._keep(p, raw)
        for p, raw in self._coded([p for p in new if p not in known]):
            self._keep(p, raw)
        for p, parts in composed:
            self._keep(p, b"".join([known[q] for q in parts]))
        return [p for p in (*pieces, *new) if len(p) > PIECE_CHARS] if max(map(len, pieces)) > PIECE_CHARS else []

    def _keep(self, piece: str, raw: bytes) -> None:
        self.known[piece] = raw
        if len(piece) <= PIECE_CHARS:
            self.held += 140 + 4 * len(piece) + len(raw)  # both objects and their entry, at most

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text.  Long texts are looked up by blocks."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        blocks, held = [], 0

        def look_up() -> None:
            long = self._learn(set().union(*(pieces for _, pieces in blocks)))
            for k, pieces in blocks:
                out[k].append(np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint32))
            for p in long:
                self.known.pop(p, None)
            blocks.clear()

        for k, text in enumerate(texts):
            if self.OTHER.search(text) or self._has_special(text):
                out[k].append(self._whole(text))
                continue
            start, mark = 0, self.MARK
            while start < len(text):
                end = text.find(" ", start + BLOCK_CHARS)
                end = len(text) if end < 0 else end
                blocks.append((k, (mark + text[start:end]).split(" ")))
                held += end - start
                start, mark = end + 1, ""
                if held >= BLOCK_CHARS:
                    look_up()
                    held = 0
        if blocks:
            look_up()
        return [np.concatenate(o) if len(o) > 1 else o[0] if o else np.empty(0, np.uint32) for o in out]


@functools.lru_cache(maxsize=1)
def cached_tokenizer(path: str) -> CachedTokenizer:
    """One for all tasks of a Python worker."""
    return CachedTokenizer(path)


#: Ids of a file, before the next one begins.
FILE_IDS = 1 << 24
FILES = "part long, file long, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Codes every text as the tokenizer does by itself, with ``end_id`` after
    it, into files below ``folder`` in ascending order of id, and returns the
    files: ``part, file`` (their order), ``path, n_docs, n_tokens``.  A task
    begins a new file after ``FILE_IDS`` ids.

    Null text counts as empty; a very long text is one document in one file.
    Null ids come first.  Rows of one id go by their text's hash, then the text.
    Further columns are not read.  Empty input: no files.
    """
    in_small_batches(docs.sparkSession)
    folder = qualified(docs.sparkSession, folder)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    schema = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = cached_tokenizer(tokenizer_path)
        each = (row for b in batches for row in zip(b.column(0).to_pylist(), coder.ids(b.column(1).to_pylist()), strict=True))
        row, file = next(each, None), 0
        while row is not None:
            with written_file(folder, "tokens", ".s8b") as (stream, path):
                writer = Writer(stream)
                while row is not None and writer.total < FILE_IDS:
                    writer.add(row[0], np.append(row[1], np.uint32(end_id)))
                    row = next(each, None)
                writer.close()
            out = {"part": [TaskContext.get().partitionId()], "file": [file], "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [writer.total]}
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            file += 1

    return saved(rows.mapInArrow(write, FILES), "token-files")


def read_tokens(files: DataFrame, ids: bool = True) -> DataFrame:
    """The documents in ``files`` (of ``write_tokens``): ``doc_id, start`` (ids
    of all documents before it), ``n_tokens, ids_crc32`` and, if asked for,
    the ``ids``."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("start"))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
    schema = pa.schema(fields if ids else fields[:-1])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as stream:
                    data = stream.read()  # of FILE_IDS ids and one document at most
                rows, held = [], 0
                for doc, own in read_documents(data):
                    rows.append((doc, start, len(own), zlib.crc32(own.astype("<u4", copy=False).tobytes()), own.astype(np.int32) if ids else None)[: len(schema)])
                    start += len(own)
                    held += len(own) * ids + 8
                    if held > 4 << 20:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return placed.repartition(min(max(1, files.count()), 10_000), "path").mapInArrow(read, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` written to token files in the shared folder and read back."""
    files = write_tokens(docs, shared_folder(docs.sparkSession, "tokens"), tokenizer_path)
    return read_tokens(files, ids=False)
