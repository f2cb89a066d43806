"""Best-fit packing of tokenised documents by hierarchical residual packing.

Documents become token pieces of at most ``CAPACITY`` tokens. Every partition
packs its own pieces best-fit, longest first. Bins with less than ``SLACK``
tokens left are done; of the others those with the most room go on as items of
their fill to a merge of ``FAN`` partitions, which packs them best-fit again,
and so on up a tree. After best fit at most one bin of a partition is half
empty or more, so what the tree can still save is about one bin per partition;
``CARRY`` bins of each are enough for it and bound what one task holds.

Only lengths and numbers are moved; texts are tokenised where they are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparqa.session import ship_package

from .common import saved, text_slices

#: Tokens of a sequence, and the id that ends a document.
CAPACITY = 4096
END_ID = 1
#: Pieces of a partition at first, partitions that a merge joins, bins each hands on, and room below which a bin is done.
PARTITION_PIECES = 50_000
FAN = 8
CARRY = 4096
SLACK = 32
#: Distinct words whose ids a task keeps, and words encoded in one call.
WORDS_KEPT = 400_000
WORDS_A_CALL = 2000
#: Rows that are cut into words at a time; the more, the fewer words are numbered and looked up again.
ROWS_A_CALL = 2048
#: Signs at the end of words that are encoded apart; none is a letter, a digit or an apostrophe.
SIGNS = ".,;:!?%&#*$|"
#: A special token of the vocabulary; put between words that are encoded in one call.
DIVIDER = "<|startoftext|>"
#: End of the tokens that end a word, and words that are letters before and after the vocabulary composes and drops case.
WORD_END = "</w>"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch


class _Table:
    """Ids of strings: a place for each, and at place k ``ids[start[k]:start[k + 1]]``."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.start = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.place.update(zip(strings, range(len(self.place), len(self.place) + len(strings))))
        self.ids = np.concatenate([self.ids, ids])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def places(self, strings: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at ``places`` one after the other, and where each begins and the last ends."""
        n = self.start[places + 1] - self.start[places]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.ids[np.repeat(self.start[places] - ends[:-1], n) + np.arange(int(ends[-1]))], ends


class WordIds:
    """Token ids of texts by a word-level vocabulary file.

    Its normaliser and its split see one word at a time (white space is dropped
    before the merges), so the ids of a text are those of its words in order.
    Arrow cuts texts into words and numbers the distinct ones; only these are
    looked up in a table of places in one flat array of ids. Words that are new
    are encoded in one call: words of letters divided by blanks, as each ends in
    one token that ends words, others by a special token.
    """

    def __init__(self, path: str) -> None:
        self.coder = _coder(path)
        self.divider = self.coder.token_to_id(DIVIDER)
        vocabulary = self.coder.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.coder.get_vocab_size(), bool)
        self.ends_word[[k for w, k in vocabulary.items() if w.endswith(WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        self.words, self.halves = _Table(), _Table()

    def _learn(self, words: list[str]) -> None:
        """Add words that are new: encode their new halves and put the ids of both together."""
        pairs = [half for w in words for half in _halves(w)]
        new = list(set(pairs).difference(self.halves.place))
        plain, other, order = [w for w in new if _LETTERS(w)], [w for w in new if not _LETTERS(w)], []
        found, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for at in range(0, len(plain), WORDS_A_CALL):
            part = plain[at:at + WORDS_A_CALL]
            ids = np.array(self.coder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends_word[ids])
            if len(cuts) != len(part):  # a vocabulary that ends its words otherwise
                other += part
                continue
            order += part
            found.append(ids)
            sizes.append(np.diff(cuts, prepend=-1))
        for at in range(0, len(other), WORDS_A_CALL):
            part = other[at:at + WORDS_A_CALL]
            if any(DIVIDER in w for w in part):
                lists = [np.array(e.ids, "<u4") for e in self.coder.encode_batch_fast(part, add_special_tokens=False)]
                found += lists
                sizes.append(np.array([*map(len, lists)], np.int64))
                continue
            ids = np.array(self.coder.encode_batch_fast([DIVIDER.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.divider)
            found.append(ids[ids != self.divider])
            sizes.append(np.diff([-1, *cuts, len(ids)]) - 1)
        self.halves.add(order + other, np.concatenate(found), np.concatenate(sizes))
        ids, ends = self.halves.gather(self.halves.places(pairs))
        self.words.add(words, ids, np.diff(ends[::2]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The little-endian unsigned 32-bit ids of all texts, and where those of each begin and end; null counts as empty."""
        if len(self.words.place) > WORDS_KEPT:
            self._clear()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        places = np.fromiter(map(self.words.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(places < 0)
        places[new] = len(self.words.place) + np.arange(len(new))
        self._learn([distinct[k] for k in new.tolist()])
        ids, ends = self.words.gather(places[words.indices.to_numpy()])
        offsets = lists.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]


def _halves(word: str) -> tuple[str, str]:
    """A word up to its last letter, and the signs behind it, which are split from a letter and so merged by themselves.

    Only an ASCII letter is sure to stay one when the vocabulary composes and
    drops case; so case is dropped here where all is ASCII, too.
    """
    if word.isascii() and word[-1:].isalpha():  # most words
        return word.lower(), ""
    core = word.rstrip(SIGNS)
    if not (core[-1:].isalpha() and core[-1:].isascii()):
        core = word
    return (core.lower() if core.isascii() else core), word[len(core):]


_CODERS: dict[str, object] = {}


def _coder(path: str):
    """The tokenizer of a file; of fixed size, so a worker keeps it."""
    if path not in _CODERS:
        from tokenizers import Tokenizer

        _CODERS[path] = Tokenizer.from_file(path)
    return _CODERS[path]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's token pieces."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    held: list[WordIds] = []  # filled in the task, so its words end with it

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, ends = held[0].encode(part.column(1))
        rows: list[tuple] = []
        for i, a, b in zip(part.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
            raw = flat[a:b].tobytes() + end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                piece = raw[at:at + 4 * capacity]
                rows.append((i, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.append(WordIds(vocabulary))
        for batch in batches:
            for part in text_slices(batch, "text", ROWS_A_CALL):
                yield cut(part)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker may go on to a stage that needs none of it

    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return body.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest items first into the fullest bin that has room; fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r is set if some bin has r left
    fill: list[int] = []
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_with[room].pop()
            if not open_with[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[item], offsets[item] = b, fill[b]
        fill[b] += size
        if room > size:
            open_with[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets, np.array(fill, np.int64)


def _pack(items: DataFrame, capacity: int, key: str) -> DataFrame:
    """Pack the items (length and more) of each value of ``key``; bin (unique), offset and fill of each."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema), "bin bigint, offset bigint, fill bigint"])

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([c for c in ("length", "doc_id", "piece", "ids_crc32", "item") if c in frame], ignore_index=True)
        bins, offsets, fill = best_fit(frame["length"].to_numpy(np.int64), capacity)
        return frame.assign(bin=(int(frame[key].iloc[0]) << 32) + bins, offset=offsets, fill=fill[bins])

    return items.groupBy(key).applyInPandas(one, schema)


def pack(parts: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) plus sequence_id and offset."""
    ship_package(parts.sparkSession)
    count = parts.count()
    width = max(1, math.ceil(count / partition_pieces))
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(width)).cast("int"))
    first = saved(_pack(dealt, capacity, "part"), "packed")
    place = None  # bin of the first round -> its last bin and the offset there
    bins = first.groupBy("bin", "part").agg(F.max("fill").alias("length"))
    level = 0
    while width > 1:
        width = math.ceil(width / FAN)
        level += 1
        rows = bins.where(F.col("length") <= capacity - SLACK)
        roomy = _roomiest(rows).select(F.col("bin").alias("item"), F.floor(F.col("part") / FAN).cast("int").alias("part"), "length")
        moved = saved(_pack(roomy, capacity, "part").withColumn("bin", F.col("bin") + (F.lit(level) * F.lit(1 << 58))), f"merge-{level}")
        step = moved.select("item", F.col("bin").alias("to"), F.col("offset").alias("add"))
        if place is None:
            place = step
        else:
            place = saved(place.join(step.select(F.col("item").alias("to"), F.col("to").alias("next"), F.col("add").alias("more")), "to", "left")
                          .select("item", F.coalesce("next", "to").alias("to"), (F.col("add") + F.coalesce("more", F.lit(0))).alias("add"))
                          , f"place-{level}")
        bins = moved.groupBy("bin", "part").agg(F.max("fill").alias("length"))
    if place is None:
        return first.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    return first.join(place, first["bin"] == place["item"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("add", F.lit(0))).alias("offset"))


def _roomiest(bins: DataFrame) -> DataFrame:
    """The ``CARRY`` bins of each partition with the most room."""
    return bins.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("length", "bin"))).where(F.col("n") <= CARRY)


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each for
    itself. An empty table gives no rows. Other columns are not looked at.
    """
    return pack(saved(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
