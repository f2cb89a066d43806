"""Substring dedup by prefix-partitioned suffix trees over words.

A repeat is a window of ``WINDOW`` words whose sequence also starts elsewhere.
Suffixes are sampled by content: of the ``PREFIX``-word sequences in a window
the one with the least hash is its anchor, and equal windows have equal
anchors at equal places. The anchor is the prefix by which suffixes are split
into groups:

1. anchors that occur once in the corpus head no repeat and are dropped;
2. an anchor with up to ``GROUP`` suffixes is a group of its own. Its suffixes
   go, with the words of the windows they anchor, to one task, which names the
   nodes of their tree at depths 1, 2, 4, ... and at last ``WINDOW`` by joining
   the names of two shorter ones (exact, on words; no hash decides). A node at
   depth ``WINDOW`` with two leaves or more is deep: its windows are repeats,
   and runs of such windows are the maximal repeats;
3. the prefix of a more frequent anchor is lengthened to all words of the
   windows it heads, then to each window. Such a group is one deep node, so its
   leaves are only counted, with partial sums before the shuffle; any number of
   copies of a passage is dealt out evenly.

Rows with the same text are repeats of each other throughout; one of them
stands for all in the groups.

Each task holds words of a bounded number of suffixes at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.session import ship_package

from .common import arrow_map, saved, text_slices

#: Words of a window, and of the shortest prefix.
WINDOW = 35
PREFIX = 8
#: Most suffixes in one group, and words that a task gathers from several groups before it builds their trees.
GROUP = 4000
TASK_WORDS = 250_000
#: Odd multiplier of the rolling hash, and distinct words whose hash a task keeps.
STEP = 0x9E3779B97F4A7C15
WORDS_KEPT = 200_000
MASK = (1 << 64) - 1


class _Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = h
        return h


_HASHES = _Hashes()


def _forget() -> None:
    """Drop the hashes that this worker keeps; later stages need none."""
    _HASHES.clear()


def _rolling(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, from the hashes of runs of powers of two."""
    n = len(h) - length + 1
    out, power, size, at = np.zeros(max(n, 0), np.uint64), h, 1, 0
    while n > 0 and length:
        if length & 1:
            out = out * np.uint64(pow(STEP, size, 1 << 64)) + power[at:at + n]
            at += size
        length >>= 1
        if length:
            power = power[:-size] * np.uint64(pow(STEP, size, 1 << 64)) + power[size:]
            size *= 2
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def anchors(words: list[bytes], window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: prefix hash, word position, first window and end of the windows each one heads."""
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none, none, none
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    grams = _mixed(_rolling(h, prefix))
    # leftmost least gram of every window: minima over runs of powers of two, then two that overlap
    span = window - prefix + 1
    at = np.arange(len(grams))
    size = 1
    while size * 2 <= span:
        left, right = at[:len(at) - size], at[size:]
        at = np.where(grams[left] <= grams[right], left, right)
        size *= 2
    left, right = at[:n], at[span - size:span - size + n]
    best = np.where(grams[left] <= grams[right], left, right)
    new = np.concatenate([[True], best[1:] != best[:-1]])
    first = np.flatnonzero(new)
    return grams[best[first]], best[first], first, np.append(first[1:], n)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _keyed(docs: DataFrame, *more) -> DataFrame:
    """(doc_id, h, text and more): ``h`` is the 128-bit digest of the text, so equal texts share it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.unhex(F.md5(text)).alias("h"), F.col("text").cast("binary").alias("text"), *more)


def _anchor_table(docs: DataFrame, window: int) -> DataFrame:
    def kernel(hs: list, texts: list) -> dict:
        found = [anchors(_words(t), window) for t in texts]
        return {"gram": np.concatenate([f[0].view(np.int64) for f in found]),
                "h": [h for h, f in zip(hs, found) for _ in range(len(f[0]))],
                "first": np.concatenate([f[2].astype(np.int32) for f in found])}

    return arrow_map(_keyed(docs), kernel, "gram bigint, h binary, first int", ["h", "text"])


def _listed(texts: DataFrame, window: int) -> DataFrame:
    """The listed anchors of each text: those in ``few`` one row each (gram, words, hs and firsts of one entry);
    for those in ``many`` the distinct segments of a slice of texts (slice, seg, windows, words) and where they stand.

    Equal segments of a slice are one row before anything is shuffled, so a passage that many texts
    share gives a row per slice and not one per copy. The slice's name is random; the table is saved
    before the name is used.

    Copies of a text stand together in a partition, and only the first of them is taken: they are
    known to be repeats of each other, and one is enough to find its windows elsewhere. A copy that
    is dealt to another task does no harm.
    """
    last: list = [None]
    columns = ("gram", "slice", "seg", "windows", "words", "hs", "firsts")

    def kernel(hs: list, texts: list, few: list, many: list) -> dict:
        out: dict[str, list] = {c: [] for c in columns}
        places: dict[bytes, tuple[int, list, list]] = {}
        for h, text, single, shared in zip(hs, texts, few, many):
            if h == last[0]:
                continue
            last[0] = h
            words = _words(text)
            gram, _, first, end = anchors(words, window)
            single, shared = set(single), set(shared)
            for g, a, b in zip(gram.view(np.int64).tolist(), first.tolist(), end.tolist()):
                if a not in single and a not in shared:
                    continue
                line = b" ".join(words[a:b + window - 1])
                if a in single:
                    for name, x in zip(columns, (g, None, None, None, line, [h], [a])):
                        out[name].append(x)
                else:
                    _, those, at = places.setdefault(line, (b - a, [], []))
                    those.append(h)
                    at.append(a)
        slice_name = uuid.uuid4().bytes
        for line, (windows, those, at) in places.items():
            for name, x in zip(columns, (None, slice_name, _digest(line), windows, line, those, at)):
                out[name].append(x)
        return out

    schema = "gram bigint, slice binary, seg binary, windows int, words binary, hs array<binary>, firsts array<int>"
    return arrow_map(texts, kernel, schema, ["h", "text", "few", "many"])


def _digest(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _frequent(segs: DataFrame, window: int) -> DataFrame:
    """(h, runs): repeated runs among the windows of frequent anchors, whose prefix is lengthened as far as they go.

    Equal segments (all windows of an anchor) are one leaf count. Only one of each kind is cut into
    windows, which are counted once more; the windows of segments that occur once are looked up there.
    """
    one = segs.select("seg", "words", F.size("hs").alias("n"), F.col("hs")[0].alias("h"), F.col("firsts")[0].alias("first"))
    kinds = saved(one.groupBy("seg").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("h", "first", "words"))), "kinds")
    met = segs.join(kinds.where("n > 1").select("seg"), "seg").groupBy("slice").agg(F.collect_list(F.struct("windows", "hs", "firsts")).alias("met"))
    equal = arrow_map(met, _joined, "h binary, first array<int>, last array<int>", ["met"]).select("h", F.arrays_zip("first", "last").alias("runs"))

    def kernel(ns: list, hs: list, firsts: list, lines: list) -> dict:
        out: dict[str, list] = {"digest": [], "alone": [], "h": [], "first": []}
        for n, h, first, line in zip(ns, hs, firsts, lines):
            words = line.split()
            for k in range(len(words) - window + 1):
                for name, x in zip(out, (_digest(b" ".join(words[k:k + window])), n == 1, h, first + k)):
                    out[name].append(x)
        return out

    cut = saved(arrow_map(kinds, kernel, "digest binary, alone boolean, h binary, first int", ["n", "h", "first", "words"]), "windows")
    again = cut.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    single = cut.where("alone").join(saved(again, "again"), "digest").select("h", "first", (F.col("first") + 1).alias("last"))
    return equal.unionByName(_as_runs(single))


def _as_runs(spans: DataFrame) -> DataFrame:
    return spans.select("h", F.array(F.struct("first", "last")).alias("runs"))


def _joined(slices: list) -> dict:
    """The runs of each text of each slice, from its repeated segments; those that meet are joined."""
    out: dict[str, list] = {"h": [], "first": [], "last": []}
    for met in slices:
        spans: dict[bytes, list[tuple[int, int]]] = {}
        for seg in met:
            for h, first in zip(seg["hs"], seg["firsts"]):
                spans.setdefault(h, []).append((first, first + seg["windows"]))
        for h, found in spans.items():
            firsts, lasts = [], []
            for first, last in sorted(found):
                if lasts and first <= lasts[-1]:
                    lasts[-1] = max(lasts[-1], last)
                else:
                    firsts.append(first)
                    lasts.append(last)
            for name, x in zip(out, (h, firsts, lasts)):
                out[name].append(x)
    return out


def deep_windows(segments: list[list[bytes]], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, whether the window at each of its words starts elsewhere in the segments too.

    Nodes at a depth get numbers: two runs of words have one number if they are equal. Those at a
    depth are numbered from pairs of numbers at half the depth.
    """
    code: dict[bytes, int] = {}
    size = np.fromiter(map(len, segments), np.int64, len(segments))
    flat = np.fromiter((code.setdefault(w, len(code)) for s in segments for w in s), np.int64, int(size.sum()))
    start = np.cumsum(size) - size
    counts = np.maximum(size - window + 1, 0)
    at = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    # names of runs of a power of two, for every place; runs across segments are named too but never asked for
    names, depth, parts, offset, left = flat, 1, [], 0, window
    while True:
        if left & 1:
            parts.append((offset, names))
            offset += depth
        left >>= 1
        if not left or len(names) <= depth:
            break
        names = _numbered(names[:-depth], names[depth:])
        depth *= 2
    node = parts[0][1][at]
    for shift, named in parts[1:]:
        node = _numbered(node, named[at + shift])
    leaves = np.bincount(node, minlength=1) if len(node) else np.zeros(1, np.int64)
    return np.split(leaves[node] > 1 if len(node) else np.zeros(0, bool), np.cumsum(counts)[:-1])


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs (a, b)."""
    if not len(a):
        return a
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _trees(grouped: DataFrame, window: int) -> DataFrame:
    """Runs (first, last + 1) of repeated windows in the groups of each partition, which is sorted by prefix."""
    def build(rows: list[tuple]) -> pa.RecordBatch:
        marks = deep_windows([r[3].split() for r in rows], window)
        made = [(r[1], r[2] + a, r[2] + b) for r, m in zip(rows, marks) for a, b in _runs(m)]
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.int32()))],
                                          names=["h", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        held: list[tuple] = []  # segments as they are; words become objects only while their trees are built
        words = 0
        for batch in batches:
            for part in text_slices(batch, "words"):
                for row in zip(*(part.column(c).to_pylist() for c in ("gram", "h", "first", "words"))):
                    if words >= TASK_WORDS and held[-1][0] != row[0]:
                        yield build(held)
                        held, words = [], 0
                    held.append(row)
                    words += row[3].count(b" ") + 1
        if held:
            yield build(held)
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker may go on to a stage that needs none of it

    return grouped.mapInArrow(run, "h binary, first int, last int")


def repeated_runs(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(h, copies, runs of (first, last)) of each text: how many rows have it, and its runs of window starts
    (last exclusive) whose window starts in another text or elsewhere in this one."""
    found = saved(_anchor_table(docs, window), "anchors")
    counts = saved(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "prefixes")
    ship_package(docs.sparkSession)

    starts = lambda which: F.collect_set(F.when(which, F.col("first")))
    anchors_of = found.join(counts, "gram").groupBy("h").agg(starts(F.col("n") <= group).alias("few"), starts(F.col("n") > group).alias("many"))
    listed = saved(_listed(_keyed(docs).join(anchors_of, "h").sortWithinPartitions("h"), window), "listed")
    small = listed.where("gram IS NOT NULL").select("gram", F.col("hs")[0].alias("h"), F.col("firsts")[0].alias("first"), "words")
    every = _as_runs(_trees(small.repartition("gram").sortWithinPartitions("gram"), window))
    if not counts.where(F.col("n") > group).isEmpty():
        every = every.unionByName(_frequent(listed.where("gram IS NULL").drop("gram"), window))
    runs = every.groupBy("h").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    copies = _keyed(docs).groupBy("h").agg(F.count("*").alias("copies"))
    return copies.join(runs, "h", "left").where((F.col("copies") > 1) | F.col("runs").isNotNull())


def _cleaned(docs: DataFrame, keyed: DataFrame, window: int, group: int, carry: list[str]) -> DataFrame:
    """``carry`` of ``keyed`` (h, text and more), with n_words, n_removed and kept (UTF-8 bytes)."""
    marked = keyed.join(repeated_runs(docs, window, group), "h", "left").select(
        *keyed.columns, F.col("copies").alias("_copies"), F.col("runs.first").alias("_first"), F.col("runs.last").alias("_last"))

    def kernel(texts: list, copies: list, firsts: list, lasts: list) -> dict:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for text, n, a, b in zip(texts, copies, firsts, lasts):
            words = _words(text)
            if (n or 0) > 1 and len(words) >= window:
                a, b = [0], [len(words) - window + 1]
            gone = np.zeros(len(words) + 1, np.int64)
            for first, last in zip(a or (), b or ()):
                gone[first] += 1
                gone[last + window - 1] -= 1
            left = (np.cumsum(gone[:-1]) == 0).tolist()
            kept = [w for w, k in zip(words, left) if k]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(kept))
            out["kept"].append(b" ".join(kept))
        return out

    return arrow_map(marked, kernel, "n_words bigint, n_removed bigint, kept binary", ["text", "_copies", "_first", "_last"], carry)


def repeat_report(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of ``docs``.

    A null or empty text has no words. Repeated rows each get a row, and all
    their windows count as repeats of each other. An empty table gives no
    rows. Columns other than doc_id and text are not looked at.
    """
    keyed = _keyed(docs)
    return _cleaned(docs, keyed, window, group, ["doc_id"]).withColumn("kept", F.col("kept").cast("string"))


def without_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """``docs`` with the words left as text and, if there is such a column, their length as n_chars.

    A text without repeats stays as it is, blanks and line breaks included; a
    null text stays null. Every row and all other columns stay.
    """
    rest = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    keyed = _keyed(docs, rest.alias("_rest"))
    done = _cleaned(docs, keyed, window, group, ["_rest", "text"])
    text = F.when(F.col("n_removed") == 0, F.col("text").cast("string")).otherwise(F.col("kept").cast("string"))
    out = done.select("_rest", text.alias("text"), "n_removed")
    chars = lambda kind: F.when(F.col("n_removed") == 0, F.col("_rest.n_chars")).otherwise(F.length("text").cast(kind))
    return out.select(*(F.col("text") if c == "text" else chars(docs.schema[c].dataType).alias(c) if c == "n_chars"
                        else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))
