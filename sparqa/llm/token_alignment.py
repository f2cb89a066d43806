"""Alignment of two tokenisations of the same texts.

A is a byte-level merge vocabulary over space + text, B a piece vocabulary over
the text, which puts the space before it itself. Places where tokens of both
end cut a text into groups; tokens of a group are linked with each other.

Neither tokenizer joins anything over a blank that follows a visible sign, nor
over a line break there, so the full tokenisation of a text is that of its
chunks between such places, and a chunk is tokenised once a task. Behind it,
anchors are looked for: shared ends, verified by the byte offsets of both
tokenisations, before tokens that start with a space in both. They split a
document into windows of token ids, and the alignment of a window is kept under
its two id tuples. A document is then a list of window numbers.

Spark counts in how many documents an id pair is linked, takes the highest
count of each A id, and sums both over the links of each document. The pairs
that most documents hold, a bounded number of them, go to all tasks; the others
meet their counts in a join where no pair has more rows than documents hold it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.session import ship_package

from .common import saved, text_slices

#: Chunks that a task keeps, and new chunks that are tokenised in one call.
CHUNKS_KEPT = 300_000
CHUNKS_A_CALL = 4000
#: Id pairs whose counts go to all tasks, at most.
HOT_PAIRS = 1 << 17

BLANK = "▁"
#: Stands between the two id tuples of a window; no id of either vocabulary.
_BETWEEN = b"\xff\xff\xff\xff"
#: A blank run or a line break and what follows up to the next; blanks after other white space belong to what stands before.
_CHUNK = re.compile(r"(?: +|\n)[^ \n]*(?:(?<=\s)[ \n]+[^ \n]*)*")


class Tokenizers:
    """Both vocabularies, with the bytes of every entry; of fixed size, so a worker keeps them."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        sign = _byte_signs()
        special = self.a.get_added_tokens_decoder()
        size = 1 + max(self.a.get_vocab(with_added_tokens=True).values())
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [n.encode() if i in special else bytes(map(sign.__getitem__, n)) for i, n in enumerate(names)]
        self.b_size = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        if any("\n" in p or BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces that run over a line break or into the next word")
        self.blank, self.line_end = self.b.encode("\n")

    def a_ids(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def b_ids(self, text: str) -> list[int]:
        """Ids of a text that brings its own space; nothing joins a line break, so one before it stands apart."""
        ids = self.b.encode("\n" + text)
        if ids[:2] != [self.blank, self.line_end]:
            raise ValueError("a line break was joined to a piece")
        return ids[2:]


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 signs for
    themselves, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(rest)}


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Tokenizers(a_path, b_path)
    return _LOADED[a_path, b_path]


class _Grown:
    """A NumPy array that grows at its end."""

    def __init__(self, width: int = 0) -> None:
        self.rows = 0
        self.held = np.zeros((1024, width) if width else 1024, np.int64)

    def add(self, more: np.ndarray) -> None:
        need = self.rows + len(more)
        if need > len(self.held):
            self.held = np.concatenate([self.held[:self.rows], np.zeros((need, *self.held.shape[1:]), np.int64)])
        self.held[self.rows:need] = more
        self.rows = need


class Aligner:
    """Chunks and windows that a task has met.

    A window's record: its digest text, its numbers of A tokens, B tokens, groups
    and links, and its distinct id pairs with their links (a range of ``pairs``
    and ``times``). Window 0 stands for a chunk whose tokens do not give its bytes again.
    """

    def __init__(self, coder: Tokenizers, kept: int = CHUNKS_KEPT) -> None:
        self.coder, self.kept = coder, kept
        self.a_len = np.array([*map(len, coder.a_bytes)], np.int64)
        self.b_len = np.array([*map(len, coder.b_bytes)], np.int64)
        self.a_space = np.array([x[:1] == b" " for x in coder.a_bytes])
        self.b_space = np.array([x[:1] == b" " for x in coder.b_bytes])
        self._clear()

    def _clear(self) -> None:
        self.chunks: dict[str, bytes] = {}
        self.windows: dict[bytes, int] = {}
        self.text: list[str] = [""]
        self.sizes, self.pair_range = _Grown(4), _Grown(2)
        self.pairs, self.times = _Grown(), _Grown()
        for table in (self.sizes, self.pair_range):
            table.add(np.zeros((1, table.held.shape[1]), np.int64))

    def _align(self, chunks: list[str]) -> bool:
        """Tokenise chunks as one text and keep their windows; False if the tokens are not those of the bytes."""
        text = "".join(chunks)
        a, b = np.array(self.coder.a_ids(text), "<u4"), np.array(self.coder.b_ids(text), "<u4")
        x, y, raw = a.tolist(), b.tolist(), text.encode()
        if b"".join(map(self.coder.a_bytes.__getitem__, x)) != raw or b"".join(map(self.coder.b_bytes.__getitem__, y)) != raw:
            return False
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        shared, i, j = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        if not np.isin(ends, shared, assume_unique=True).all():
            return False
        # Anchors: verified shared ends before tokens that start with a space on both sides.
        anchor = np.zeros(len(shared), bool)
        anchor[:-1] = self.a_space[a[i[:-1] + 1]] & self.b_space[b[j[:-1] + 1]]
        of_chunk = np.isin(shared, ends, assume_unique=True)
        cut = np.flatnonzero(anchor | of_chunk)
        i, j = i + 1, j + 1  # of each group: the end of its tokens
        numbers, new = self._numbers(a, b, i[cut], j[cut])
        if new:
            self._record(a, b, i, j, cut, np.array(new))
        last = np.flatnonzero(of_chunk[cut]).tolist()
        held = np.array(numbers, "<u4").tobytes()
        at = 0
        for c, k in zip(chunks, last):
            self.chunks[c] = held[at:4 * k + 4]
            at = 4 * k + 4
        return True

    def _numbers(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[list[int], list[int]]:
        """The number of each window by its two id tuples, and the places of those met for the first time."""
        known, left, right = self.windows, a.tobytes(), b.tobytes()
        numbers, new = [], []
        p = r = 0
        for k, (q, s) in enumerate(zip((4 * a_cut).tolist(), (4 * b_cut).tolist())):
            key = left[p:q] + _BETWEEN + right[r:s]
            number = known.get(key)
            if number is None:
                number = known[key] = len(known) + 1
                new.append(k)
            numbers.append(number)
            p, r = q, s
        return numbers, new

    def _record(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, cut: np.ndarray, new: np.ndarray) -> None:
        """Add the records of the windows ``new``; window k has the groups after ``cut[k - 1]`` up to ``cut[k]``."""
        first = np.concatenate([[0], cut[:-1] + 1])[new]
        count = cut[new] + 1 - first
        start = np.cumsum(count) - count
        group = np.repeat(first - start, count) + np.arange(int(count.sum()))  # the groups of the new windows in order
        window = np.repeat(np.arange(len(new)), count)
        i0, j0 = np.concatenate([[0], i[:-1]])[group], np.concatenate([[0], j[:-1]])[group]
        wide, high = i[group] - i0, j[group] - j0
        n = wide * high
        total = lambda v: np.add.reduceat(v, start)
        self.sizes.add(np.column_stack([total(wide), total(high), count, total(n)]))
        # every link of the groups, then the distinct id pairs of a window
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(len(group)), n)
        pair = a[i0[of] + step // high[of]].astype(np.int64) * self.coder.b_size + b[j0[of] + step % high[of]]
        owner = window[of]
        order = np.lexsort((pair, owner))
        owner, pair = owner[order], pair[order]
        heads = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]))
        size = np.bincount(owner[heads], minlength=len(new))
        self.pair_range.add(np.column_stack([self.pairs.rows + np.cumsum(size) - size, size]))
        self.pairs.add(pair[heads])
        self.times.add(np.diff([*heads, len(pair)]))
        u, v = list(map(str, a.tolist())), list(map(str, b.tolist()))
        texts = [f"{u[p] if q - p == 1 else ','.join(u[p:q])}|{v[r] if s - r == 1 else ','.join(v[r:s])}"
                 for p, q, r, s in zip(i0.tolist(), (i0 + wide).tolist(), j0.tolist(), (j0 + high).tolist())]
        self.text += [texts[p] if n == 1 else ";".join(texts[p:p + n]) for p, n in zip(start.tolist(), count.tolist())]

    def _learn(self, chunks: Iterable[str]) -> None:
        plain = []
        for c in chunks:
            if BLANK in c or c[-1:].isspace():
                if not self._align([c]):
                    self.chunks[c] = b"\0\0\0\0"
            else:
                plain.append(c)
        for at in range(0, len(plain), CHUNKS_A_CALL):
            part = plain[at:at + CHUNKS_A_CALL]
            if not self._align(part):
                for c in part:
                    if not self._align([c]):
                        self.chunks[c] = b"\0\0\0\0"

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The window numbers of each text; none for texts that are null, empty or not given again by their tokens."""
        if len(self.chunks) > self.kept:
            self._clear()
        lists = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        self._learn(set().union(*lists).difference(self.chunks))
        known = self.chunks.__getitem__
        found = [np.frombuffer(b"".join(map(known, x)), "<u4") for x in lists]
        return [x if x.all() else x[:0] for x in found]


FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair array<bigint>, n array<bigint>"


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id of every row with the sizes and digest of its alignment, its distinct id pairs (A id * size of B + B id) and their links."""
    ship_package(docs.sparkSession)
    held: list[Aligner] = []  # filled in the task, so what is learned ends with it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Aligner(_tokenizers(a_path, b_path)))
        aligner = held[0]
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield _digest(aligner, part)

    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return body.mapInArrow(run, "doc_id bigint, " + FIELDS)


def _digest(aligner: Aligner, part: pa.RecordBatch) -> pa.RecordBatch:
    wins = aligner.encode(part.column(1).to_pylist())
    rows, length = len(wins), np.array([*map(len, wins)], np.int64)
    flat = np.concatenate([*wins, np.zeros(0, np.uint32)]).astype(np.int64)
    row = np.repeat(np.arange(rows), length)
    sums = [np.bincount(row, aligner.sizes.held[flat, k], rows).astype(np.int64) for k in range(4)]
    # distinct windows of a row, then distinct id pairs of a row
    key, times = np.unique(row * aligner.sizes.rows + flat, return_counts=True)
    at, (start, n) = key // aligner.sizes.rows, aligner.pair_range.held[key % aligner.sizes.rows].T
    places = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    owner, pair, weight = np.repeat(at, n), aligner.pairs.held[places], aligner.times.held[places] * np.repeat(times, n)
    order = np.lexsort((pair, owner))
    owner, pair, weight = owner[order], pair[order], weight[order]
    first = np.ones(len(pair), bool)
    first[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(first)
    total = np.add.reduceat(weight, heads) if len(heads) else weight
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[heads], minlength=rows))]), pa.int32())
    text = aligner.text.__getitem__
    digests = [hashlib.sha256(";".join(map(text, w.tolist())).encode()).hexdigest() if len(w) else "" for w in wins]
    return pa.RecordBatch.from_arrays(
        [part.column(0), *(pa.array(s) for s in sums), pa.array(digests, pa.string()),
         pa.ListArray.from_arrays(offsets, pa.array(pair[heads])), pa.ListArray.from_arrays(offsets, pa.array(total))],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "n"])


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, docs (rows that hold it linked) and whether that is the highest of its A id."""
    counts = saved(rows.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pair-counts")
    a = F.floor(F.col("pair") / F.lit(b_size))
    best = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))  # a row per entry of A's vocabulary at most
    return counts.join(F.broadcast(best), a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _hot_from(counts: DataFrame, limit: int) -> int:
    """The least power of two that at most ``limit`` pairs reach with their documents."""
    steps = counts.groupBy(F.floor(F.log2("docs")).cast("int").alias("step")).agg(F.count("*").alias("pairs")).collect()
    held, least = 0, 64
    for step, pairs in sorted(map(tuple, steps), reverse=True):
        held += pairs
        if held > limit:
            break
        least = step
    return 1 << min(least, 62)


def align_table(docs: DataFrame, a_path: str, b_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens do not give space + text again
    (a U+2581 in the text is taken for a space by B), have no tokens: zeros and
    an empty digest. Every row counts as a document, repeated rows and those without doc_id
    too. An empty table gives no rows. Very long texts are taken whole, one at a time. Other
    columns are not looked at.
    """
    rows = saved(alignments(docs, a_path, b_path).withColumn("rid", F.monotonically_increasing_id()), "alignments")
    counts = saved(pair_counts(rows, _tokenizers(a_path, b_path).b_size), "counts")
    hot = _hot_from(counts, hot_pairs)
    near = F.broadcast(counts.where(F.col("docs") >= hot))
    flat = rows.select("rid", F.inline(F.arrays_zip("pair", "n")))
    sums = lambda df: df.groupBy("rid").agg(F.sum(F.col("n") * F.col("docs")).alias("count_sum"),
                                            F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
    rest = flat.join(near, "pair", "left_anti").join(counts.where(F.col("docs") < hot), "pair")
    both = sums(flat.join(near, "pair")).unionByName(sums(rest)).groupBy("rid").agg(
        F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(both, "rid", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
