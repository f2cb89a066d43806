"""Encoding with a piece vocabulary, the N best ways through its lattice, and decoding.

The encoding is the model's own: of all neighbours that join to a piece, those
with the highest score (merge rank) are joined first, the leftmost of equals.

The N best ways stand beside it. Scores of a merge model are ranks, not
log-probabilities, so the way of the highest sum is in general not the
encoding. A text becomes pieces whose scores add up; the lattice has an edge for every
piece that matches at a place and a byte edge for every byte of a character
without a piece. A forward Viterbi pass gives the best score from the start to
each place. Read backwards from the end, that score is the exact rest of a
path, so A-star search yields the segmentations in order of score.

No piece of the vocabulary runs from a letter into the next blank, so every
path passes the place before each run of blanks; if none joins a Latin letter
and another sign, it passes the places between those too. The chunks between
such places are cut and numbered by Arrow for many texts at a time. Distinct
chunks that are new are merged, and the best way through their lattice and the
score of the second found, for all of them at once, place by place. The N best
of a text leave the best way in the N - 1 chunks that lose least by it; only
those are searched by A-star, once per distinct chunk. So are chunks too long
to go with the others.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparqa.session import ship_package

from .common import arrow_map, text_slices

#: Segmentations wanted, and distinct chunks whose segmentations a task keeps.
N_BEST = 3
CHUNKS_KEPT = 400_000
#: Signs of a chunk above which it is searched by itself, and signs of the chunks that are searched together.
LONG = 64
SIGNS_A_CALL = 1 << 18
BLANK = "▁"
#: Score of a byte edge: below that of every piece, so bytes serve only where no piece does.
BYTE_SCORE = -1e6

_LETTER = "A-Za-zÀ-ɏ"
#: Kind of a sign by its first UTF-8 byte: blank, letter, other; bytes inside a sign have none. Of C9 .. only those up to 8F are letters.
_SPACE, _WORD, _OTHER, _INSIDE = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = _WORD
_KIND[0x80:0xC0] = _INSIDE
_KIND[0x20] = _SPACE
_JOINT = re.compile(f"[{_LETTER}][^{_LETTER}]|[^{_LETTER}{BLANK}][{_LETTER}]")


def _gather(values: np.ndarray, start: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[start[k]:start[k + 1]]`` for each k of ``places`` one after the other, and where each begins and the last ends."""
    n = start[places + 1] - start[places]
    ends = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(start[places] - ends[:-1], n) + np.arange(int(ends[-1]))], ends


class _Lookup:
    """Numbers by pairs of numbers (not negative), looked up many at a time; -1 where there is none."""

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        bits = (4 * len(pairs) + 1).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1), np.full(1 << bits, -1, np.int32)
        both = np.array([*pairs], np.int64).reshape(-1, 2)
        keys, values = both[:, 0] << 32 | both[:, 1], np.array([*pairs.values()], np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[free]  # one of those that meet stays
            kept = self.key[slot] == keys
            self.value[slot[kept]] = values[kept]
            keys, values, slot = keys[~kept], values[~kept], (slot[~kept] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = self._slot(keys)
        met, out = self.key[slot], self.value[slot]
        wrong = np.flatnonzero((met != keys) & (met >= 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.last
            met, out[wrong] = self.key[slot[wrong]], self.value[slot[wrong]]
            wrong = wrong[(met != keys[wrong]) & (met >= 0)]
        return out


class Pieces:
    """The vocabulary of a model file: pieces with scores, and byte pieces."""

    def __init__(self, path: str, n: int = N_BEST) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.n = n
        self.byte = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        usable = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {names[i]: float(model.get_score(i)) if model.get_score(i) > -1e8 else 0.0 for i in usable}
        self.id = {names[i]: i for i in usable}
        self.rank = {names[i]: float(model.get_score(i)) for i in usable}
        crossing = [p for p in self.id if BLANK in p.lstrip(BLANK)]
        if crossing:
            raise ValueError(f"pieces that run into the next word: {crossing[:3]}")
        self.kind = _KIND.copy()
        if any(map(_JOINT.search, self.id)):
            self.kind[self.kind == _WORD] = _OTHER
        self.longest = max(map(len, self.id))
        # What a beginning of a piece gives by itself: score and ids, or None if it is no piece.
        self.begins = dict.fromkeys(p[:k] for p in self.id for k in range(1, len(p))) | {p: (self.score[p], (i,)) for p, i in self.id.items()}
        self.raw = {i: p.replace(BLANK, " ").encode() for p, i in self.id.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.known: dict[str, list[tuple[float, bytes]]] = {}
        self._arrays()
        self._clear()

    def _arrays(self) -> None:
        """The vocabulary as arrays; ``size + b`` stands for a sign that goes by its b bytes, above that are signs that only longer pieces have."""
        size = self.size
        symbol = dict.fromkeys(c for p in self.id for c in p)
        symbol = {c: size + 5 + k for k, c in enumerate(symbol)} | self.id
        self.none = size + 5 + len(symbol)
        self.symbol = np.full(0x110000, self.none, np.int32)
        for c in symbol:
            if len(c) == 1 and c != BLANK:  # a blank sign of the text itself goes by its bytes
                self.symbol[ord(c)] = symbol[c]
        self.symbol[0x20] = symbol.get(BLANK, self.none)
        self.pairs = _Lookup({(symbol[p[:k]], symbol[p[k:]]): i for p, i in self.id.items() for k in range(1, len(p))
                              if p[:k] in symbol and p[k:] in symbol})
        node = {"": 0} | {p: k for k, p in enumerate(self.begins, 1)}
        self.steps = _Lookup({(node[p[:-1]], symbol[p[-1]]): k for p, k in node.items() if p})
        self.piece_at = np.array([self.id.get(p, -1) for p in node], np.int32)
        self.gain = np.full(size + 6, -np.inf)  # the last for no piece
        self.order = np.full(size + 1, -1, np.int32)
        ids = np.array([*self.id.values()])
        self.gain[ids] = [self.score[p] for p in self.id]
        self.gain[size + 1:size + 5] = BYTE_SCORE * np.arange(1, 5)
        self.order[ids] = np.unique([self.rank[p] for p in self.id], return_inverse=True)[1]
        raw = [self.raw.get(i, b"") for i in range(size)]
        self.raw_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_start = np.concatenate([[0], np.cumsum([*map(len, raw)])])

    def _clear(self) -> None:
        """Forget the chunks: a place for each, at place k its ids by merges and by the best way, its score, and what the second way loses."""
        self.place: dict[str, int] = {}
        self.own, self.own_start = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.best, self.best_start = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.total, self.loss = np.zeros(0), np.zeros(0)

    def merge(self, text: str) -> bytes:
        """Ids (unsigned 32-bit numbers) of a chunk by merges."""
        rank, end = self.rank, len(text)
        parts = list(text)  # a piece stands at its first place, its other places are empty
        before, after = list(range(-1, end - 1)), list(range(1, end + 1))
        open_ = [(-rank[text[a:a + 2]], a, a + 1, 2) for a in range(end - 1) if text[a:a + 2] in rank]
        heapq.heapify(open_)
        while open_:
            _, a, b, size = heapq.heappop(open_)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue  # one of the two has been joined since
            parts[a] += parts[b]
            parts[b] = ""
            after[a] = c = after[b]
            if c < end:
                before[c] = a
            for x, y in ((before[a], a), (a, c)):
                if x >= 0 and y < end and (r := rank.get(parts[x] + parts[y])) is not None:
                    heapq.heappush(open_, (-r, x, y, len(parts[x]) + len(parts[y])))
        ids = array("I")
        for p in filter(None, parts):
            if p in self.id:
                ids.append(self.id[p])
            else:
                ids.extend(self.byte[x] for x in ESCAPE.get(p, p).encode())
        return ids.tobytes()

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each place the edges that end there: (start, score, ids)."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(text) + 1)]
        begins, end = self.begins, len(text)
        for a, ch in enumerate(text):
            for b in range(a + 1, min(a + self.longest, end) + 1):
                p = text[a:b]
                if p not in begins:
                    break
                if (piece := begins[p]) is not None:
                    into[b].append((a, *piece))
            if ch not in self.id:
                raw = ESCAPE.get(ch, ch).encode()
                into[a + 1].append((a, BYTE_SCORE * len(raw), tuple(self.byte[x] for x in raw)))
        return into

    def chunk(self, text: str) -> list[tuple[float, bytes]]:
        """The N best (score, ids as unsigned 32-bit numbers) of a chunk; of equal scores the one found first."""
        if text in self.known:
            return self.known[text]
        into = self.edges(text)
        best = [0.0]
        for edges in into[1:]:
            best.append(max([best[a] + s for a, s, _ in edges]) if len(edges) > 1 else best[edges[0][0]] + edges[0][1])
        found: list[tuple[float, bytes]] = []
        # Every open path has a completion that scores as promised, so as many as are still wanted suffice.
        wanted = self.n
        count = 0
        open_: list[tuple] = [(-best[-1], len(text), 0, 0.0, None)]
        while open_ and wanted:
            _, at, _, done, path = open_.pop(0)
            if at == 0:
                ids = array("I")
                while path is not None:
                    ids.extend(path[0])
                    path = path[1]
                found.append((done, ids.tobytes()))
                wanted -= 1
                continue
            for a, s, i in into[at]:
                promised = -(best[a] + s + done)
                if len(open_) >= wanted:
                    last = open_[-1]
                    if promised > last[0] or promised == last[0] and a >= last[1]:
                        continue
                    open_.pop()
                count += 1
                insort(open_, (promised, a, count, s + done, (i, path)))
        if len(self.known) < CHUNKS_KEPT:
            self.known[text] = found
        return found

    def _merge_all(self, sym: np.ndarray) -> None:
        """Merge the rows of ``sym`` (its last column is ``none``), one pair of each row at a time; joined places become -1."""
        n, width = sym.shape
        joined = np.full(sym.shape, -1, np.int32)
        joined[:, :-1] = self.pairs.get(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, -1)
        order = self.order[joined]
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1)).ravel()
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32) % width, (n, 1)).ravel()
        flat, flat_joined, flat_order = sym.reshape(-1), joined.reshape(-1), order.reshape(-1)
        rows = np.arange(n)
        while True:
            a = order[rows].argmax(1)  # the leftmost of equals
            at = rows * width + a
            live = flat_order[at] >= 0
            rows, a, at = rows[live], a[live], at[live]
            if not len(rows):
                return
            row = rows * width
            b = row + after[at]
            c = row + after[b]
            flat[at] = made = flat_joined[at]
            flat[b] = flat_order[b] = -1
            after[at], before[c] = c - row, a
            left = row + before[at]
            for x, pair in ((at, self.pairs.get(made, flat[c])), (left, self.pairs.get(flat[left], made))):
                flat_joined[x], flat_order[x] = pair, self.order[pair]

    def _best_all(self, sym: np.ndarray, inside: np.ndarray, width: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of the best way of each row at the places where they begin (else -1), its score, and the score of the second way.

        Of equal ways the one that the search finds first: read from the end, the longest piece each time.
        """
        n, end = inside.shape
        signs = np.ascontiguousarray(sym.T).reshape(-1)
        most = min(self.longest, end)
        piece = np.full((most, end, n), -1, np.int32)  # by length and beginning
        at = np.flatnonzero(inside.T)
        node = np.zeros(len(at), np.int32)
        for k in range(most):
            node = self.steps.get(node, signs[at + k * n])
            on = np.flatnonzero(node >= 0)
            at, node = at[on], node[on]
            piece[k].reshape(-1)[at] = self.piece_at[node]
        single = piece[0]
        np.copyto(single, self.size + width.T, where=(single < 0) & inside.T)
        first, second = np.full((end + 1, n), -np.inf), np.full((end + 1, n), -np.inf)
        first[0] = 0
        last = np.zeros((end + 1, n), np.int32)
        for e in range(1, end + 1):
            m = int(np.searchsorted(-sizes, -e, "right"))  # rows that reach so far; the longest are first
            f, s, back = first[e, :m], second[e, :m], last[e, :m]
            for k in range(min(e, most), 0, -1):
                gain = self.gain[piece[k - 1, e - k, :m]]
                f2, s2 = first[e - k, :m] + gain, second[e - k, :m] + gain
                np.maximum(s, s2, out=s)
                np.maximum(s, np.minimum(f, f2), out=s)
                back[f2 > f] = k
                np.maximum(f, f2, out=f)
        out = np.full((n, end), -1, np.int32)
        rows, at = np.arange(n), sizes
        while len(rows):
            k = last[at, rows]
            at = at - k
            out[rows, at] = piece[k - 1, at, rows]
            rows, at = rows[at > 0], at[at > 0]
        return out, first[sizes, np.arange(n)], second[sizes, np.arange(n)]

    def _search(self, chunks: list[str]) -> tuple:
        """Ids by merges and their counts, ids of the best way and their counts, scores and losses of chunks, the longest first."""
        text = "".join(chunks)
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        utf8 = np.frombuffer(text.encode(), np.uint8)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        inside = np.arange(sizes[0]) < sizes[:, None]
        sym = np.full((len(chunks), int(sizes[0]) + 1), self.none, np.int32)
        width = np.zeros(inside.shape, np.int32)  # in bytes
        sym[:, :-1][inside] = self.symbol[code]
        width[inside] = wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        sign_at = np.cumsum(wide) - wide

        def ids(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            begin = found >= 0
            pieces = found[begin]
            counts = np.where(begin, np.maximum(found - self.size, 1), 0).sum(1)
            by_byte = pieces >= self.size
            if not by_byte.any():
                return pieces.astype("<u4"), counts
            n = np.maximum(pieces - self.size, 1)
            out = np.repeat(pieces, n).astype("<u4")
            runs = np.concatenate([[0], np.cumsum(n)])
            places, _ = _gather(np.arange(len(out)), runs, np.flatnonzero(by_byte))
            signs, _ = _gather(utf8, np.append(sign_at, len(utf8)), np.flatnonzero(begin[inside])[by_byte])
            out[places] = [self.byte[b] for b in signs.tolist()]
            return out, counts

        best, score, second = self._best_all(sym, inside, width, sizes)
        self._merge_all(sym)
        own = sym[:, :-1]
        np.copyto(own, np.where(inside, self.size + width, -1), where=own >= self.size)
        return *ids(own), *ids(best), score, score - second

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks that are new."""
        chunks = sorted(chunks, key=len, reverse=True)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        alone = int(np.searchsorted(-sizes, -LONG, "left")) if BLANK in self.id else len(chunks)
        parts = []
        for c in map(_signs, chunks[:alone]):
            own, ways = np.frombuffer(self.merge(c), "<u4"), self.chunk(c)
            best = np.frombuffer(ways[0][1], "<u4")
            second = ways[1][0] if len(ways) > 1 else -np.inf
            parts.append((own, [len(own)], best, [len(best)], [ways[0][0]], [ways[0][0] - second]))
        while alone < len(chunks):  # of at least half the length, so that little room is left open
            stop = min(int(np.searchsorted(-sizes, -(sizes[alone] // 2), "left")), alone + max(SIGNS_A_CALL // int(sizes[alone]), 1))
            stop = max(stop, alone + 1)
            parts.append(self._search(chunks[alone:stop]))
            alone = stop
        if not parts:
            return
        own, owns, best, bests, score, loss = map(np.concatenate, zip(*parts))
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + len(chunks))))
        self.own, self.best = np.concatenate([self.own, own]), np.concatenate([self.best, best])
        self.own_start = np.concatenate([self.own_start, self.own_start[-1] + np.cumsum(owns)])
        self.best_start = np.concatenate([self.best_start, self.best_start[-1] + np.cumsum(bests)])
        self.total, self.loss = np.concatenate([self.total, score]), np.concatenate([self.loss, loss])

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the chunks of texts begin, each with a blank before it, in their bytes."""
        kind = self.kind[data]
        if self.kind[0xC9] == _WORD:
            odd = np.flatnonzero(data == 0xC9)
            kind[odd[data[odd + 1] > 0x8F]] = _OTHER
        signs = np.flatnonzero(kind != _INSIDE)
        kind = kind[signs]
        begins = np.zeros(len(data) + 1, bool)
        begins[signs[1:][(kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)]] = True
        begins[offsets] = True
        return np.flatnonzero(begins[:-1])

    def _spelled(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether the ids of each text have its bytes."""
        raw, at = _gather(self.raw_bytes, self.raw_start, ids)
        at = at[ends]
        if np.array_equal(at, offsets) and np.array_equal(raw, data):
            return np.ones(len(offsets) - 1, bool)
        return np.array([raw[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(at, at[1:], offsets, offsets[1:])], bool)

    def _least(self, loss: np.ndarray, cuts: np.ndarray) -> list[list[int]]:
        """For each text its N - 1 chunks that lose least by another way (of equals the first), in their order."""
        out: list[list[int]] = [[] for _ in cuts[1:]]
        owner = np.repeat(np.arange(len(out)), np.diff(cuts))
        filled = np.flatnonzero(np.diff(cuts))
        least = np.full(len(out), np.inf)
        for _ in range(self.n - 1 if len(filled) else 0):
            least[filled] = np.minimum.reduceat(loss, cuts[filled])
            hits = np.flatnonzero((loss == least[owner]) & (loss < np.inf))
            hits = hits[np.diff(owner[hits], prepend=-1) > 0]
            for t, k in zip(owner[hits].tolist(), hits.tolist()):
                out[t].append(k)
            loss[hits] = np.inf
        return [sorted(ks) for ks in out]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[tuple[float, bytes]]], list[bool]]:
        """The encodings of texts, and where those of each begin and end; the N best (score, ids) of each; whether all decode to the text.

        Null counts as empty. No piece crosses chunks, so each is merged by
        itself. A way that leaves the best path in some chunk scores no more
        than the one that leaves it there alone, so only the N - 1 chunks with
        the least loss can matter.
        """
        if len(self.place) > CHUNKS_KEPT:
            self._clear()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        spaced = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
        _, offsets, data = spaced.buffers()
        offsets = np.frombuffer(offsets, np.int32)[spaced.offset:spaced.offset + len(spaced) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        starts = self._cut(data, offsets)
        cuts = np.searchsorted(starts, offsets)
        bounds = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        chunks = pa.StringArray.from_buffers(len(starts), bounds, pa.py_buffer(data)).dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(places < 0)
        self._learn([distinct[k] for k in new.tolist()])
        places[new] = [self.place[distinct[k]] for k in new.tolist()]
        of = chunks.indices.to_numpy()
        places = places[of]
        own, own_ends = _gather(self.own, self.own_start, places)
        best, ends = _gather(self.best, self.best_start, places)
        right = self._spelled(own, own_ends[cuts], data, offsets) & self._spelled(best, ends[cuts], data, offsets)
        totals, filled = np.zeros(len(texts)), np.flatnonzero(np.diff(cuts))
        if len(filled):
            totals[filled] = np.add.reduceat(self.total[places], cuts[filled])
        every, fits = [], []
        for t, least in enumerate(self._least(self.loss[places], cuts)):
            found = {k: self.chunk(_signs(distinct[of[k]])) for k in least}
            ways: list[tuple[float, dict[int, int]]] = [(0.0, {})]
            for k, part in found.items():
                more = [(loss + part[0][0] - s, use | {k: j}) for loss, use in ways for j, (s, _) in enumerate(part)]
                ways = heapq.nsmallest(self.n, more, key=lambda x: x[0])
            out, fit = [], bool(right[t])
            for loss, use in ways:
                at, ids = ends[cuts[t]], []
                for k, j in use.items():
                    if j:
                        other = found[k][j][1]
                        ids += [best[at:ends[k]].tobytes(), other]
                        at = ends[k + 1]
                        fit = fit and b"".join(map(self.raw.__getitem__, array("I", other))) == distinct[of[k]].encode()
                out.append((float(totals[t]) - loss, b"".join([*ids, best[at:ends[cuts[t + 1]]].tobytes()])))
            if not fit:  # bytes that are not the text's may still decode to it
                lists = [own[own_ends[cuts[t]]:own_ends[cuts[t + 1]]], *(np.frombuffer(raw, "<u4") for _, raw in out)]
                fit = all(self.decode(ids.tolist()) == texts[t].as_py() for ids in lists)
            every.append(out)
            fits.append(fit)
        return own, own_ends[cuts], every, fits

    def model_ids(self, text: str) -> bytes:
        """The encoding of a text, unsigned 32-bit numbers."""
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The N best (score, ids as unsigned 32-bit numbers) of a text, best first."""
        return self.encode_all(pa.array([text]))[2][0]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces joined, runs of byte pieces as UTF-8, blanks as spaces."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


#: A blank sign of the text itself, kept apart from those that stand for spaces (no text holds a lone
#: surrogate); it goes by its bytes.
_OWN = "\udc00"
ESCAPE = {_OWN: BLANK}


def _signs(chunk: str) -> str:
    """A chunk as it stands in the text with its spaces as blank signs."""
    return chunk.replace(BLANK, _OWN).replace(" ", BLANK)


def escaped(text: str) -> str:
    """Spaces as blank signs, one put before the text."""
    return _signs(" " + text) if text else ""


_MODELS: dict[tuple[str, int], Pieces] = {}


def _model(path: str, n: int) -> Pieces:
    if (path, n) not in _MODELS:
        _MODELS[path, n] = Pieces(path, n)
    return _MODELS[path, n]


def encode_table(rows: DataFrame, model: str, keys: list[str], n: int = N_BEST) -> DataFrame:
    """``keys`` of every row, with ids, n_pieces and ids_crc32 of the encoding, scores of the N best, n_best, best_crc32, second_crc32, round_trip.

    ``round_trip`` tells whether decoding the encoding and each of the N best
    gives the text again. A null or empty text has no pieces and one
    segmentation, the empty one. Repeated rows each get a row; an empty table
    gives no rows. Other columns are not looked at.
    """
    ship_package(rows.sparkSession)
    body = rows.select(*keys, F.col("text").cast("string").alias("text"))
    made = StructType.fromDDL("ids array<int>, n_pieces bigint, ids_crc32 bigint, scores array<double>, n_best int, best_crc32 bigint, "
                              "second_crc32 bigint, round_trip boolean")

    def encoded(part: pa.RecordBatch) -> pa.RecordBatch:
        own, ends, every, fits = _model(model, n).encode_all(part.column(len(keys)))
        crc = [[zlib.crc32(raw) for _, raw in ways[:2]] for ways in every]
        columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own.view("<i4"), pa.int32())),
                   pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(own[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.int64()),
                   pa.array([[s for s, _ in ways] for ways in every], pa.list_(pa.float64())), pa.array([*map(len, every)], pa.int32()),
                   pa.array([x[0] for x in crc], pa.int64()), pa.array([x[1] if len(x) > 1 else None for x in crc], pa.int64()), pa.array(fits, pa.bool_())]
        return pa.RecordBatch.from_arrays([*part.columns[:len(keys)], *columns], names=[*keys, *made.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield encoded(part)

    return body.mapInArrow(run, StructType([*body.schema.fields[:len(keys)], *made.fields]))


def decode_table(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``rows`` plus ``decoded``, the text of the array of ids (null: empty)."""
    def kernel(lists: list) -> dict:
        coder = _model(model, N_BEST)
        return {"decoded": [coder.decode(x or []) for x in lists]}

    return arrow_map(rows, kernel, "decoded string", [ids], rows.columns)
