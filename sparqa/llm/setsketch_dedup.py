"""Near-duplicate components by SetSketch registers, likelihood and full sets.

A document's set holds the XXH64 hashes of its distinct 4-word shingles. Every
element sends out random points at growing distances, each to a random
register; a register keeps the least distance that reaches it, rounded to a
power of ``BASE`` and cut to 16 bits. Equal elements send the same points, so
the sketch of a union is the register-wise maximum (``merged``) and two
registers agree about as often as two sets overlap.

Bands of ``BAND`` registers are the search: sets that share a band meet in a
bucket. Inside it, the registers in which one set lies above, below or level
with the other, and both set sizes, give the overlap of greatest likelihood.
A pair that the likelihood tells from a link is done; others are compared on
their full sets. Two rounds keep the pairs few:

1. A search through each bucket takes every set that looks linked to one
   already reached out of the bucket, so a bucket yields at most one pair per
   set. The pairs are verified, and the links found name components.
2. Buckets whose sets are in one component are done. In the others, the sets in
   a pair of two components that the likelihood cannot tell from a link come
   together, in blocks, and are all held against each other inside their task.

Exact copies of a set are one class and enter once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparqa.session import ship_package

from .common import met_by_key, saved, text_slices
from .components import connected_components

#: Words of a shingle, and the link rule 100 * intersection >= PERCENT * union.
SHINGLE = 4
PERCENT = 80
#: Registers (one is left over by the bands), their base, rate and largest value.
REGISTERS = 256
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
#: Bands and registers in each: a pair at 0.8 shares no band with probability (1 - 0.8^5)^51 = 2e-9.
BANDS = 51
BAND = 5
#: How much less likely (natural log) an overlap of 0.8 may be than the most likely one below it: 4.5 standard errors.
MARGIN = 10.0
#: Sets of one bucket that are searched together in round 1 and make a block in round 2, and elements of such a block.
BLOCK = 1024
BLOCK_ELEMENTS = 1 << 20
#: Columns that one step of the comparison of full sets takes.
COLUMNS = 4096
#: Rows of whole buckets that one step of a search takes.
STEP_ROWS = 8192
#: Pairs of rows that one step of round 2 holds against each other.
STEP_PAIRS = 4096
#: Pairs of one set that one task verifies at most, give or take.
PAIRS_A_TASK = 4096


# ------------------------------------------------------------------ sketches

def shingle_hashes(text: bytes | None) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its shingles (fewer words: of the whole sequence; none: empty)."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only blanks and controls 9-13 split
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(line)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())], np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixing one-to-one map of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers (uint16) of each set; an empty set has zeros.

    Points are drawn in steps of growing size for all sets at once, and an
    element is done when its next point lies beyond every register of its set.
    """
    least = np.full((len(sets), REGISTERS), np.inf)
    flat = least.reshape(-1)
    element = np.concatenate([*sets, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = np.zeros(len(element))
    drawn = 0
    while len(element):
        size = max(1, drawn)
        count = np.arange(drawn + 1, drawn + size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = _mixed(element[:, None] + count)
        gap = -np.log(((z >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53) / (REGISTERS * RATE)
        place = at[:, None] + np.cumsum(gap, axis=1)
        np.minimum.at(flat, owner[:, None] * REGISTERS + (z & np.uint64(REGISTERS - 1)).astype(np.int64), place)
        at, drawn = place[:, -1], drawn + size
        more = at < least.max(axis=1)[owner]
        element, owner, at = element[more], owner[more], at[more]
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(least) / math.log(BASE))
    return np.where(np.isfinite(least), np.clip(level, 0, TOP), 0).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    bands = registers[:, :BANDS * BAND].reshape(len(registers), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32), bands.shape[:2])
    for k in range(BAND):
        key = _mixed(key + bands[:, :, k] + np.uint64(0x9E3779B97F4A7C15))
    return key.view(np.int64)


# ---------------------------------------------------------------- likelihood

def _step(x: np.ndarray) -> np.ndarray:
    """Probability that a register lies above another, of the share x of the union that only its set has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def log_likelihood(overlap: np.ndarray, above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of the Jaccard overlap, given the registers above and below and both set sizes."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    p, q = _step(np.maximum(u - v * overlap, 1e-12)), _step(np.maximum(v - u * overlap, 1e-12))
    return above * np.log(p) + below * np.log(q) + (REGISTERS - above - below) * np.log(np.maximum(1 - p - q, 1e-12))


def most_likely(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The overlap of greatest likelihood, by ternary search (the likelihood has one peak)."""
    low, high = np.zeros(len(above)), np.minimum(size_a / size_b, size_b / size_a)
    for _ in range(24):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rising = log_likelihood(a, above, below, size_a, size_b) < log_likelihood(b, above, below, size_a, size_b)
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    return (low + high) / 2


def _slope(overlap: float, above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The derivative of the log-likelihood; as it has one peak, the peak is not below ``overlap`` if this is not negative."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    x, y = np.maximum(u - v * overlap, 1e-12), np.maximum(v - u * overlap, 1e-12)
    share = (BASE - 1) / BASE
    p, q = _step(x), _step(y)
    dp, dq = -v * share / (1 - x * share) / math.log(BASE), -u * share / (1 - y * share) / math.log(BASE)
    return above * dp / p + below * dq / q - (REGISTERS - above - below) * (dp + dq) / np.maximum(1 - p - q, 1e-12)


def _counted(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places of the pairs whose sizes allow a link; their registers above and below, their sizes, and whether a link is the likelier."""
    fits = np.flatnonzero(100 * np.minimum(size_a, size_b) >= PERCENT * np.maximum(size_a, size_b))  # exact: else no link
    x, y, n, m = a[fits], b[fits], size_a[fits].astype(float), size_b[fits].astype(float)
    above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
    return fits, above, below, n, m, _slope(PERCENT / 100, above, below, n, m) >= 0


def likely_links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Of pairs of sketches: whether a link is the likelier."""
    likely = np.zeros(len(a), bool)
    fits, *_, near = _counted(a, b, size_a, size_b)
    likely[fits] = near
    return likely


def open_links(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Of pairs of sketches: whether the likelihood leaves a link open.

    Any overlap that is more likely than the bound by more than ``MARGIN``
    rules a link out; the share of level registers is mostly one, so only the
    other pairs need the overlap of greatest likelihood.
    """
    bound = PERCENT / 100
    out = np.zeros(len(a), bool)
    fits, above, below, n, m, near = _counted(a, b, size_a, size_b)
    out[fits[near]] = True
    rest = np.flatnonzero(~near)
    fits, pairs = fits[rest], [x[rest] for x in (above, below, n, m)]
    at_bound = log_likelihood(np.full(len(fits), bound), *pairs)
    level = np.minimum(1 - (pairs[0] + pairs[1]) / REGISTERS, bound)
    unsure = np.flatnonzero(log_likelihood(level, *pairs) - at_bound <= MARGIN)
    if len(unsure):
        pairs = [x[unsure] for x in pairs]
        out[fits[unsure]] = log_likelihood(most_likely(*pairs), *pairs) - at_bound[unsure] <= MARGIN
    return out


# ------------------------------------------------------------ search in buckets

def spanning_pairs(bucket: np.ndarray, sketch: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the likely pairs of a search through each bucket: every b is met once.

    All buckets go on in step: each takes one set reached before, or a new one,
    and holds it against those it has not reached.
    """
    left, front = np.ones(len(bucket), bool), np.zeros(len(bucket), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        first = np.full(int(bucket.max()) + 1, -1) if len(bucket) else np.zeros(0, int)
        for mask in (left, front):  # a set in front goes before a new one
            places = np.flatnonzero(mask)[::-1]
            first[bucket[places]] = places
        pivots = first[first >= 0]
        left[pivots] = front[pivots] = False
        rest = np.flatnonzero(left)
        if not len(rest):
            break
        pivot = first[bucket[rest]]
        likely = likely_links(sketch[pivot], sketch[rest], size[pivot], size[rest])
        found.append((pivot[likely], rest[likely]))
        left[rest[likely]], front[rest[likely]] = False, True
    return tuple(np.concatenate([*(f[k] for f in found), np.zeros(0, int)]) for k in (0, 1))


def open_rows(unit: np.ndarray, block: np.ndarray, label: np.ndarray, sketch: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which rows of a unit have a pair of two components that the likelihood does not tell from a link.

    A unit is one block, all of whose pairs count, or two, of which pairs across
    count. A pair of two rows that are found already is not looked at.
    """
    order = np.lexsort((block, unit))
    unit, block, label, sketch, size = unit[order], block[order], label[order], sketch[order], size[order]
    first, last = np.searchsorted(unit, unit), np.searchsorted(unit, unit, "right")
    two = np.searchsorted(unit * 2 + (block != block[first]), unit * 2 + 1) if len(unit) else first  # where the second block begins
    pivots = np.flatnonzero(block == block[first])
    start = np.where(two < last, two, np.arange(len(unit)) + 1)[pivots]
    count = last[pivots] - start
    done, out, at = np.cumsum(count), np.zeros(len(unit), bool), 0
    while at < len(pivots):  # as many rows as have STEP_PAIRS pairs, one at least
        stop = max(int(np.searchsorted(done, (done[at - 1] if at else 0) + STEP_PAIRS, "right")), at + 1)
        n = count[at:stop]
        pivot = np.repeat(pivots[at:stop], n)
        rest = np.repeat(start[at:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        apart = (label[pivot] != label[rest]) & ~(out[pivot] & out[rest])
        pivot, rest = pivot[apart], rest[apart]
        open_ = open_links(sketch[pivot], sketch[rest], size[pivot], size[rest])
        out[pivot[open_]] = out[rest[open_]] = True
        at = stop
    found = np.zeros(len(unit), bool)
    found[order] = out
    return found


def full_links(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links between full sets (sorted), as few as join what links join."""
    size = np.array([*map(len, sets)], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count[column] > 1  # an element of one set alone is in no intersection
    owner, column = owner[often], (np.cumsum(count > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        held = np.zeros((len(sets), int(column[b - 1]) - at + 1), np.float32)  # sums below 2^24, so exact
        held[owner[a:b], column[a:b] - at] = 1
        shared += held @ held.T
    linked = (100 * shared >= percent * (size[:, None] + size[None, :] - shared)) & (shared > 0)
    left = np.ones(len(sets), bool)
    a, b = [], []
    for start in range(len(sets)):
        front, left[start] = [start] if left[start] else [], False
        while front:
            at = front.pop()
            near = np.flatnonzero(linked[at] & left)
            left[near] = False
            a += [at] * len(near)
            b += near.tolist()
            front += near.tolist()
    return np.array(a, int), np.array(b, int)


def _runs(frames: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition sorted by ``keys``, in steps of whole groups of at least ``rows`` rows together."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        for at in range(0, len(frame), rows):
            held.append(frame.iloc[at:at + rows])
            if sum(map(len, held)) >= rows:
                every = pd.concat(held, ignore_index=True)
                own = (every[keys] == every[keys].iloc[-1]).all(axis=1).to_numpy()  # the last group may go on
                held = [every[own]]
                if not own.all():
                    yield every[~own]
    if held:
        yield pd.concat(held, ignore_index=True)


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each group of ``keys`` a run of a partition, sorted by cid, so that every group's search starts at its least class."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, "cid")


def _groups(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    return (frame[keys] != frame[keys].shift()).any(axis=1).cumsum().to_numpy(np.int64) - 1


def _sketches_of(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["registers"]), np.uint16).reshape(len(frame), REGISTERS)


def _likely(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pairs (a, b) of cids, a < b, of the round 1 search in the groups of ``rows`` (keys, cid, n, registers)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(frames, keys, STEP_ROWS):
            cid = frame["cid"].to_numpy(np.int64)
            a, b = spanning_pairs(_groups(frame, keys), _sketches_of(frame), frame["n"].to_numpy(np.int64))
            yield pd.DataFrame({"a": np.minimum(cid[a], cid[b]), "b": np.maximum(cid[a], cid[b])})

    return _dealt(rows, keys).mapInPandas(run, "a bigint, b bigint").distinct()


def _open(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The ``rows`` (keys, cid, n, registers, block, label) with an open pair in their unit: keys and cid."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(frames, keys, STEP_ROWS):
            found = open_rows(_groups(frame, keys), frame["block"].to_numpy(np.int64), frame["label"].to_numpy(np.int64),
                              _sketches_of(frame), frame["n"].to_numpy(np.int64))
            yield frame.loc[found, [*keys, "cid"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return _dealt(rows, keys).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in (*keys, "cid")))


def _full(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct links (a, b) between the full sets of each group of ``rows`` (keys, cid, members)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(frames, keys, 256):
            cid, group = frame["cid"].to_numpy(np.int64), _groups(frame, keys)
            for places in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(group)) + 1):
                a, b = full_links([np.asarray(frame["members"].iat[k]) for k in places])
                if len(a):
                    x, y = cid[places[a]], cid[places[b]]
                    yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return _dealt(rows, keys).mapInPandas(run, "a bigint, b bigint").distinct()


# --------------------------------------------------------------------- tables

def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, set size, digest of the set, registers and band keys of every row; empty sets have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [shingle_hashes(t) for t in part.column(2).to_pylist()]
                registers = sketches(sets)
                keys = band_keys(registers)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([_digest(s) if f else None for s, f in zip(sets, full)], pa.binary()),
                     pa.array([r.tobytes() if f else None for r, f in zip(registers, full)], pa.binary()),
                     pa.array([k if f else None for k, f in zip(keys, full)], pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n", "digest", "registers", "keys"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, digest binary, registers binary, keys array<bigint>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                       F.col("text").cast("binary").alias("text"))


def _digest(members: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(members.tobytes())


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid and set (array<bigint>) of the classes ``wanted`` (cid, doc_id, text_hash, digest), from one of their texts each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = [shingle_hashes(t) for t in part.column(0).to_pylist()]
                same = [k for k, (s, d) in enumerate(zip(sets, part.column(2).to_pylist())) if _digest(s) == d]
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(same, pa.int64())),
                                                  pa.array([sets[k].view(np.int64) for k in same], pa.list_(pa.int64()))], names=["cid", "members"])

    texts, w = _texts(docs), wanted.select("cid", "digest", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    met = texts.join(w, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash")))
    return met.select("text", "cid", "digest").mapInArrow(run, "cid bigint, members array<bigint>").dropDuplicates(["cid"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets (cid, members) meet the link rule.

    A set in many pairs is copied, one copy for about ``PAIRS_A_TASK`` of them.
    """
    salt = []
    for side in ("a", "b"):
        degree = pairs.groupBy(side).agg(F.count("*").alias("pairs")).where(F.col("pairs") > PAIRS_A_TASK)
        total = degree.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        # at most 65 536 copied sets: more pairs a task where a corpus has more of them
        each = max(PAIRS_A_TASK, -(-int(total) // 65_536))
        salt.append(F.broadcast(saved(degree.where(F.col("pairs") > each).select(
            side, F.ceil(F.col("pairs") / F.lit(each)).cast("int").alias("copies")), f"copies-{side}")))
    one = lambda c: F.coalesce(c, F.lit(1))

    def met(rows: DataFrame, side: str, other: str, copies: DataFrame) -> DataFrame:
        own = sets.select(F.col("cid").alias(side), F.col("members").alias(f"set_{side}")).join(copies, side, "left")
        own = own.select(side, f"set_{side}", F.explode(F.sequence(F.lit(0), one("copies") - 1)).alias("salt"))
        return rows.join(copies, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), one("copies")).cast("int")).drop("copies").join(
            own, [side, "salt"]).drop("salt")

    both = met(met(pairs, "b", "a", salt[1]), "a", "b", salt[0])
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", shared.alias("shared"), F.size("set_a").alias("x"), F.size("set_b").alias("y")).where(
        F.lit(100) * F.col("shared") >= F.lit(percent) * (F.col("x") + F.col("y") - F.col("shared"))).select("a", "b")


def _buckets(classes: DataFrame) -> DataFrame:
    """key, cid, rows and first (least cid) of the buckets that hold several classes; of buckets with the same classes one."""
    places = classes.select(F.explode("keys").alias("key"), "cid")
    shared = saved(places.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "shared-keys")
    members = saved(met_by_key(places, shared, "key", "rows").select("key", "cid", "rows"), "members")
    found = members.groupBy("key").agg(F.max("rows").alias("rows"), F.min("cid").alias("first"), F.max("cid").alias("last"),
                                       F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"))
    kept = saved(found.groupBy("rows", "first", "last", "x", "y").agg(F.min("key").alias("key")).select("key", "rows", "first"), "kept-keys")
    return met_by_key(members.drop("rows"), kept, "key", "rows").select("key", "cid", "rows", "first")


def _near(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The links (a, b) between classes: enough of them to join whatever links join."""
    buckets = saved(_buckets(classes), "buckets")
    sets = saved(_sets(docs, classes.join(buckets.select("cid").distinct(), "cid", "left_semi")), "sets")
    sketch = classes.select("cid", "n", "registers")
    # Round 1: a bucket of many classes is cut, and its least class goes to each part.
    parts = F.ceil(F.col("rows") / F.lit(BLOCK)).cast("int")
    own = buckets.where("cid != first").select("key", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"), "cid")
    least = buckets.where("cid = first").select("key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "cid")
    likely = saved(_likely(own.unionByName(least).join(sketch, "cid"), ["key", "part"]), "likely")
    links = saved(verified(likely, sets), "links")
    labels = saved(connected_components(links).select(F.col("node").alias("cid"), F.col("component").alias("label")), "labels")
    # Round 2: buckets with several components, as blocks and pairs of blocks of bounded rows and elements.
    named = saved(buckets.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid")).join(sketch, "cid"), "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("rows").alias("size"), F.sum("n").alias("elements"))
    blocks = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("elements") / F.lit(BLOCK_ELEMENTS))).cast("int")
    mixed = saved(mixed.where("low != high").select("key", "size", blocks.alias("blocks")), "mixed-keys")
    units = met_by_key(named, mixed, "key", "size").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).select(
        "key", "cid", "label", "n", "registers", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")
    keys = ["key", "i", "j"]
    unsure = saved(_open(units, keys), "unsure")
    return links.unionByName(saved(_full(unsure.join(sets, "cid"), keys), "more-links"))


def near_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    A null or empty text, or one without words, has an empty set, no link, and
    its own doc_id as component. Repeated rows each get a row. Rows without
    doc_id link like others but give no component its name: a component without
    any doc_id has null, and ``kept`` compares null with null as equal. Very long
    texts are taken whole. Ties do not arise. An empty table gives no rows. Other
    columns are not looked at. Two shingles count as equal if their 64-bit hashes are.
    """
    ship_package(docs.sparkSession)
    rows = saved(_marked(docs), "sketches")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("place")
    classes = saved(rows.where("n > 0").groupBy("digest").agg(
        F.count("*").alias("held"), F.min("doc_id").alias("least"), place, F.any_value("n").alias("n"), F.any_value("registers").alias("registers"),
        F.any_value("keys").alias("keys")).select("digest", "held", "least", "place.doc_id", "place.text_hash", "n", "registers", "keys")
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    nodes = saved(connected_components(_near(docs, classes)), "nodes")
    joined = classes.select("cid", "least").join(nodes, F.col("cid") == F.col("node"))
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    named = saved(met_by_key(joined.select("cid", "component"), saved(names, "names"), "component", "classes").select("cid", "component_id"), "named")
    facts = classes.select("digest", "held", "cid", "least").join(named, "cid", "left").select(
        "digest", "held", F.when(F.col("component_id").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    own = rows.select("doc_id", "n", "digest")
    out = met_by_key(own.where("n > 0"), saved(facts, "facts"), "digest", "held").select("doc_id", "n", "component_id").unionByName(
        own.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
