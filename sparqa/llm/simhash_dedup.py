"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints have 64 bits. A covering family for radius ``r`` gives each bit a
nonzero vector of ``r + 1`` bits; table ``v`` (every nonzero vector) keeps the
bits whose vector has an odd inner product with ``v``. The vectors of
up to ``r`` differing bits leave some ``v`` orthogonal to them all, so two
fingerprints within the radius have equal keys in that table: no pair is lost.

Only distinct fingerprints enter the tables, so exact copies cost one row. A
bucket with more than ``BUCKET`` fingerprints is dealt out again by a second
covering family over the bits its table left open; both keys together leave at
most ``OPEN_BITS`` bits open, which bounds any second bucket. Inside a bucket
a search over the fingerprints yields one link per member, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, saved
from .components import connected_components

#: Words in a shingle, seed of XXH64, and the largest number of differing bits of a link.
SHINGLE = 4
SEED = 42
RADIUS = 4
BITS = 64
#: Bits that the keys of both families leave open at most, so a second bucket has at most 2^24 fingerprints.
OPEN_BITS = 24
#: Distinct fingerprints that one bucket of the first family may hold.
BUCKET = 2048


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text's words as an unsigned 64-bit number; 0 without words."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only blanks and controls 9-13 split
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 4096):
        block = h[at:at + 4096]
        ones += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and ``fp`` (the fingerprint's bits as a signed bigint) of every row of ``docs``."""
    def kernel(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "fp": [_signed(fingerprint(t)) for t in texts]}

    body = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return arrow_map(body, kernel, "doc_id bigint, fp bigint", ["doc_id", "text"])


def covering_masks(radius: int, turn: int = 0) -> list[int]:
    """The masks of a covering family: one for each nonzero vector of ``radius + 1`` bits.

    Bit ``i`` gets one of the nonzero vectors; ``turn`` selects another dealing
    of the vectors to the bits, by an odd step through them.
    """
    size = (1 << (radius + 1)) - 1
    step = 1 + 10 * turn
    vector = [1 + (i * step + i // size + turn) % size for i in range(BITS)]
    return [sum(1 << i for i, a in enumerate(vector) if (a & v).bit_count() & 1) for v in range(1, size + 1)]


def _keys(fp: Column, masks: list[int]) -> Column:
    """An array of (table, key) of a fingerprint."""
    return F.array(*(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))


def bucket_links(fps: np.ndarray, reps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """One link per fingerprint that a search through near fingerprints reaches."""
    left = np.arange(len(fps))
    a: list[int] = []
    b: list[int] = []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[0], front[1:]
            near = np.bitwise_count(fps[left] ^ fps[at]) <= radius
            if near.any():
                found = left[near]
                a += [int(reps[at])] * len(found)
                b += reps[found].tolist()
                front, left = np.concatenate([front, found]), left[~near]
    return a, b


def _search(rows: DataFrame, keys: list[str], radius: int, limit: int | None) -> DataFrame:
    """Links inside the buckets of ``rows`` (keys, fp, rep), and members of buckets over ``limit``.

    Buckets are sorted runs of a partition; a run goes through a task in
    batches, and of a run over the limit nothing is held back.
    """
    schema = "a bigint, b bigint, t int, fp bigint, rep bigint"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        over = None  # key of a run that has passed the limit

        def spill(x: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"a": None, "b": None, "t": x["t"].astype("Int32"), "fp": x["fp"], "rep": x["rep"]})

        def search(x: pd.DataFrame) -> pd.DataFrame | None:
            fps, reps = x["fp"].to_numpy().view(np.uint64), x["rep"].to_numpy()
            a, b = bucket_links(fps, reps, radius)
            return pd.DataFrame({"a": a, "b": b, "t": None, "fp": None, "rep": None}) if a else None

        def ended(parts: list[pd.DataFrame]) -> pd.DataFrame | None:
            return search(pd.concat(parts, ignore_index=True)) if sum(map(len, parts)) > 1 else None

        for frame in frames:
            if not len(frame):
                continue
            grid = frame[keys].to_numpy()
            cuts = np.flatnonzero((grid[1:] != grid[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), len(frame)]
            last = len(bounds) - 2
            shared = np.flatnonzero(np.diff(bounds) > 1).tolist()  # the first and last run may go on in other batches
            out = []
            for k in sorted({0, last, *shared}):
                part, key = frame.iloc[bounds[k]:bounds[k + 1]], tuple(grid[bounds[k]])
                if k or (held and tuple(held[0][keys].iloc[0]) != key) or (over is not None and over != key):
                    if held:
                        out.append(ended(held))
                    held, over = [], None
                if over == key:
                    out.append(spill(part))
                    continue
                held.append(part)
                if limit is not None and sum(map(len, held)) > limit:
                    out += [spill(x) for x in held]
                    held, over = [], key
            if found := [x for x in out if x is not None]:
                yield pd.concat(found, ignore_index=True)
        if held and (x := ended(held)) is not None:
            yield x

    return rows.mapInPandas(run, schema)


def near_links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the ``rep`` of distinct fingerprints that join all pairs within ``radius``.

    ``distinct`` has one row (fp, rep) per fingerprint.
    """
    first, second = covering_masks(radius), covering_masks(radius, 1)
    dealt = distinct.select(F.explode(_keys(F.col("fp"), first)).alias("k"), "fp", "rep").select("k.t", "k.key", "fp", "rep")
    found = saved(_search(dealt.repartition("t", "key").sortWithinPartitions("t", "key"), ["t", "key"], radius, bucket), "near")
    large = found.where("a is null").select("t", "fp", "rep")
    table_mask = F.element_at(F.array(*(F.lit(_signed(m)) for m in first)), F.col("t") + 1)
    again = large.select("t", table_mask.alias("m"), "fp", "rep").select(
        "t", F.explode(F.array(*(F.struct(F.lit(u).alias("u"), F.col("fp").bitwiseAND(F.col("m").bitwiseOR(F.lit(_signed(m)))).alias("key"))
                                 for u, m in enumerate(second)))).alias("k"), "fp", "rep").select("t", "k.u", "k.key", "fp", "rep")
    rest = _search(again.repartition("t", "u", "key").sortWithinPartitions("t", "u", "key"), ["t", "u", "key"], radius, None)
    return found.where("a is not null").select("a", "b").unionByName(rest.select("a", "b")).distinct()


def simhash_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    A null or empty text, or one without words, has fingerprint zero and links
    like any other. Repeated rows each get a row. A row without doc_id takes
    part in no link; its component_id is that of its fingerprint, null if no
    row with a doc_id has it. An empty table gives no rows. Other columns are
    not looked at.
    """
    marked = saved(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    distinct = saved(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    nodes = connected_components(near_links(distinct, radius))
    known = distinct.join(nodes, F.col("rep") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return marked.join(known, F.col("fp") == F.col("_fp"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component: one row of each, all columns as they are.

    Of repeated rows with that doc_id the first in the order of the rows' hash stays; rows
    without doc_id go if a row with a doc_id has their fingerprint, else they stay.
    """
    parts = simhash_components(docs, radius)
    best = parts.where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    named = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    whole = docs.select(named.alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("_h"))
    first = whole.where("_id is not null").join(best, F.col("_id") == F.col("_keep")) \
        .withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("_h"))).where("_n = 1").select("_row")
    lone = parts.where("doc_id is null and component_id is null").select("fingerprint").distinct()
    return first.unionByName(_unnamed(whole, lone)).select("_row.*")


def _unnamed(whole: DataFrame, lone: DataFrame) -> DataFrame:
    """Rows without doc_id whose fingerprint no named row has."""
    rows = whole.where("_id is null").select("_row", F.col("_row.text").cast("binary").alias("text"))

    @F.pandas_udf("string")
    def digits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: f"{fingerprint(t):016x}")

    return rows.withColumn("_f", digits("text")).join(lone, F.col("_f") == F.col("fingerprint"), "left_semi").select("_row")
