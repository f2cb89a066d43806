"""Deterministic positions, sampling, shuffling, splitting and sharding.

Two mechanisms, neither with a one-partition window or a table that grows on the driver:

* **Positions** (R1, R3). Rows are range-partitioned by (stratum, order) from
  sampled splitters and sorted; their number inside the partition is kept with
  them. A two-level prefix sum, over the partitions of each stratum, adds what comes before.
* **Cuts** (R2, R4, R5). Sampling, splitting and sharding only ask on which side
  of a few cut positions a row falls. The row at a cut is selected by narrowing
  over the key column alone: counts per range, then per range of the one that
  holds the cut, until few rows are left. The wide rows are then
  compared with the cut keys, in one scan without join, window or shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import stored

DEFAULT_SEED = 42
BUCKET_ROWS = 250_000      # target rows of a range partition
HASH_DIGITS = 3            # md5 digits by which one step narrows: 4096 counts
RANGES = 256               # ranges by which one step narrows a natural order
FEW_ROWS = 4096            # rows around a cut that are looked at one by one
NEAR_ROWS = 1 << 17        # strata whose cuts go to all tasks; more are shuffled
PARTITION_BITS = 33        # ``monotonically_increasing_id``: partition above, row number below

_H, ROW, _POS = "__h", "__m", "__pos"


# ---------------------------------------------------------------- order keys

def seeded_hash(key: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """``md5(seed|key)``: the random order used for sampling and shuffling
    (a null key hashes like the empty string, so its row is kept)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(k.cast("string"), F.lit(""))))


def _order(df: DataFrame, key: str, order: str, seed: int) -> tuple[DataFrame, list[str]]:
    """``df`` with what it is ordered by, and those columns."""
    if order == "hash":
        return df.withColumn(_H, seeded_hash(key, seed)), [_H, key]
    if order == "key":
        return df, [key]
    raise ValueError(f"order must be 'hash' or 'key', not {order!r}")


# ------------------------------------------------------------------ R1 / R3

def with_position(df: DataFrame, key: str, out: str = "pos", order: str = "hash",
                  seed: int = DEFAULT_SEED, by: tuple[str, ...] = ()) -> DataFrame:
    """Add the exact 0-based position of every row (within its ``by``
    stratum, if given; null is a stratum like others).

    ``order="hash"`` is the seeded random order ``(md5(seed|key), key)`` (a full
    shuffle, R3); ``order="key"`` is the natural order of ``key``, nulls first.
    ``key`` must be unique, of any orderable type.
    """
    d, columns = _order(df, key, order, seed)
    return _positions(d, tuple(by), columns, out).drop(_H)


def in_order(d: DataFrame, by: tuple[str, ...], columns: list[str], name: str) -> DataFrame:
    """``d`` range-partitioned and sorted by (by, columns), stored with ``ROW``: range partition and number inside it."""
    parts = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(d.count() / BUCKET_ROWS))
    return stored(d.repartitionByRange(parts, *by, *columns).sortWithinPartitions(*by, *columns)
                  .withColumn(ROW, F.monotonically_increasing_id()), name)


def partition_of() -> Column:
    """The range partition of a row of ``in_order``."""
    return F.shiftright(ROW, PARTITION_BITS)


def _positions(d: DataFrame, by: tuple[str, ...], columns: list[str], out: str) -> DataFrame:
    spark = d.sparkSession
    placed = in_order(d, by, columns, "positions")
    part, number = partition_of(), F.col(ROW).bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    runs = placed.groupBy(part.alias("__part"), *by).agg(F.count(F.lit(1)).alias("__cnt"), F.min(number).alias("__first"))
    before = F.coalesce(F.sum("__cnt").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if by:
        starts = runs.select("__part", *(F.col(c).alias(f"__s_{c}") for c in by), (before - F.col("__first")).alias("__start"))
    else:  # a row per partition
        rows, total = [], 0
        for r in sorted(runs.collect()):
            rows.append((r["__part"], total - r["__first"]))
            total += r["__cnt"]
        starts = F.broadcast(spark.createDataFrame(rows, "__part long, __start long"))
    same = [part == starts["__part"], *(placed[c].eqNullSafe(starts[f"__s_{c}"]) for c in by)]
    return placed.join(starts, same).withColumn(out, F.col("__start") + number).select(*(c for c in d.columns), out)


# ------------------------------------------------------------- cuts by key

Cuts = Callable[[int], list[int]]  # the positions at which a new segment begins, of a number of rows


def _hash_cuts(narrow: DataFrame, key: str, cuts: Cuts) -> list[tuple | None]:
    """(hash, key) of the row at each cut position, in the order of (hash, key); None past the last row."""
    def counted(df: DataFrame, digits: int) -> list[tuple[str, int]]:
        return sorted(map(tuple, df.groupBy(F.substring(_H, 1, digits).alias("b")).agg(F.count(F.lit(1))).collect()))

    digits = HASH_DIGITS
    counts = counted(narrow, digits)
    want = {i: ("", p) for i, p in enumerate(cuts(sum(n for _, n in counts)))}  # cut -> prefix, rank below it
    held: dict[str, int] = {}
    while True:
        for i, (prefix, rank) in want.items():
            for b, n in counts:
                if b.startswith(prefix) and len(b) > len(prefix):
                    if rank < n:
                        want[i] = (b, rank)
                        held[b] = n
                        break
                    rank -= n
        wide = sorted({b for b, _ in want.values() if b and held[b] > FEW_ROWS and len(b) < 32 and len(b) == digits})
        if not wide:
            break
        digits = min(32, digits + HASH_DIGITS)
        counts = counted(narrow.where(F.substring(_H, 1, len(wide[0])).isin(wide)), digits)
    found: list[tuple | None] = [None] * len(want)
    ends = sorted({b for b, _ in want.values() if b})
    if ends:
        hit = [F.col(_H).startswith(b) for b in ends]
        rows = [(r[_H], r[key]) for r in narrow.where(_any(hit)).select(_H, key).collect()]
        rows.sort(key=lambda r: (r[0], r[1] is not None, r[1]) if r[1] is not None else (r[0], False))
        for i, (prefix, rank) in want.items():
            inside = [r for r in rows if prefix and r[0].startswith(prefix)]
            found[i] = inside[rank] if rank < len(inside) else None
    return found


def _key_cuts(narrow: DataFrame, key: str, cuts: Cuts) -> list[tuple | None]:
    """(key,) of the row at each cut position in the natural order, nulls first; None past the last row."""
    nulls, total = narrow.select(F.count_if(F.col(key).isNull()), F.count(F.lit(1))).first()
    kind = narrow.schema[key].dataType
    ranks = {i: max(p - nulls, 0) for i, p in enumerate(cuts(total))}
    found: list[tuple | None] = [None] * len(ranks)
    left = {i: r for i, r in ranks.items() if r < total - nulls}
    where: dict[int, tuple | None] = dict.fromkeys(left)  # the range that holds the cut
    rows, size = narrow.where(F.col(key).isNotNull()).select(key), total - nulls
    while left:
        spans = sorted({s for s in where.values() if s is not None})
        span = F.lit(0)
        for k, (low, high) in enumerate(spans):
            span = F.when((F.col(key) >= F.lit(low).cast(kind)) & (F.col(key) <= F.lit(high).cast(kind)), F.lit(k)).otherwise(span)
        inside = rows if not spans else rows.where(_any([(F.col(key) >= F.lit(a).cast(kind)) & (F.col(key) <= F.lit(b).cast(kind)) for a, b in spans]))
        ranges = min(RANGES, max(2, math.ceil(4 * size / FEW_ROWS)))
        ranged = inside.repartitionByRange(ranges, key).select(key, F.spark_partition_id().alias("__part"), span.alias("__span"))
        counts = ranged.groupBy("__span", "__part").agg(F.count(F.lit(1)), F.min(key), F.max(key)).collect()
        few: dict[int, tuple] = {}
        size = 0
        for i, rank in list(left.items()):
            own = 0 if where[i] is None else spans.index(where[i])
            for s, _, n, low, high in sorted(counts, key=lambda r: (r[0], r[1])):
                if s != own:
                    continue
                if rank < n:
                    left[i], where[i], size = rank, (low, high), size + n
                    if n <= FEW_ROWS or low == high:
                        few[i] = (low, high)
                    break
                rank -= n
        if few:
            spans = sorted(set(few.values()))
            near = rows.where(_any([(F.col(key) >= F.lit(a).cast(kind)) & (F.col(key) <= F.lit(b).cast(kind)) for a, b in spans if a != b] or [F.lit(False)]))
            keys = sorted(r[0] for r in near.collect())
            for i, (low, high) in few.items():
                found[i] = (low,) if low == high else ([x for x in keys if low <= x <= high][left[i]],)
                del left[i], where[i]
    return found


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _reached(columns: list[str], cut: tuple, kinds: dict) -> Column:
    """Whether a row stands at the cut or behind it (nulls come first)."""
    column, value = F.col(columns[0]), cut[0]
    behind = F.lit(True) if value is None else F.coalesce(column >= F.lit(value).cast(kinds[columns[0]]), F.lit(False))
    if len(columns) == 1:
        return behind
    level = column == F.lit(value)
    return (column > F.lit(value)) | (level & _reached(columns[1:], cut[1:], kinds))


def assign_by_cuts(df: DataFrame, key: str, cuts: Cuts, out: str, order: str = "hash", seed: int = DEFAULT_SEED) -> DataFrame:
    """Add ``out``, how many of the cut positions a row has reached (0 before the first).

    ``key`` must be unique; rows of equal key would all go to one side.
    """
    d, columns = _order(df, key, order, seed)
    found = _hash_cuts(d.select(_H, key), key, cuts) if order == "hash" else _key_cuts(d.select(key), key, cuts)
    kinds = {f.name: f.dataType for f in d.schema.fields}
    reached = [_reached(columns, c, kinds).cast("int") for c in found if c is not None]
    return d.withColumn(out, sum(reached[1:], reached[0]) if reached else F.lit(0)).drop(_H)


# ------------------------------------------------------------------- R2, R4

def sample_exact(df: DataFrame, key: str, n: int, seed: int = DEFAULT_SEED,
                 strict: bool = False) -> DataFrame:
    """R2: exactly ``min(n, rows)`` rows without replacement, chosen by seed.

    With ``strict=True`` asking for more rows than exist raises (one count).
    """
    if strict:
        total = df.count()
        if n > total:
            raise ValueError(f"cannot sample {n} rows from {total}")
    return assign_by_cuts(df, key, lambda _: [n], "__side", "hash", seed).where("__side = 0").drop("__side")


def sample_exact_many(items: list[tuple[DataFrame, str, int]], seed: int = DEFAULT_SEED) -> list[DataFrame]:
    """R2 for several inputs at once: ``[(df, key, n), ...]`` -> samples."""
    return [sample_exact(df, key, n, seed) for df, key, n in items]


def split_train_test(df: DataFrame, key: str, train_fraction: float = 0.95,
                     seed: int = DEFAULT_SEED, order: str = "hash",
                     out: str = "split", stratify: tuple[str, ...] = ()) -> DataFrame:
    """The first ``int(train_fraction * N)`` positions are ``train``, the rest ``test``
    (of every stratum by itself, if ``stratify`` names columns).

    The cut is Python's ``int(fraction * N)``, the product of two doubles (so
    e.g. ``int(0.29 * 100) == 28`` here too).
    """
    if stratify:
        return _split_strata(df, key, train_fraction, seed, order, out, tuple(stratify))
    sides = assign_by_cuts(df, key, lambda n: [int(train_fraction * n)], "__side", order, seed)
    return sides.withColumn(out, F.when(F.col("__side") == 0, F.lit("train")).otherwise(F.lit("test"))).drop("__side")


def _split_strata(df: DataFrame, key: str, fraction: float, seed: int, order: str, out: str, by: tuple[str, ...]) -> DataFrame:
    """The cut of every stratum is the row at its position, found over the strata and order columns alone."""
    d, columns = _order(df, key, order, seed)
    placed = _positions(d.select(*dict.fromkeys([*by, *columns])), by, columns, _POS)
    cut = F.floor(F.count(F.lit(1)).cast("double") * F.lit(float(fraction))).cast("long").alias("__cut")
    totals = placed.groupBy(*by).agg(cut).select(*(F.col(c).alias(f"__t_{c}") for c in by), "__cut")
    at = [placed[_POS] == totals["__cut"], *(placed[c].eqNullSafe(totals[f"__t_{c}"]) for c in by)]
    cuts = stored(placed.join(totals, at).select(*(F.col(c).alias(f"__s_{c}") for c in by),
                                                 *(F.col(c).alias(f"__c_{c}") for c in columns)), "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= NEAR_ROWS else cuts
    first, last = columns[0], columns[-1]
    reached = F.coalesce(F.col(last) >= F.col(f"__c_{last}"), F.col(f"__c_{last}").isNull())
    if len(columns) > 1:
        reached = (F.col(first) > F.col(f"__c_{first}")) | ((F.col(first) == F.col(f"__c_{first}")) & reached)
    met = d.join(cuts.withColumn("__hit", F.lit(True)), [d[c].eqNullSafe(F.col(f"__s_{c}")) for c in by], "left")
    # a stratum whose cut lies past its last row is train as a whole
    return met.withColumn(out, F.when(F.col("__hit") & reached, F.lit("test")).otherwise(F.lit("train"))).select(*df.columns, out)


# ----------------------------------------------------------------------- R5

def shard_index(df: DataFrame, key: str, num_shards: int, order: str = "key",
                seed: int = DEFAULT_SEED, out: str = "shard") -> DataFrame:
    """Contiguous shard number of every row (``Dataset.shard(contiguous=True)``):
    sizes ``N div k``, one more for the first ``N mod k``."""
    def cuts(n: int) -> list[int]:
        size, more = divmod(n, num_shards)
        return [i * size + min(i, more) for i in range(1, num_shards)]
    return assign_by_cuts(df, key, cuts, "__shard", order, seed).withColumn(out, F.col("__shard").cast("long")).drop("__shard")


def shard(df: DataFrame, key: str, num_shards: int, index: int, order: str = "key",
          exclude: bool = False) -> DataFrame:
    """Rows of shard ``index`` (or, with ``exclude=True``, all other rows)."""
    s = shard_index(df, key, num_shards, order, out="__shard")
    cond = F.col("__shard") != index if exclude else F.col("__shard") == index
    return s.where(cond).drop("__shard")


# ----------------------------------------------------------------------- U1

def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``key`` (nulls first; rows of the last one's key as well), ``df`` itself if it has no more."""
    found = _key_cuts(df.select(key), key, lambda _: [n - 1])[0]
    if found is None:
        return df
    last = F.lit(found[0]).cast(df.schema[key].dataType)
    return df.where(F.col(key).isNull() | (F.col(key) <= last))


def concat_tables(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name, duplicates kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
