"""Resharding by minimum-cost flow.

Rows belong to blocks by a hash of their text; a block with far more than its
share of the bytes or of the rows is cut again by the rest of that hash, so
equal texts stay together. Only a text whose copies alone hold more than a
quarter of a shard is cut by row. From the
block sizes, which are few, come the old shard sizes. A flow from old shards to
new capacities, where a byte costs nothing if it stays and one if it moves,
gives the bytes each pair of shards has to transfer. Whole blocks are chosen to
fill the transfers, largest first, and only files of shards that give or get
blocks are written again. Blocks number at most four times ``BLOCKS``, whatever the
input, so their table may be collected and broadcast.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Blocks that the hash deals out, shards, and the share of a shard above which a block is cut.
BLOCKS = 8192
SHARDS = 8
CUT_SHARE = 1 / 64
#: Share of a shard, in bytes or rows, above which the copies of one text are parted; so few rows never are for their number.
TEXT_SHARE = 1 / 4
FEW_COPIES = 64


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Cheapest whole-number flow from suppliers to consumers (equal totals), by shortest augmenting paths."""
    n, m = len(supply), len(demand)
    source, sink = n + m, n + m + 1
    room: dict[tuple[int, int], int] = defaultdict(int)
    price: dict[tuple[int, int], int] = {}
    for i in range(n):
        room[source, i], price[source, i], price[i, source] = supply[i], 0, 0
        for j in range(m):
            room[i, n + j], price[i, n + j], price[n + j, i] = min(supply[i], demand[j]), cost[i][j], -cost[i][j]
    for j in range(m):
        room[n + j, sink], price[n + j, sink], price[sink, n + j] = demand[j], 0, 0
    while True:
        far: dict[int, int] = {source: 0}
        before: dict[int, int] = {}
        changed = True
        while changed:
            changed = False
            for (a, b), c in price.items():
                if a in far and room[a, b] > 0 and far[a] + c < far.get(b, 1 << 62):
                    far[b], before[b], changed = far[a] + c, a, True
        if sink not in far:
            break
        path, at = [], sink
        while at != source:
            path.append((before[at], at))
            at = before[at]
        add = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= add
            room[b, a] += add
    return [[room[n + j, i] for j in range(m)] for i in range(n)]


def plan_moves(blocks: list[tuple[int, int, int]], capacities: list[int]) -> dict[int, int]:
    """New shard of each block that moves; ``blocks`` has (block, old shard, bytes) and capacities sum to all bytes."""
    shards = len(capacities)
    supply = [0] * max(shards, 1 + max((s for _, s, _ in blocks), default=0))
    for _, s, size in blocks:
        supply[s] += size
    flow = min_cost_flow(supply, capacities, [[int(i != j) for j in range(shards)] for i in range(len(supply))])
    moves: dict[int, int] = {}
    by_shard = defaultdict(list)
    for b, s, size in blocks:
        by_shard[s].append((size, b))
    for i, out in enumerate(flow):
        free = sorted(by_shard[i], reverse=True)
        for j in sorted((j for j in range(shards) if j != i and out[j]), key=lambda j: (-out[j], j)):
            left, rest = out[j], []
            for size, b in free:
                if size <= left:
                    moves[b] = j
                    left -= size
                else:
                    rest.append((size, b))
            free = rest
        if i >= shards:  # a shard that is given up keeps nothing
            for k, (_, b) in enumerate(free):
                moves[b] = k % shards
    return moves


def near_equal(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one; null: 1), text_crc32, the text's hash, its bucket, and a number of the row (to be stored)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
                       F.pmod(F.xxhash64(text), F.lit(BLOCKS)).cast("int").alias("bucket"), F.monotonically_increasing_id().alias("row"))


def _blocked(rows: DataFrame, total: int, count: int, shards: int) -> DataFrame:
    """``rows`` plus ``block``: the bucket, or a part of one that is large.

    A large bucket is cut by text, and a text with more than ``TEXT_SHARE`` of a shard by row.
    """
    share, most = CUT_SHARE / shards, TEXT_SHARE / shards
    fine, few = max(total / BLOCKS, 1.0), max(count / BLOCKS, 1.0)
    sums = [F.sum("size").alias("all"), F.count("*").alias("n")]
    parts = F.greatest(F.ceil(F.col("all") / fine), F.ceil(F.col("n") / few)).cast("int")
    # at most 2 * shards / CUT_SHARE buckets are that large, and 2 * shards / TEXT_SHARE texts
    large = rows.groupBy("bucket").agg(*sums).where((F.col("all") > total * share) | (F.col("n") > count * share)).select("bucket")
    texts = saved(rows.join(F.broadcast(large), "bucket").groupBy("bucket", "text_hash").agg(*sums), "texts")
    heavy = (F.col("all") > total * most) & (F.col("n") > 1) | (F.col("n") > max(count * most, FEW_COPIES))
    by_row = texts.where(heavy).select(F.col("text_hash").alias("_t"), parts.alias("_rows"))
    by_text = texts.where(~heavy).groupBy("bucket").agg(F.sum("all").alias("all"), F.sum("n").alias("n")) \
        .select(F.col("bucket").alias("_b"), parts.alias("_texts"))
    met = rows.join(F.broadcast(by_text), F.col("bucket") == F.col("_b"), "left").join(F.broadcast(by_row), F.col("text_hash") == F.col("_t"), "left")
    part = F.coalesce(F.pmod(F.xxhash64("row", "doc_id"), F.col("_rows")), F.pmod(F.xxhash64("text_hash"), F.col("_texts")), F.lit(0))
    return met.withColumn("block", F.col("bucket") + BLOCKS * part.cast("bigint")).drop("_b", "_t", "_rows", "_texts", "bucket", "text_hash", "row")


def reshard(docs: DataFrame, shards: int = SHARDS, old_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, shard and slot (gapless from 0 in a shard) of every row.

    The old layout is ``block mod old_shards``; new capacities are near equal
    in bytes, so shards end within about one block of each other. Equal texts
    stay together unless they alone hold more than a quarter of a shard's bytes
    or rows (and more than 64 rows, as to these). A null text is empty and
    counts one byte. Repeated rows each get a slot, those of a hot doc_id in many blocks; an empty table gives no
    rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = saved(_sized(docs), "sized")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    blocked = _blocked(rows, total, count, shards)
    table = blocked.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    blocks = sorted((r["block"], r["block"] % old_shards, r["size"], r["n"]) for r in table)
    moves = plan_moves([b[:3] for b in blocks], near_equal(total, shards))
    base = [0] * shards
    plan = []
    for b, old, _, n in blocks:
        new = moves.get(b, old)
        plan.append((b, old, new, base[new]))
        base[new] += n
    places = spark.createDataFrame(plan, "_block bigint, old_shard int, shard int, base bigint")
    order = Window.partitionBy("block").orderBy("doc_id", "text_crc32", "size")
    return blocked.join(F.broadcast(places), F.col("block") == F.col("_block")).select(
        "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.row_number().over(order) - 1).alias("slot"))


def rewrite_affected(files: dict[int, str], moves: DataFrame, target: str) -> dict[int, str]:
    """Write the shards that give or get rows again below ``target``; folder of every shard afterwards.

    ``files`` maps shards to Parquet folders of documents with unique doc_id, ``moves`` has (doc_id,
    old_shard, shard). Folders of shards that nothing enters or leaves stay as they are.
    """
    spark = moves.sparkSession
    changed = moves.where("old_shard != shard")
    touched = sorted({s for r in changed.select("old_shard", "shard").distinct().collect() for s in r})
    after = dict(files)
    if not touched:
        return after
    old = None
    for s in sorted(set(touched) & set(files)):
        part = spark.read.parquet(files[s])
        old = part if old is None else old.unionByName(part)
    where = moves.select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"))
    old.join(where, F.col("doc_id") == F.col("_id")).drop("_id").write.partitionBy("_shard").parquet(target)
    kept = {r[0] for r in spark.read.parquet(target).select("_shard").distinct().collect()}
    for s in touched:
        if s in kept:
            after[s] = f"{target}/_shard={s}"
        else:
            after.pop(s, None)
    return after
