"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones, a minimum-cost flow (staying is free, each byte
moved costs one) says how many bytes go from each old shard to each new one. Each old shard is laid out as a line of
documents, in blocks by a hash; the flow cuts that line into one stretch that stays and stretches that move. Only
sizes of blocks reach the driver, one row for each ``BLOCK_ROWS`` documents or fewer; single documents are cut by a window
within a block.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablewright.llm.common import settled, table

SHARDS = 8
#: Blocks of an old shard at least, rows of a block beyond that, and bytes of a rewritten file, about.
BLOCKS, BLOCK_ROWS, FILE_BYTES = 1024, 1_000_000, 512 << 20


def equal_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def min_cost_flow(supply: list[int], capacity: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j at least cost: successive shortest augmenting paths (Bellman-Ford).

    The graph has a node for each shard, so its size does not depend on the data.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold all bytes")
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    arcs: list[list[int]] = []  # from, to, what is left, cost; the arc after each is its reverse

    def arc(a: int, b: int, room: int, c: int) -> None:
        arcs.extend(([a, b, room, c], [b, a, 0, -c]))

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    first = len(arcs)
    for i in range(m):
        for j in range(n):
            arc(i, m + j, min(supply[i], capacity[j]), cost(i, j))
    for j, c in enumerate(capacity):
        arc(m + j, sink, c, 0)
    while True:
        far = [1 << 62] * (m + n + 2)
        far[source], via = 0, {}
        changed = True
        while changed:
            changed = False
            for k, (a, b, room, c) in enumerate(arcs):
                if room and far[a] + c < far[b]:
                    far[b], via[b], changed = far[a] + c, k, True
        if sink not in via:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = arcs[via[at]][0]
        push = min(arcs[k][2] for k in path)
        for k in path:
            arcs[k][2] -= push
            arcs[k ^ 1][2] += push
    flow = {}
    for i in range(m):
        for j in range(n):
            if x := arcs[first + 2 * (i * n + j) + 1][2]:
                flow[i, j] = x
    return flow


def stretches(flow: dict[tuple[int, int], int], n_old: int) -> list[list[tuple[int, int]]]:
    """For each old shard the cuts of its line: (end, new shard), what stays first."""
    out = []
    for i in range(n_old):
        end, cuts = 0, []
        for (_, j), x in sorted(((k, x) for k, x in flow.items() if k[0] == i), key=lambda e: (e[0][1] != i, e[0][1])):
            end += x
            cuts.append((end, j))
        out.append(cuts)
    return out


def reshard(docs: DataFrame, old: Column, n_old: int, n_new: int = SHARDS, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``text_crc32``, ``old_shard``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``old`` gives the present shard (null or out of range: 0). A null text has size 1 and checksum 0. Repeated rows, and those
    with a null id, are placed each for itself, spread over the blocks; an empty table gives an empty result. Other columns
    but those in ``keep`` are not carried.
    The shards' sizes differ from the capacities by at most about a document for each stretch that meets in them.
    """
    spark = docs.sparkSession
    raw = F.col(text_col).cast("binary")
    thin = docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.when((old >= 0) & (old < n_old), old.cast("int")).otherwise(0).alias("old_shard"),
        *(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)),
    )
    blocks = blocks or max(BLOCKS, docs.count() // (BLOCK_ROWS * n_old))
    # the row's place in the input spreads rows that repeat; once written, it does not change
    thin = settled(thin.withColumn("block", F.pmod(F.xxhash64("__id", "text_crc32", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")))
    held = thin.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes")).collect()  # n_old x blocks rows at most
    supply, begin = [0] * n_old, {}
    for old_shard, block, size in sorted(held):
        begin[old_shard, block] = supply[old_shard]
        supply[old_shard] += size
    capacities = capacities or equal_capacities(sum(supply), n_new)
    cuts = stretches(min_cost_flow(supply, capacities), n_old)

    shard = F.lit(None).cast("int")
    for i, line in enumerate(cuts):
        here = F.lit(line[-1][1] if line else min(i, n_new - 1))
        for end, j in reversed(line[:-1]):
            here = F.when(F.col("middle") < 2 * end, j).otherwise(here)
        shard = F.when(F.col("old_shard") == i, here).otherwise(shard)

    def small(rows: list, ddl: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, ddl))

    line = Window.partitionBy("old_shard", "block").orderBy("__id", "size", "text_crc32")
    placed = thin.join(small([(*k, v) for k, v in begin.items()], "old_shard int, block int, begin long"), ["old_shard", "block"])
    before = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = placed.withColumn("middle", 2 * (F.col("begin") + before) + F.col("size")).withColumn("shard", shard.cast("int"))
    place = Window.partitionBy("old_shard", "block", "shard").orderBy("__id", "size", "text_crc32")
    placed = settled(placed.withColumn("n", F.row_number().over(place) - 1).drop("middle", "begin"))

    free, rows = defaultdict(int), []
    for old_shard, block, new, count in sorted(placed.groupBy("old_shard", "block", "shard").count().collect()):
        rows.append((old_shard, block, new, free[new]))
        free[new] += count
    placed = placed.join(small(rows, "old_shard int, block int, shard int, first long"), ["old_shard", "block", "shard"])
    return placed.select(F.col("__id").alias(id_col), "size", "text_crc32", "old_shard", "shard", (F.col("first") + F.col("n")).alias("slot"), *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)))


#: Where a row stands in a folder of Parquet files.
PLACE = ("__file", "__row")


def located(spark: SparkSession, data_dir: str) -> DataFrame:
    """The rows of a folder of Parquet files, with the file and the place in it of each; these tell rows apart whatever their ids."""
    return spark.read.parquet(data_dir).select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))


def rewrite_shards(data_dir: str, plan: DataFrame, file_bytes: int = FILE_BYTES) -> list[int]:
    """Move the rows of a dataset in folders ``shard=K`` as ``plan`` says; returns the shards whose files were rewritten.

    ``plan`` is ``reshard`` of ``located(spark, data_dir)`` with ``keep=PLACE``. Folders that neither lose nor gain a row
    are not touched. The rows of the others are first copied to shared storage, so that a failure while folders are
    replaced loses nothing; then files of about ``file_bytes`` bytes of text replace the folders' old ones, and folders left without
    rows are deleted.
    """
    spark = plan.sparkSession
    plan = settled(plan.select("old_shard", "shard", "size", *PLACE))  # what it was made from is about to change
    moved = plan.where(F.col("old_shard") != F.col("shard"))
    changed = sorted({x for r in moved.select("old_shard", "shard").distinct().collect() for x in r})
    if not changed:
        return []
    held = {r.shard: r.bytes for r in plan.where(F.col("shard").isin(changed)).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    files = F.lit(1)
    for k, size in held.items():
        files = F.when(F.col("shard") == k, -(-size // file_bytes)).otherwise(files)
    rows = located(spark, data_dir).where(F.col("shard").isin(changed)).drop("shard")
    goes = plan.where(F.col("old_shard").isin(changed)).select("shard", *PLACE)
    rows = rows.join(goes, list(PLACE)).withColumn("__part", F.pmod(F.xxhash64(*PLACE), files.cast("long")).cast("int")).drop(*PLACE)
    copy = settled(rows)
    if copy.count() != plan.where(F.col("old_shard").isin(changed)).count():
        raise ValueError("the plan was not made from the files as they are now")
    copy = copy.repartition(sum(-(-size // file_bytes) for size in held.values()), "shard", "__part").drop("__part")
    copy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(data_dir)
    for k in set(changed) - set(held):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{data_dir}/shard={k}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return changed


def op4_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, now dealt to shards by source and so uneven, moved to eight shards of equal bytes."""
    docs = table(spark, sf_dir, "documents")
    now = F.coalesce(F.crc32(F.col("source").cast("binary")) % SHARDS, F.lit(0))
    out = reshard(docs, now, SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
