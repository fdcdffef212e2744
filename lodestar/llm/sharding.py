"""Sharding by fixed virtual slots.

Records are hashed to a fixed number of slots, bytes and rows are summed per slot, and a versioned map sends each
slot to a shard. Only the map, whose size is the number of slots, is ever planned on the driver or broadcast; the
records see one aggregate and one join with it. Rebalancing edits the map and moves whole slots. Native operators only.
"""

from __future__ import annotations

import heapq
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, shared_dir, stored

SHARDS = 40
SLOTS = 8192
ROW_BYTES = 16
#: Exact repeats of a row that one task writes out at most.
REPEATS = 10_000

MAP_SCHEMA = "array<struct<virtual_slot:int,shard:int,bytes:bigint,rows:bigint,base:bigint>>"


def with_slots(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """(doc_id, size, text_crc32, copy, virtual_slot) of every row. copy numbers the rows that agree in all of that, from 0;
    the slot hashes id, checksum and copy, so that neither repeated ids nor exact repeats of a row share a slot.

    Repeats are counted and the counts written out again, so no task holds the rows of a hot one: counts over REPEATS are
    first cut into parts of that many.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        quoted(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    counted = stored(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "counted")
    own = ["doc_id", "size", "text_crc32"]
    few = counted.where(F.col("n") <= REPEATS).select(*own, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    many = counted.where(F.col("n") > REPEATS).select(*own, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))).alias("part"))
    first = F.col("part") * REPEATS
    dealt = many.repartition("doc_id", "text_crc32", "part").select(*own, F.explode(F.sequence(first, F.least(first + REPEATS, F.col("n")) - 1)).alias("copy"))
    return few.unionByName(dealt).withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int"))


def slot_stats(rows: DataFrame) -> list[dict]:
    """(virtual_slot, bytes, rows) of the slots in use: at most as many rows as there are slots."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return sorted((r.asDict() for r in found), key=lambda r: (-r["bytes"], r["virtual_slot"]))


def new_map(stats: list[dict], shards: int) -> dict[int, int]:
    """Slot -> shard: the largest slot left goes to the shard with the fewest bytes (ties: smallest number)."""
    heap, out = [(0, s) for s in range(shards)], {}
    for r in sorted(stats, key=lambda r: (-r["bytes"], r["virtual_slot"])):
        held, shard = heapq.heappop(heap)
        out[r["virtual_slot"]] = shard
        heapq.heappush(heap, (held + r["bytes"], shard))
    return out


def rebalanced(current: dict[int, int], stats: list[dict], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """An edit of current for new byte counts or another number of shards, moving few slots.

    Slots of shards that are gone, and slots not seen before, are placed first; then, while some shard is over the
    mean by more than tolerance, its largest slot that fits goes to the emptiest shard.
    """
    size = {r["virtual_slot"]: r["bytes"] for r in stats}
    out = {s: h for s, h in current.items() if h < shards and s in size}
    held = [0] * shards
    of: list[set[int]] = [set() for _ in range(shards)]
    for s, h in out.items():
        held[h] += size[s]
        of[h].add(s)

    def put(slot: int, to: int) -> None:
        out[slot] = to
        held[to] += size[slot]
        of[to].add(slot)

    for s in sorted(size.keys() - out.keys(), key=lambda s: (-size[s], s)):
        put(s, min(range(shards), key=lambda h: (held[h], h)))
    mean = sum(held) / max(shards, 1)
    for _ in range(len(out)):
        most, least = max(range(shards), key=lambda h: (held[h], -h)), min(range(shards), key=lambda h: (held[h], h))
        room = min(held[most] - mean, mean - held[least])
        fits = [s for s in of[most] if 0 < size[s] <= max(room, 0)] or [s for s in of[most] if 0 < size[s] < held[most] - held[least]][:1]
        if held[most] <= mean * (1 + tolerance) or not fits:
            break
        s = max(fits, key=lambda s: (size[s], -s))
        of[most].discard(s)
        held[most] -= size[s]
        put(s, least)
    return out


def map_frame(spark: SparkSession, assigned: dict[int, int], stats: list[dict]) -> DataFrame:
    """The map as a DataFrame (virtual_slot, shard, bytes, rows, base); base: rows of the shard in earlier slots."""
    by = {r["virtual_slot"]: r for r in stats}
    seen: dict[int, int] = {}
    rows = []
    for s in sorted(assigned):
        shard, n = assigned[s], by[s]["rows"] if s in by else 0
        rows.append({"virtual_slot": s, "shard": shard, "bytes": by[s]["bytes"] if s in by else 0, "rows": n, "base": seen.get(shard, 0)})
        seen[shard] = seen.get(shard, 0) + n
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), MAP_SCHEMA)))


def write_map(frame: DataFrame, path: str, version: int) -> None:
    """Store the map as a new version; a version that exists is never overwritten."""
    frame.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, bytes long, rows long, base long").parquet(f"{path}/version={version}")


def last_version(spark: SparkSession, path: str) -> int:
    """The newest version of the map under path, complete or not; 0 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    return max([int(x.removeprefix("version=")) for x in names if x.startswith("version=")], default=0)


def next_map(spark: SparkSession, path: str, stats: list[dict], shards: int) -> int:
    """Write the next version of the map and return its number: the first is planned anew, later ones edit the one before
    for the bytes and the number of shards of now."""
    before = last_version(spark, path)
    if before:
        current = {r["virtual_slot"]: r["shard"] for r in read_map(spark, path, before).collect()}  # a row for each slot at most
        assigned = rebalanced(current, stats, shards)
    else:
        assigned = new_map(stats, shards)
    write_map(map_frame(spark, assigned, stats), path, before + 1)
    return before + 1


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) of every row.

    law is `bytes`: shards hold nearly equal bytes. size is the UTF-8 bytes of the text (null: none) plus 16. slot is
    the row's place in its shard, gapless from 0: rows of a shard go by virtual slot, id, checksum, size and copy. Exact
    repeats of a row are spread over slots like any rows. grown_shard is null under this law. The map is stored under
    map_path as its next version and read back from there: where versions exist, the last one is edited, so that few slots
    move when data or the number of shards have changed, else version 1 is planned anew. By default it has a folder of its
    own in the shared folder. Null ids and empty texts are rows like any other. An empty table gives an empty map and an
    empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_dir(spark)}/lodestar/{uuid.uuid4().hex}/slot_map"
    rows = stored(with_slots(docs, id_col, text_col, slots), "slotted")
    version = next_map(spark, path, slot_stats(rows), shards)
    placed = rows.join(F.broadcast(read_map(spark, path, version).select("virtual_slot", "shard", "base")), "virtual_slot")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.expr("row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id, text_crc32, size, copy)") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
