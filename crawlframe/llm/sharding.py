"""Shards of near equal bytes: sampled splitters cut the keys into ranges, and ranges are cut into shards.

The key of a record is the digest of its text, then its id, so that equal texts stand together. A sample of keys, drawn with a
chance that grows with a record's size, is sorted, and its quantiles are the splitters: every range holds about as many bytes.
What the ranges really hold is then counted; a range that holds too much gets further splitters from a denser sample of its
own, and one that cannot be cut by keys (repeated records) is dealt by row number. The ranges spread the sorting over all
tasks: within a range a window gives each record the bytes and rows before it, and the counts of the ranges before are added.

With the bytes before it, a record's shard is plain arithmetic: the shard in which the middle of the record lies, where the
bytes of all records in key order are cut into equal parts. Records of one text go together if all of them take no more bytes
than the largest record alone; larger groups are cut between records. So a shard's bytes differ from the mean by the largest
record at most, whatever the sample was. The sample decides only how the work is spread.

Nothing but the splitters and the ranges' counts reaches the driver: ``RANGE_ROWS`` bounds how many they are, one range for
each of so many rows (and ``SHARD_RANGES`` a shard), ``RANGE_SAMPLES`` sampled keys for each range.

Defined cases: a null text has 16 bytes and the checksum of an empty one, and stands before all others; a null id stands
before others of its text; repeated rows are records of their own; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import save

SHARDS = 40
#: Bytes that a record takes besides its text.
OVERHEAD = 16
SHARD_RANGES = 16
RANGE_ROWS = 2_000_000
RANGE_SAMPLES = 8
#: Times its due bytes or rows that a range may hold.
OVERFULL = 2


def records(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, digest, key, row)``: what sharding knows of a record, its text left out."""
    text, number = docs[text_column], docs[id_column]
    digest = F.coalesce(F.md5(text), F.lit(" "))
    # Numbers as text in their own order: moved above zero and padded.
    place = F.lpad((number.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return docs.select(
        number.alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        digest.alias("digest"),
        F.concat(digest, F.lit(" "), F.coalesce(place, F.lit(""))).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )


def range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are no greater than the key, by halving."""
    if not splitters:
        return F.lit(0)
    sorted_keys = F.array(*[F.lit(s) for s in splitters])
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]

    def step(low: Column, jump: Column) -> Column:
        return F.when((low + jump <= len(splitters)) & (F.try_element_at(sorted_keys, low + jump) <= key), low + jump).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _sampled(rows: DataFrame, chance: Column, turn: int) -> DataFrame:
    """The rows whose number drawn from the key falls under the chance; the same whenever a lost task runs again."""
    drawn = F.pmod(F.xxhash64("key", "row", F.lit(turn)), F.lit(1 << 53)) / float(1 << 53)
    return rows.where(drawn < chance)


def splitters_of(rows: DataFrame, total: int, count: int, most: int, shards: int) -> tuple[list[str], dict[int, int]]:
    """Splitters, and the ranges (by number) that hold one key only and are to be dealt to so many parts by row.

    Each turn adds splitters to the ranges that are still overfull, until those hold one key each.
    """
    ranges = max(SHARD_RANGES * shards, -(-count // RANGE_ROWS))
    due, due_rows = max(total / ranges, 1), max(count / ranges, 1)
    most_bytes, most_rows = max(OVERFULL * due, most), max(OVERFULL * due_rows, 2)
    weight = F.greatest(F.col("size") / due, F.lit(1 / due_rows)) * RANGE_SAMPLES
    drawn = sorted(r["key"] for r in _sampled(rows, weight, 0).select("key").collect())
    found = sorted(set(drawn[RANGE_SAMPLES - 1 :: RANGE_SAMPLES]))
    turn = 0
    while True:
        held = rows.groupBy(range_of(F.col("key"), found).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("least"), F.max("key").alias("most"))
        over = [r for r in held.collect() if r["bytes"] > most_bytes or r["rows"] > most_rows]
        wide = [r for r in over if r["least"] < r["most"]]
        if not wide:
            return found, {r["range"]: int(max(r["bytes"] / due, r["rows"] / due_rows)) + 1 for r in over}
        turn += 1
        # A denser sample each turn; the ends are splitters too, so that a key with much of the range is soon alone in its own.
        inside = rows.where(range_of(F.col("key"), found).isin([r["range"] for r in wide]))
        denser = sorted(r["key"] for r in _sampled(inside, weight * turn, turn).select("key").collect())
        fresh = {k for k in denser[RANGE_SAMPLES * turn // 2 :: max(1, RANGE_SAMPLES * turn // 2)]} | {r["most"] for r in wide}
        repeated = {a for a, b in zip(denser, denser[1:], strict=False) if a == b}
        # The next key there can be, so that what stands behind a repeated key is parted from it.
        found = sorted(set(found) | fresh | repeated | {k + " " for k in repeated})


def placed(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``records`` with ``shard`` and ``slot``: contiguous parts of the key order with near equal bytes."""
    rows = save(rows, "records")
    sums = rows.agg(F.sum("size").alias("total"), F.count("*").alias("count"), F.max("size").alias("most")).first()
    total, count, most = sums["total"] or 0, sums["count"], sums["most"] or 0
    if not count:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    found, dealt = splitters_of(rows, total, count, most, shards)
    ranged = rows.withColumn("range", range_of(F.col("key"), found))
    part = F.lit(0).cast("long")
    for number, parts in dealt.items():
        part = F.when(F.col("range") == number, F.pmod(F.xxhash64("row"), F.lit(parts))).otherwise(part)
    ranged = ranged.withColumn("part", part)

    counts = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # A row for each range: bounded by the splitters.
    behind = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range", "part", F.coalesce(F.sum("bytes").over(behind), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(behind), F.lit(0)).alias("rows_before"))
    own = Window.partitionBy("range", "part").orderBy("key", "row")
    ranged = ranged.withColumns({"start": F.sum("size").over(own) - F.col("size"), "place": F.row_number().over(own)})
    ranged = ranged.join(F.broadcast(offsets), ["range", "part"]).withColumns({"start": F.col("start") + F.col("bytes_before"), "place": F.col("place") + F.col("rows_before")})
    ranged = save(ranged.select(*rows.columns, "start", "place"), "ranged")

    # Texts that stand more than once and still are no larger than one record may be.
    groups = ranged.groupBy("digest").agg(F.sum("size").alias("group_size"), F.min("start").alias("group_start"), F.count("*").alias("n"))
    groups = save(groups.where((F.col("n") > 1) & (F.col("group_size") <= most)).drop("n"), "groups")
    ranged = ranged.join(groups, "digest", "left").withColumns({"unit_start": F.coalesce("group_start", "start"), "unit_size": F.coalesce("group_size", "size")})
    kind = "BIGINT" if 2 * total * shards < 2**62 else "DECIMAL(38, 0)"
    shard = F.expr(f"(2 * CAST(unit_start AS {kind}) + unit_size) * {shards} div {2 * total}")
    ranged = save(ranged.withColumn("shard", shard.cast("int")).select(*rows.columns, "place", "shard"), "placed")
    first = ranged.groupBy("shard").agg(F.min("place").alias("first"))  # a row for each shard
    return ranged.join(F.broadcast(first), "shard").withColumn("slot", F.col("place") - F.col("first")).select(*rows.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet, a folder ``shard=k`` for each shard; ids must be unique. Files of a shard are cut by its rows."""
    where = save(placed(records(docs), shards).select("doc_id", "shard", "slot"), "where")
    whole = docs.join(where, "doc_id")
    whole.repartition(F.col("shard"), F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``."""
    found = placed(records(docs.select("doc_id", "text")), shards)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

