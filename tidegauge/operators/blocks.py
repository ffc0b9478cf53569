"""Time blocks: cut the ordered history of each source into bounded pieces, so that a hot source never sits in one task.

A source with few rows stays whole (block 0). One with more than ``rows_per_block`` rows is cut at bucket borders (days by
default) found by a prefix sum over its bucket counts, which are small. With ``halo_rows``, buckets next to a border are
also sent to the neighbouring blocks with ``core = false``: an operator that looks at most ``halo_rows`` readings back or
ahead then gets exactly the result of the uncut history. A rule that counts buckets instead of readings needs ``halo_buckets``
whole buckets (a column of the keys) on either side, which may be spread over as many blocks (``reach``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import broadcast_if_small, written

BUCKET, BLOCK, CORE = "__bucket", "__block", "__core"


def block_map(counts: DataFrame, keys: list[str], rows_per_block: int, halo_rows: int, halo_buckets: Column | None = None, reach: int = 0) -> DataFrame:
    """(keys, bucket, targets) for the sources that must be cut; ``counts`` holds (keys, bucket, n).

    ``halo_buckets``: so many whole buckets are sent at least, whatever they hold; at most ``reach``.
    """
    buckets = F.lit(0) if halo_buckets is None else halo_buckets
    src = Window.partitionBy(*keys)
    order = src.orderBy(BUCKET)
    piece = Window.partitionBy(*keys, "own")
    d = (
        counts.withColumn("total", F.sum("n").over(src))
        .filter(F.col("total") > rows_per_block)
        .withColumn("before", F.sum("n").over(order) - F.col("n"))
        .withColumn("pos", F.row_number().over(order))
        .withColumn("own", F.dense_rank().over(src.orderBy(F.floor(F.col("before") / rows_per_block))) - 1)
        .withColumn("lo", F.min("before").over(piece))
        .withColumn("hi", F.max(F.col("before") + F.col("n")).over(piece))
        .withColumn("from", F.min("pos").over(piece))
        .withColumn("to", F.max("pos").over(piece))
    )
    # the extents of the blocks before and after: two hold more than rows_per_block rows, each one bucket at least
    reach = max(1, reach, 2 * -(-halo_rows // rows_per_block))
    edges = d.select(*keys, "own", "lo", "hi", "from", "to").distinct()
    by_block = Window.partitionBy(*keys).orderBy("own")
    extents = F.collect_list(F.struct("own", "lo", "hi", "from", "to"))
    edges = edges.withColumn("next", extents.over(by_block.rowsBetween(1, reach))).withColumn("prev", extents.over(by_block.rowsBetween(-reach, -1)))
    d = d.drop("lo", "hi", "from", "to").join(edges.select(*keys, "own", "next", "prev"), [*keys, "own"])
    end = F.col("before") + F.col("n")

    def target(block: Column, core: bool) -> Column:
        return F.struct(block.cast("int").alias(BLOCK), F.lit(core).alias(CORE))

    near_next = F.filter("next", lambda b: (b["lo"] - end < halo_rows) | (b["from"] - F.col("pos") <= buckets))
    near_prev = F.filter("prev", lambda b: (F.col("before") - b["hi"] < halo_rows) | (F.col("pos") - b["to"] <= buckets))
    halo = F.transform(F.concat(near_next, near_prev), lambda b: target(b["own"], False))
    return d.select(*keys, BUCKET, F.concat(F.array(target(F.col("own"), True)), halo).alias("__targets"))


def time_blocks(
    df: DataFrame, keys: list[str], bucket: Column, rows_per_block: int = 50_000, halo_rows: int = 0, halo_buckets: Column | None = None, reach: int = 0
) -> DataFrame:
    """``df`` with ``__block`` and ``__core``; rows next to a cut occur again, with ``__core = false``, in the other block.

    Null keys form a source of their own in the result (block 0) and are never cut.
    """
    d = df.withColumn(BUCKET, bucket)
    counts = d.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("n"))
    cut = written(block_map(counts, keys, rows_per_block, halo_rows, halo_buckets, reach), "blocks")
    if cut.isEmpty():
        return d.drop(BUCKET).withColumn(BLOCK, F.lit(0)).withColumn(CORE, F.lit(True))
    whole = F.array(F.struct(F.lit(0).alias(BLOCK), F.lit(True).alias(CORE)))
    out = d.join(broadcast_if_small(cut), [*keys, BUCKET], "left")
    out = out.withColumn("__t", F.explode(F.coalesce("__targets", whole)))
    return out.withColumn(BLOCK, F.col(f"__t.{BLOCK}")).withColumn(CORE, F.col(f"__t.{CORE}")).drop("__t", "__targets", BUCKET)


def by_block(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each block in one partition, in order: the input of a streaming ``mapInArrow``."""
    return df.repartition(*keys, BLOCK).sortWithinPartitions(*keys, BLOCK, *order)


def _starts(t: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where a group starts, the first row excepted."""
    new = np.zeros(max(0, t.num_rows - 1), dtype=bool)
    for k in keys:
        c = t.column(k)
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.fill_null(pc.equal(a, b), False)
        both = pc.and_(pc.is_null(a), pc.is_null(b))
        new |= ~np.asarray(pc.or_(same, both).to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches regrouped so that each table holds whole groups; with it the offsets of its groups (n + 1)."""
    held: list[pa.RecordBatch] = []

    def out(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.r_[0, _starts(t, keys), t.num_rows].astype(np.int64)

    for b in batches:
        if b.num_rows == 0:
            continue
        s = _starts(b, keys)
        cut = int(s[-1]) if len(s) else 0
        if held and not len(s):
            joint = pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), b.slice(0, 1)])
            if len(_starts(joint, keys)):
                yield out(held)
                held = [b]
            else:
                held.append(b)
            continue
        if cut:
            yield out([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield out(held)
