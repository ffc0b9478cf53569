"""Compaction of many small files into few well-sized ones, every record once.

Method: freeze a manifest of the files; pack them by size into bins by first-fit decreasing; rewrite each bin; verify row
counts and checksums of what was written against what should be; commit atomically by one pointer file that is written last.

Packing runs per dataset and shelf: days are laid on shelves until a shelf is worth ``SHELF_BINS`` bins, days with more files than
``SHELF_FILES`` are dealt out over several. Each shelf is packed alone, with at most about that many files, so neither the
manifest nor a busy day is ever collected. Records that are in several files are listed in a ledger; the rewrite keeps
one copy and the ledger tells which files were delivered twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import broadcast_if_small, run_dir, written
from tidegauge.sources.files import publish, published

TARGET_BYTES = 128 << 20
SHELF_BINS, SHELF_FILES = 64, 10_000

BIN = "file_name string, dataset string, n_rows long, n_bytes long, written_at timestamp_ntz, bin string"


def manifest(slot_files: DataFrame) -> DataFrame:
    """The frozen list of files: one row per name (the latest written), null names dropped, with the day in the name."""
    best = F.max(F.struct(F.col("written_at").cast("timestamp_ntz").alias("written_at"), "n_rows", "n_bytes", "dataset"))
    m = slot_files.filter("file_name is not null").groupBy("file_name").agg(best.alias("b"))
    m = m.select("file_name", "b.dataset", F.coalesce("b.n_rows", F.lit(0)).alias("n_rows"), F.coalesce("b.n_bytes", F.lit(0)).alias("n_bytes"), "b.written_at")
    return m.withColumn("dt", F.regexp_extract("file_name", r"dt=(\d{4}-\d{2}-\d{2})", 1))


def complete(files: DataFrame, events: DataFrame, positions: DataFrame) -> DataFrame:
    """The manifest with every file that rows name: each in the dataset its rows are in, whatever the list says; files that it lacks
    with their rows counted and their bytes reckoned from these; rows without a file as one of null name."""
    count = lambda name, df: df.groupBy("src_file").agg(F.count(F.lit(1)).alias("seen")).select(F.lit(name).alias("own"), F.col("src_file").alias("f"), "seen")
    rows = count("events", events).unionAll(count("positions", positions))
    per_row = files.agg(F.sum("n_bytes") / F.nullif(F.sum("n_rows"), F.lit(0))).first()[0] or 100.0
    name = F.coalesce("file_name", "f")
    return files.join(rows, F.col("file_name") == F.col("f"), "full").select(
        name.alias("file_name"), F.coalesce("own", "dataset").alias("dataset"), F.coalesce("n_rows", "seen").alias("n_rows"),
        F.coalesce("n_bytes", F.ceil(F.col("seen") * F.lit(per_row))).alias("n_bytes"), "written_at",
        F.coalesce("dt", F.regexp_extract(name, r"dt=(\d{4}-\d{2}-\d{2})", 1), F.lit("")).alias("dt"),
    )


def first_fit_decreasing(sizes: list[int], target: int) -> list[int]:
    """The bin of each size; a size above the target has a bin of its own. A segment tree finds the first bin with room."""
    n = 1
    while n < max(1, len(sizes)):
        n *= 2
    room = [0] * n + [target] * n
    for i in range(n - 1, 0, -1):
        room[i] = max(room[2 * i], room[2 * i + 1])
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        need, at = min(sizes[i], target), 1
        while at < n:
            at = 2 * at if room[2 * at] >= need else 2 * at + 1
        out[i] = at - n
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return out


def plan(files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(``BIN``): the bin of every file of the manifest."""
    days = files.groupBy("dataset", "dt").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("files"))
    order = Window.partitionBy("dataset").orderBy("dt")
    before = lambda c: F.sum(c).over(order) - F.col(c)
    shelf = F.greatest(F.floor(before("bytes") / (SHELF_BINS * target)), F.floor(before("files") / SHELF_FILES))
    days = days.withColumn("shelf", shelf).withColumn("parts", F.ceil(F.col("files") / SHELF_FILES).cast("int"))
    shelves = written(days.select(F.col("dataset").alias("ds"), F.col("dt").alias("day"), "shelf", "parts"), "shelves")
    dealt = files.join(broadcast_if_small(shelves), F.col("dataset").eqNullSafe(F.col("ds")) & F.col("dt").eqNullSafe(F.col("day"))).drop("ds", "day")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("file_name"), F.col("parts")).cast("int"))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_bytes", "file_name"], ascending=[False, True], kind="stable")
        b = first_fit_decreasing(g["n_bytes"].tolist(), target)
        head = f"{g['dataset'].iloc[0]}-{int(g['shelf'].iloc[0]):06d}-{int(g['part'].iloc[0]):04d}-"
        return g.assign(bin=[f"{head}{k:05d}" for k in b])[["file_name", "dataset", "n_rows", "n_bytes", "written_at", "bin"]]

    return dealt.groupBy("dataset", "shelf", "part").applyInPandas(pack, BIN)


def records(events: DataFrame, positions: DataFrame) -> DataFrame:
    """(ds, k1, k2, f): the key of every record and the hash of the file it is in. Rows without a full key are no records."""
    e = events.filter("GlobalEventID is not null and src_file is not null")
    p = positions.filter("mmsi is not null and ts_utc is not null and src_file is not null")
    micros = F.unix_micros(F.col("ts_utc").cast("timestamp_ntz").cast("timestamp"))
    e = e.select(F.lit(0).cast("byte").alias("ds"), F.col("GlobalEventID").alias("k1"), F.lit(0).cast("long").alias("k2"), F.xxhash64("src_file").alias("f"))
    return e.unionAll(p.select(F.lit(1).cast("byte").alias("ds"), F.col("mmsi").alias("k1"), micros.alias("k2"), F.xxhash64("src_file").alias("f")))


def ledger(events: DataFrame, positions: DataFrame, bins: DataFrame) -> DataFrame:
    """(file_a, file_b, bin_a, bin_b, records): pairs of files of the plan that hold records in common, smaller name first.

    One pass of fixed-size state (lowest and highest file, rows) finds the records in more than one file; where such a record
    has just two rows these are the pair. Only records with three rows or more are looked up again; equal sets of files
    are counted once before their pairs are written out.
    """
    r = records(events, positions)
    key = ["ds", "k1", "k2"]
    seen = r.groupBy(*key).agg(F.min("f").alias("lo"), F.max("f").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    seen = written(seen, "shared")
    two = seen.filter("n = 2").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("records"))
    many = broadcast_if_small(seen.filter("n > 2").select(*key))
    sets = r.join(many, key, "left_semi").groupBy(*key).agg(F.sort_array(F.collect_set("f")).alias("fs"))
    sets = sets.groupBy("fs").agg(F.count(F.lit(1)).alias("records"))
    i = sets.select("records", "fs", F.posexplode("fs").alias("at", "lo"))
    pairs = i.select("lo", F.explode(F.slice("fs", F.col("at") + 2, F.size("fs"))).alias("hi"), "records")
    pairs = two.unionByName(pairs).groupBy("lo", "hi").agg(F.sum("records").alias("records"))
    names = bins.filter("file_name is not null").dropDuplicates(["file_name"]).select(F.xxhash64("file_name").alias("h"), "file_name", "bin")
    a = names.select(F.col("h").alias("lo"), F.col("file_name").alias("fa"), F.col("bin").alias("ba"))
    b = names.select(F.col("h").alias("hi"), F.col("file_name").alias("fb"), F.col("bin").alias("bb"))
    d = pairs.join(a, "lo").join(b, "hi")
    first = F.col("fa") < F.col("fb")
    pick = lambda x, y, as_: F.when(first, F.col(x)).otherwise(F.col(y)).alias(as_)
    return d.select(pick("fa", "fb", "file_a"), pick("fb", "fa", "file_b"), pick("ba", "bb", "bin_a"), pick("bb", "ba", "bin_b"), "records")


def found(events: DataFrame, positions: DataFrame, slot_files: DataFrame, target: int = TARGET_BYTES) -> DataFrame:
    """(file_a, file_b): the pairs of the ledger of the compaction planned by ``plan``."""
    bins = written(plan(complete(manifest(slot_files), events, positions), target), "bins")
    return ledger(events, positions, bins).select("file_a", "file_b")


#: The column added to the rows while they are rewritten; part of the folder names.
BIN_COLUMN = "compact_bin"


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, __n): keys that several rows share, and how many. Counted before the shuffle, keys only."""
    full = " and ".join(f"`{k}` is not null" for k in key)
    return df.filter(full).groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")


def once(df: DataFrame, key: list[str], bins: DataFrame, twice: DataFrame, narrow: bool = False) -> DataFrame:
    """``df`` with ``compact_bin``, each record once: the copy of the file written last (then the later name).

    Only rows of the keys in ``twice`` (of :func:`repeated`) are ranked, all others pass as they are; rows without a full key can't be
    told apart and are all kept. Files outside ``bins`` are not touched (:func:`complete` leaves none out). Other columns may have any name but
    ``compact_bin``. ``narrow`` keeps the bin and a hash of the whole row (``__h``) alone: the same choice of rows without
    moving them, to verify against.
    """
    if BIN_COLUMN in df.columns:
        raise ValueError(f"a column is named {BIN_COLUMN}")
    b = bins.select(F.col("file_name").alias("__file"), F.col("bin").alias(BIN_COLUMN), F.col("written_at").alias("__written"))
    own = df.withColumn("__h", F.xxhash64(*df.columns))
    own = own.select(*key, "src_file", "__h") if narrow else own
    own = own.join(broadcast_if_small(b), F.col("src_file").eqNullSafe(F.col("__file"))).drop("__file")
    cols = [BIN_COLUMN, "__h"] if narrow else [*df.columns, BIN_COLUMN]
    twice = broadcast_if_small(twice.select(*key))
    # ties of time and file are settled by the whole row, so a rerun keeps the same copy
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("__written").desc(), F.col("src_file").desc(), F.col("__h")))
    best = own.join(twice, key, "left_semi").withColumn("__r", rank).filter("__r = 1").select(cols)
    return own.join(twice, key, "left_anti").select(cols).unionByName(best)


def _sums(df: DataFrame, h: Column) -> DataFrame:
    """Rows and two checksums of the row hashes of each bin."""
    return df.groupBy(F.col(BIN_COLUMN).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("s"))


def compact(df: DataFrame, name: str, key: list[str], bins: DataFrame, target_dir: str | None = None) -> DataFrame:
    """Rewrite the files of one dataset bin by bin and verify; (dataset, bin, files, rows_in, rows_out, checksum, path).

    Rows go to a folder of their own, one file per bin, that no reader knows yet. The files are read again and compared with the source:
    by row count and two checksums per bin, and in all: the rows of the source, whatever file they name, are those written and the
    copies left out. A difference raises RuntimeError. :func:`commit` then publishes what was verified. An executor lost on the way only repeats
    its tasks: the writer commits per task.
    """
    spark = df.sparkSession
    own = bins.filter(F.col("dataset") == name)
    twice = written(repeated(df, key), "repeated")
    clean = once(df, key, own, twice)
    cols = df.columns
    root = target_dir or f"{run_dir(spark)}/compact-{uuid.uuid4().hex}"
    final = f"{root}/{name}-{uuid.uuid4().hex}"
    clean.repartition(BIN_COLUMN).write.partitionBy(BIN_COLUMN).parquet(final)
    back = spark.read.schema(clean.schema).parquet(final)
    want, got = _sums(once(df, key, own, twice, narrow=True), F.col("__h")), _sums(back, F.xxhash64(*cols)).withColumnsRenamed({"n": "n2", "x": "x2", "s": "s2"})
    both = written(want.join(got, "bin", "full"), "verify")
    bad = both.filter(~(F.col("n").eqNullSafe(F.col("n2")) & F.col("x").eqNullSafe(F.col("x2")) & F.col("s").eqNullSafe(F.col("s2"))))
    if not bad.isEmpty():
        raise RuntimeError(f"{name}: what was written differs from the source; nothing was committed")
    kept = both.agg(F.coalesce(F.sum("n2"), F.lit(0))).first()[0]
    copies = twice.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))).first()[0]
    rows = df.count()
    if rows != kept + copies:
        raise RuntimeError(f"{name}: of {rows} rows {kept} were written and {copies} are copies; nothing was committed")
    per_bin = own.groupBy("bin").agg(F.count("file_name").alias("files"), F.sum("n_rows").alias("rows_in"))
    return per_bin.join(both, "bin", "left").select(F.lit(name).alias("dataset"), "bin", "files", "rows_in", F.coalesce("n", F.lit(0)).alias("rows_out"), F.col("x").alias("checksum"), F.lit(final).alias("path"))


POINTER = "_CURRENT.json"


def commit(spark: SparkSession, root: str, reports: DataFrame) -> None:
    """Publish verified datasets together: one pointer file, written last, names the folder of each."""
    paths = {r["dataset"]: r["path"] for r in reports.select("dataset", "path").distinct().collect()}  # a row a dataset
    publish(spark, f"{root}/{POINTER}", paths)


def compacted(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A dataset as last published; FileNotFoundError if it never was."""
    return spark.read.parquet(published(spark, f"{root}/{POINTER}")[name]).drop(BIN_COLUMN)


def compact_all(events: DataFrame, positions: DataFrame, slot_files: DataFrame, target: int = TARGET_BYTES, target_dir: str | None = None) -> DataFrame:
    """Both datasets compacted and published at once; the reports of :func:`compact` in one table."""
    spark = events.sparkSession
    bins = written(plan(complete(manifest(slot_files), events, positions), target), "bins")
    root = target_dir or f"{run_dir(spark)}/compact-{uuid.uuid4().hex}"
    a = compact(events, "events", ["GlobalEventID"], bins, root)
    both = a.unionByName(compact(positions, "positions", ["mmsi", "ts_utc"], bins, root))
    commit(spark, root, both)
    return both
