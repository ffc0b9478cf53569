"""Distinct counts with a known error bound: registers of minimum exponential hash values.

Every identifier gets, for each of m registers, a fixed Exp(1) variate drawn from its hash; a register holds the minimum over
the identifiers seen. Registers of a union are the elementwise minima, so partial results combine in any order and repeated
identifiers change nothing. With n distinct identifiers each register is Exp(n), their sum S is Gamma(m, 1/n):
(m - 1) / S is an unbiased count of relative error 1 / sqrt(m - 2), and quantiles of Gamma(m, 1) give a confidence interval.

The variates are drawn in rising order: the arrivals of a Poisson process of rate m, seeded by the identifier, fall on registers
at random, and the first arrival at each of them is Exp(1) and independent of the others. An identifier is done once its
process has passed the highest register of its group, as nothing later can lower any. With n identifiers seen that takes about m log(m) / n arrivals of the next.

Partials are made in each partition before any shuffle and merged in two steps (salted, then final), so neither a hot group
nor a long list of partials lands in one task. Only registers move: 8 m bytes for a group and partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import root_code

#: Registers: relative standard error 1 / sqrt(m - 2) = 4.4 %.
M = 512
#: Groups a partition holds at once before it hands on partial results (32 MB of registers at M = 512).
HELD = 8_192
SALTS = 16
#: Arrivals drawn at once for an identifier: first, and at most; and for all identifiers together.
FIRST, LARGEST, PART = 4, 256, 1 << 18
#: Pairs of group and identifier a task gathers before it draws.
GATHERED = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def arrivals(h: np.ndarray, k: int, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Waiting times and registers, (len(h), n) each, of the arrivals k to k + n of the process of each 64-bit hash."""
    step = np.arange(k + 1, k + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = _mixed(h[:, None] + step[None, :])
    u = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return -np.log1p(-u) / m, (_mixed(x) % np.uint64(m)).astype(np.int64)


def insert(registers: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Lower ``registers`` (groups, m) by the identifiers of hashes ``h`` (uint64) in groups ``g``. Arrivals come in parts of fixed sizes, so an
    identifier's variates are the same to the last bit wherever it is met."""
    m = registers.shape[1]
    flat, limit = registers.reshape(-1), registers.max(axis=1)
    t, k, n = np.zeros(len(h)), 0, FIRST
    while len(h):
        part = max(1, PART // n)
        for a in range(0, len(h), part):
            own = slice(a, a + part)
            wait, at = arrivals(h[own], k, n, m)
            wait[:, 0] += t[own]
            when = np.cumsum(wait, axis=1)
            np.minimum.at(flat, (g[own, None] * m + at).ravel(), when.ravel())
            t[own] = when[:, -1]
        live = np.unique(g)
        limit[live] = registers[live].max(axis=1)
        keep = t < limit[g]
        g, h, t = g[keep], h[keep], t[keep]
        k, n = k + n, min(2 * n, LARGEST)


def registers_of(h: np.ndarray, m: int) -> np.ndarray:
    """The registers of a set of 64-bit hashes; infinite for an empty one."""
    out = np.full((1, m), np.inf)
    insert(out, np.zeros(len(h), dtype=np.int64), np.unique(h.view(np.uint64)))
    return out[0]


def gamma_quantile(m: int, p: float) -> float:
    """Quantile of Gamma(m, 1) by the Wilson-Hilferty cube (m >= 16: error below 1e-3 relative)."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return m * (1 - 1 / (9 * m) + lo / (3 * math.sqrt(m))) ** 3


def _group_ids(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    codes = np.zeros(t.num_rows, dtype=np.int64)
    for k in keys:
        d = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
    uniq, first, inv = np.unique(codes, return_index=True, return_inverse=True)
    rows = t.select(keys).take(pa.array(first)).to_pylist()
    return inv, [tuple(r[k] for k in keys) for r in rows]


def partials(df: DataFrame, keys: list[str], item: Column, m: int = M) -> DataFrame:
    """(keys, registers): partial sketches of each partition. Null items count nothing; null keys are groups of their own."""
    d = df.filter(item.isNotNull()).select(*keys, F.xxhash64(item).alias("__h"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.select(*keys).schema)
    types = d.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple, int] = {}
        low = np.full((16, m), np.inf)
        waiting: list[np.ndarray] = []

        def draw() -> None:
            pairs = np.unique(np.concatenate(waiting, axis=1), axis=1)  # many rows an item
            insert(low, pairs[0], pairs[1].view(np.uint64))
            waiting.clear()

        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            inv, names = _group_ids(t, keys)
            own = np.array([number.setdefault(k, len(number)) for k in names], dtype=np.int64)
            if len(number) > len(low):
                low = np.concatenate([low, np.full((max(len(low), len(number) - len(low)), m), np.inf)])
            waiting.append(np.stack([own[inv], t.column("__h").to_numpy()]))
            if sum(w.shape[1] for w in waiting) > GATHERED:
                draw()
            if len(number) > HELD:
                if waiting:
                    draw()
                yield _batch(dict(zip(number, low)), keys, schema)
                number, low = {}, np.full((16, m), np.inf)
        if waiting:
            draw()
        if number:
            yield _batch(dict(zip(number, low)), keys, schema)

    schema = _arrow(types)
    return d.mapInArrow(run, f"{kinds}, registers binary")


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(held: dict[tuple, np.ndarray], keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*held)) if held else [[] for _ in keys]
    arrays = [pa.array(c, schema.field(k).type) for k, c in zip(keys, cols)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([r.tobytes() for r in held.values()], pa.binary())], names=[*keys, "registers"])


def _merge_step(df: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    schema = _arrow(df.select(*keys).schema)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, low = None, None
        for b in batches:
            done: dict[tuple, np.ndarray] = {}
            cols = [b.column(k).to_pylist() for k in keys]
            for i, raw in enumerate(b.column("registers").to_pylist()):
                k, r = tuple(c[i] for c in cols), np.frombuffer(raw, dtype=np.float64)
                if k == cur:
                    low = np.minimum(low, r)
                else:
                    if cur is not None:
                        done[cur] = low
                    cur, low = k, r
            if done:
                yield _batch(done, keys, schema)
        if cur is not None:
            yield _batch({cur: low}, keys, schema)

    return df.repartition(*by).sortWithinPartitions(*by).select(*keys, "registers").mapInArrow(run, f"{kinds}, registers binary")


def merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of equal keys merged: first over salted shares of the partials, then over these."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64("registers"), F.lit(SALTS)))
    return _merge_step(_merge_step(salted, [*keys, "__salt"], keys), keys, keys)


def estimates(df: DataFrame, confidence: float = 0.99) -> DataFrame:
    """``registers`` replaced by (estimate, low, high): the unbiased count and its confidence interval."""
    keys = [c for c in df.columns if c != "registers"]
    tail = (1 - confidence) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([np.frombuffer(r, dtype=np.float64).sum() for r in b.column("registers").to_pylist()])
            m = len(b.column("registers")[0].as_py()) // 8 if b.num_rows else M
            arrays = [b.column(k) for k in keys] + [pa.array(x) for x in ((m - 1) / s, gamma_quantile(m, tail) / s, gamma_quantile(m, 1 - tail) / s)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "estimate", "low", "high"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.mapInArrow(run, f"{kinds}, estimate double, low double, high double")


def event_keys(events: DataFrame) -> DataFrame:
    """``events`` with ``day`` (of DATEADDED, null if unreadable) and ``root`` (two digits or more, null if none)."""
    day = F.to_date(F.try_to_timestamp("DATEADDED", F.lit("yyyyMMddHHmmss")))
    return events.select(F.date_format(day, "yyyy-MM-dd").alias("day"), root_code(F.col("EventRootCode")).alias("root"), "SOURCEURL")


def distinct_cube(events: DataFrame, m: int = M) -> DataFrame:
    """(level, day, root, registers): sketches of the distinct non-null SOURCEURL per day, root code, both, and in all.

    ``level`` is ``day``, ``root``, ``day_root`` or ``total``; keys that a level doesn't use are null. Rows without a
    readable day count in the levels ``root`` and ``total`` only, those without a root code in ``day`` and ``total`` only.
    Root codes of one digit equal those with a leading zero. An empty table gives no rows.
    """
    base = merge(partials(event_keys(events), ["day", "root"], F.col("SOURCEURL"), m), ["day", "root"])
    none = F.lit(None).cast("string")
    day, root = F.col("day"), F.col("root")
    level = lambda name, d, r: F.struct(F.lit(name).alias("level"), d.alias("day"), r.alias("root"))
    every = F.array(
        level("total", none, none),
        F.when(day.isNotNull(), level("day", day, none)),
        F.when(root.isNotNull(), level("root", none, root)),
        F.when(day.isNotNull() & root.isNotNull(), level("day_root", day, root)),
    )
    up = base.select(F.explode(F.filter(every, lambda x: x.isNotNull())).alias("k"), "registers").select("k.*", "registers")
    return merge(up, ["level", "day", "root"])
