"""Trips and stops from location pings.

Method: the fixes of a vessel are summed up as stationary medians, the medians form a proximity graph whose communities are
the vessel's recurring places, contiguous visits to a place are the stops, and trips run between stops.

1. ``stretches`` reads each time block of a vessel once, in order. ``_History.pieces`` cuts its fixes into short stationary pieces,
   ``communities`` finds the places in the proximity graph of the pieces' medians, and successive pieces of one place are a visit.
   An exact check follows: of a visit there stays the longest stretch of fixes within the radius of its own median, and
   it must span the least time. One row per such stretch leaves the block, and one for either end of each block or silence,
   where a stretch may go on in the next block: at most a few rows per half hour of its time, however many pings it has.
2. ``visits`` gets only these rows: the medians of all blocks are joined to places once more, which number them, stretches cut by
   a block border are put together if their medians lie within the radius, and what spans the least time is a stop.

Both steps are streams over sorted partitions. A hot vessel is cut into blocks (operators.blocks).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.blocks import BLOCK, by_block, time_blocks, whole_groups

EARTH_M = 6_371_008.8
PIECE = 1 / 3  # of the least time of a stop, spanned by the pieces whose medians are joined to places
ROUNDS = 20

STRETCH = (
    f"mmsi string, {BLOCK} int, seg int, t0 timestamp_ntz, t1 timestamp_ntz, n long, settled boolean, x double, y double, z double, "
    "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double, inner_m double, gap_m double, between long"
)
VISIT = (
    "mmsi string, kind string, start_ts timestamp_ntz, end_ts timestamp_ntz, duration_s double, distance_m double, "
    "n_fixes long, place long, lat double, lon double, from_place long, to_place long"
)


def fixes(positions: DataFrame) -> DataFrame:
    """The usable pings: id, time and both coordinates present and in range, one per vessel and time (the lowest msg_id)."""
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    ok = ok & F.col("mmsi").isNotNull() & F.col("ts_utc").isNotNull()
    return positions.select("mmsi", F.col("ts_utc").cast("timestamp_ntz").alias("ts_utc"), "lat", "lon", "msg_id").filter(ok)


def _unit(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    la, lo = np.radians(lat), np.radians(lon)
    return EARTH_M * np.cos(la) * np.cos(lo), EARTH_M * np.cos(la) * np.sin(lo), EARTH_M * np.sin(la)


class _History:
    """The fixes of one segment (one vessel and block, no long silence) and the search for stationary stretches in it."""

    def __init__(self, t: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, radius: float, least_us: int):
        self.ta, self.xa, self.ya, self.za = t, x, y, z
        self.t, self.x, self.y, self.z = t.tolist(), x.tolist(), y.tolist(), z.tolist()
        self.r2, self.least, self.n = radius * radius, least_us, len(t)

    def grow(self, i: int, step: int, end: int, until: float = float("inf")) -> int:
        """The last fix of the stretch that starts at i: near its running mean; a lone fix elsewhere is passed over.

        A stretch of two fixes or more ends with the first one later than ``until``.
        """
        x, y, z, r2 = self.x, self.y, self.z, self.r2
        cx, cy, cz, k, last, j = x[i], y[i], z[i], 1, i, i + step
        while j != end:
            dx, dy, dz = x[j] - cx, y[j] - cy, z[j] - cz
            if dx * dx + dy * dy + dz * dz > r2:
                j += step
                if j == end:
                    break
                dx, dy, dz = x[j] - cx, y[j] - cy, z[j] - cz
                if dx * dx + dy * dy + dz * dz > r2:
                    break
            k += 1
            cx, cy, cz = cx + dx / k, cy + dy / k, cz + dz / k
            last = j
            if self.t[j] > until:
                break
            j += step
        return last

    def near(self, j: int, c: tuple[float, float, float]) -> bool:
        dx, dy, dz = self.x[j] - c[0], self.y[j] - c[1], self.z[j] - c[2]
        return dx * dx + dy * dy + dz * dz <= self.r2

    def centre(self, s: int, e: int) -> tuple[float, float, float]:
        return tuple(float(np.median(a[s : e + 1])) for a in (self.xa, self.ya, self.za))  # type: ignore[return-value]

    def refine(self, s: int, e: int, low: int, high: int) -> tuple[int, int, tuple[float, float, float]]:
        """The stretch around the median of s..e, as long as possible within low..high."""
        c = self.centre(s, e)
        for _ in range(2):
            while s < e and not self.near(s, c):
                s += 1
            while e > s and not self.near(e, c):
                e -= 1
            while s > low:
                if self.near(s - 1, c):
                    s -= 1
                elif s - 2 >= low and self.near(s - 2, c):
                    s -= 2
                else:
                    break
            while e < high:
                if self.near(e + 1, c):
                    e += 1
                elif e + 2 <= high and self.near(e + 2, c):
                    e += 2
                else:
                    break
            c = self.centre(s, e)
        return s, e, c

    def pieces(self) -> list[tuple[int, int]]:
        """(first, last) of pieces: successive fixes near their running mean, cut where they span ``PIECE`` of the least time; or one fix
        near one of the two before it."""
        out, i, n, t, span = [], 0, self.n, self.t, self.least * PIECE
        while i < n:
            e = self.grow(i, 1, n, t[i] + span)
            if e > i or any(self.near(k, (self.x[i], self.y[i], self.z[i])) for k in range(max(0, i - 2), i)):
                out.append((i, e))
            i = e + 1
        return out

    def settled(self) -> list[tuple[int, int, tuple[float, float, float]]]:
        """The visits that pass the exact check, in order: contiguous pieces of one place, refined."""
        pieces = self.pieces()
        out: list[tuple[int, int, tuple[float, float, float]]] = []
        if pieces:
            mid = [[sorted(a[s : e + 1])[(e - s) // 2] for a in (self.x, self.y, self.z)] for s, e in pieces]
            place = communities(np.array(mid), np.array([e - s + 1.0 for s, e in pieces]), self.r2**0.5).tolist()
            a = 0
            for k in range(1, len(pieces) + 1):
                # a lone fix elsewhere doesn't end a visit
                if k == len(pieces) or place[k] != place[a] or pieces[k][0] - pieces[k - 1][1] > 2:
                    self._stays(pieces[a:k], out)
                    a = k
        return out

    def _stays(self, visit: list[tuple[int, int]], out: list[tuple[int, int, tuple[float, float, float]]]) -> None:
        """Adds the stops of a visit: what stays within the radius of its median; what is left of it on either side is looked at alike."""
        todo = [visit]
        while todo:
            low = out[-1][1] + 1 if out else 0
            v = [p for p in todo.pop() if p[0] >= low]
            if not v or self.t[v[-1][1]] - self.t[v[0][0]] <= 2 * PIECE * self.least:
                continue
            s, e, c = self.refine(v[0][0], v[-1][1], low, self.n - 1)
            before = [p for p in v if p[1] < s]
            if before:
                todo += [v[len(before) :], before]
                continue
            if self.t[e] - self.t[s] >= self.least:
                out.append((s, e, c))
            todo.append([p for p in v if p[0] > e])

    def rows(self) -> list[tuple]:
        """(first, last, centre, settled) of the settled stretches and of the stretches at either end."""
        found = [(s, e, c, True) for s, e, c in self.settled()]
        first, last = (found[0][0], found[-1][1]) if found else (self.n, -1)
        ends = []
        if first > 0:
            e = self.grow(0, 1, first)
            s, e, c = self.refine(0, e, 0, first - 1)
            ends.append((0, e, c, False) if s == 0 else (0, 0, self.centre(0, 0), False))
        if last < self.n - 1 and not (ends and not found and ends[0][1] == self.n - 1):
            low = max(last, ends[0][1] if ends and not found else -1)
            s = self.grow(self.n - 1, -1, low)
            s, e, c = self.refine(s, self.n - 1, low + 1, self.n - 1)
            k = self.n - 1
            ends.append((s, k, c, False) if e == k else (k, k, self.centre(k, k), False))
        return sorted(found + ends)


def stretches(df: DataFrame, radius_m: float, least_s: float, silence_s: float) -> DataFrame:
    """Summary rows (``STRETCH``) of blocks of fixes; see the module."""
    least, silence = int(least_s * 1e6), int(silence_s * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tbl, off in whole_groups(batches, ["mmsi", BLOCK]):
            t = tbl.column("ts_utc").combine_chunks().cast(pa.int64()).to_numpy()
            x, y, z = _unit(*(tbl.column(c).to_numpy() for c in ("lat", "lon")))
            who, block = tbl.column("mmsi").take(pa.array(off[:-1])).to_pylist(), tbl.column(BLOCK).to_numpy()
            fresh = np.r_[True, np.diff(t) != 0]
            fresh[off[:-1]] = True  # copies of a ping (same vessel and time) count once
            got: list[tuple] = []
            for g in range(len(off) - 1):
                own = np.arange(off[g], off[g + 1])[fresh[off[g] : off[g + 1]]]
                tg = t[own]
                for seg, part in enumerate(np.split(own, np.flatnonzero(np.diff(tg) > silence) + 1)):
                    got += _segment(who[g], int(block[off[g]]), seg, t[part], x[part], y[part], z[part], radius_m, least)
            if got:
                cols = list(zip(*got))
                types = [pa.string(), pa.int32(), pa.int32(), pa.timestamp("us"), pa.timestamp("us"), pa.int64(), pa.bool_(), *[pa.float64()] * 11, pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=[p.split()[0] for p in STRETCH.split(", ")])

    return df.mapInArrow(run, STRETCH)


def _segment(mmsi: str, block: int, seg: int, t, x, y, z, radius: float, least: int) -> list[tuple]:
    h = _History(t, x, y, z, radius, least)
    leg = np.sqrt(np.diff(x) ** 2 + np.diff(y) ** 2 + np.diff(z) ** 2)
    # a spike (far off and back at once) adds nothing to the way
    way = np.r_[0.0, leg]
    if len(t) > 2:
        skip = np.sqrt((x[2:] - x[:-2]) ** 2 + (y[2:] - y[:-2]) ** 2 + (z[2:] - z[:-2]) ** 2)
        spike = np.flatnonzero((np.minimum(leg[:-1], leg[1:]) > 2_000) & (skip < 0.5 * np.minimum(leg[:-1], leg[1:]))) + 1
        way[spike] = 0.0
        way[spike + 1] = skip[spike - 1]
    way = np.cumsum(way)
    out, prev = [], -1
    for s, e, c, ok in h.rows():
        gap, between = (float(way[s] - way[prev]), s - prev - 1) if prev >= 0 else (0.0, 0)
        out.append((mmsi, block, seg, int(t[s]), int(t[e]), e - s + 1, ok, *c, float(x[s]), float(y[s]), float(z[s]), float(x[e]), float(y[e]), float(z[e]), float(way[e] - way[s]), gap, between))
        prev = e
    return out


def communities(points: np.ndarray, weight: np.ndarray, radius: float) -> np.ndarray:
    """The community of each median (n, 3) in the proximity graph, numbered from the heaviest on.

    Nodes are the medians of one cell of a fifth of ``radius``, edges join nodes within ``radius``, the stronger the nearer. Labels
    spread along them, weighed by the fixes behind a node, until none changes (``ROUNDS`` at most). Neighbours are looked
    up in a hash grid, so no pair of far medians is compared.
    """
    _, node = np.unique(np.floor(points * (5.0 / radius)).astype(np.int64), axis=0, return_inverse=True)
    node = node.ravel()
    mass = np.bincount(node, weights=weight)
    at = np.stack([np.bincount(node, weights=weight * points[:, k]) / mass for k in range(3)], axis=1)
    n, pts, w = len(mass), at.tolist(), mass.tolist()
    order = sorted(range(n), key=lambda i: (-w[i], i))
    where = [tuple(c) for c in np.floor(at / radius).astype(np.int64).tolist()]
    cells: dict[tuple[int, int, int], list[int]] = {}
    for i in order:
        cells.setdefault(where[i], []).append(i)
    near: list[list[tuple[int, float]]] = []
    for i in range(n):
        a, b, c = where[i]
        x, y, z = pts[i]
        own = []
        for cell in ((a + da, b + db, c + dc) for da in (-1, 0, 1) for db in (-1, 0, 1) for dc in (-1, 0, 1)):
            for j in cells.get(cell, ()):
                d = ((pts[j][0] - x) ** 2 + (pts[j][1] - y) ** 2 + (pts[j][2] - z) ** 2) ** 0.5
                if d <= radius and j != i:
                    own.append((j, w[j] * (1.0 - d / radius)))
        near.append(own)
    rank = {i: k for k, i in enumerate(order)}
    label = [rank[i] for i in range(n)]
    for _ in range(ROUNDS):
        changed = False
        for i in order:
            votes: dict[int, float] = {}
            for j, v in near[i]:
                votes[label[j]] = votes.get(label[j], 0.0) + v
            best = min(votes, key=lambda k: (-votes[k], k)) if votes else label[i]
            if best != label[i]:
                label[i], changed = best, True
        if not changed:
            break
    return np.unique(np.array(label), return_inverse=True)[1].ravel()[node]


def _itinerary(mmsi: str, rows: list[dict], radius: float, least: int, silence: int) -> list[tuple]:
    """Stops and trips of one vessel from its stretch rows, in time order."""
    label = communities(np.array([[r[k] for k in "xyz"] for r in rows]), np.array([float(r["n"]) for r in rows]), radius)
    out: list[tuple] = []
    stop = None  # the last finished stop of this run of fixes, with the way since
    cur: dict | None = None

    def dist(a, b, p="xyz", q="xyz") -> float:
        return sum((a[i] - b[j]) ** 2 for i, j in zip(p, q)) ** 0.5

    def leg(a: dict, b: dict) -> float:
        """The way from the last fix of stretch a to the first of the next stretch b."""
        if a["block"] == b["block"]:
            return b["gap_m"]
        return sum((a[k + "1"] - b[k + "0"]) ** 2 for k in "xyz") ** 0.5

    def degrees(c: dict) -> tuple[float, float]:
        return float(np.degrees(np.arctan2(c["z"], np.hypot(c["x"], c["y"])))), float(np.degrees(np.arctan2(c["y"], c["x"])))

    def finish() -> None:
        nonlocal stop, cur
        if cur is not None and cur["t1"] - cur["t0"] >= least:
            lat, lon = degrees(cur)
            if stop is not None:
                out.append((mmsi, "trip", stop["t1"], cur["t0"], (cur["t0"] - stop["t1"]) / 1e6, stop["way"], None, None, None, None, stop["place"], cur["place"]))
            out.append((mmsi, "stop", cur["t0"], cur["t1"], (cur["t1"] - cur["t0"]) / 1e6, cur["inner"], cur["n"], cur["place"], lat, lon, None, None))
            stop = {"t1": cur["t1"], "place": cur["place"], "way": 0.0}
        elif cur is not None and stop is not None:
            stop["way"] += cur["inner"]
        cur = None

    i = 0
    while i < len(rows):
        r = rows[i]
        if i and _silent(rows[i - 1], r, silence):
            finish()
            stop = None
        elif i:
            way = leg(rows[i - 1], r)
            # a lone fix between two stretches of one visit doesn't end it
            ahead = rows[i + 1] if i + 1 < len(rows) else None
            if cur is not None and dist(cur, r) <= radius and (r["between"] if r["block"] == rows[i - 1]["block"] else 0) + cur["lone"] <= 1 and (r["block"] != cur["block"]):
                total = cur["n"] + r["n"]
                for k in "xyz":
                    cur[k] = (cur[k] * cur["n"] + r[k] * r["n"]) / total
                cur |= {"t1": r["t1"], "n": total, "inner": cur["inner"] + way + r["inner"] + cur.pop("pending", 0.0), "block": r["block"], "lone": 0}
                i += 1
                continue
            if (
                cur is not None and ahead is not None and r["n"] == 1 and cur["lone"] == 0 and ahead["block"] != cur["block"]
                and not _silent(r, ahead, silence) and (r["between"] if r["block"] == rows[i - 1]["block"] else 0) == 0
                and (ahead["between"] if ahead["block"] == r["block"] else 0) == 0 and dist(cur, ahead) <= radius
            ):
                cur["lone"] = 1
                cur["pending"] = way
                i += 1
                continue
            finish()
            if stop is not None:
                stop["way"] += way
        cur = {k: r[k] for k in ("t0", "t1", "n", "x", "y", "z", "block")} | {"place": int(label[i]), "inner": r["inner_m"], "lone": 0}
        i += 1
    finish()
    return out


def _silent(a: dict, b: dict, silence: int) -> bool:
    """Whether a long silence lies between two successive rows; within one segment there is none."""
    return (a["block"], a["seg"]) != (b["block"], b["seg"]) and b["t0"] - a["t1"] > silence


def visits(rows: DataFrame, radius_m: float, least_s: float, silence_s: float) -> DataFrame:
    """Stops and trips (``VISIT``) from stretch rows."""
    least, silence = int(least_s * 1e6), int(silence_s * 1e6)
    names = [p.split()[0] for p in VISIT.split(", ")]
    types = [pa.string(), pa.string(), pa.timestamp("us"), pa.timestamp("us"), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tbl, off in whole_groups(batches, ["mmsi"]):
            cols = {}
            for n, c in zip(tbl.column_names, tbl.columns):
                cols[n] = (c.combine_chunks().cast(pa.int64()) if pa.types.is_timestamp(c.type) else c).to_pylist()
            got: list[tuple] = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                rows_ = [{"block": cols[BLOCK][k], "inner": cols["inner_m"][k]} | {n: v[k] for n, v in cols.items()} for k in range(a, b)]
                got += _itinerary(cols["mmsi"][a], rows_, radius_m, least, silence)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), types)], names=names)

    return rows.repartition("mmsi").sortWithinPartitions("mmsi", "t0", "t1").mapInArrow(run, VISIT)


def stops_and_trips(
    positions: DataFrame,
    radius_m: float = 500.0,
    least_s: float = 1_800.0,
    silence_s: float = 86_400.0,
    rows_per_block: int = 100_000,
) -> DataFrame:
    """One row per stop and per trip of every vessel.

    A stop is a stretch of fixes within ``radius_m`` of one place (the median of the stretch) that spans ``least_s`` or
    more; a lone fix elsewhere doesn't end it. More than ``silence_s`` without a fix ends stops and trips. A trip runs from the
    last fix of a stop to the first fix of the next one. ``distance_m`` is the way along the fixes without lone spikes;
    ``place`` numbers the vessel's recurring places.

    Null or impossible coordinates, null ids or times: no fix. Copies of a ping (same vessel and time): one fix, that with
    the lowest ``msg_id``. Empty input: no rows. Other columns of ``positions`` are ignored.
    """
    f = time_blocks(fixes(positions), ["mmsi"], F.date_trunc("DAY", "ts_utc"), rows_per_block)
    s = stretches(by_block(f, ["mmsi"], ["ts_utc", "msg_id"]), radius_m, least_s, silence_s)
    return visits(s, radius_m, least_s, silence_s)


def found(positions: DataFrame) -> DataFrame:
    """(mmsi, kind, start_hour, end_hour): the hours of the first and last fix of each stop and trip."""
    v = stops_and_trips(positions)
    hour = lambda c: F.date_format(c, "yyyyMMddHH")
    return v.select("mmsi", "kind", hour("start_ts").alias("start_hour"), hour("end_ts").alias("end_hour"))
