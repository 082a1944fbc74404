"""Zone search: greedy and annealed growth, multi-start, hour-by-hour adaptation.

A search is sequential, so runs are what Spark spreads: one group a run, by seed, schedule
or hour. The city (blocks, neighbours, revenue) has thousands of rows whatever the number
of trips; it is collected once and sent to all runs.

The kernel keeps for every block what it would add to the zone, updates that when a block
comes or goes, and finds the blocks that hold a zone together as cut vertices in one
traversal, so that no step scans all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordon.config import CAP_MARGIN_KM2, MAX_AREA_KM2, MAX_ITERATIONS, MIN_BLOCKS, N_SEEDS, SA_ITERATIONS, SA_T_END, SEED

#: Pairs of blocks with revenue that a search keeps in memory, some 100 bytes each.
MAX_PAIRS = 20_000_000


@dataclass
class City:
    """Blocks by position, in order of their ids."""

    ids: np.ndarray
    area: np.ndarray
    near: list[np.ndarray]
    others: list[np.ndarray]
    revenue: list[np.ndarray]
    own: np.ndarray

    @classmethod
    def of(cls, blocks: pd.DataFrame, adjacency: pd.DataFrame, both: pd.DataFrame) -> City:
        b = blocks.sort_values("block_id")
        ids = b["block_id"].to_numpy()
        at = {int(k): i for i, k in enumerate(ids)}
        near: list[set] = [set() for _ in ids]
        for s, d in zip(adjacency["src"], adjacency["dst"]):
            if s in at and d in at and s != d:
                near[at[s]].add(at[d])
        own, rows = np.zeros(len(ids)), [{} for _ in ids]
        for s, d, r in zip(both["block"], both["other"], both["revenue"]):
            if s in at and d in at:
                if s == d:
                    own[at[s]] = r
                else:
                    rows[at[s]][at[d]] = r
        return cls(ids, b["area_m2"].to_numpy(float), [np.array(sorted(x), int) for x in near], [np.array(sorted(x), int) for x in rows], [np.array([x[k] for k in sorted(x)], float) for x in rows], own)

    @classmethod
    def collect(cls, blocks: DataFrame, adjacency: DataFrame, both: DataFrame) -> City:
        """The city's tables on the driver, from where every search gets them whole. More than MAX_PAIRS pairs are an error."""
        pairs = both.count()
        if pairs > MAX_PAIRS:
            raise ValueError(f"{pairs} pairs of blocks with revenue are more than the {MAX_PAIRS} that a search keeps in memory")
        return cls.of(blocks.select("block_id", "area_m2").toPandas(), adjacency.select("src", "dst").toPandas(), both.toPandas())

    def between(self, a: int, b: int) -> float:
        k = np.searchsorted(self.others[a], b)
        return float(self.revenue[a][k]) if k < len(self.others[a]) and self.others[a][k] == b else 0.0

    def positions(self, ids) -> list[int]:
        return [int(np.searchsorted(self.ids, i)) for i in sorted(ids)]


class Zone:
    """A set of blocks with its revenue (both ends inside), its area, and every block's gain: own revenue and that with the zone."""

    def __init__(self, city: City, members=()):
        self.city, n = city, len(city.ids)
        self.inside, self.gain, self.touching = np.zeros(n, bool), city.own.copy(), np.zeros(n, int)
        self.revenue = self.area = 0.0
        for m in members:
            self.add(m)

    def _change(self, b: int, sign: int) -> None:
        c = self.city
        self.inside[b] = sign > 0
        self.revenue += sign * self.gain[b]
        self.area += sign * c.area[b]
        self.gain[c.others[b]] += sign * c.revenue[b]
        self.touching[c.near[b]] += sign

    def add(self, b: int) -> None:
        self._change(b, 1)

    def remove(self, b: int) -> None:
        self._change(b, -1)

    def members(self) -> np.ndarray:
        return np.flatnonzero(self.inside)

    def external(self) -> np.ndarray:
        return np.flatnonzero(~self.inside & (self.touching > 0))

    def cut_vertices(self) -> set[int]:
        """Members without which the rest falls apart (lowest-link search, without recursion)."""
        members = self.members()
        if len(members) < 2:
            return set()
        order: dict[int, int] = {}
        low: dict[int, int] = {}
        cuts: set[int] = set()
        root, count, branches = int(members[0]), 0, 0
        stack = [(root, -1, iter(self.city.near[root]))]
        order[root] = low[root] = 0
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                w = int(w)
                if not self.inside[w] or w == parent:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                    continue
                count += 1
                order[w] = low[w] = count
                branches += v == root
                stack.append((w, v, iter(self.city.near[w])))
                break
            else:
                stack.pop()
                if parent >= 0:
                    low[parent] = min(low[parent], low[v])
                    if parent != root and low[v] >= order[parent]:
                        cuts.add(parent)
        if len(order) < len(members):  # in parts: the rest is connected only if the block is a part of its own, of two
            every = set(map(int, members))
            return {m for m in every if not _connected(self.city, every - {m})}
        return cuts | ({root} if branches > 1 else set())


def _connected(city: City, members: set[int]) -> bool:
    if len(members) <= 1:
        return True
    todo, seen = [next(iter(members))], set()
    while todo:
        v = todo.pop()
        if v not in seen:
            seen.add(v)
            todo += [int(w) for w in city.near[v] if w in members]
    return len(seen) == len(members)


def expand(zone: Zone, cap: float, temperature: float | None = None, rng: np.random.Generator | None = None) -> int | None:
    """The block to add within the cap: the best of positive gain (of ties the smallest id), or with a temperature one drawn by softmax of gains."""
    c = zone.external()
    c = c[zone.area + zone.city.area[c] <= cap]
    if not len(c):
        return None
    gain = zone.gain[c]
    if temperature is None:
        k = int(np.argmax(gain))
        return int(c[k]) if gain[k] > 0 else None
    weight = np.exp((gain - gain.max()) / max(temperature, 1e-9))
    return int(rng.choice(c, p=weight / weight.sum()))


def swap(zone: Zone, cap: float) -> tuple[int, int, float] | None:
    """The best pair (block to remove, block to add, gain > 0): the rest stays connected and touches the new block, the area fits."""
    city, c = zone.city, zone.external()
    cuts, best = zone.cut_vertices(), None
    if zone.inside.sum() < 2:
        return None
    for b in map(int, zone.members()):
        if b in cuts:
            continue
        touches = zone.touching[c] - np.isin(c, city.near[b])
        k = c[(touches > 0) & (zone.area - city.area[b] + city.area[c] <= cap)]
        if len(k):
            lost = np.zeros(len(city.ids))
            lost[city.others[b]] = city.revenue[b]
            delta = zone.gain[k] - lost[k] - zone.gain[b]
            i = int(np.argmax(delta))
            if delta[i] > (best[2] if best else 0.0):
                best = b, int(k[i]), float(delta[i])
    return best


HISTORY = "iteration int, action string, block long, revenue double, best_revenue double, area_sqkm double, n_blocks int, temperature double"


def run(city: City, seed_block: int, mode: str = "greedy", max_area_km2: float = MAX_AREA_KM2, iterations: int = MAX_ITERATIONS, t_start: float = 300.0, cooling: float = 0.995, t_end: float = SA_T_END, random_seed: int = SEED) -> tuple[list[int], float, pd.DataFrame]:
    """Grows a zone from a block. Returns the best zone ever (ids), its revenue, and a row for each move."""
    if mode not in ("greedy", "sa"):
        raise ValueError(f"mode is 'greedy' or 'sa', not {mode!r}")
    rng, temperature, cap = np.random.default_rng(random_seed), t_start if mode == "sa" else None, max_area_km2 * 1e6
    zone = Zone(city, [int(np.searchsorted(city.ids, seed_block))])
    best, top, rows = zone.members(), zone.revenue, []

    def note(i: int, action: str, block: int) -> None:
        nonlocal best, top
        if zone.revenue > top:
            best, top = zone.members(), zone.revenue
        rows.append((i, action, int(city.ids[block]), zone.revenue, top, zone.area / 1e6, int(zone.inside.sum()), temperature))

    note(0, "seed", int(best[0]))
    for i in range(1, iterations + 1):
        if temperature is not None and temperature < t_end:
            break
        b = expand(zone, cap, temperature, rng)
        if b is not None:
            zone.add(b)
            note(i, "expand", b)
            if zone.area >= cap:
                break
        s = swap(zone, cap)
        if s is not None:
            zone.remove(s[0])
            zone.add(s[1])
            note(i, "swap", s[1])
        if b is None and s is None:
            break
        if temperature is not None:
            temperature *= cooling
    return [int(x) for x in city.ids[best]], top, pd.DataFrame(rows, columns=[c.split()[0] for c in HISTORY.split(", ")])


RUN = "run_id long, seed_block long, mode string, t_start double, cooling double, random_seed long"


def run_all(spark: SparkSession, runs: DataFrame, city: City, iterations: int, max_area_km2: float = MAX_AREA_KM2, history: bool = False) -> DataFrame:
    """One search per row of `runs` (RUN), each a task: its best zone and revenue, or every move of it."""
    sent = spark.sparkContext.broadcast(city)
    keys = "run_id long, seed_block long, mode string, t_start double, cooling double, "

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        zone, revenue, moves = run(sent.value, int(r.seed_block), r["mode"], max_area_km2, iterations, float(r.t_start), float(r.cooling), random_seed=int(r.random_seed))
        out = moves if history else pd.DataFrame([(revenue, len(zone), sum(sent.value.area[sent.value.positions(zone)]) / 1e6, zone)], columns=["revenue", "n_blocks", "area_sqkm", "blocks"])
        for k in ("cooling", "t_start", "mode", "seed_block", "run_id"):
            out.insert(0, k, r[k])
        return out

    return runs.groupBy("run_id").applyInPandas(search, keys + (HISTORY if history else "revenue double, n_blocks int, area_sqkm double, blocks array<long>"))


def multi_start(spark: SparkSession, seed_blocks: list[int], mode: str = "greedy", t_start: float = 300.0, cooling: float = 0.995, random_seed: int = SEED) -> DataFrame:
    """Runs for seeds: the i-th has random seed + i."""
    return spark.createDataFrame([(i, int(b), mode, float(t_start), float(cooling), random_seed + i) for i, b in enumerate(seed_blocks[:N_SEEDS])], RUN)


def schedule_grid(spark: SparkSession, seed_block: int, starts=(50, 150, 300, 600), coolings=(0.98, 0.99, 0.995, 0.999), random_seed: int = SEED) -> DataFrame:
    return spark.createDataFrame([(i, int(seed_block), "sa", float(t), float(c), random_seed) for i, (t, c) in enumerate((t, c) for t in starts for c in coolings)], RUN)


def best_run(results: DataFrame) -> DataFrame:
    """The run of the largest revenue; of ties the first."""
    return results.orderBy(F.desc("revenue"), "run_id").limit(1)


def grid_pivot(results: DataFrame) -> DataFrame:
    return results.groupBy("t_start").pivot("cooling").agg(F.first("revenue"))


def compare_modes(greedy: DataFrame, annealed: DataFrame) -> DataFrame:
    """Per seed: both revenues and the gain of annealing in percent."""
    g, s = greedy.select("seed_block", F.col("revenue").alias("greedy_revenue")), annealed.select("seed_block", F.col("revenue").alias("sa_revenue"))
    return g.join(s, "seed_block").withColumn("gain_pct", F.try_divide(100 * (F.col("sa_revenue") - F.col("greedy_revenue")), F.col("greedy_revenue")))


# Adaptation from hour to hour


def path_to_zone(city: City, start: int, zone: Zone) -> list[int]:
    """Blocks of a shortest path from `start` to a neighbour of the zone, both included; empty if it touches the zone already or cannot reach it."""
    if zone.touching[start] > 0:
        return []
    came, layer = {start: -1}, [start]
    while layer:
        nxt = []
        for v in layer:
            for w in map(int, city.near[v]):
                if w in came:
                    continue
                came[w] = v
                if zone.touching[w] > 0 and not zone.inside[w]:
                    path = [w]
                    while came[path[-1]] >= 0:
                        path.append(came[path[-1]])
                    return path[::-1]
                nxt.append(w)
        layer = nxt
    return []


def contract(zone: Zone, least: int = MIN_BLOCKS) -> int:
    """Takes away border blocks that add nothing and hold nothing together, those with the fewest neighbours inside first. Returns how many."""
    gone = 0
    while zone.inside.sum() > least:
        cuts, degree = zone.cut_vertices(), zone.touching
        border = [b for b in map(int, zone.members()) if not zone.inside[zone.city.near[b]].all()]
        b = next((b for b in sorted(border, key=lambda b: (degree[b], b)) if b not in cuts and zone.gain[b] <= 0), None)
        if b is None:
            break
        zone.remove(b)
        gone += 1
    return gone


def keep_border(before: set[int], zone: Zone, cap: float) -> tuple[int, int]:
    """Dropped blocks must still touch the zone: those that don't come back with a path to it, where the cap allows. Returns blocks added and blocks left apart."""
    added = 0
    while True:
        apart, again = 0, False
        for b in sorted(before - set(map(int, zone.members()))):
            if zone.touching[b] > 0:
                continue
            path = path_to_zone(zone.city, b, zone)
            if not path or zone.area + zone.city.area[path].sum() > cap:
                apart += 1
                continue
            for p in reversed(path):
                zone.add(p)
            added, again = added + len(path), True
            break
        if not again:
            return added, apart


def transition(city: City, zone_ids, max_area_km2: float = MAX_AREA_KM2, margin_km2: float = CAP_MARGIN_KM2, least: int = MIN_BLOCKS) -> tuple[list[int], dict]:
    """Adapts a zone to the revenue of `city`: contract, swap, expand under the cap less a margin, then keep the border under the cap."""
    zone = Zone(city, city.positions(zone_ids))
    before, cap = set(map(int, zone.members())), (max_area_km2 - margin_km2) * 1e6
    contract(zone, least)
    swapped = 0
    while (s := swap(zone, cap)) is not None:
        zone.remove(s[0])
        zone.add(s[1])
        swapped += 1
    while (b := expand(zone, cap)) is not None:
        zone.add(b)
    bridges, apart = keep_border(before, zone, max_area_km2 * 1e6)
    after = set(map(int, zone.members()))
    stats = {"n_removed": len(before - after), "n_added": len(after - before), "n_swapped": swapped, "n_bridge_blocks": bridges, "n_continuity_skipped": apart, "n_blocks": len(after), "area_sqkm": zone.area / 1e6}
    return [int(city.ids[p]) for p in sorted(after)], stats


TRANSITION = "hour int, n_removed int, n_added int, n_swapped int, n_bridge_blocks int, n_continuity_skipped int, n_blocks int, area_sqkm double, pickup_revenue double, blocks array<long>"


def breathe(spark: SparkSession, blocks: DataFrame, adjacency: DataFrame, hourly_both: DataFrame, hourly: DataFrame, seed_block: int, hours: list[int], max_area_km2: float = MAX_AREA_KM2, least: int = MIN_BLOCKS, iterations: int = SA_ITERATIONS) -> DataFrame:
    """The first hour's zone by annealing, each later hour's by transition from the one before. Hours depend on each other, so
    one task walks through them; hourly lookups are of city size. Revenue counts trips that begin in the zone."""
    b, adj = blocks.select("block_id", "area_m2").toPandas(), adjacency.select("src", "dst").toPandas()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, zone = [], None
        for hour in hours:
            now = pdf[pdf["hour"] == hour]
            city = City.of(b, adj, now[now["kind"] == "both"].rename(columns={"a": "block", "b": "other"}))
            if zone is None:
                zone, _, _ = run(city, seed_block, "sa", max_area_km2, iterations)
                stats = {"n_removed": 0, "n_added": len(zone), "n_swapped": 0, "n_bridge_blocks": 0, "n_continuity_skipped": 0, "n_blocks": len(zone), "area_sqkm": float(city.area[city.positions(zone)].sum()) / 1e6}
            else:
                zone, stats = transition(city, zone, max_area_km2, least=least)
            trips = now[(now["kind"] == "trips") & now["a"].isin(zone)]
            rows.append((hour, *stats.values(), float(trips["revenue"].sum()), zone))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in TRANSITION.split(", ")])

    given = hourly_both.select("hour", F.lit("both").alias("kind"), F.col("block").cast("long").alias("a"), F.col("other").cast("long").alias("b"), "revenue").unionByName(hourly.select("hour", F.lit("trips").alias("kind"), F.col("pickup_block").cast("long").alias("a"), F.col("dropoff_block").cast("long").alias("b"), "revenue"))
    return given.where(F.col("hour").isin(hours)).groupBy(F.lit(0).alias("one")).applyInPandas(walk, TRANSITION)
