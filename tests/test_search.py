import numpy as np
import pandas as pd
import pytest

from cordon.operators import optimise as op
from cordon.operators import revenue as rv


def random_city(seed, side=6):
    rng = np.random.default_rng(seed)
    n = side * side
    blocks = pd.DataFrame({"block_id": np.arange(n) * 3, "area_m2": rng.uniform(0.5e6, 1.5e6, n)})
    adj = [(3 * a, 3 * b) for a in range(n) for b in range(n) if abs(a // side - b // side) + abs(a % side - b % side) == 1]
    rows = {}
    for _ in range(n * 6):
        a, b = map(int, rng.integers(0, n, 2))
        rows[a, b] = rows[b, a] = float(rng.uniform(1, 50))
    both = pd.DataFrame([(3 * a, 3 * b, r) for (a, b), r in rows.items()], columns=["block", "other", "revenue"])
    return op.City.of(blocks, pd.DataFrame(adj, columns=["src", "dst"]), both), rows, adj


def revenue_of(members, rows):
    return sum(r for (a, b), r in rows.items() if a in members and b in members and a <= b)


def connected(city, members):
    return op._connected(city, set(map(int, members)))


@pytest.mark.parametrize("mode", ["greedy", "sa"])
@pytest.mark.parametrize("seed", range(4))
def test_zones_are_connected_within_the_cap_and_worth_what_is_said(mode, seed):
    city, rows, _ = random_city(seed)
    zone, revenue, moves = op.run(city, 3 * (7 + seed), mode, max_area_km2=9.0, iterations=60, t_start=50, random_seed=seed)
    at = city.positions(zone)
    assert connected(city, at) and city.area[at].sum() <= 9.0e6
    assert revenue == pytest.approx(revenue_of(set(at), rows)) and revenue == pytest.approx(moves.best_revenue.max())
    assert (moves.best_revenue.diff().dropna() >= 0).all()
    if mode == "greedy":
        assert (moves.revenue.diff().dropna() > 0).all() and moves.temperature.isna().all()
    again = op.run(city, 3 * (7 + seed), mode, max_area_km2=9.0, iterations=60, t_start=50, random_seed=seed)
    assert again[0] == zone and again[1] == revenue


def test_steps_against_trying_everything():
    for seed in range(6):
        city, rows, _ = random_city(seed, 4)
        rng = np.random.default_rng(seed)
        zone = op.Zone(city, [5])
        for _ in range(int(rng.integers(1, 6))):
            zone.add(int(rng.choice(zone.external())))
        members, cap = set(map(int, zone.members())), zone.area + 1.2e6
        worth = revenue_of(members, rows)
        assert zone.revenue == pytest.approx(worth)
        for b in range(16):
            if b not in members:
                assert zone.gain[b] == pytest.approx(revenue_of(members | {b}, rows) - worth)
        assert zone.cut_vertices() == {b for b in members if not connected(city, members - {b})}
        best = None
        for b in sorted(members):
            rest = members - {b}
            if rest and connected(city, rest):
                for c in map(int, zone.external()):
                    if set(map(int, city.near[c])) & rest and zone.area - city.area[b] + city.area[c] <= cap:
                        d = revenue_of(rest | {c}, rows) - worth
                        if d > 1e-9 and (best is None or d > best[2] + 1e-9):
                            best = (b, c, d)
        got = op.swap(zone, cap)
        assert (got is None) == (best is None) and (got is None or got[2] == pytest.approx(best[2]))


def test_a_wrong_mode_is_an_error():
    with pytest.raises(ValueError):
        op.run(random_city(0)[0], 0, "annealing")


def test_transition_keeps_the_zone_whole():
    city, _, _ = random_city(1)
    other, rows, _ = random_city(2)
    zone, _, _ = op.run(city, 42, "greedy", 9.0, 60)
    new, stats = op.transition(other, zone, 9.0, least=3)
    at = other.positions(new)
    assert connected(other, at) and stats["area_sqkm"] <= 9.0 and stats["n_blocks"] == len(new)
    assert stats["n_removed"] == len(set(zone) - set(new)) and stats["n_added"] == len(set(new) - set(zone))
    inside = set(at)
    apart = [b for b in other.positions(set(zone) - set(new)) if not set(map(int, other.near[b])) & inside]
    assert len(apart) == stats["n_continuity_skipped"]


def line_city(n, revenue):
    blocks = pd.DataFrame({"block_id": range(n), "area_m2": [1e6] * n})
    adj = pd.DataFrame([(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], columns=["src", "dst"])
    return op.City.of(blocks, adj, pd.DataFrame([(b, b, r) for b, r in revenue.items()], columns=["block", "other", "revenue"]))


def test_contraction_peels_tips_without_revenue_down_to_the_floor():
    city = line_city(8, {3: 5.0, 4: 5.0})
    zone = op.Zone(city, range(1, 7))
    assert op.contract(zone, least=1) == 4 and set(zone.members()) == {3, 4}
    zone = op.Zone(city, range(1, 7))
    assert op.contract(zone, least=5) == 1
    whole = op.Zone(city, range(8))  # no block has a neighbour outside
    assert op.contract(whole, least=1) == 0


def test_bridges_and_unreachable_blocks():
    city = line_city(6, {0: 1.0})
    zone = op.Zone(city, [0])
    assert op.path_to_zone(city, 4, zone) == [4, 3, 2, 1] and op.path_to_zone(city, 1, zone) == []
    assert op.keep_border({0, 4}, zone, 9e6) == (4, 0)
    zone = op.Zone(city, [0])
    assert op.keep_border({0, 4}, zone, 3e6) == (0, 1)
    city.near[2] = np.array([1])
    city.near[3] = np.array([4])
    assert op.keep_border({0, 4}, op.Zone(city, [0]), 9e6) == (0, 1)


def test_more_pairs_than_fit_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(op, "MAX_PAIRS", 1)
    blocks = spark.createDataFrame([(0, 1e6), (1, 1e6)], "block_id int, area_m2 double")
    adj = spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")
    both = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "block int, other int, revenue double")
    with pytest.raises(ValueError, match="2 pairs"):
        op.City.collect(blocks, adj, both)
    assert len(op.City.collect(blocks, adj, both.limit(1)).ids) == 2


def test_seeds_keep_two_steps_apart(spark):
    adj = spark.createDataFrame([(i, j) for i in range(10) for j in (i - 1, i + 1) if 0 <= j < 10], "src int, dst int")
    uni = spark.createDataFrame([(0, 9.0), (1, 1.0), (2, 8.0), (3, 1.0), (4, 1.0), (5, 7.0), (6, 0.0), (7, 0.0), (8, 0.0), (9, 7.0)], "block_id int, revenue double")
    maxima = rv.local_maxima(uni, adj)
    assert sorted(r.block_id for r in maxima.collect()) == [0, 2, 5, 7, 9]
    assert [(r.seed_rank, r.block_id) for r in rv.seeds(maxima, adj, 3).collect()] == [(1, 0), (2, 5), (3, 9)]
