"""The pruned search equals brute force over all selections."""

from itertools import combinations

import numpy as np
import pytest

from leaguelens.plans import selection as se


def brute(ents, teams, budget, rules, held):
    best = None
    for es in combinations(ents, rules.n_entities):
        for ts in combinations(teams, rules.n_teams):
            price = sum(e[2] for e in es) + sum(t[1] for t in ts)
            if price > budget + 1e-9:
                continue
            per_team = [e[1] for e in es]
            cap = rules.max_entities_per_team
            if cap is not None and any(per_team.count(t) > cap for t in per_team):
                continue
            if any(per_team.count(t[0]) < rules.min_entities_per_chosen_team for t in ts):
                continue
            gross = sum(e[3] for e in es) + sum(t[2] for t in ts)
            if rules.bonus_multiplier > 1:
                gross += (rules.bonus_multiplier - 1) * max(e[3] for e in es)
            moves = 0
            if held is not None:
                moves = sum(("entity", e[0]) not in held for e in es) + sum(("team", t[0]) not in held for t in ts)
            net = gross - rules.transfer_penalty * max(0, moves - rules.free_transfers)
            if best is None or net > best + 1e-9:
                best = net
    return best


CASES = {
    "plain": (se.SelectionRules(), False),
    "bonus_and_transfers": (se.SelectionRules(bonus_multiplier=2.0), True),
    "cap": (se.SelectionRules(max_entities_per_team=1), False),
    "required": (se.SelectionRules(min_entities_per_chosen_team=1), True),
    "double_stack": (se.SelectionRules(min_entities_per_chosen_team=2, bonus_multiplier=3.0), True),
    "negative_points": (se.SelectionRules(n_entities=3, n_teams=1, bonus_multiplier=2.0), True),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, name):
    rules, transfers = CASES[name]
    ent_rows, team_rows, budgets, held_rows, want = [], [], [], [], {}
    for g in range(6):
        rng = np.random.default_rng(100 + g)
        low = -30 if name == "negative_points" else 0
        ents = [
            (i, i % 4, round(float(rng.uniform(3, 30)), 1), round(float(rng.uniform(low, 30)), 2)) for i in range(11)
        ]
        teams = [(t, round(float(rng.uniform(5, 30)), 1), round(float(rng.uniform(0, 60)), 2)) for t in range(4)]
        held = {("entity", i) for i in range(0, 11, 3)} | {("team", 1)} if transfers else None
        budget = 110.0 if g else 20.0
        want[g] = brute(ents, teams, budget, rules, held)
        ent_rows += [(g, *e) for e in ents]
        team_rows += [(g, *t) for t in teams]
        budgets.append((g, budget))
        held_rows += [(g, *h) for h in held or ()]
    out = se.best_selection(
        spark.createDataFrame(ent_rows, "period_id int, entity_id int, team_id int, price double, points double"),
        spark.createDataFrame(team_rows, "period_id int, team_id int, price double, points double"),
        spark.createDataFrame(budgets, "period_id int, budget double"),
        "period_id",
        spark.createDataFrame(held_rows, "period_id int, asset_type string, asset_id int") if transfers else None,
        rules,
    ).collect()
    got = {r["period_id"]: r["net_points"] for r in out}
    assert got.keys() == {g for g, v in want.items() if v is not None}
    for g, v in got.items():
        assert v == pytest.approx(want[g], abs=1e-6)
    for r in out:
        assert len(r["entity_ids"]) == rules.n_entities and len(r["team_ids"]) == rules.n_teams
        assert r["total_price"] <= r["budget"] + 1e-9


def test_team_without_entities_raises(spark):
    ents = spark.createDataFrame([(1, 1, 1, 5.0, 5.0)], "period_id int, entity_id int, team_id int, price double, points double")
    teams = spark.createDataFrame([(1, 2, 5.0, 5.0)], "period_id int, team_id int, price double, points double")
    budget = spark.createDataFrame([(1, 100.0)], "period_id int, budget double")
    with pytest.raises(ValueError, match="no entities"):
        se.best_selection(ents, teams, budget, rules=se.SelectionRules(min_entities_per_chosen_team=1))


def test_needed_keeps_what_fewer_than_k_beat():
    rng = np.random.default_rng(1)
    price, points = rng.integers(1, 20, 300) / 2.0, rng.integers(0, 40, 300) / 1.0
    new, ids = rng.integers(0, 2, 300), np.arange(300)
    keep = se.needed(price, points, new, ids, np.full(300, 3), np.zeros(300, dtype=int))
    for i in range(300):
        beats = (price <= price[i]) & (points >= points[i]) & (new <= new[i])
        strict = (price < price[i]) | (points > points[i]) | (new < new[i]) | (ids < ids[i])
        assert keep[i] == ((beats & strict).sum() < 3)


def test_prior_selection(spark):
    rows = [("me", 3, 1, 2, 9), ("me", 5, 3, 4, 8), ("you", 6, 5, 6, 7)]
    config = spark.createDataFrame(rows, "selection_name string, period_id int, entity_1_id int, entity_2_id int, team_1_id int")
    ids = lambda df: sorted((r["asset_type"], r["asset_id"]) for r in df.collect())
    slots = {"n_entities": 2, "n_teams": 1}
    assert ids(se.prior_selection(config, 7, "me", **slots)) == [("entity", 3), ("entity", 4), ("team", 8)]
    assert ids(se.prior_selection(config, 4, "me", exact=True, **slots)) == [("entity", 1), ("entity", 2), ("team", 9)]
    with pytest.raises(ValueError, match="no prior"):
        se.prior_selection(config, 8, "me", exact=True, **slots)
