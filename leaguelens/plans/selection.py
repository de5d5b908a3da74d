"""Budget-constrained selections.

A candidate that enough others beat on price, points and transfer status can
never be needed, so each batch of rows drops those before anything is
shuffled, and again per salted part of a group. What is left of a group is
searched exactly: candidates are added one at a time and only states no other
state beats on both price and points are kept.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.aggregates import share_of_total
from leaguelens.operators.common import Order, as_list, number_rows, spread
from leaguelens.operators.ordering import best_row
from leaguelens.operators.reshape import bucketize, pivot_fill


@dataclass(frozen=True)
class SelectionRules:
    n_entities: int = 5
    n_teams: int = 2
    max_entities_per_team: int | None = None
    min_entities_per_chosen_team: int = 0
    bonus_multiplier: float = 1.0
    free_transfers: int = 2
    transfer_penalty: float = 10.0

    @property
    def by_team(self) -> bool:
        return self.max_entities_per_team is not None or self.min_entities_per_chosen_team > 0


def needed(price, points, is_new, ids, k, group) -> np.ndarray:
    """Which candidates fewer than ``k`` others of their group beat; ties go to the lower id.

    ``k`` is given per row. Rows are visited from the cheapest up, so whatever
    was seen before costs no more; the ``k`` highest points seen decide.
    """
    order = np.lexsort((ids, is_new, -points, price, group))
    keep = np.zeros(len(order), dtype=bool)
    current, seen = None, {}
    # plain lists: this visits every row once
    group, points, is_new, k = group.tolist(), points.tolist(), is_new.tolist(), k.tolist()
    for i in order.tolist():
        if group[i] != current:
            current, seen = group[i], {0: [], 1: []}  # points of the kept ones, of all
        new, limit, value = is_new[i], k[i], points[i]
        ahead = seen[new]
        keep[i] = len(ahead) < limit or ahead[0] < value
        for heap in (seen[1],) if new else (seen[0], seen[1]):
            if len(heap) < limit:
                heapq.heappush(heap, value)
            elif heap[0] < value:
                heapq.heapreplace(heap, value)
    return keep


def _prune(rules: SelectionRules, group: list[str]):
    by = [*group, "kind"] + (["team_id"] if rules.by_team else [])

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            entity = (pdf["kind"] == "entity").to_numpy()
            code = pdf.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
            k = np.where(entity, rules.n_entities, rules.n_teams)
            cols = [pdf[c].to_numpy() for c in ("price", "points", "is_new", "asset_id")]
            keep = needed(*cols, k, code)
            if rules.min_entities_per_chosen_team > 0:
                keep |= ~entity  # a team stands for its entities too
            yield pdf[keep]

    return prune


class _Front:
    """States that no other state beats on price and points, with the rows picked."""

    __slots__ = ("price", "points", "picks")

    def __init__(self, price, points, picks):
        self.price, self.points, self.picks = price, points, picks

    def plus(self, price: float, points: float, row: int, budget: float) -> _Front | None:
        ok = self.price + price <= budget + 1e-9
        if not ok.any():
            return None
        added = np.full((int(ok.sum()), 1), row, dtype=np.int32)
        return _Front(
            self.price[ok] + price, self.points[ok] + points, np.hstack([self.picks[ok], added])
        )


def _merge(fronts: list[_Front]) -> _Front:
    price = np.concatenate([f.price for f in fronts])
    points = np.concatenate([f.points for f in fronts])
    picks = np.concatenate([f.picks for f in fronts])
    order = np.lexsort((-points, price))
    p = points[order]
    ahead = np.r_[-np.inf, np.maximum.accumulate(p)[:-1]]
    order = order[p > ahead]
    return _Front(price[order], points[order], picks[order])


def _search(pdf: pd.DataFrame, rules: SelectionRules) -> tuple | None:
    """Best (picks, bonus row, price, gross, transfers, net) of one group.

    A state's key is (entities, teams, transfers, bonus given). Entities come
    team by team, so the count within the current team is known when its team
    may be chosen.
    """
    budget = float(pdf["budget"].iloc[0])
    price, points = pdf["price"].to_numpy(float), pdf["points"].to_numpy(float)
    new = pdf["is_new"].to_numpy(int)
    kind, team = pdf["kind"].to_numpy(), pdf["team_id"].to_numpy()
    use_bonus = rules.bonus_multiplier > 1.0
    cap = rules.max_entities_per_team or rules.n_entities
    none = np.empty((1, 0), dtype=np.int32)
    states = {(0, 0, 0, 0): [_Front(np.zeros(1), np.zeros(1), none)]}
    for t in sorted(set(team)):
        inner = {(0, *key): fronts for key, fronts in states.items()}
        for row in np.flatnonzero((team == t) & (kind == "entity")):
            grown: dict[tuple, list[_Front]] = {k: list(v) for k, v in inner.items()}
            for (j, k, c, n, b), fronts in inner.items():
                if j == cap or k == rules.n_entities:
                    continue
                for bonus in (0, 1) if use_bonus and not b else (0,):
                    gain = points[row] * (rules.bonus_multiplier if bonus else 1.0)
                    for f in fronts:
                        g = f.plus(price[row], gain, row * 2 + bonus, budget)
                        if g is not None:
                            grown.setdefault((j + 1, k + 1, c, n + new[row], b + bonus), []).append(g)
            inner = {k: [_merge(v)] for k, v in grown.items()}
        states = {}
        chosen = np.flatnonzero((team == t) & (kind == "team"))
        for (j, k, c, n, b), fronts in inner.items():
            states.setdefault((k, c, n, b), []).extend(fronts)
            if c < rules.n_teams and j >= rules.min_entities_per_chosen_team:
                for row in chosen:
                    for f in fronts:
                        g = f.plus(price[row], points[row], row * 2, budget)
                        if g is not None:
                            states.setdefault((k, c + 1, n + new[row], b), []).append(g)
        states = {k: [_merge(v)] for k, v in states.items()}
    best = None
    for (k, c, n, b), (front,) in states.items():
        if (k, c) != (rules.n_entities, rules.n_teams) or b != int(use_bonus):
            continue
        net = front.points - rules.transfer_penalty * max(0, n - rules.free_transfers)
        i = int(np.argmax(net))
        cand = (net[i], -front.price[i], front.picks[i], front.points[i], n)
        if best is None or cand[:2] > best[:2]:
            best = cand
    if best is None:
        return None
    net, neg_price, picks, gross, n = best
    bonus = picks[picks % 2 == 1] // 2
    return picks // 2, (int(bonus[0]) if len(bonus) else None), -neg_price, gross, n, net


def best_selection(
    entities: DataFrame,
    teams: DataFrame,
    budgets: DataFrame,
    group: Order = "period_id",
    prior: DataFrame | None = None,
    rules: SelectionRules = SelectionRules(),
    salts: int = 32,
) -> DataFrame:
    """The selection with the most points within budget, one row per group.

    ``entities`` has the group columns, entity_id, team_id, price and points;
    ``teams`` the same without entity_id; ``budgets`` one budget per group;
    ``prior`` asset_type and asset_id (and group columns) of the selection
    held before, against which transfers are counted. Groups without a
    feasible selection give no row.
    """
    group = as_list(group)
    kind = lambda df, k, i: df.select(
        *group,
        F.lit(k).alias("kind"),
        F.col(i).cast("long").alias("asset_id"),
        F.col("team_id").cast("long"),
        F.col("price").cast("double"),
        F.col("points").cast("double"),
    ).na.drop()
    ents, tms = kind(entities, "entity", "entity_id"), kind(teams, "team", "team_id")
    if rules.min_entities_per_chosen_team > 0:
        bare = tms.join(ents, [*group, "team_id"], "left_anti").limit(5).collect()
        if bare:
            raise ValueError(f"no entities for teams {[r['team_id'] for r in bare]}")
    rows = ents.unionByName(tms)
    if prior is None:
        rows = rows.withColumn("is_new", F.lit(0))
    else:
        on = [*(g for g in group if g in prior.columns), "kind", "asset_id"]
        held = prior.withColumnRenamed("asset_type", "kind").select(*on).distinct()
        rows = rows.join(held.withColumn("__held", F.lit(0)), on, "left")
        rows = rows.withColumn("is_new", F.coalesce("__held", F.lit(1))).drop("__held")
    rows = rows.join(budgets.select(*group, F.col("budget").cast("double")), group)
    rows = rows.filter(F.col("price") <= F.col("budget"))
    prune = _prune(rules, group)
    rows = rows.select(*group, "kind", "asset_id", "team_id", "price", "points", "is_new", "budget")
    rows = rows.mapInPandas(prune, rows.schema)
    salt = F.pmod(F.xxhash64("asset_id"), F.lit(salts))
    rows = spread(rows, [*group, salt]).mapInPandas(prune, rows.schema)
    head = [f for f in rows.schema if f.name in group]
    ids = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            *head,
            T.StructField("entity_ids", ids),
            T.StructField("team_ids", ids),
            T.StructField("bonus_entity_id", T.LongType()),
            T.StructField("budget", T.DoubleType()),
            T.StructField("total_price", T.DoubleType()),
            T.StructField("gross_points", T.DoubleType()),
            T.StructField("total_transfers", T.LongType()),
            T.StructField("paid_transfers", T.LongType()),
            T.StructField("penalty", T.DoubleType()),
            T.StructField("net_points", T.DoubleType()),
        ]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = next(prune(iter([pdf]))).sort_values(["kind", "asset_id"], ignore_index=True)
        found = _search(pdf, rules)
        if found is None:
            return pd.DataFrame(columns=schema.names)
        picks, bonus, price, gross, moves, net = found
        sel = pdf.loc[picks]
        paid = max(0, int(moves) - rules.free_transfers)
        out = {g: pdf[g].iloc[0] for g in group}
        out |= {
            "entity_ids": sorted(sel.loc[sel["kind"] == "entity", "asset_id"]),
            "team_ids": sorted(sel.loc[sel["kind"] == "team", "asset_id"]),
            "bonus_entity_id": None if bonus is None else int(pdf.loc[bonus, "asset_id"]),
            "budget": pdf["budget"].iloc[0],
            "total_price": price,
            "gross_points": gross,
            "total_transfers": int(moves),
            "paid_transfers": paid,
            "penalty": rules.transfer_penalty * paid,
            "net_points": net,
        }
        return pd.DataFrame([out], columns=schema.names)

    return spread(rows, group).groupBy(*group).applyInPandas(solve, schema)


def selection_rows(
    best: DataFrame,
    entities: DataFrame,
    teams: DataFrame,
    group: Order = "period_id",
    prior: DataFrame | None = None,
) -> DataFrame:
    """A selection as rows: slot by points, bonus flag, transfer flag."""
    group = as_list(group)
    picked = []
    for kind, ids, assets, key in (
        ("entity", "entity_ids", entities, "entity_id"),
        ("team", "team_ids", teams, "team_id"),
    ):
        rows = best.select(*group, "bonus_entity_id", F.explode(ids).alias("asset_id"))
        attrs = assets.select(*group, F.col(key).alias("asset_id"), *{"team_id", "price", "points"} - {key})
        rows = rows.join(attrs, [*group, "asset_id"]).withColumn("asset_type", F.lit(kind))
        if kind == "team":
            rows = rows.withColumn("team_id", F.col("asset_id"))
        picked.append(rows)
    rows = picked[0].unionByName(picked[1])
    if prior is None:
        rows = rows.withColumn("is_transfer_in", F.lit(False))
    else:
        on = [*(g for g in group if g in prior.columns), "asset_type", "asset_id"]
        held = prior.select(*on).distinct().withColumn("__held", F.lit(True))
        rows = rows.join(held, on, "left").withColumn("is_transfer_in", F.col("__held").isNull()).drop("__held")
    bonus = (F.col("asset_type") == "entity") & (F.col("asset_id") == F.col("bonus_entity_id"))
    rows = rows.withColumn("is_bonus", F.coalesce(bonus, F.lit(False)))
    # a selection has a handful of slots
    rows = number_rows(rows, [*group, "asset_type"], ["-points", "asset_id"], "slot_num", None)
    return rows.select(
        *group, "asset_type", "slot_num", "asset_id", "team_id", "price", "points", "is_bonus", "is_transfer_in"
    )


def config_rows(config: DataFrame, n_entities: int = 5, n_teams: int = 2) -> DataFrame:
    """Wide saved selections (``entity_1_id`` ...) as rows; empty slots give none."""
    slots = [("entity", f"entity_{i}_id") for i in range(1, n_entities + 1)]
    slots += [("team", f"team_{i}_id") for i in range(1, n_teams + 1)]
    cells = [
        F.struct(F.lit(k).alias("asset_type"), F.col(c).cast("long").alias("asset_id")) for k, c in slots
    ]
    rest = [c for c in config.columns if c not in {c for _, c in slots}]
    return config.select(*rest, F.inline(F.array(*cells))).filter("asset_id IS NOT NULL")


def prior_selection(
    config: DataFrame, period: int, team_name: str, exact: bool = False, **slots
) -> DataFrame:
    """The saved selection before ``period``; exactly one period back if ``exact``."""
    mine = config.filter(F.col("selection_name") == team_name)
    if exact:
        rows = mine.filter(F.col("period_id") == period - 1)
        n = rows.limit(2).count()
        if n != 1:
            raise ValueError("no prior selection" if n == 0 else "several prior selections")
    else:
        earlier = mine.filter(F.col("period_id") < period)
        rows = best_row(earlier, "selection_name", "-period_id")
    return config_rows(rows, **slots)


def find_existing_run(log: DataFrame, settings: dict[str, object]) -> DataFrame:
    """The first run made with the same settings, NULL when there is none."""
    same = F.lit(True)
    for col, value in settings.items():
        same = same & (F.col(col) == F.lit(value))
    return log.filter(same).agg(F.min("selection_run_id").alias("selection_run_id"))


PRICE_BANDS = ([10, 20], ["cheap", "mid", "premium"])


def spend_analysis(rows: DataFrame, group: Order = "period_id") -> DataFrame:
    """Spend and share per asset type, and entity picks per price bucket."""
    group = as_list(group)
    share = share_of_total(rows, group, "asset_type", "price")
    wide = share.groupBy(*group).agg(
        *[
            F.max(F.when(F.col("asset_type") == k, F.col(c))).alias(f"{k}_{n}")
            for k in ("entity", "team")
            for c, n in (("price", "spend"), ("pct", "pct"))
        ]
    )
    picks = rows.filter(F.col("asset_type") == "entity").withColumn(
        "bucket", bucketize(F.col("price"), *PRICE_BANDS)
    )
    counts = pivot_fill(picks, group, "bucket", F.count(F.lit(1)), PRICE_BANDS[1])
    return wide.join(counts.withColumnsRenamed({b: f"n_{b}" for b in PRICE_BANDS[1]}), group, "left")


def compare_selections(results: DataFrame, selections: DataFrame, run_id: int, strategies) -> DataFrame:
    """Assets of the chosen strategies of one simulation run side by side."""
    rows = results.filter((F.col("simulation_run_id") == run_id) & F.col("profile_strategy").isin(list(strategies)))
    return rows.join(selections, "selection_run_id", "left").orderBy(
        "profile_strategy", "asset_type", "slot_num"
    )
