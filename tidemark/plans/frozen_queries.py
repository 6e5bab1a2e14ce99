"""Frozen-period state (Z1 to Z14, J1 to J8, A1 to A7, A29, W12 are what it is made of)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.frozen import Profile, domain_paths, finished, global_prior, latest_snapshot, team_paths, with_state
from tidemark.plans.common import FACTS, RATED, ROW, ROW_SQL, rounded
from tidemark.plans.registry import register
from tidemark.sources.facts import facts, large_of, most_rows, with_rates
from tidemark.sources.facts import RATES as RATED_ENTITIES

P, B = "p_y_rate", "b_y_rate"
BUCKETS = "greatest(least(score, 3), -3) AS score_b, CASE WHEN li IS NULL THEN -1 WHEN li <= 0.5 THEN 0 WHEN li <= 1 THEN 1 WHEN li <= 2 THEN 2 WHEN li <= 4 THEN 3 ELSE 4 END AS li_b, CASE WHEN p_y_rate IS NULL THEN b_y_rate ELSE 0.7 * p_y_rate + 0.3 * b_y_rate END AS pair_base"

#: name: (key set, base, k) for each profile of a query.
SPECS: dict[str, list[tuple[tuple[str, ...], str, float]]] = {
    "z1_frozen_matchup": [(("p", "bhand"), P, 50), (("b", "phand"), B, 50), (("p", "bhand", "gt"), P, 50), (("b", "phand", "gt"), B, 50)],
    "z2_frozen_count": [(("p", "balls", "strikes"), P, 100), (("b", "balls", "strikes"), B, 100), (("p", "bhand", "balls", "strikes"), P, 100), (("b", "phand", "balls", "strikes"), B, 100)],
    "z3_frozen_pressure": [(("p", "r1", "r2", "r3", "outs"), P, 100), (("b", "r1", "r2", "r3", "outs"), B, 100), (("p", "inning"), P, 100), (("b", "inning"), B, 100)],
    "z4_frozen_context_lattice": [
        (("p", "balls", "strikes", "bhand", "gt"), P, 50),
        (("b", "balls", "strikes", "phand", "gt"), B, 50),
        (("p", "balls", "strikes", "r1", "r2", "r3"), P, 50),
        (("b", "balls", "strikes", "r1", "r2", "r3"), B, 50),
        (("p", "inning", "bhand"), P, 50),
        (("b", "inning", "phand"), B, 50),
    ],
    "z5_frozen_opponent": [(("p", "bteam"), P, 100), (("b", "pteam"), B, 100), (("p", "half"), P, 100), (("b", "half"), B, 100)],
    "z6_frozen_domain": [(("p", "gt"), P, 100), (("b", "gt"), B, 100)],
    "z7_frozen_pair": [(("p", "b"), "pair_base", 100)],
    "z8_frozen_leverage": [(("p", "score_b"), P, 100), (("b", "score_b"), B, 100), (("p", "li_b"), P, 100), (("b", "li_b"), B, 100)],
}
AUX_KEYS = [("p", "bhand"), ("p", "balls", "strikes"), ("p", "bhand", "balls", "strikes"), ("p", "r1", "r2", "r3", "outs")]


#: What is added to the key sets of the first three of AUX_KEYS by each extra.
EXTRAS = {"gt": ("gt",), "inning": ("inning",), "both": ("gt", "inning")}
BATTER_KEYS = [("b", "phand"), ("b", "balls", "strikes"), ("b", "phand", "balls", "strikes"), ("b", "r1", "r2", "r3", "outs")]


def profiles_of(name: str) -> list[Profile]:
    if name.startswith("z9_aux_"):
        more = EXTRAS[name.removeprefix("z9_aux_")]
        return [Profile(f"k{i}_{t}", (*k, *more), f"p_{t}_rate", 100, t) for i, k in enumerate(AUX_KEYS[:3]) for t in ("reverse", "middle", "ball", "strike")]
    if name == "z10_conditional_both_sides":
        return [Profile(f"k{i}", k, "prior", 100, "y", "reverse = 0 AND middle = 0") for i, k in enumerate([*AUX_KEYS, *BATTER_KEYS])]
    if name == "z9_frozen_aux":
        return [Profile(f"k{i}_{t}", k, f"p_{t}_rate", 100, t) for i, k in enumerate(AUX_KEYS) for t in ("reverse", "middle", "ball", "strike")]
    if name == "z10_frozen_conditional":
        return [Profile(f"k{i}", k, "prior", 100, "y", "reverse = 0 AND middle = 0") for i, k in enumerate(AUX_KEYS)]
    return [Profile(f"k{i}", keys, base, k) for i, (keys, base, k) in enumerate(SPECS[name])]


def profile_sql(profiles: list[Profile], source: str, ctes: str) -> str:
    sets = list(dict.fromkeys(p.keys for p in profiles))
    more, joins, columns = [], [], []
    for i, keys in enumerate(sets):
        own = [p for p in profiles if p.keys == keys]
        k = ", ".join(keys)
        each = ", ".join(f"count(CASE WHEN {p.where or 'true'} THEN 1 END) AS n_{p.name}, coalesce(sum(CASE WHEN {p.where or 'true'} THEN {p.target} END), 0) AS s_{p.name}" for p in own)
        run = ", ".join(f"sum({x}_{p.name}) OVER w AS {x}_{p.name}" for p in own for x in "ns")
        more.append(f"h{i} AS (SELECT {k}, season, {run} FROM (SELECT {k}, season, {each} FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {k} ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        joins.append(f"LEFT JOIN h{i} ON " + " AND ".join(f"r.{c} = h{i}.{c}" for c in [*keys, "season"]))
        for p in own:
            n, rate = f"nullif(h{i}.n_{p.name}, 0)", f"((h{i}.s_{p.name} + {p.k} * r.{p.base}) / (nullif(h{i}.n_{p.name}, 0) + {p.k}))"
            columns += [f"round(ln(1 + {n}), 9) + 0.0 AS {p.name}_logn", f"round({rate}, 9) + 0.0 AS {p.name}_rate", f"round({rate} - r.{p.base}, 9) + 0.0 AS {p.name}_delta"]
    return f"WITH {ctes}, {', '.join(more)} SELECT {ROW_SQL}, {', '.join(columns)} FROM {source} r {' '.join(joins)}"


BASE = f"{RATED}, src AS (SELECT *, {BUCKETS} FROM rated)"
PRIOR = f"""{FACTS}, pr AS (SELECT season, coalesce(sum(s) OVER w / sum(n) OVER w, 0.8) AS prior FROM (SELECT season, count(CASE WHEN reverse = 0 AND middle = 0 THEN 1 END)::double AS n,
  coalesce(sum(CASE WHEN reverse = 0 AND middle = 0 THEN y END), 0)::double AS s FROM facts GROUP BY season) WINDOW w AS (ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src AS (SELECT f.*, pr.prior FROM facts f JOIN pr ON f.season = pr.season)"""


#: Columns of BUCKETS, and what each is made of.
_BUCKETS = dict(zip(("score_b", "li_b", "pair_base"), (e.rsplit(" AS ", 1)[0] for e in BUCKETS.replace("_b, ", "_b\n").split("\n"))))


def _add(name: str) -> None:
    own = profiles_of(name)
    columns = [f"{p.name}_{x}" for p in own for x in ("logn", "rate", "delta")]
    sql = profile_sql(own, "src", PRIOR if name.startswith("z10") else BASE)
    rates = [] if name.startswith("z10") else [e for e in RATED_ENTITIES if any(p.keys[0] == e or p.base == "pair_base" for p in own)]

    @register(name, sql)
    def query(spark, sf_dir: str) -> DataFrame:
        df = facts(spark, sf_dir)
        sides = dict.fromkeys(p.keys[0] for p in own)
        large = large_of(df, most=most_rows(spark, sf_dir), entities=dict.fromkeys([*rates, *sides]))
        if name.startswith("z10"):
            df = global_prior(df, where="reverse = 0 AND middle = 0")
        needed = dict.fromkeys([*ROW, *(c for p in own for c in (*p.keys, p.base, p.target)), "reverse", "middle"])
        for c in ("score_b", "li_b"):
            df = df.withColumn(c, F.expr(_BUCKETS[c]))
        # An entity's rates and its state one after the other: its rows are dealt once for both.
        for e in dict.fromkeys([*rates, *sides]):
            if e in rates:
                df = with_rates(df, large={e: large[e]})
            if e in sides:
                df = with_state(df, own, e, large=large[e])
        if "pair_base" in needed:
            df = df.withColumn("pair_base", F.expr(_BUCKETS["pair_base"]))
        return rounded(finished(df, own, [c for c in needed if c in df.columns]), *columns)


for _name in [*SPECS, "z9_frozen_aux", *[f"z9_aux_{x}" for x in EXTRAS], "z10_frozen_conditional", "z10_conditional_both_sides"]:
    _add(_name)

RATES = ["y", "reverse", "middle", "ball", "strike"]


def anchored(df: DataFrame, entity: str, rates: list[str], tolerance: float | None, large=None) -> DataFrame:
    """The entity's frozen anchor: its latest (n, rates) of earlier periods, the gap since, and the rate since."""
    n, at = f"{entity}_n", f"{entity}anchor"
    out = latest_snapshot(df, entity, n, [f"{entity}_{x}_rate" for x in rates], [c for c in ROW if c != "season"], prefix=at, large=large)
    then = F.col(f"{at}_{n}")
    gap = F.when(F.col(n) > then, F.col(n) - then)
    new = {f"{at}_available": then.isNotNull().cast("int"), f"{at}_gap_n": gap}
    for x in rates:
        rate, old = F.col(f"{entity}_{x}_rate"), F.col(f"{at}_{entity}_{x}_rate")
        a, b = F.col(n) * rate, then * old
        change = F.rint(a) - F.rint(b)
        good = (change >= 0) & (change <= gap)
        if tolerance is not None:
            good = good & (F.abs(a - F.rint(a)) <= tolerance) & (F.abs(b - F.rint(b)) <= tolerance)
        since = F.when(good, change / gap)
        new |= {f"{at}_{x}": old, f"{at}_{x}_since": since, f"{at}_{x}_since_long": since - rate, f"{at}_{x}_since_anchor": since - old}
    return out.select("*", *[c.alias(k) for k, c in new.items()])


def anchored_facts(spark, sf_dir: str, anchors: dict[str, tuple[list[str], float | None]]) -> DataFrame:
    """facts with the rates and the anchor (labels, tolerance) of each entity, its rows dealt once for both."""
    df = facts(spark, sf_dir)
    large = large_of(df, most=most_rows(spark, sf_dir), entities=anchors)
    for e, (rates, tolerance) in anchors.items():
        df = anchored(with_rates(df, large={e: large[e]}), e, rates, tolerance, large[e])
    return df


def anchor_sql(entity: str, rates: list[str], tolerance: float | None) -> str:
    n, at = f"{entity}_n", f"{entity}anchor"
    keys = [c for c in ROW if c != "season"]
    fields = ", ".join([f"n := {n}", "s := season", *[f"o{i} := {c}" for i, c in enumerate(keys)], *[f"{x} := {entity}_{x}_rate" for x in rates]])
    ctes = f"""{RATED}, snap AS (SELECT {entity}, season, max(struct_pack({fields})) AS s FROM rated WHERE {n} IS NOT NULL GROUP BY 1, 2),
anc AS (SELECT {entity}, season, max(s) OVER (PARTITION BY {entity} ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM snap),
r AS (SELECT x.*, anc.a, CASE WHEN x.{n} > anc.a.n THEN x.{n} - anc.a.n END AS gap FROM rated x LEFT JOIN anc ON x.{entity} = anc.{entity} AND x.season = anc.season)"""
    cols = [f"(a IS NOT NULL)::int AS {at}_available", f"gap AS {at}_gap_n"]
    for x in rates:
        a, b, rate = f"({n} * {entity}_{x}_rate)", f"(a.n * a.{x})", f"{entity}_{x}_rate"
        change = f"(round_even({a}, 0) - round_even({b}, 0))"
        tol = f" AND abs({a} - round_even({a}, 0)) <= {tolerance} AND abs({b} - round_even({b}, 0)) <= {tolerance}" if tolerance is not None else ""
        since = f"CASE WHEN {change} >= 0 AND {change} <= gap{tol} THEN {change} / gap END"
        cols += [f"round(a.{x}, 9) + 0.0 AS {at}_{x}", f"round({since}, 9) + 0.0 AS {at}_{x}_since", f"round(({since}) - {rate}, 9) + 0.0 AS {at}_{x}_since_long", f"round(({since}) - a.{x}, 9) + 0.0 AS {at}_{x}_since_anchor"]
    return f"WITH {ctes} SELECT {ROW_SQL}, {', '.join(cols)} FROM r"


def _anchor_columns(entity: str, rates: list[str]) -> list[str]:
    at = f"{entity}anchor"
    return [f"{at}_available", f"{at}_gap_n", *[f"{at}_{x}{y}" for x in rates for y in ("", "_since", "_since_long", "_since_anchor")]]


@register("z11_frozen_anchor", anchor_sql("p", RATES, 0.05))
def z11(spark, sf_dir: str) -> DataFrame:
    return rounded(anchored_facts(spark, sf_dir, {"p": (RATES, 0.05)}), *_anchor_columns("p", RATES))


@register("z12_batter_anchor", anchor_sql("b", ["y", "middle"], None))
def z12(spark, sf_dir: str) -> DataFrame:
    return rounded(anchored_facts(spark, sf_dir, {"b": (["y", "middle"], None)}), *_anchor_columns("b", ["y", "middle"]))


def _path_sql(e: str) -> str:
    w = f"OVER (PARTITION BY {e} ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {FACTS}, c AS (SELECT {e}, season, count(*) FILTER (gt = 'R') AS nr, count(*) FILTER (gt = 'F') AS nf, sum(y) FILTER (gt = 'R') AS sr, sum(y) FILTER (gt = 'F') AS sf FROM facts GROUP BY 1, 2),
h AS (SELECT {e}, season, sum(nr) {w} AS nr, sum(nf) {w} AS nf, sum(sr) {w} AS sr, sum(sf) {w} AS sf, count(*) {w} AS periods, last_value(CASE WHEN nr >= nf THEN 'R' ELSE 'F' END) {w} AS last,
  last_value(sr::double / nullif(nr, 0) IGNORE NULLS) {w} AS lr, last_value(sf::double / nullif(nf, 0) IGNORE NULLS) {w} AS lf FROM c)
SELECT {ROW_SQL}, round(ln(1 + coalesce(nr, 0)), 9) + 0.0 AS {e}_log_R, round(ln(1 + coalesce(nf, 0)), 9) + 0.0 AS {e}_log_F, round(coalesce(coalesce(nf, 0)::double / nullif(coalesce(nr, 0) + coalesce(nf, 0), 0), 0), 9) + 0.0 AS {e}_share_F,
  coalesce(last, 'NEW') AS {e}_last, CASE WHEN r.season = (SELECT min(season) FROM facts) THEN 'NEW' ELSE r.gt || '<-' || coalesce(last, 'NEW') END AS {e}_current_x_last,
  (coalesce(nr, 0) > 0 AND coalesce(nf, 0) > 0)::int AS {e}_both, periods AS {e}_periods, round(sr::double / nullif(nr, 0), 9) + 0.0 AS {e}_rate_R, round(sf::double / nullif(nf, 0), 9) + 0.0 AS {e}_rate_F,
  round(lr, 9) + 0.0 AS {e}_lastrate_R, round(lf, 9) + 0.0 AS {e}_lastrate_F
FROM facts r LEFT JOIN h ON r.{e} = h.{e} AND r.season = h.season"""


def _team_sql(e: str, t: str) -> str:
    w = f"OVER (PARTITION BY {e} ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""WITH {FACTS}, c AS (SELECT {e}, season, {t}, count(*) AS n FROM facts GROUP BY ALL),
top AS (SELECT {e}, season, {t} AS top FROM c QUALIFY row_number() OVER (PARTITION BY {e}, season ORDER BY n DESC, {t}) = 1),
seen AS (SELECT {e}, season, count(*) AS new FROM (SELECT {e}, {t}, min(season) AS season FROM c GROUP BY 1, 2) GROUP BY 1, 2),
h AS (SELECT top.{e}, top.season, last_value(top) {w.replace(f'PARTITION BY {e} ORDER BY season', f'PARTITION BY top.{e} ORDER BY top.season')} AS last, coalesce(sum(new) {w.replace(f'PARTITION BY {e} ORDER BY season', f'PARTITION BY top.{e} ORDER BY top.season')}, 0) AS teams
  FROM top LEFT JOIN seen ON top.{e} = seen.{e} AND top.season = seen.season)
SELECT {ROW_SQL}, coalesce(last::varchar, 'NEW') AS {e}_last_team, r.{t}::varchar || '<-' || coalesce(last::varchar, 'NEW') AS {e}_team_cross, coalesce((r.{t} <> last)::int, 0) AS {e}_switched, coalesce(teams, 0)::bigint AS {e}_teams
FROM facts r LEFT JOIN h ON r.{e} = h.{e} AND r.season = h.season"""


@register("z13_domain_paths", _path_sql("p"))
def z13(spark, sf_dir: str) -> DataFrame:
    out = domain_paths(facts(spark, sf_dir), "p")
    return rounded(out, *[c for c in out.columns if c.startswith("p_")])


@register("z14_team_paths", _team_sql("b", "pteam"))
def z14(spark, sf_dir: str) -> DataFrame:
    return rounded(team_paths(facts(spark, sf_dir), "b", "pteam"), "b_last_team", "b_team_cross", "b_switched", "b_teams")


@register("a4_global_running_prior", f"WITH {PRIOR} SELECT season, round(prior, 9) + 0.0 AS prior FROM pr")
def a4(spark, sf_dir: str) -> DataFrame:
    out = global_prior(facts(spark, sf_dir), where="reverse = 0 AND middle = 0").select("season", "prior").distinct()
    return rounded(out, "season", "prior", keys=[])
