"""SQL for the registered queries, over the same fact text."""

from __future__ import annotations

from .views import FACTS

_PAIRS = """
prs as (
  select * from (values ('jgl_mid', 'JUNGLE', 'MIDDLE'), ('jgl_sup', 'JUNGLE', 'UTILITY'), ('mid_sup', 'MIDDLE', 'UTILITY'),
    ('top_jgl', 'TOP', 'JUNGLE'), ('top_mid', 'TOP', 'MIDDLE'), ('top_bot', 'TOP', 'BOTTOM'), ('top_sup', 'TOP', 'UTILITY'),
    ('jgl_bot', 'JUNGLE', 'BOTTOM'), ('mid_bot', 'MIDDLE', 'BOTTOM'), ('bot_sup', 'BOTTOM', 'UTILITY')) v(roles, slot_a, slot_b)),
tg as (
  select a.event_id, a.side, sum(a.gold_15 - b.gold_15)::bigint as team_gold_diff_15
  from p a join p b on a.event_id = b.event_id and a.slot = b.slot and a.side <> b.side
  where a.gold_15 is not null and b.gold_15 is not null group by all having count(*) = 5)
"""

_WINDOW = """
win as (
  select period, depth, case depth when 1 then 1.0e0 when 2 then 0.6e0 else 0.35e0 end as w
  from (select period, row_number() over (order by split_part(period, '.', 1)::int desc, split_part(period, '.', 2)::int desc) as depth
    from (select distinct period from m)) where depth <= 3),
ind as (
  select period, segment, slot, entity, count(*)::bigint as games, count(*) filter (where win)::bigint as wins from p group by all),
inda as (
  select * from ind union all
  select period, 'all', slot, entity, sum(games)::bigint, sum(wins)::bigint from ind group by period, slot, entity)
"""

_SCORES = """
duo as (
  select x.period, x.segment, prs.roles, x.entity as a, y.entity as b, count(*)::bigint as games, count(*) filter (where x.win)::bigint as wins,
    sum(case when x.duration_s >= 900 then lead_15 end) as gold15_sum, count(case when x.duration_s >= 900 then 1 end) as gold15_n
  from prs join p x on x.slot = prs.slot_a join p y on y.event_id = x.event_id and y.side = x.side and y.slot = prs.slot_b
  join faced on faced.event_id = x.event_id and faced.side = x.side and faced.roles = prs.roles where whole
  group by all),
duoa as (
  select * from duo union all
  select period, 'all', roles, a, b, sum(games)::bigint, sum(wins)::bigint, sum(gold15_sum), sum(gold15_n)::bigint from duo group by period, roles, a, b),
base as (
  select segment, slot, entity, sum(w * wins) / sum(w * games) as rate, sum(w * games) as n from inda join win using (period) group by all),
dr as (
  select segment, roles, a, b, sum(games)::bigint as games, sum(w * games) as games_eff, sum(w * wins) / sum(w * games) as rate,
    sum(w * gold15_sum) / nullif(sum(w * gold15_n), 0) as gold_diff_15
  from duoa join win using (period) group by all),
db as (
  select dr.*, x.rate as p1, x.n as n1, y.rate as p2, y.n as n2 from dr join prs using (roles)
  join base x on x.segment = dr.segment and x.slot = prs.slot_a and x.entity = dr.a
  join base y on y.segment = dr.segment and y.slot = prs.slot_b and y.entity = dr.b),
dk as (
  select *, rate - (p1 + p2) / 2 as synergy, (p1 + p2) / 2 as bl, sqrt((p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) / 4) as se,
    (rate + zz / (2 * games_eff)) / (1 + zz / games_eff) as wc, 1.959963984540054e0 / (1 + zz / games_eff) * sqrt(rate * (1 - rate) / games_eff + zz / (4 * games_eff * games_eff)) as wm
  from (select *, 1.959963984540054e0 * 1.959963984540054e0 as zz from db)),
ds as (
  select *, greatest(0, wc - wm) as ci_low, least(1, wc + wm) as ci_high,
    greatest(0, bl - 1.959963984540054e0 * se) as l2, least(1, bl + 1.959963984540054e0 * se) as u2,
    case when round(games_eff, 9) < 50 then 'faible' when round(games_eff, 9) < 400 then 'moyen' else 'eleve' end as tier from dk)
"""

_TRIO = """
trio as (
  select period, segment, jgl, mid, sup, count(*)::bigint as games, count(*) filter (where win)::bigint as wins from t group by all),
trioa as (
  select * from trio union all select period, 'all', jgl, mid, sup, sum(games)::bigint, sum(wins)::bigint from trio group by period, jgl, mid, sup),
tr as (
  select segment, jgl, mid, sup, sum(games)::bigint as games, sum(w * games) as games_eff, sum(w * wins) / sum(w * games) as rate from trioa join win using (period) group by all),
tp as (
  select tr.*, x.rate as p1, x.n as n1, y.rate as p2, y.n as n2, z.rate as p3, z.n as n3,
    (select coalesce(avg(d.games_eff * d.synergy / (d.games_eff + 200)), 0) from ds d where d.segment = tr.segment and
      ((d.roles = 'jgl_mid' and d.a = tr.jgl and d.b = tr.mid) or (d.roles = 'jgl_sup' and d.a = tr.jgl and d.b = tr.sup) or (d.roles = 'mid_sup' and d.a = tr.mid and d.b = tr.sup))) as prior
  from tr join base x on x.segment = tr.segment and x.slot = 'JUNGLE' and x.entity = tr.jgl
  join base y on y.segment = tr.segment and y.slot = 'MIDDLE' and y.entity = tr.mid join base z on z.segment = tr.segment and z.slot = 'UTILITY' and z.entity = tr.sup),
tk as (
  select *, rate - (p1 + p2 + p3) / 3 as raw, (p1 + p2 + p3) / 3 as bl, sqrt((p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2 + p3 * (1 - p3) / n3) / 9) as se,
    (rate + zz / (2 * games_eff)) / (1 + zz / games_eff) as wc, 1.959963984540054e0 / (1 + zz / games_eff) * sqrt(rate * (1 - rate) / games_eff + zz / (4 * games_eff * games_eff)) as wm
  from (select *, 1.959963984540054e0 * 1.959963984540054e0 as zz from tp)),
ts as (
  select *, (games_eff * raw + 200 * prior) / (games_eff + 200) as synergy, greatest(0, wc - wm) as ci_low, least(1, wc + wm) as ci_high,
    greatest(0, bl - 1.959963984540054e0 * se) as l2, least(1, bl + 1.959963984540054e0 * se) as u2,
    case when round(games_eff, 9) < 50 then 'faible' when round(games_eff, 9) < 400 then 'moyen' else 'eleve' end as tier from tk)
"""

_MATCHUPS = """
mu as (
  select x.period, x.segment, x.slot, x.entity as a, y.entity as b, count(*)::bigint as games, count(*) filter (where x.win)::bigint as wins
  from p x join p y on y.event_id = x.event_id and y.slot = x.slot and y.side <> x.side group by all),
mua as (
  select * from mu union all select period, 'all', slot, a, b, sum(games)::bigint, sum(wins)::bigint from mu group by period, slot, a, b),
mr as (
  select segment, slot, a, b, sum(games)::bigint as games, sum(w * games) as games_eff, sum(w * wins) / sum(w * games) as rate from mua join win using (period) group by all),
mb as (
  select mr.*, base2.rate as bl, 1.959963984540054e0 * 1.959963984540054e0 as zz
  from mr join (select segment, slot, entity, sum(w * wins) / sum(w * games) as rate from inda join win using (period) group by all) base2
    on base2.segment = mr.segment and base2.slot = mr.slot and base2.entity = mr.a),
ms as (
  select segment, slot, a, b, games, games_eff, rate, rate - bl as delta_raw, games_eff * (rate - bl) / (games_eff + 200) as delta,
    greatest(0, (rate + zz / (2 * games_eff)) / (1 + zz / games_eff) - 1.959963984540054e0 / (1 + zz / games_eff) * sqrt(rate * (1 - rate) / games_eff + zz / (4 * games_eff * games_eff))) as ci_low,
    least(1, (rate + zz / (2 * games_eff)) / (1 + zz / games_eff) + 1.959963984540054e0 / (1 + zz / games_eff) * sqrt(rate * (1 - rate) / games_eff + zz / (4 * games_eff * games_eff))) as ci_high,
    case when round(games_eff, 9) < 50 then 'faible' when round(games_eff, 9) < 400 then 'moyen' else 'eleve' end as tier from mb)
"""

_TRIO_COUNTS = """
own as (
  select segment, jgl, mid, sup, sum(w * win::int) / sum(w) as base from (
    select segment, period, jgl, mid, sup, win from t union all select 'all', period, jgl, mid, sup, win from t) join win using (period) group by all)
"""

#: {match} says which picks of an event count for a side.
_VERSUS = """
seen as (
  select t.segment, t.period, t.jgl, t.mid, t.sup, o.slot, o.entity as other, t.win from t join p o on o.event_id = t.event_id and {match}),
vr as (
  select segment, jgl, mid, sup, slot, other, count(*)::bigint as games, sum(w) as games_eff, sum(w * win::int) / sum(w) as rate from (
    select * from seen union all select 'all', period, jgl, mid, sup, slot, other, win from seen) join win using (period) group by all),
vs as (
  select vr.*, rate - base as effect_raw, games_eff * (rate - base) / (games_eff + 200) as effect,
    greatest(0, (rate + z * z / (2 * games_eff)) / (1 + z * z / games_eff) - z / (1 + z * z / games_eff) * sqrt(rate * (1 - rate) / games_eff + z * z / (4 * games_eff * games_eff))) as ci_low,
    least(1, (rate + z * z / (2 * games_eff)) / (1 + z * z / games_eff) + z / (1 + z * z / games_eff) * sqrt(rate * (1 - rate) / games_eff + z * z / (4 * games_eff * games_eff))) as ci_high,
    case when round(games_eff, 9) < 50 then 'faible' when round(games_eff, 9) < 400 then 'moyen' else 'eleve' end as tier
  from vr join own using (segment, jgl, mid, sup), (select 1.959963984540054e0 as z))
"""

#: Both sides of each event in one row, by conditional sums: side 0's lead, and lists by
#: side. Only events with a checkpoint value in all ten slots.
_BOTH_SIDES = """
ev as (
  select event_id, sum(case side when 0 then gold_15 else -gold_15 end)::bigint as lead,
    [sum(cc_time_s) filter (where side = 0), sum(cc_time_s) filter (where side = 1)] as ccs,
    [sum(vision_score) filter (where side = 0), sum(vision_score) filter (where side = 1)] as visions,
    [coalesce(bool_or(first_blood) filter (where side = 0), false), coalesce(bool_or(first_blood) filter (where side = 1), false)] as bloods
  from p group by event_id having count(gold_15) filter (where side = 0) = 5 and count(gold_15) filter (where side = 1) = 5)
"""

_FACTOR = (
    _BOTH_SIDES
    + """,
fr as (
  select event_id, t.side, t.period, win.w as weight, t.win::int::double as y, (case t.side when 0 then lead else -lead end)::double as team_gold_diff_15,
    ccs[t.side + 1] / (t.duration_s / 60.0e0) as team_cc_per_min, visions[t.side + 1] / (t.duration_s / 60.0e0) as team_vision_per_min, t.jgl_cs_diff_15::double as jgl_cs_diff_15
  from t join ev using (event_id) join win on win.period = t.period where t.jgl_cs_diff_15 is not null)
"""
)


def _facts(select: str, *parts: str) -> str:
    recursive = "recursive " if any("newton as" in p or "seidel as" in p for p in parts) else ""
    return f"with {recursive}{','.join([FACTS, *parts])} {select}"


_F = "(count(*) filter (where {0}))::bigint"


def _additive(name: str, value: str, counted: str | None = None, kind: str = "") -> str:
    """A stat as its (sum, n) pair."""
    return f"sum({value}){kind} as {name}_sum, count({counted or value})::bigint as {name}_n"


def _rate(value: str) -> str:
    return f"({value}) / (duration_s / 60.0e0)"


#: Stats of a whole side: flags count the times they are set.
_SIDE_STATS = ", ".join(
    [
        _additive("team_gold15", "team_gold_diff_15", kind="::bigint"),
        _additive("drakes", _rate("drakes_taken"), "drakes_taken"),
        *(_additive(name, f"{flag}::int", flag, "::bigint") for name, flag in {"herald": "herald_taken", "soul": "soul_taken", "tower1": "first_tower"}.items()),
    ]
)

#: The members of each slot pair of a side as one row, their totals known only where both
#: members' values are; then that row beside the one that faces it.
_FACED = """
halves as (
  select event_id, side, roles, count(*) as members,
    max(case when slot = slot_a then entity end) as first_entity, max(case when slot = slot_b then entity end) as second_entity,
    max(case when slot = slot_a then cc_time_s end) as first_cc, max(case when slot = slot_b then cc_time_s end) as second_cc,
    case when count(cc_time_s) = 2 then sum(cc_time_s) end as both_cc, case when count(vision_score) = 2 then sum(vision_score) end as both_vision,
    case when count(gold_5) = 2 then sum(gold_5) end as both_5, case when count(gold_10) = 2 then sum(gold_10) end as both_10, case when count(gold_15) = 2 then sum(gold_15) end as both_15
  from {roles} join prs on slot in (slot_a, slot_b) group by all),
faced as (
  select own.*, own.members = 2 and foe.members = 2 as whole, own.both_5 - foe.both_5 as lead_5, own.both_10 - foe.both_10 as lead_10, own.both_15 - foe.both_15 as lead_15
  from halves own left join halves foe on foe.event_id = own.event_id and foe.roles = own.roles and foe.side <> own.side)
"""


def _pairs_inside(roles: str) -> str:
    """Pairs among the three core members: the pair's own values, else the side's."""
    core = lambda slot, suffix: f"map(['JUNGLE', 'MIDDLE', 'UTILITY'], [jgl{suffix}, mid{suffix}, sup{suffix}])[{slot}]"
    stats = [
        *(_additive(f"gold{m}", f"coalesce(lead_{m}, gold_diff_{m})", kind="::bigint") for m in (5, 10, 15)),
        *(_additive(name, _rate(f"coalesce(both_{name}, {column})"), column) for name, column in {"cc": "cc_time_s", "vision": "vision_score"}.items()),
        *(_additive(f"{x}_cc", _rate(core(f"slot_{x}", "_cc_time_s")), core(f"slot_{x}", "_cc_time_s")) for x in "ab"),
    ]
    return f"""select period, segment, roles, {core("slot_a", "")} as a, {core("slot_b", "")} as b, count(*)::bigint as games, {_F.format("win")} as wins, {", ".join(stats)}, {_SIDE_STATS}
    from t join prs on roles in ({roles}) left join faced using (event_id, side, roles) left join tg using (event_id, side) group by 1, 2, 3, 4, 5"""


def _pairs_across(roles: str) -> str:
    """The other pairs: their own values alone, where both sides field both slots."""
    stats = [
        *(_additive(f"gold{m}", f"lead_{m}", kind="::bigint") for m in (5, 10, 15)),
        *(_additive(name, _rate(f"both_{name}"), "*") for name in ("cc", "vision")),
        *(_additive(f"{x}_cc", _rate(f"{nth}_cc")) for x, nth in (("a", "first"), ("b", "second"))),
    ]
    return f"""select period, segment, roles, first_entity as a, second_entity as b, count(*)::bigint as games, {_F.format("win")} as wins, {", ".join(stats)}, {_SIDE_STATS}
    from t join faced using (event_id, side) left join tg using (event_id, side) where whole and roles in ({roles}) group by 1, 2, 3, 4, 5"""


def _round(sql: str, columns: list[str], digits: int) -> str:
    fixed = ", ".join(f"round({c}, {digits}) + 0.0e0 as {c}" for c in columns)
    return f"select * replace ({fixed}) from ({sql})"


_INNER = "'jgl_mid', 'jgl_sup', 'mid_sup'"
_EXT = "'top_jgl', 'top_mid', 'top_bot', 'top_sup', 'jgl_bot', 'mid_bot', 'bot_sup'"
_SUMS = ["vision_sum", "cc_sum", "a_cc_sum", "b_cc_sum", "drakes_sum"]
_TRIO_AGG = f"""select period, segment, jgl, mid, sup, count(*)::bigint as games, {_F.format("win")} as wins,
  {", ".join(f"sum(gold_diff_{m})::bigint as gold{m}_sum, count(gold_diff_{m})::bigint as gold{m}_n" for m in (5, 10, 15))},
  {", ".join(f"sum({c} / (duration_s / 60.0e0)) as {s}_sum, count({c})::bigint as {s}_n" for c, s in (("vision_score", "vision"), ("cc_time_s", "cc"), ("jgl_cc_time_s", "jgl_cc"), ("mid_cc_time_s", "mid_cc"), ("sup_cc_time_s", "sup_cc")))},
  {_SIDE_STATS} from t left join tg using (event_id, side) group by all"""

_BUCKET = "least(40, 5 * (duration_s // 300))::bigint"
_STATS = {
    "gold_diff_5": "gold5", "gold_diff_10": "gold10", "gold_diff_15": "gold15", "team_gold_diff_15": "team_gold15", "vision_score": "vision",
    "drakes": "drakes", "soul_rate": "soul", "herald_rate": "herald", "first_tower_rate": "tower1", "cc_time_s": "cc",
}

_DUO_STATS = {**_STATS, "a_cc_time_s": "a_cc", "b_cc_time_s": "b_cc"}

_CI = "rate - bl - sqrt((rate - ci_low) * (rate - ci_low) + (u2 - bl) * (u2 - bl)) as synergy_ci_low, rate - bl + sqrt((ci_high - rate) * (ci_high - rate) + (bl - l2) * (bl - l2)) as synergy_ci_high"
_LABEL = "(select string_agg(period, '+' order by depth) from win) as label"
_DUO_SCORES = f"select {_LABEL}, segment, roles, a, b, games, games_eff, rate, ci_low, ci_high, synergy, {_CI}, tier from ds"
_TRIO_SCORES = f"select {_LABEL}, segment, jgl, mid, sup, games, games_eff, rate, ci_low, ci_high, synergy, {_CI}, tier, prior from ts"
_SCORE_DOUBLES = ["games_eff", "rate", "ci_low", "ci_high", "synergy", "synergy_ci_low", "synergy_ci_high"]
_ALL = (_PAIRS, _WINDOW, _FACED.format(roles="p"), _SCORES)

#: Heads-to-heads against the opponents that are expected, entity 1 in the middle and 2 on
#: top, z-scored among the candidates of a slot.
_SCOUTED = """
sc as (
  select segment, slot, a as partner, (delta - avg(delta) over g) / (case when stddev_pop(delta) over g = 0 then 1 else stddev_pop(delta) over g end) as z, count(*) over g as n
  from ms where (slot, b) in (('MIDDLE', 1), ('TOP', 2)) window g as (partition by segment, slot, b)),
scz as (select segment, slot, partner, z from sc where n >= 2)
"""


def _lineups(profiles: dict[str, dict[str, float]], counter: float = 0.0) -> str:
    """Greedy completion unrolled: the eight best pairs of each segment and profile, then
    three rounds, each adding the best candidate that pairs with every placed member."""
    axes = sorted({a for w in profiles.values() for a in w})
    score = lambda of: "case archetype " + " ".join(f"when '{k}' then " + " + ".join(f"{x}e0 * ({of(a)} - m_{a}) / s_{a}" for a, x in w.items()) for k, w in profiles.items()) + " end"
    out = [
        "prof as (select * from (values " + ", ".join(f"('{k}')" for k in profiles) + ") v(archetype))",
        "good as (select * from ds where games >= 20)",
        "mom as (select segment, " + ", ".join(f"avg({a}) as m_{a}, case when stddev_pop({a}) = 0 then 1 else stddev_pop({a}) end as s_{a}" for a in axes) + " from good group by segment)",
        f"ranked as (select segment, archetype, roles, a, b, synergy, {score(lambda a: a)} as seed_score from good join mom using (segment), prof)",
        """first8 as (select *, roles || ':' || a || ':' || b as seed from ranked where seed_score is not null
          qualify row_number() over (partition by segment, archetype order by seed_score desc, roles, a, b) <= 8)""",
        """st0 as (select segment, archetype, seed, slot_a as slot, a as entity, synergy as total from first8 join prs using (roles)
          union all select segment, archetype, seed, slot_b, b, synergy from first8 join prs using (roles))""",
        f"seen as (select segment, slot_a as anchor_slot, a as anchor, slot_b as slot, b as partner, synergy{''.join(f', {a} as v_{a}' for a in axes)} from good join prs using (roles)"
        f" union all select segment, slot_b, b, slot_a, a, synergy{''.join(f', {a}' for a in axes)} from good join prs using (roles))",
    ]
    order = "list_position(['TOP', 'JUNGLE', 'MIDDLE', 'BOTTOM', 'UTILITY'], slot)"
    for r in range(3):
        axis = f" + {counter}e0 * coalesce(z, 0)" if counter else ""
        scouted = "left join scz using (segment, slot, partner)" if counter else ""
        out += [
            f"""cd{r} as (
          select st.segment, archetype, seed, seen.slot, partner, sum(synergy) as s, {", ".join(f"avg(v_{a}) as v_{a}" for a in axes)}
          from st{r} st join seen on seen.segment = st.segment and anchor_slot = st.slot and anchor = st.entity
          where not exists (select 1 from st{r} o where o.segment = st.segment and o.archetype = st.archetype and o.seed = st.seed and o.slot = seen.slot)
          group by all having count(*) = {r + 2})""",
            f"""bs{r} as (
          select * from (select *, {score(lambda a: f"v_{a}")}{axis} as score from cd{r} join mom using (segment) {scouted})
          where score is not null qualify row_number() over (partition by segment, archetype, seed order by score desc, {order}, partner) = 1)""",
            f"""st{r + 1} as (
          select segment, archetype, seed, st.slot, entity, total + s as total from st{r} st join bs{r} using (segment, archetype, seed)
          union all select distinct segment, archetype, seed, bs.slot, partner, total + s from bs{r} bs join st{r} using (segment, archetype, seed))""",
        ]
    return ",\n        ".join(out)


#: A logistic fit by cyclic coordinate Newton steps: another way to the same maximum than
#: the library's. 160 steps are 32 rounds over five coefficients.
_LOGISTIC = """
pop as (select 'all' as population, * from fr union all select 'behind_gold15', * from fr where team_gold_diff_15 < 0),
mm as (
  select population, count(*)::bigint as n, avg(team_gold_diff_15) as m1, stddev_pop(team_gold_diff_15) as s1, avg(team_cc_per_min) as m2, stddev_pop(team_cc_per_min) as s2,
    avg(team_vision_per_min) as m3, stddev_pop(team_vision_per_min) as s3, avg(jgl_cs_diff_15) as m4, stddev_pop(jgl_cs_diff_15) as s4
  from pop group by population),
zz as (
  select population, weight as w, y, [1.0e0, (team_gold_diff_15 - m1) / s1, (team_cc_per_min - m2) / s2, (team_vision_per_min - m3) / s3, (jgl_cs_diff_15 - m4) / s4] as x
  from pop join mm using (population)),
newton as (
  select 0 as k, population, [0.0e0, 0.0e0, 0.0e0, 0.0e0, 0.0e0] as b from mm
  union all
  select k + 1, population, [case when i = j then b[i] + step else b[i] end for i in range(1, 6)] as b
  from (
    select k, population, b, j, sum(w * (y - p) * x[j]) / sum(w * p * (1 - p) * x[j] * x[j]) as step
    from (
      select newton.k, newton.population, newton.b, newton.k % 5 + 1 as j, x, w, y, 1 / (1 + exp(-list_dot_product(newton.b, x))) as p
      from newton join zz on zz.population = newton.population where newton.k < 160)
    group by k, population, b, j)),
fitted as (
  select population, unnest(['intercept', 'team_gold_diff_15', 'team_cc_per_min', 'team_vision_per_min', 'jgl_cs_diff_15']) as feature, unnest(b) as coef from newton where k = 160)
"""

#: Rows of the model of early leads, and least squares by Gauss-Seidel steps on the normal
#: equations of both blocks.
_LEADS = """
lone as (select period, slot, entity, sum(wins) / sum(games) as rate from ind group by all),
team as (
  select x.event_id, x.side, x.period, win.w, sum(x.gold_15 - y.gold_15)::double as y, avg(lone.rate) as f1, coalesce(avg(ms.delta), 0) as f2
  from p x join win on win.period = x.period join p y on y.event_id = x.event_id and y.slot = x.slot and y.side <> x.side
    left join lone on lone.period = x.period and lone.slot = x.slot and lone.entity = x.entity
    left join ms on ms.segment = 'all' and ms.slot = x.slot and ms.a = x.entity and ms.b = y.entity
  where x.gold_15 is not null and y.gold_15 is not null group by all having count(*) = 5 and avg(lone.rate) is not null),
blood as (select event_id, side, coalesce(bool_or(first_blood), false)::int::double as f5 from p group by all),
ld as (
  select team.w, team.y, f1, f2, coalesce(ts.synergy, 0) as f3, t.jgl_cs_diff_15::double as f4, f5, t.herald_taken_pre15::int::double as f6, t.dragons_taken_pre15::double as f7, t.wards_pre15::double as f8
  from team join t on t.event_id = team.event_id and t.side = team.side join blood on blood.event_id = team.event_id and blood.side = team.side
    left join ts on ts.segment = 'all' and ts.jgl = t.jgl and ts.mid = t.mid and ts.sup = t.sup
  where t.jgl_cs_diff_15 is not null and t.herald_taken_pre15 is not null),
lz as (
  select w, y, [1.0e0, (f1 - avg(f1) over ()) / stddev_pop(f1) over (), (f2 - avg(f2) over ()) / stddev_pop(f2) over (), (f3 - avg(f3) over ()) / stddev_pop(f3) over (),
    (f4 - avg(f4) over ()) / stddev_pop(f4) over (), f5, f6, (f7 - avg(f7) over ()) / stddev_pop(f7) over (), (f8 - avg(f8) over ()) / stddev_pop(f8) over ()] as x from ld),
ix as (select unnest(range(1, 10)) as i),
gm as (select a.i, b.i as j, sum(w * x[a.i] * x[b.i]) as v from lz, ix a, ix b group by all),
gy as (select i, sum(w * x[i] * y) as c from lz, ix group by all),
ga as (select g.i, any_value(c) as c, list(v order by j) as row from gm g join gy using (i) group by g.i),
seidel as (
  select 0 as k, m as size, [0.0e0 for i in range(1, 10)] as b from (values (4), (9)) v(m)
  union all
  select k + 1, size, [case when i = ga.i then (c - list_dot_product(b, row) + b[ga.i] * row[ga.i]) / row[ga.i] else b[i] end for i in range(1, 10)]
  from seidel join ga on ga.i = k % size + 1 where k < 360),
fit as (select size, b from seidel where k = 360),
r2 as (
  select size, 1 - sum(w * (y - list_dot_product(b, x)) ** 2) / sum(w * (y - ym) ** 2) as r2 from (select *, sum(w * y) over () / sum(w) over () as ym from lz), fit group by size)
"""

_LOG = """with l as (
  select user_id * 100000000 + strftime(ts, '%Y%m%d')::bigint as event_id, event_id as log_id, ((floor(epoch(ts))::bigint % 86400) // 20)::bigint as ts_s,
    case event_type when 'view' then 'VOID_GRUB' when 'signup' then 'RIFT_HERALD' when 'purchase' then 'TOWER' when 'error' then 'BARON' when 'click' then 'DRAGON' end as event_type,
    case when event_id % 2 = 0 then 100 else 200 end as side from events),
s as (select *, row_number() over (partition by event_id order by ts_s, log_id)::int as seq from l)
"""
_FIRST = """ft as (
  select event_id, arg_min(side, seq) filter (where event_type = 'BARON') as baron_side, arg_min(ts_s, seq) filter (where event_type = 'BARON') as baron_s,
    arg_min(side, seq) filter (where event_type = 'TOWER') as tower_side from s group by event_id)"""

ORACLE: dict[str, str] = {
    "basket_synergy": """
with e as (
  select o_orderkey as event_id, r_name as segment, year(o_orderdate) as y, o_orderstatus = 'F' as win
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
l as (
  select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as rn from lineitem),
k as (
  select l_orderkey as event_id, l_linenumber as slot, p_brand as entity, y, win, segment from l join part on l_partkey = p_partkey join e on e.event_id = l_orderkey where rn = 1),
w as (
  select y, case row_number() over (order by y desc) when 1 then 1.0e0 when 2 then 0.6e0 when 3 then 0.35e0 end as w from (select distinct y from e) qualify row_number() over (order by y desc) <= 3),
lone as (
  select slot, entity, sum(w * win::int) / sum(w) as rate from k join w using (y) group by all),
pr as (
  select a.slot as slot_a, b.slot as slot_b, a.entity as a, b.entity as b, count(*)::bigint as games, sum(w) as games_eff, sum(w * a.win::int) / sum(w) as rate
  from k a join k b on a.event_id = b.event_id and a.slot < b.slot join w on w.y = a.y group by all),
z as (
  select pr.*, x.rate as rx, y.rate as ry, 3.841458820694124e0 as zz, 1.959963984540054e0 as z
  from pr join lone x on x.slot = slot_a and x.entity = a join lone y on y.slot = slot_b and y.entity = b)
select slot_a, slot_b, a, b, games, round(games_eff, 6) as games_eff, round(rate, 6) as rate,
  round(greatest(0, (rate + zz / (2 * games_eff)) / (1 + zz / games_eff) - z / (1 + zz / games_eff) * sqrt(rate * (1 - rate) / games_eff + zz / (4 * games_eff * games_eff))), 6) as ci_low,
  round(least(1, (rate + zz / (2 * games_eff)) / (1 + zz / games_eff) + z / (1 + zz / games_eff) * sqrt(rate * (1 - rate) / games_eff + zz / (4 * games_eff * games_eff))), 6) as ci_high,
  round(rate - (rx + ry) / 2, 6) as synergy, case when round(games_eff, 9) < 3 then 'faible' when round(games_eff, 9) < 6 then 'moyen' else 'eleve' end as tier
from z order by synergy desc, games desc, slot_a, slot_b, a, b limit 50
""",
    "individual_rates": _facts("select period, segment, slot, entity, games, wins from ind", _WINDOW),
    "matchups": _facts("select * from mu", _WINDOW, _MATCHUPS),
    "team_gold": _facts("select * from tg", _PAIRS),
    "duo_agg": _facts(_round(_pairs_inside(_INNER), _SUMS, 4), _PAIRS, _FACED.format(roles="p")),
    "duo_agg_ext": _facts(_round(_pairs_across(_EXT), _SUMS, 4), _PAIRS, _FACED.format(roles="p")),
    "pair_gold_fallback": _facts(
        _round("select period, segment, roles, a, b, games, gold10_sum, gold10_n, gold15_sum, gold15_n, vision_sum, vision_n, team_gold15_n from (" + _pairs_inside(_INNER) + ")", ["vision_sum"], 4),
        "p5 as (select * from p where event_id % 5 <> 0)", _PAIRS.replace("from p a join p b", "from p5 a join p5 b"), _FACED.format(roles="p5"),
    ),
    "trio_agg": _facts(_round(_TRIO_AGG, ["vision_sum", "cc_sum", "jgl_cc_sum", "mid_cc_sum", "sup_cc_sum", "drakes_sum"], 4), _PAIRS),
    "duration_counts": _facts(
        f"""select period, segment, 'trio' as roles, jgl as a, mid as b, sup as c, {_BUCKET} as bucket, count(*)::bigint as games, {_F.format("win")} as wins from t group by all
        union all select x.period, x.segment, roles, x.entity, y.entity, null::bigint, least(40, 5 * (x.duration_s // 300))::bigint, count(*)::bigint, {_F.format("x.win")}
        from prs join p x on x.slot = slot_a join p y on y.event_id = x.event_id and y.side = x.side and y.slot = slot_b group by all""", _PAIRS,
    ),
    "combo_vs_enemy": _facts(f"select t.period, t.segment, jgl, mid, sup, p.slot, p.entity as enemy, count(*)::bigint as games, {_F.format('t.win')} as wins from t join p on p.event_id = t.event_id and p.side <> t.side group by all"),
    "combo_with_ally": _facts(f"select t.period, t.segment, jgl, mid, sup, p.slot, p.entity as ally, count(*)::bigint as games, {_F.format('t.win')} as wins from t join p on p.event_id = t.event_id and p.side = t.side where p.slot in ('TOP', 'BOTTOM') group by all"),
    "group_total": _facts("select event_id, side, slot, damage, round(damage::double / sum(damage) over (partition by event_id, side), 6) as share from p"),
    "all_segment": _facts("select segment, period, slot, entity, games, wins from inda", _WINDOW),
    "window_definition": _facts(f"select {_LABEL}, period, depth::int as depth, w as weight from win", _WINDOW),
    "window_rates": _facts("select segment, slot, entity, sum(games)::bigint as games, round(sum(w * games), 6) as games_eff, round(sum(w * wins) / sum(w * games), 6) as rate from inda join win using (period) group by all", _WINDOW),
    "window_stats": _facts(
        "select segment, jgl, mid, sup, " + ", ".join(f"round(sum(case when {s}_sum is not null and {s}_n > 0 then w * {s}_sum end) / sum(case when {s}_sum is not null and {s}_n > 0 then w * {s}_n end), 4) + 0.0e0 as {c}" for c, s in _STATS.items())
        + f" from ({_TRIO_AGG}) join win using (period) group by all", _PAIRS, _WINDOW,
    ),
    "rework_cut": _facts("select a, b, sum(games)::bigint as games, round(sum(case when (a = 3 or b = 3) and depth > 1 then 0 else w end * games), 4) as games_eff from mu join win using (period) group by all", _WINDOW, _MATCHUPS),
    "duo_scores": _facts(_round(_DUO_SCORES, _SCORE_DOUBLES, 9), *_ALL),
    "trio_scores": _facts(_round(_TRIO_SCORES, [*_SCORE_DOUBLES, "prior"], 9), *_ALL, _TRIO),
    "scaling": _facts(
        """select segment, roles, a, b, case when ok then round(slope, 5) + 0.0e0 end as scaling, case when ok then round(slope - t * sqrt(greatest(0, rss) / (n - 2) / den), 5) + 0.0e0 end as scaling_ci_low,
          case when ok then round(slope + t * sqrt(greatest(0, rss) / (n - 2) / den), 5) + 0.0e0 end as scaling_ci_high
        from (select segment, roles, a, b, any_value(slope) as slope, any_value(den) as den, count(*) as n, sum(w * (dy - slope * dx) * (dy - slope * dx)) as rss,
            case count(*) when 3 then 12.706 when 4 then 4.303 when 5 then 3.182 when 6 then 2.776 when 7 then 2.571 when 8 then 2.447 end as t, any_value(den) > 0 as ok from sl group by 1, 2, 3, 4 having count(*) >= 3)""",
        _PAIRS, _WINDOW,
        """bk as (
          select x.period, x.segment, roles, x.entity as a, y.entity as b, least(40, 5 * (x.duration_s // 300)) as bucket, count(*) as games, count(*) filter (where x.win) as wins
          from prs join p x on x.slot = slot_a join p y on y.event_id = x.event_id and y.side = x.side and y.slot = slot_b group by all),
        bka as (select * from bk union all select period, 'all', roles, a, b, bucket, sum(games), sum(wins) from bk group by period, roles, a, b, bucket),
        pt as (
          select segment, roles, a, b, bucket / 5.0e0 as x, sum(w * wins) / sum(w * games) as y, sum(w * games) as w from bka join win using (period) group by segment, roles, a, b, bucket having sum(games) >= 3),
        ce as (
          select *, x - sum(w * x) over g / sum(w) over g as dx, y - sum(w * y) over g / sum(w) over g as dy from pt window g as (partition by segment, roles, a, b)),
        sl as (
          select *, sum(w * dx * dx) over g as den, sum(w * dx * dy) over g / nullif(sum(w * dx * dx) over g, 0) as slope from ce window g as (partition by segment, roles, a, b))""",
    ),
    "matchup_scores": _facts(_round(f"select *, {_LABEL} from ms", ["games_eff", "rate", "delta_raw", "delta", "ci_low", "ci_high"], 6), _WINDOW, _MATCHUPS),
    "slot_distribution": _facts("select entity, slot, sum(games)::bigint as games, sum(wins)::bigint as wins from ind group by all having sum(games) >= 30", _WINDOW),
    "primary_slot": _facts(
        "select entity, slot as primary_slot, games, round(games::double / total, 6) as share from (select entity, slot, games, sum(games) over (partition by entity) as total, row_number() over (partition by entity order by games desc, slot) as rn from (select entity, slot, sum(games)::bigint as games from ind group by all)) where rn = 1",
        _WINDOW,
    ),
    "flex_picks": _facts(
        """select d.entity, d.slot, p1.slot as primary_slot, d.games, d.wins, round(d.share, 6) as share, round(pr.g, 6) as avg_gold_15, round(pr.d, 6) as avg_dmg_per_gold,
          round(pr.g - ba.g, 6) + 0.0e0 as gold_vs_slot, round(pr.d - ba.d, 6) + 0.0e0 as dmg_vs_slot, round(pr.g - ho.g, 6) + 0.0e0 as gold_vs_primary, round(pr.d - ho.d, 6) + 0.0e0 as dmg_vs_primary, d.games >= 100 and d.share >= 0.05 as established
        from dist d join (select * from dist qualify row_number() over (partition by entity order by games desc, slot) = 1) p1 on p1.entity = d.entity and p1.slot <> d.slot
        left join pf pr on pr.entity = d.entity and pr.slot = d.slot left join pf ho on ho.entity = d.entity and ho.slot = p1.slot
        left join (select slot, avg(gold_15) as g, avg(dmg_per_gold) as d from p where gold_15 is not null group by all) ba on ba.slot = d.slot""",
        _WINDOW,
        """dist as (select entity, slot, games, wins, games::double / sum(games) over (partition by entity) as share from (select entity, slot, sum(games)::bigint as games, sum(wins)::bigint as wins from ind group by all having sum(games) >= 30)),
        pf as (select entity, slot, avg(gold_15) as g, avg(dmg_per_gold) as d from p where gold_15 is not null group by all having count(*) >= 30)""",
    ),
    "resilience": _facts("select * from re", _PAIRS, "RESILIENCE"),
    "resilience_report": _facts(
        """select *, round(wins_ahead::double / games_ahead, 6) as rate_ahead, round(wins_behind::double / games_behind, 6) as rate_behind, round(wins_ahead::double / games_ahead - wins_behind::double / games_behind, 6) + 0.0e0 as gap
        from re where games_ahead >= 30 and games_behind >= 30 and wins_ahead::double / games_ahead - wins_behind::double / games_behind >= -0.2 and wins_behind::double / games_behind between 0.3 and 0.7""",
        _PAIRS, "RESILIENCE",
    ),
    "summary_report": _facts(
        "select segment, jgl, count(*)::bigint as games, round(avg_w(win::int), 4) as rate, " + ", ".join(f"round(avg_w(gold_diff_{m}), 4) + 0.0e0 as gold_diff_{m}, count(gold_diff_{m})::bigint as gold_diff_{m}_n" for m in (5, 10, 15))
        + ", " + ", ".join(f"round(avg_w({c}::int), 4) + 0.0e0 as {c}" for c in ("herald_taken", "soul_taken", "first_tower", "jgl_cs_diff_15"))
        + ", " + ", ".join(f"round(avg_w({c} / (duration_s / 60.0e0)), 4) as {c}" for c in ("vision_score", "drakes_taken", "cc_time_s", "jgl_cc_time_s", "mid_cc_time_s", "sup_cc_time_s"))
        + ", round(avg_w(case when soul_taken then win::int end), 4) as rate_with_soul, round(avg_w(case when not soul_taken then win::int end), 4) as rate_without_soul, round(avg_w(case when win then duration_s end), 4) as avg_duration_win_s, round(avg_w(case when not win then duration_s end), 4) as avg_duration_loss_s from t join win using (period) group by all",
        _WINDOW,
    ),
    "tier_page": _facts(
        "select roles, a, b, games, rate, tier, (count(*) over ())::bigint as total from (select roles, a, b, games, round(rate, 6) as rate, tier from ds where segment = 'all' and tier in ('moyen', 'eleve')) where games >= 60 and rate <= 0.6 order by rate desc, games, roles, a, b limit 20 offset 20",
        *_ALL,
    ),
    "top_partners": _facts(
        """select anchor, slot, partner, games, synergy, rank from (select *, row_number() over (partition by anchor order by synergy desc, slot, partner)::int as rank from (
          select a as anchor, slot_b as slot, b as partner, games, round(synergy, 6) + 0.0e0 as synergy from ds join prs using (roles) where segment = 'all' and slot_a = 'JUNGLE'
          union all select b, slot_a, a, games, round(synergy, 6) + 0.0e0 from ds join prs using (roles) where segment = 'all' and slot_b = 'JUNGLE')) where rank <= 3""",
        *_ALL,
    ),
    "top_matchups": _facts(
        """select 'by' as side, slot, a, b, delta, rank from (select *, row_number() over (partition by slot, a order by delta desc, b)::int as rank from mx) where rank <= 3
        union all select 'against', slot, a, b, delta, rank from (select *, row_number() over (partition by slot, b order by delta desc, a)::int as rank from mx) where rank <= 3""",
        _WINDOW, _MATCHUPS, "mx as (select slot, a, b, round(delta, 6) + 0.0e0 as delta from ms where segment = 'all' and games_eff >= 10)",
    ),
    "pair_trios": _facts("select jgl, mid, sup, games, round(synergy, 6) + 0.0e0 as synergy from ts where segment = 'all' and jgl = 3 and mid = 5 order by synergy desc, sup limit 8", *_ALL, _TRIO),
    "inner_pairs": _facts(f"select * from (select period, segment, roles, a, b, games, wins from ({_pairs_inside(_INNER)})) where (roles, a, b) in (('jgl_mid', 3, 5), ('jgl_sup', 3, 7), ('mid_sup', 5, 7))", _PAIRS, _FACED.format(roles="p")),
    "factor_rows": _facts(_round("select * from fr", ["team_cc_per_min", "team_vision_per_min"], 6), _WINDOW, _FACTOR),
    "factor_moments": _facts("select " + ", ".join(f"round(avg({x}), 3) + 0.0e0 as mean_{x}, round(stddev_pop({x}), 3) as std_{x}" for x in ("team_gold_diff_15", "team_cc_per_min", "team_vision_per_min", "jgl_cs_diff_15")) + " from fr", _WINDOW, _FACTOR),
    "factor_gram": _facts(
        "select " + ", ".join(f"round(sum(weight * {a} * {b}), 3) + 0.0e0 as x{i}_{j}" for i, a in enumerate(("1", "g", "j")) for j, b in enumerate(("1", "g", "j")) if j >= i) + ", " + ", ".join(f"round(sum(weight * {a} * y), 3) + 0.0e0 as y{i}" for i, a in enumerate(("1", "g", "j"))) + " from (select *, team_gold_diff_15 / 1000 as g, jgl_cs_diff_15 as j from fr)",
        _WINDOW, _FACTOR,
    ),
    "auc_ranks": _facts(
        "select round((sum(r) filter (where y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) as auc from (select y, rank() over (order by team_gold_diff_15) + (count(*) over (partition by team_gold_diff_15) - 1) / 2.0e0 as r from fr)",
        _WINDOW, _FACTOR,
    ),
    "factor_r2": _facts("select round(1 - sum(weight * (y - 0.5e0 - team_gold_diff_15 / 100000) ** 2) / sum(weight * (y - ym) ** 2), 6) as r2 from (select *, (select sum(weight * y) / sum(weight) from fr) as ym from fr)", _WINDOW, _FACTOR),
    "correlations": _facts(
        "select round(corr(x, z), 5) as pearson, round(corr(rx, rz), 5) as spearman from (select team_gold_diff_15 as x, jgl_cs_diff_15 as z, rank() over (order by team_gold_diff_15) + (count(*) over (partition by team_gold_diff_15) - 1) / 2.0e0 as rx, rank() over (order by jgl_cs_diff_15) + (count(*) over (partition by jgl_cs_diff_15) - 1) / 2.0e0 as rz from fr)",
        _WINDOW, _FACTOR,
    ),
    "counter_scores": _facts(_round("select segment, jgl, mid, sup, slot, other as enemy, games, games_eff, rate, effect_raw as delta_raw, effect as delta, ci_low, ci_high, tier from vs", ["games_eff", "rate", "delta_raw", "delta", "ci_low", "ci_high"], 12), _WINDOW, _TRIO_COUNTS, _VERSUS.format(match="o.side <> t.side")),
    "ally_scores": _facts(_round("select segment, jgl, mid, sup, slot, other as ally, games, games_eff, rate, effect_raw as uplift_raw, effect as uplift, ci_low, ci_high, tier from vs", ["games_eff", "rate", "uplift_raw", "uplift", "ci_low", "ci_high"], 12), _WINDOW, _TRIO_COUNTS, _VERSUS.format(match="o.side = t.side and o.slot in ('TOP', 'BOTTOM')")),
    "member_rows": _facts("select period, segment, jgl, mid, sup, count(*)::bigint as games from t where jgl = 3 and sup = 7 group by all"),
    "segment_volumes": _facts("select segment, count(*)::bigint as games from p group by all"),
    "stat_shares": _facts(
        """select slot, entity, round(emp, 6) as empirical, round((games * emp + 200 * (entity * 100 / 11.0e0)) / (games + 200), 6) as blended, round(least(100, cc * 100 / max(cc) over (partition by slot)), 6) as bar, round(games * 100.0e0 / sum(games) over (partition by slot), 6) as of_games
        from (select slot, entity, avg(cc_time_s / (duration_s / 60.0e0)) as cc, count(*) as games, least(avg(cc_time_s / (duration_s / 60.0e0)) * 100 / 6.0e0, 100) as emp from p group by all)""",
    ),
    "advice_tags": _facts(
        """select event_id, side, concat_ws(',', case when s > 0.03e0 then 'late' when s < -0.03e0 then 'early' end, case when c >= 2.5e0 then 'control' end, case when gold_diff_15 > 350 then 'lead' when gold_diff_15 < -350 then 'patience' end) as tags
        from (select event_id, side, gold_diff_15, jgl_cs_diff_15 / 500.0e0 as s, cc_time_s / (duration_s / 60.0e0) as c from t)""",
    ),
    "vif": _facts(
        """select unnest(['team_gold_diff_15', 'team_cc_per_min', 'team_vision_per_min', 'jgl_cs_diff_15']) as feature, round(unnest([
          (1 + 2 * d * e * f - d * d - e * e - f * f) / det, (1 + 2 * b * c * f - b * b - c * c - f * f) / det, (1 + 2 * a * c * e - a * a - c * c - e * e) / det, (1 + 2 * a * b * d - a * a - b * b - d * d) / det]), 5) as vif
        from (select *, 1 - (a * a + b * b + c * c + d * d + e * e + f * f) + 2 * (a * b * d + a * c * e + b * c * f + d * e * f) + a * a * f * f + b * b * e * e + c * c * d * d - 2 * (a * b * e * f + a * c * d * f + b * c * d * e) as det
          from (select corr(g, k) as a, corr(g, v) as b, corr(g, j) as c, corr(k, v) as d, corr(k, j) as e, corr(v, j) as f from (select team_gold_diff_15 as g, team_cc_per_min as k, team_vision_per_min as v, jgl_cs_diff_15 as j from fr)))""",
        _WINDOW, _FACTOR,
    ),
    "comp_matchups": _facts(
        """select 'all' as segment, 'x' as archetype, b::varchar as seed, case when slot_rank = 1 then 'primary' else 'secondary' end as kind, slot, b as against, a as pick, round(delta, 4) + 0.0e0 as delta, slot_rank, pick_rank
        from (select *, max(first_rank) over (partition by b, slot) as slot_rank from (
          select *, case when pick_rank = 1 then row_number() over (partition by b, pick_rank order by delta desc, list_position(['TOP', 'JUNGLE', 'MIDDLE', 'BOTTOM', 'UTILITY'], slot))::int end as first_rank from (
            select slot, a, b, delta * 10 as delta, row_number() over (partition by b, slot order by delta desc, a)::int as pick_rank from ms where segment = 'all' and delta * 10 >= 0.03e0 and games_eff * 10 >= 50) where pick_rank <= 3))
        where slot_rank = 1 or (slot_rank <= 3 and pick_rank = 1)""",
        _WINDOW, _MATCHUPS,
    ),
    "markup_entries": """
with x as (select page_id, string_split(regexp_replace(html, '(?i)(<(?:h[1-6]|p|li|a)[ >])', chr(10) || '\\1', 'g'), chr(10)) as parts from pages),
n as (select page_id, unnest(range(1, len(parts) + 1)) as pos, parts from x),
l as (select page_id, pos, parts[pos] as line, nullif(regexp_extract(parts[pos], '<h[1-6][^>]*>([^<]*)', 1), '') as head from n),
c as (select page_id, line, last_value(head ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and current row) as category from l),
e as (select page_id, category, unnest(regexp_extract_all(line, 'href="([^"]*)"', 1)) as entry, regexp_matches(line, 'nofollow|external|http') as f from c)
select page_id, category, entry, bool_or(f) as flagged from e group by all
""",
    "event_seq": _LOG + "select * from s",
    "first_taker": f"{_LOG}, {_FIRST} select * from ft",
    "early_rollup": f"""{_LOG}, {_FIRST} select event_id, side, {_F.format("event_type = 'VOID_GRUB'")} as grubs_taken, bool_or(event_type = 'RIFT_HERALD') as herald_taken, {_F.format("event_type = 'DRAGON'")} as drakes_taken,
      count(*) filter (where event_type = 'DRAGON') >= 4 as soul_taken, {_F.format("event_type = 'TOWER'")} as towers_destroyed, bool_or(event_type = 'RIFT_HERALD' and ts_s < 900) as herald_taken_pre15, {_F.format("event_type = 'DRAGON' and ts_s < 900")} as dragons_taken_pre15,
      coalesce(any_value(baron_side) = side, false) as nashor_first, case when any_value(baron_side) = side then any_value(baron_s) end as nashor_first_s, coalesce(any_value(tower_side) = side, false) as first_tower
      from s join ft using (event_id) group by event_id, side""",
    "gaps": "select p as gap_start, ts as gap_end, floor(epoch(ts))::bigint - floor(epoch(p))::bigint as gap_s from (select ts, lag(ts) over (order by ts) as p from events) where floor(epoch(ts)) - floor(epoch(p)) > 600",
    "gaps_by_type": """
select event_type, p as gap_start, ts as gap_end, floor(epoch(ts))::bigint - floor(epoch(p))::bigint as gap_s
from (select event_type, ts, lag(ts) over (partition by event_type order by ts) as p from events where ts > (select max(ts) from events) - interval 7 day)
where floor(epoch(ts)) - floor(epoch(p)) > 3600
""",
    "ingest_status": """
with e as (select ts, event_type, '1.' || (user_id % 7) as period from events)
select 'day' as metric, strftime(ts, '%Y-%m-%d') as key, event_type as key2, count(*)::bigint as n, null::timestamp as at from e where ts > (select max(ts) from e) - interval 7 day group by all
union all select 'period', period, null, count(*)::bigint, max(ts) from e group by period
union all select 'status', o_orderstatus, null, count(*)::bigint, null from orders group by o_orderstatus
""",
    "pair_detail": _facts(
        "select 'bot_sup' as roles, bot.entity as a, count(*)::bigint as games, round(sum(w * bot.win::int) / sum(w), 4) as rate, round(sum(w * bot.cc_time_s / (bot.duration_s / 60.0e0)) / sum(w), 4) as a_cc_time_s, round(sum(w * partner.cc_time_s / (bot.duration_s / 60.0e0)) / sum(w), 4) as b_cc_time_s, "
        "round(sum(w * bot.duration_s) filter (where bot.win) / sum(w) filter (where bot.win), 4) as avg_duration_win_s, round(sum(w * bot.duration_s) filter (where not bot.win) / sum(w) filter (where not bot.win), 4) as avg_duration_loss_s "
        "from p bot join p partner on partner.event_id = bot.event_id and partner.side = bot.side and partner.slot = 'UTILITY' join win on win.period = bot.period where bot.slot = 'BOTTOM' and bot.entity = 3 group by bot.entity",
        _WINDOW,
    ),
    "daily_pivot": "select strftime(ts, '%Y-%m-%d') as day, " + ", ".join(f"{_F.format(f'event_type = {k!r}')} as {k}" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by 1",
    "dedup": "select distinct l_orderkey, l_linenumber from lineitem where l_orderkey % 3 <> 0",
    "not_done": "select distinct c_custkey as key from customer where c_acctbal >= 0 and c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')",
    "done_keys": "select o_custkey as key from orders union select c_custkey from customer where c_acctbal < 0",
    "missing_facts": "select o_orderkey as key, o_orderpriority from orders where o_orderkey not in (select l_orderkey from lineitem)",
    "keep_newest": _facts("select period, count(*)::bigint as n from m where period in (select period from win where depth <= 2) group by all", _WINDOW),
    "changed_rows": "with n as (select o_orderkey as key, case when o_orderkey % 11 <> 0 then round(o_totalprice) end as total from orders) select key, total from n where key % 5 = 0 or (key % 7 = 0 and total is distinct from 1.0)",
    "merge_columns": "select coalesce(o.c_custkey, n.c_custkey) as c_custkey, coalesce(o.c_mktsegment, n.c_mktsegment) as c_mktsegment, coalesce(n.balance, o.balance) as balance from (select c_custkey, c_mktsegment, round(c_acctbal) as balance from customer where c_custkey % 2 = 0) o full join (select c_custkey, 'NEW' as c_mktsegment, round(c_acctbal + 1) as balance from customer where c_custkey % 3 = 0) n on o.c_custkey = n.c_custkey",
    "backfill": "select o_orderkey as key, case when o_orderkey % 4 <> 0 then o_custkey else v end as value from orders left join (select l_orderkey, max(l_suppkey) as v from lineitem group by 1) on l_orderkey = o_orderkey",
    "retention": _facts("select 'm' as \"table\", count(*)::bigint as n from m where period not in (select period from win where depth <= 2) union all select 'p', count(*)::bigint from p where period not in (select period from win where depth <= 2)", _WINDOW),
    "contract": """
select 'unique' as rule, concat_ws('|', l_orderkey, l_linenumber) as detail, count(*)::bigint as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1
union all select 'enum:l_returnflag', l_returnflag, count(*)::bigint from lineitem where l_returnflag not in ('A', 'N') group by l_returnflag
union all select 'parent', l_orderkey::varchar, count(*)::bigint from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 50 <> 0) group by l_orderkey
""",
    "work_list": """
with u as (select user_id as player, user_id % 3 as segment, user_id % 2 = 0 as active, max(ts) as checked, min(ts) as discovered from events group by user_id),
n as (select *, checked + case when active then interval 2 hour else interval 1 day end as due, (select max(ts) from events) as now from u)
select player, segment, position from (select *, row_number() over (partition by segment order by due, discovered, player)::int as position from n where due <= now) where position <= 20
""",
    "weight_requests": """
select p_partkey, case when a is null and b is null then 'unset' when a < 0 or b < 0 then 'negative' when abs(a + b - 100) > 0.5 then 'sum' end as reason
from (select p_partkey, case when p_size % 5 <> 0 then p_size::double end as a, case when p_size % 5 <> 0 then 100.0e0 - p_size + p_partkey % 3 * 0.3e0 - case when p_partkey % 7 = 0 then 200 else 0 end end as b from part)
""",
    "overrides": """
with e as (select *, row_number() over (partition by p_brand, p_type order by p_partkey) as rn from part where p_partkey % 40 = 0 or p_partkey % 25 = 0),
r as (select *, row_number() over (partition by p_brand, p_type order by p_partkey) as rn from part)
select r.p_brand, r.p_type, r.p_partkey, case when e.p_partkey is not null then e.p_size + 100 else r.p_size end as p_size
from r left join e on e.p_brand = r.p_brand and e.p_type = r.p_type and e.rn = r.rn where e.p_partkey is null or e.p_partkey % 40 <> 0
union all select p_brand, p_type, p_partkey, p_size + 100 from part where p_partkey % 97 = 0 and p_partkey % 40 <> 0 and p_partkey % 25 <> 0
""",
    "spell_scores": """
with x as (
  select p_brand as entity, p_type as spell, p_partkey as n, ['airborne', 'suppression', 'stun', 'charm', 'fear', 'taunt', 'sleep', 'root', 'silence', 'ground', 'blind', 'polymorph', 'slow'][(p_partkey % 13 + 1)::int] as effect,
    [1.0, 1.0, 0.9, 0.9, 0.9, 0.9, 0.9, 0.7, 0.5, 0.5, 0.5, 0.5, 0.3][(p_partkey % 13 + 1)::int]::double as w, case when p_partkey % 9 <> 0 then p_size / 10.0e0 end as duration from part),
v as (
  select entity, spell, effect, coalesce(w * duration * case when effect = 'slow' then (n % 60 + 20) / 100.0e0 else 1 end * case when n % 2 = 1 then 1.5e0 else 1 end * case when n % 3 = 1 then 1.2e0 else 1 end * case when (n + 1) % 3 = 1 then 0.5e0 else 1 end
    * case when n % 4 = 0 then 1.15e0 else 1 end * case when n % 5 = 0 then 0.7e0 else 1 end * case when n % 30 > 0 and (n + 1) % 3 <> 1 then least(1.5e0, greatest(1.0e0, 12.0e0 / (n % 30))) else 1 end, 0) as c from x),
s as (
  select entity, spell, coalesce(max(c) filter (where effect <> 'slow'), 0) + coalesce(sum(c) filter (where effect = 'slow'), 0) as c from v group by all)
select entity, round(sum(c), 4) as score from s group by all
""",
    "range_scores": """
with k as (select *, row_number() over (partition by p_brand order by p_partkey::varchar) as rn from part)
select p_brand as entity, round(count(*)::double * max(p_size) + coalesce(sum(case when rn <= 4 and p_partkey % 6 = 0 and p_partkey % 12 <> 0 then 0.0e0 when rn <= 4 then
  least(case when p_partkey % 12 = 0 then 9000.0e0 else greatest(p_retailprice * 5, p_size * 10.0e0) end, 8000.0e0) / case when p_size % 3 = 0 then 1.0e0 else greatest(p_size, 4.0e0) end end), 0), 4) as score
from k group by all
""",
    "outlier_fence": """
with r as (select o_custkey, sum(o_totalprice) / count(*) as ratio from orders group by 1),
q as (select quantile_cont(ratio, 0.75) + 0.5e0 * (quantile_cont(ratio, 0.75) - quantile_cont(ratio, 0.25)) as fence from r)
select o_custkey, round(ratio, 4) as ratio, round(fence, 4) as fence from r, q where ratio > fence
""",
    "rank_gap": """
with s as (select s_suppkey as entity, round(s_acctbal, -2) as x, (s_suppkey * 37 % 101)::double as y from supplier),
k as (select *, ((rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0e0) - (rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0e0)) / count(*) over () as gap from s)
select entity, x, y, round(gap, 6) + 0.0e0 as gap, 'over' as "end" from (select * from k order by gap desc, entity limit 5) union all select entity, x, y, round(gap, 6) + 0.0e0, 'under' from (select * from k order by gap, entity limit 5)
""",
    "reference_fill": """
with s as (select s_suppkey, s_nationkey, case when s_suppkey % 3 <> 0 then round(s_acctbal) end as value from supplier),
f as (select c_nationkey as n, round(max(c_acctbal)) as v from customer where c_nationkey < 15 group by 1)
select s_suppkey, s_nationkey, coalesce(value, v, case when s_nationkey < 20 then 1.0 else 2.0 end) as value, case when value is null and v is not null then 'filled:value' end as note, value is null and v is null as defaulted
from s left join f on n = s_nationkey
""",
    "zscores": "select s_suppkey, round((s_acctbal - case when n < 2 then 0 else m end) / case when n < 2 or s = 0 then 1 else s end, 6) + 0.0e0 as z_s_acctbal from (select s_suppkey, s_acctbal, count(*) over g as n, avg(s_acctbal) over g as m, stddev_pop(s_acctbal) over g as s from supplier window g as (partition by s_nationkey))",
    "resolved_names": "select case when n_nationkey % 2 = 0 then 'the ' || n_name else n_name end as name, case when n_nationkey % 2 = 1 or n_nationkey % 4 = 0 then n_nationkey end as asked, case when n_nationkey % 2 = 1 or n_nationkey % 4 = 0 then n_nationkey end as entity from nation",
    "pair_averages": _facts(
        """select a::varchar as seed, round(avg(rate), 4) as rate, round(avg(synergy), 4) + 0.0e0 as synergy, case when count(gold_diff_15) = 10 then round(avg(gold_diff_15), 4) + 0.0e0 end as gold_diff_15, round(min(games_eff), 4) as min_games_eff, min(games) as min_games
        from ds where segment = 'all' and a = b group by a having count(*) = 10""",
        *_ALL,
    ),
    "seed_rank": _facts(
        """select archetype, seed, round(synergy, 4) + 0.0e0 as total, round(score, 4) + 0.0e0 as seed_score from (select *, row_number() over (partition by archetype order by score desc, roles, a, b) as rn from (
          select 'synergy' as archetype, roles, a, b, roles || ':' || a || ':' || b as seed, synergy, (synergy - ms) / ss as score from po
          union all select 'lead', roles, a, b, roles || ':' || a || ':' || b, synergy, 0.6e0 * (gold_diff_15 - mg) / sg + 0.4e0 * (rate - mr) / sr from po where gold_diff_15 is not null)) where rn <= 8""",
        *_ALL,
        "po as (select *, avg(synergy) over () as ms, stddev_pop(synergy) over () as ss, avg(gold_diff_15) over () as mg, stddev_pop(gold_diff_15) over () as sg, avg(rate) over () as mr, stddev_pop(rate) over () as sr from ds where segment = 'all' and games >= 20)",
    ),
    "duo_score_stats": _facts(
        "select segment, roles, a, b, "
        + ", ".join(f"round(sum(case when {c}_sum is not null and {c}_n > 0 then w * {c}_sum end) / sum(case when {c}_sum is not null and {c}_n > 0 then w * {c}_n end), 9) + 0.0e0 as {name}" for name, c in _DUO_STATS.items())
        + f""" from (
          with pairs as (select * from ({_pairs_inside(_INNER)}) union all by name select * from ({_pairs_across(_EXT)}))
          select * from pairs union all by name
          select period, 'all' as segment, roles, a, b, {", ".join(f"sum({c}_sum) as {c}_sum, sum({c}_n)::bigint as {c}_n" for c in _DUO_STATS.values())} from pairs group by all)
        join win using (period) group by all""",
        _PAIRS, _WINDOW, _FACED.format(roles="p"),
    ),
    "window_labels": _facts(f"select {_LABEL}", _WINDOW),
    "behind_sides": _facts(
        """select segment, count(*)::bigint as n, (count(*) filter (where win))::bigint as wins, sum(diff)::bigint as lead, kind
        from (select segment, win, diff, unnest([x for x in [case when diff < 0 then 'behind' end, case when abs(diff) >= 1000 then 'far' end] if x is not null]) as kind
          from (select t.segment, t.win, case t.side when 0 then lead else -lead end as diff from t join ev using (event_id)))
        group by segment, kind""",
        _BOTH_SIDES,
    ),
    "win_factor_coefs": _facts(
        f"select {_LABEL}, population, feature, round(coef, 5) + 0.0e0 as coef, round(exp(coef), 5) as odds_ratio, n from fitted join mm using (population) where n >= 200",
        _WINDOW, _FACTOR, _LOGISTIC,
    ),
    "gold_factors": _facts(
        f"""select {_LABEL}, block, feature, round(value, 4) + 0.0e0 as coef, (select count(*) from ld)::bigint as n from (
          select unnest([null, 'draft', 'draft', 'draft', 'play', 'play', 'play', 'play', 'play']) as block,
            unnest(['intercept', 'team_baseline_rate', 'team_matchup_delta', 'team_trio_synergy', 'jgl_cs_diff_15', 'first_blood_team', 'herald_taken_pre15', 'dragons_taken_pre15', 'wards_pre15']) as feature,
            unnest(b) as value from fit where size = 9
          union all select null, case size when 4 then '_r2_draft_only' else '_r2_full' end, r2 from r2)""",
        *_ALL, _TRIO, _MATCHUPS, _LEADS,
    ),
    "compositions": _facts(
        "select segment, archetype, seed, slot, entity, round(total, 6) + 0.0e0 as total from st3 qualify count(*) over (partition by segment, archetype, seed) = 5",
        *_ALL, _lineups({"synergy": {"synergy": 1.0}, "lead": {"gold_diff_15": 0.6, "rate": 0.4}}),
    ),
    "opponent_lineups": _facts(
        "select segment, archetype, seed, slot, entity, round(total, 6) + 0.0e0 as total from st3 qualify count(*) over (partition by segment, archetype, seed) = 5",
        *_ALL, _MATCHUPS, _SCOUTED, _lineups({"counter": {"synergy": 0.6}}, 0.4),
    ),
    "complete_round1": _facts(
        """select seed, slot, entity, round(total, 4) + 0.0e0 as total from (
          select seed, slot, partner as entity, total from best union all select seed, slot_a, a, total from best join prs using (roles) union all select seed, slot_b, b, total from best join prs using (roles))""",
        *_ALL,
        """seeds as (select roles, a, b, roles || ':' || a || ':' || b as seed, synergy from ds where segment = 'all' and games >= 20 order by synergy desc, roles, a, b limit 8),
        ori as (
          select slot_a as anchor_slot, a as anchor, slot_b as slot, b as partner, synergy from ds join prs using (roles) where segment = 'all' and games >= 20
          union all select slot_b, b, slot_a, a, synergy from ds join prs using (roles) where segment = 'all' and games >= 20),
        anc as (select seed, slot_a as anchor_slot, a as anchor from seeds join prs using (roles) union all select seed, slot_b, b from seeds join prs using (roles)),
        cand as (
          select seed, slot, partner, sum(synergy) as s, avg(synergy) as v from anc join ori using (anchor_slot, anchor)
          where (seed, slot) not in (select (seed, anchor_slot) from anc) group by all having count(*) = 2),
        best as (
          select seeds.*, slot, partner, seeds.synergy + s as total from (select * from cand qualify row_number() over (partition by seed order by v desc,
            list_position(['TOP', 'JUNGLE', 'MIDDLE', 'BOTTOM', 'UTILITY'], slot), partner) = 1) join seeds using (seed))""",
    ),
}

_RESILIENCE = (
    _BOTH_SIDES.strip()
    + """,
early as (
  select event_id, t.side, unnest([
    {'factor': 'team_gold_diff_15', 'ahead': case when abs(lead) >= 1000 then (lead >= 0) = (t.side = 0) or lead = 0 end},
    {'factor': 'jgl_cs_diff_15', 'ahead': t.jgl_cs_diff_15 >= 0},
    {'factor': 'first_blood_team', 'ahead': bloods[t.side + 1]}], recursive := true)
  from t join ev using (event_id) where t.jgl_cs_diff_15 is not null),
re as (
  select slot, entity, factor, (count(*) filter (where ahead))::bigint as games_ahead, (count(*) filter (where ahead and win))::bigint as wins_ahead,
    (count(*) filter (where not ahead))::bigint as games_behind, (count(*) filter (where not ahead and win))::bigint as wins_behind
  from early join p using (event_id, side) where ahead is not null group by all)"""
)


def _expand(sql: str) -> str:
    """Fill in the shared parts that stand for themselves in the texts above."""
    sql = sql.replace("RESILIENCE", _RESILIENCE)
    while "avg_w(" in sql:
        at = sql.index("avg_w(")
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = sql[at + 6 : end - 1]
        sql = f"{sql[:at]}(sum(w * ({x})) / sum(case when ({x}) is not null then w end)){sql[end:]}"
    return sql


# the effect scores' SQL again, beside the real averages
_THEORY = ORACLE["spell_scores"].strip().removesuffix("select entity, round(sum(c), 4) as score from s group by all")
ORACLE["reference_validation"] = f"""{_THEORY},
both_ as (select entity, score, value from (select entity, sum(c) as score from s group by all) join (select p_brand as entity, avg(p_retailprice) as value from part group by all having count(*) >= 2) using (entity))
select count(*)::bigint as n, round(corr(score, value), 4) + 0.0e0 as pearson, round(corr(rs, rv), 4) + 0.0e0 as spearman
from (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0e0 as rs, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0e0 as rv from both_)
"""

ORACLE = {k: _expand(v) for k, v in ORACLE.items()}
