"""Registered queries over stored tables, raw documents and small reference operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import filters, joins
from ..operators import ranking as R
from ..operators import reference as ref
from ..sources import readers, sinks, tables
from ..sources.scratch import fresh_path
from .views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _month() -> Column:
    """Periods such as 16.1, 16.9 and 16.10, from an order's month."""
    return F.concat(F.lit("16."), F.month("o_orderdate").cast("string"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    total = F.round("o_totalprice").cast("long").alias("total")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), total, _month().alias("period"))


@query
def stored_scan(spark: SparkSession, d: str) -> DataFrame:
    """Stored orders of the periods 16.1 and 16.10, by status: only these folders are read."""
    path = fresh_path(spark, "stored")
    sinks.refresh_partitions(_orders(spark, d), path)
    rows = readers.scan_facts(spark, path, ["16.1", "16.10"])
    return rows.groupBy("period", "status").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query
def stored_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Orders by period after two refreshes of 16.1, which gets other rows, and 16.9, which
    gets none."""
    path = fresh_path(spark, "stored")
    rows = _orders(spark, d)
    sinks.refresh_partitions(rows, path)
    newer = rows.where("period = '16.1' and status <> 'P'").withColumn("total", F.col("total") + 1)
    for _ in range(2):
        sinks.refresh_partitions(newer, path, values=["16.1", "16.9"])
    return tables.read(spark, path).groupBy("period").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


@query
def stored_window(spark: SparkSession, d: str) -> DataFrame:
    """Rows of window labels by segment: one label is replaced by fewer rows, one by none."""
    path = fresh_path(spark, "stored")
    label = F.when(F.col("o_custkey") % 3 == 0, "16.10+16.9").when(F.col("o_custkey") % 3 == 1, "16.9+16.8").otherwise("16.8")
    rows = table(spark, d, "orders").select(label.alias("label"), F.col("o_orderpriority").alias("segment"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    sinks.replace_window(rows, path, ["16.10+16.9", "16.9+16.8", "16.8"], ["segment"])
    sinks.replace_window(rows.where("label = '16.10+16.9' and status = 'F'"), path, ["16.10+16.9", "16.9+16.8"], ["segment"])
    return tables.read(spark, path).groupBy("label", "segment", "status").agg(F.count("*").alias("n"))


@query
def stored_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders after an upsert that changes every seventh total, moves every fifth order to
    period 16.13 and adds orders; a null key is a key like any other."""
    path = fresh_path(spark, "stored")
    rows = _orders(spark, d)
    keyed = rows.withColumn("key", F.when(F.col("key") != 1, F.col("key")))
    sinks.upsert(keyed.where("key is null or key % 4 <> 0"), path, ["key"], "period")
    moved = F.when(F.col("key") % 5 == 0, "16.13").otherwise(F.col("period"))
    newer = keyed.withColumn("period", moved).withColumn("total", F.when(F.col("key") % 7 == 0, F.col("total") * 2).otherwise(F.col("total")))
    sinks.upsert(newer.unionByName(newer.where("key is null")), path, ["key"], "period")
    return tables.read(spark, path).groupBy("period", "status").agg(F.count("*").alias("n"), F.count("key").alias("n_keys"), F.sum("total").alias("total"))


@query
def stored_replace(spark: SparkSession, d: str) -> DataFrame:
    """A dimension replaced whole, twice."""
    path = fresh_path(spark, "stored")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("entity"), F.col("p_size").cast("double").alias("score"))
    sinks.replace_all(parts, path)
    sinks.replace_all(parts.where("entity % 3 = 0").withColumn("score", F.col("score") + 0.5), path)
    return tables.read(spark, path)


@query
def stored_append(spark: SparkSession, d: str) -> DataFrame:
    """Lines appended in three overlapping parts, by order and line: each key once."""
    path = fresh_path(spark, "stored")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("line"), F.col("l_returnflag").alias("flag"))
    for k in range(3):
        sinks.append_new(lines.where(F.col("l_orderkey") % 3 != k), path, ["l_orderkey", "line"], None)
    return tables.read(spark, path).groupBy("line", "flag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_orders"))


@query
def stored_retention(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay and rows that went, by table, when stored orders keep their newest 24
    months and their lines, stored by order, go with them."""
    root = fresh_path(spark, "stored")
    month = F.date_format("o_orderdate", "yyyy.M")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), month.alias("period"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"))
    tables.append(orders, f"{root}/events", ["period"])
    tables.append(orders.withColumn("side", F.lit(0)), f"{root}/sides", ["period"])
    tables.append(lines, f"{root}/lines", [])
    gone = sinks.purge_stored(spark, root, "events", ["sides", "lines"], 24, dry_run=False)
    stay = None
    for name in gone:
        one = tables.read(spark, f"{root}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("n"), F.max("event_id").alias("last"), F.lit(gone[name]).cast("long").alias("gone"))
        stay = one if stay is None else stay.unionByName(one)
    return stay


@query
def raw_archive(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as a tree of gzipped JSON documents and read back, with segment and
    period from the path."""
    path = fresh_path(spark, "raw")
    created = F.unix_timestamp("o_orderdate") * 1000
    info = F.struct((F.col("o_orderkey") % 4 + 420).cast("int").alias("queueId"), F.concat(_month(), F.lit(".5")).alias("gameVersion"), created.alias("gameCreation"), (F.col("o_orderkey") % 2000).alias("gameDuration"))
    document = F.to_json(F.struct(F.struct(F.col("o_orderkey").cast("string").alias("matchId")).alias("metadata"), info.alias("info")))
    segment = F.element_at(F.array(*map(F.lit, ("eu", "kr", "na"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    readers.write_raw(table(spark, d, "orders").select(segment.alias("segment"), _month().alias("period"), document.alias("document")), path, "detail")
    rows = readers.read_raw(spark, path, "detail")
    return rows.groupBy("segment", "period").agg(F.count("*").alias("n"), F.sum(F.col("metadata.matchId").cast("long")).alias("ids"), F.sum("info.gameDuration").alias("duration"), F.max("info.queueId").alias("queue"))


@query
def template_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a template text made from each part, and the least number of one."""
    cool = F.concat(F.col("p_size").cast("string"), F.lit(" to "), (F.col("p_size") % 7).cast("string"), F.lit(".5"))
    text = F.concat(F.lit("{{ability\n| name = "), F.col("p_brand"), F.lit(" \n|cool="), F.when(F.col("p_partkey") % 5 != 0, cool).otherwise(""), F.lit("\n}}"))
    rows = table(spark, d, "part").select("p_partkey", text.alias("t"))
    value = ref.template_field(F.col("t"), "cool")
    return rows.select("p_partkey", ref.template_field(F.col("t"), "name").alias("name"), value.alias("cool"), ref.min_number(value).alias("least"), ref.template_field(F.col("t"), "none").alias("none"))


@query
def nulls_last(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last places of customers by a balance that some lack."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 != 0, F.round("c_acctbal")).alias("balance"))
    down = R.sort_nulls_last(rows, "balance", True, ["key"]).limit(1200).withColumn("way", F.lit("desc"))
    up = R.sort_nulls_last(rows, "balance", False, ["key"]).limit(1200).withColumn("way", F.lit("asc"))
    return down.unionByName(up)


@query
def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and customers of a nation by name of the set: in both, only in one, and
    the rows of both tables together."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("key"))
    named = {"common": joins.common(c, s, ["key", "nation"]), "unknown": joins.unknown(s, c, ["key", "nation"]), "all": joins.union_by_name(s, c)}
    out = None
    for name, rows in named.items():
        one = rows.groupBy("nation").agg(F.count("*").alias("n"), F.sum("key").alias("keys")).withColumn("set", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def theoretical_share(spark: SparkSession, d: str) -> DataFrame:
    """Size of two parts of a brand in percent of twice the largest part's."""
    part = table(spark, d, "part")
    pair = part.groupBy("p_brand", "p_type").agg((F.min("p_size") + F.max("p_size")).cast("double").alias("raw"))
    best = part.agg(F.max("p_size").cast("double").alias("best"))
    rows = pair.join(F.broadcast(best))  # one row
    return rows.select("p_brand", "p_type", F.round(C.theoretical_pct("raw", 2, "best"), 6).alias("pct"), C.theoretical_pct("raw", 2, F.lit(0.0)).alias("zero"))


@query
def enriched_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders beside their customer's largest recent order; customers without one stay."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round("o_totalprice").cast("long").alias("total"), "o_orderdate")
    scores = orders.where("o_orderdate >= '2000-01-01'").select("o_custkey", F.col("total").alias("best"))
    rows = joins.enrich(orders, scores, ["o_custkey"], ["best"])
    return rows.groupBy(F.year("o_orderdate").alias("year"), F.col("best").isNull().alias("alone")).agg(F.count("*").alias("n"), F.sum("best").alias("best"))


@query
def win_chance(spark: SparkSession, d: str) -> DataFrame:
    """Logistic prediction for suppliers, clamped at both ends."""
    eta = F.col("s_acctbal") / 100
    return table(spark, d, "supplier").select("s_suppkey", F.round(C.sigmoid(eta), 9).alias("chance"))


@query
def behind_sides(spark: SparkSession, d: str) -> DataFrame:
    """Sides that are behind at a checkpoint, and those outside the neutral zone."""
    from .queries import _p, _t

    lead = joins.side_vs_side(_p(spark, d).where("gold_15 is not null").groupBy("event_id", "side").agg(F.sum("gold_15").alias("gold")), ["gold"])
    lead = lead.withColumn("team_gold_diff_15", F.col("gold") - F.col("enemy_gold")).join(_t(spark, d).select("event_id", "side", "segment", "win"), ["event_id", "side"])
    behind, far = filters.behind_only(lead), filters.drop_neutral(lead, "team_gold_diff_15", 1000)
    count = lambda df, name: df.groupBy("segment").agg(F.count("*").alias("n"), C.count_true("win").alias("wins"), F.sum("team_gold_diff_15").alias("lead")).withColumn("kind", F.lit(name))
    return count(behind, "behind").unionByName(count(far, "far"))


_MONTH = "concat('16.', month(o_orderdate))"
_ORDERS = f"o as (select o_orderkey as key, o_orderstatus as status, round(o_totalprice)::bigint as total, {_MONTH} as period, o_orderdate from orders)"

ORACLE: dict[str, str] = {
    "stored_scan": f"with {_ORDERS} select period, status, count(*)::bigint as n, sum(total)::bigint as total from o where period in ('16.1', '16.10') group by all",
    "stored_refresh": f"""with {_ORDERS} select period, count(*)::bigint as n, sum(total + case when period = '16.1' then 1 else 0 end)::bigint as total
from o where period <> '16.9' and (period <> '16.1' or status <> 'P') group by all""",
    "stored_window": """
with r as (
  select case o_custkey % 3 when 0 then '16.10+16.9' when 1 then '16.9+16.8' else '16.8' end as label, o_orderpriority as segment, o_orderstatus as status from orders)
select label, segment, status, count(*)::bigint as n from r where label = '16.8' or (label = '16.10+16.9' and status = 'F') group by all
""",
    "stored_upsert": f"""
with {_ORDERS},
k as (
  select case when key <> 1 then key end as key, status, total, period from o),
n as (
  select key, status, case when key % 7 = 0 then total * 2 else total end as total, case when key % 5 = 0 then '16.13' else period end as period from k)
select period, status, count(*)::bigint as n, count(key)::bigint as n_keys, sum(total)::bigint as total from n group by all
""",
    "stored_replace": "select p_partkey as entity, p_size + 0.5e0 as score from part where p_partkey % 3 = 0",
    "stored_append": """
with l as (
  select l_orderkey, case when l_linenumber < 7 then l_linenumber end as line, l_returnflag as flag, case when l_orderkey % 3 = 0 then 1 else 0 end as part from lineitem),
f as (
  select l_orderkey, line, min(flag) as flag from l group by all)
select line, flag, count(*)::bigint as n, count(distinct l_orderkey)::bigint as n_orders from f group by all
""",
    "stored_retention": """
with m as (
  select year(o_orderdate) * 12 + month(o_orderdate) as m, o_orderkey as event_id from orders),
t as (
  select event_id, m in (select distinct m from m order by m desc limit 24) as fresh from m),
a as (
  select 'events' as "table", event_id, fresh from t union all select 'sides', event_id, fresh from t
  union all select 'lines', l_orderkey, coalesce(fresh, true) from lineitem left join t on t.event_id = l_orderkey)
select "table", (count(*) filter (where fresh))::bigint as n, max(event_id) filter (where fresh) as last, (count(*) filter (where not fresh))::bigint as gone from a group by 1
""",
    "raw_archive": f"""
select case o_custkey % 3 when 0 then 'eu' when 1 then 'kr' else 'na' end as segment, {_MONTH} as period, count(*)::bigint as n, sum(o_orderkey)::bigint as ids,
  sum(o_orderkey % 2000)::bigint as duration, max(o_orderkey % 4 + 420)::int as queue from orders group by 1, 2
""",
    "template_fields": """
select p_partkey, p_brand as name, case when p_partkey % 5 <> 0 then concat(p_size, ' to ', p_size % 7, '.5') end as cool,
  case when p_partkey % 5 <> 0 then least(p_size::double, p_size % 7 + 0.5e0) end as least, null::varchar as "none" from part
""",
    "nulls_last": """
with c as (
  select c_custkey as key, case when c_custkey % 3 <> 0 then round(c_acctbal) end as balance from customer)
select * from (select key, balance, 'desc' as way from c order by balance desc nulls last, key limit 1200)
union all select * from (select key, balance, 'asc' as way from c order by balance asc nulls last, key limit 1200)
""",
    "key_sets": """
with s as (select s_suppkey as key, s_nationkey as nation from supplier), c as (select c_custkey as key, c_nationkey as nation from customer where c_acctbal > 0),
u as (
  select 'common' as set_, nation, key from c where (key, nation) in (select (key, nation) from s)
  union all select 'unknown', nation, key from s where (key, nation) not in (select (key, nation) from c)
  union all select 'all', nation, key from s union all select 'all', nation, key from c)
select set_ as "set", nation, count(*)::bigint as n, sum(key)::bigint as keys from u group by all
""",
    "theoretical_share": """
select p_brand, p_type, round((min(p_size) + max(p_size)) * 100.0e0 / (2 * (select max(p_size) from part)), 6) as pct, 0.0e0 as zero from part group by all
""",
    "enriched_orders": """
with b as (
  select o_custkey, max(round(o_totalprice)::bigint) as best from orders where o_orderdate >= timestamp '2000-01-01' group by 1)
select year(o_orderdate)::int as year, best is null as alone, count(*)::bigint as n, sum(best)::bigint as best from orders left join b using (o_custkey) group by 1, 2
""",
    "win_chance": "select s_suppkey, round(1 / (1 + exp(-least(30, greatest(-30, s_acctbal / 100)))), 9) as chance from supplier",
}
