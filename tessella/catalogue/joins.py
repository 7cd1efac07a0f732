"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.operators import relational as R
from tessella.operators.inference import best_synonym
from tessella.sources import tables as S


@query("q_inner", "J01", "select o_orderkey, c_mktsegment from orders join customer on o_custkey = c_custkey where o_totalprice > 250000")
def q_inner(t: Tables) -> DataFrame:
    return t("orders").where("o_totalprice > 250000").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("q_natural", "J02", "with a as (select n_nationkey as k, n_name, n_regionkey as r from nation), b as (select r_regionkey as r, r_name from region) select k, r, n_name, r_name from a natural join b")
def q_natural(t: Tables) -> DataFrame:
    a = t("nation").select(F.col("n_nationkey").alias("k"), "n_name", F.col("n_regionkey").alias("r"))
    return R.natural_join(a, t("region").select(F.col("r_regionkey").alias("r"), "r_name"))


@query("q_left_composite", "J03", "select a.l_orderkey, a.l_linenumber, b.l_partkey as late_part from lineitem a left join (select * from lineitem where l_shipdate > timestamp '1997-06-01') b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber")
def q_left_composite(t: Tables) -> DataFrame:
    late = t("lineitem").where("l_shipdate > timestamp_ntz'1997-06-01'").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("late_part"))
    return t("lineitem").select("l_orderkey", "l_linenumber").join(late, ["l_orderkey", "l_linenumber"], "left")


@query("q_left_coalesce", "J04 S14", "select c.c_custkey, c.c_name, coalesce(case when c.c_custkey % 3 = 0 then 'CHECKED' end, c.c_mktsegment) as c_mktsegment from customer c")
def q_left_coalesce(t: Tables) -> DataFrame:
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    return R.coalesce_update(c, c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("CHECKED").alias("c_mktsegment")), ["c_custkey"])


@query("q_outer", "J05 J07", "with a as (select lang, count(*) as docs from documents group by 1), b as (select lang, count(*) as news from news_body group by 1) select coalesce(a.lang, b.lang) as lang, docs, news from a full join b on a.lang is not distinct from b.lang")
def q_outer(t: Tables) -> DataFrame:
    a, b = t("documents").groupBy("lang").agg(F.count("*").alias("docs")), t("news_body").groupBy("lang").agg(F.count("*").alias("news"))
    return R.null_safe_join(a, b, ["lang"])


@query("q_outer_fold", "J06", "select k, a, b, c from (select n_nationkey as k, count(*) as a from nation group by 1) full join (select c_nationkey as k, count(*) as b from customer where c_acctbal > 5000 group by 1) using (k) full join (select s_nationkey as k, count(*) as c from supplier where s_acctbal > 5000 group by 1) using (k)")
def q_outer_fold(t: Tables) -> DataFrame:
    counts = lambda df, key, name: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(name))
    return R.outer_fold([counts(t("nation"), "n_nationkey", "a"), counts(t("customer").where("c_acctbal > 5000"), "c_nationkey", "b"), counts(t("supplier").where("s_acctbal > 5000"), "s_nationkey", "c")], ["k"])


@query("q_one_to_one", "J08", "select n_nationkey as k, n_name, n_regionkey as r from nation")
def q_one_to_one(t: Tables) -> DataFrame:
    n = t("nation").withColumnRenamed("n_nationkey", "k")
    return R.one_to_one(n.select("k", "n_name"), n.select("k", F.col("n_regionkey").alias("r")), ["k"])


@query("q_semi", "J09", "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity = 50)")
def q_semi(t: Tables) -> DataFrame:
    return t("orders").join(t("lineitem").where("l_quantity = 50"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("q_anti", "J10 S15", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null and o_orderpriority = '1-URGENT')")
def q_anti(t: Tables) -> DataFrame:
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("q_cross_label", "J11 J12", "with l as (select distinct event_type as label from events), u as (select user_id, list(distinct event_type) as own from events where value > 80 group by 1) select user_id, label, cast(list_contains(own, label) as integer) as labels from u cross join l")
def q_cross_label(t: Tables) -> DataFrame:
    own = t("events").where("value > 80").groupBy("user_id").agg(F.collect_set("event_type").alias("own"))
    labels = t("events").select(F.col("event_type").alias("label")).distinct()
    return R.label_cross(own, labels, "own").select("user_id", "label", "labels")


@query("q_theta_contains", "J13 J19", "select p_partkey, c.color from part join (select distinct split_part(p_name, ' ', 1) as color from part) c on contains(p_name, c.color)")
def q_theta_contains(t: Tables) -> DataFrame:
    colors = t("part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color")).distinct()
    return R.contains_join(t("part").select("p_partkey", "p_name"), colors, "p_name", "color").select("p_partkey", "color")


@query("q_interval_week", "J14 J15 P02", "with n as (select news_id, publish_date as t, resource from finance_news where resource is not null) select a.news_id as a_id, b.news_id as b_id from n a join n b on a.resource = b.resource and a.news_id % 10 = 0 and b.t is not null and (a.t is null or (b.t > a.t - 604800000 and b.t < a.t + 604800000)) where a.news_id <> b.news_id")
def q_interval_week(t: Tables) -> DataFrame:
    n = t("finance_news").where("resource is not null")
    a = n.where("news_id % 10 = 0").select(F.col("news_id").alias("a_id"), F.col("publish_date").alias("a_t"), "resource")
    b = n.select(F.col("news_id").alias("b_id"), F.col("publish_date").alias("b_t"), "resource")
    return R.within_window(a, b, ["resource"], "a_t", "b_t").where("a_id <> b_id").select("a_id", "b_id")


@query("q_as_of", "J14", "select e.event_id, p.event_id as purchase_id from events e asof left join (select user_id as u, ts as pt, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2) p on e.user_id = p.u and e.ts >= p.pt where e.event_type = 'view'")
def q_as_of(t: Tables) -> DataFrame:
    e = t("events")
    right = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("pt")).agg(F.max("event_id").alias("purchase_id"))
    return R.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "pt", ["purchase_id"]).select("event_id", "purchase_id")


@query("q_best_synonym", "J17 N10 V16 C24")
def q_best_synonym(t: Tables) -> DataFrame:
    names = t("customer").select("c_custkey", "c_mktsegment")
    words = t("nation").select(F.col("n_nationkey").alias("term"), F.col("n_name").alias("name"))
    return best_synonym(names, words, "c_custkey", "c_mktsegment")


@query("q_inclusive_filter", "J18", "select c.c_custkey, s.s_suppkey from customer c join supplier s on c.c_nationkey = s.s_nationkey and (s.s_acctbal < 0 or s.s_acctbal > 9000)")
def q_inclusive_filter(t: Tables) -> DataFrame:
    s = t("supplier").withColumn("bal", F.when(F.col("s_acctbal").between(0, 9000), F.lit("mid")))
    both = t("customer").join(s, F.col("c_nationkey") == F.col("s_nationkey"))
    return both.where(F.coalesce(F.col("bal") == "none", F.lit(True))).select("c_custkey", "s_suppkey")


@query("q_resolve_ids", "S35 N08", "select news_id, coalesce(c.short_name, n.company) as company from finance_news n left join company c on n.company = c.id")
def q_resolve_ids(t: Tables) -> DataFrame:
    return R.resolve_ids(t("finance_news").select("news_id", "company"), "company", t("company"), "id", "short_name")


@query("q_first_source", "S09", "select esid, coalesce(min(t1), min(t2)) as title from (select esid, min(title) as t1, null as t2 from finance_news where esid is not null group by 1 union all select esid, null, min(title) from news_body where esid is not null group by 1) group by 1")
def q_first_source(t: Tables) -> DataFrame:
    best = lambda df: df.where("esid is not null").groupBy("esid").agg(F.min("title").alias("title"))
    a, b = best(t("finance_news")), best(t("news_body"))
    return R.first_source(a.select("esid").unionByName(b.select("esid")), "esid", [a, b], "title")


@query("q_lookup_titles", "S10", "with q as (select distinct title as asked, lower(regexp_replace(title, '[^\\p{L}\\p{N}]+', '', 'g')) as p from news_body where rec_id % 20 = 0 and title is not null) select rec_id, asked from news_body n join q on lower(regexp_replace(n.title, '[^\\p{L}\\p{N}]+', '', 'g')) = q.p")
def q_lookup_titles(t: Tables) -> DataFrame:
    n = t("news_body")
    return S.lookup_titles(n, n.where("rec_id % 20 = 0 and title is not null").select("title")).select("rec_id", "asked")


@query("q_union_by_name", "U01", "select c_custkey as id, c_nationkey as nation, c_mktsegment as segment from customer union all select s_suppkey, s_nationkey, null from supplier")
def q_union_by_name(t: Tables) -> DataFrame:
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return R.union_all(c, t("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id")))


@query("q_distinct", "U02", "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem")
def q_distinct(t: Tables) -> DataFrame:
    return t("lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("q_set_ops", "U03 U05", "select o_custkey from orders where o_orderpriority = '1-URGENT' intersect select o_custkey from orders where o_orderpriority = '5-LOW' except select o_custkey from orders where o_orderstatus = 'P'")
def q_set_ops(t: Tables) -> DataFrame:
    o = t("orders")
    pick = lambda c: o.where(c).select("o_custkey")
    return pick("o_orderpriority = '1-URGENT'").intersect(pick("o_orderpriority = '5-LOW'")).subtract(pick("o_orderstatus = 'P'"))


@query("q_overlap_sets", "U04 B07", "with s as (select user_id, string_agg(distinct event_type, '&' order by event_type) as groups from events where value > 90 group by 1) select groups, count(*) as n from s group by 1")
def q_overlap_sets(t: Tables) -> DataFrame:
    return R.overlap_counts(t("events").where("value > 90"), "user_id", "event_type")


@query("q_subset", "U06 M04", "select a.o_custkey from (select o_custkey, list(distinct o_orderpriority) as p from orders group by 1) a where list_has_all(p, ['1-URGENT', '2-HIGH', '5-LOW'])")
def q_subset(t: Tables) -> DataFrame:
    p = t("orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return p.where(F.size(F.array_except(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW")), "p")) == 0).select("o_custkey")


@query("q_merge_results", "U07", "select event_id as id, value from events where event_type = 'error' union all select event_id, value from events where event_type = 'purchase' and value > 50")
def q_merge_results(t: Tables) -> DataFrame:
    e = t("events")
    return S.union_of([e.where("event_type = 'error'").select(F.col("event_id").alias("id"), "value"), e.where("event_type = 'purchase' and value > 50").select(F.col("event_id").alias("id"), "value")], F.asc("value"))


@query("q_drop_contained", "U08 K12", "with w as (select o_orderkey as k, [o_orderpriority, split_part(o_orderpriority, '-', 2), o_orderstatus] as a from orders) select k, array_to_string(list_filter(a, lambda x: not list_contains(list_transform(a, lambda y: y <> x and contains(y, x)), true)), '|') as kept from w")
def q_drop_contained(t: Tables) -> DataFrame:
    a = F.array("o_orderpriority", F.split_part("o_orderpriority", F.lit("-"), F.lit(2)), "o_orderstatus")
    return t("orders").select(F.col("o_orderkey").alias("k"), F.array_join(R.drop_contained(a), "|").alias("kept"))


@query("q_drop_token_subsets", "U09", "with w as (select p_partkey, p_name, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) as turned, p_brand from part) select p_partkey, case when turned = p_name then p_name || '|' || p_name else least(p_name, turned) end || '|' || p_brand as kept from w")
def q_drop_token_subsets(t: Tables) -> DataFrame:
    a = F.array("p_name", F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))), "p_brand")
    return t("part").select("p_partkey", F.array_join(R.drop_token_subsets(a), "|").alias("kept"))


@query("q_upsert", "S13 S16 S17 S18 S36", "select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 11 <> 0 union all select -o_orderkey - 1, 'N' from orders where o_orderkey % 1000 = 0")
def q_upsert(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_orderstatus")
    ops = R.union_all(
        o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit("update").alias("op"), F.lit(1).alias("seq")),
        o.where("o_orderkey % 11 = 0").select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), F.lit("delete").alias("op"), F.lit(2).alias("seq")),
        o.where("o_orderkey % 1000 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), F.lit("upsert").alias("op"), F.lit(1).alias("seq")),
    )
    return S.bulk(o, ops, "o_orderkey")[0]
