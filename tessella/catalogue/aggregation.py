"""Metric and bucket aggregations, windows and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.operators import relational as R
from tessella.plans import aggregates as A
from tessella.plans.query import Op, where


@query("q_metric_agg", "A01 A07", "select l_returnflag, round(avg(l_quantity), 6) as avg_qty, max(l_extendedprice) as max_price, min(l_discount) as min_disc, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(l_tax) as n_tax, count(*) as doc_count from lineitem group by 1")
def q_metric_agg(t: Tables) -> DataFrame:
    df = t("lineitem").withColumn("net", F.expr("l_extendedprice * (1 - l_discount)"))
    out = A.terms(df, "l_returnflag", [A.metric("avg", "l_quantity").alias("avg_qty"), A.metric("max", "l_extendedprice").alias("max_price"), A.metric("min", "l_discount").alias("min_disc"), A.metric("sum", "net").alias("revenue"), A.metric("value_count", "l_tax").alias("n_tax")])
    return out.withColumns({"avg_qty": F.round("avg_qty", 6), "revenue": F.round("revenue", 2)})


@query("q_value_count_array", "A01", "select lang, coalesce(sum(len(paragraphs)), 0)::bigint as n from news_body where lang is not null group by 1")
def q_value_count_array(t: Tables) -> DataFrame:
    return A.terms(t("news_body"), "lang", [A.metric("value_count", "paragraphs", array=True).alias("n")]).drop("doc_count")


@query("q_count_distinct", "A02", "select o_orderpriority, count(distinct o_custkey) as customers from orders group by 1")
def q_count_distinct(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_orderpriority").agg(A.metric("count_distinct", "o_custkey").alias("customers"))


@query("q_count_distinct_approx", "A02")
def q_count_distinct_approx(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag").agg(A.metric("count_distinct", "l_partkey", approximate=True).alias("parts"))


@query("q_percentiles", "A03", "select event_type, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(median(value), 6) as med from events group by 1")
def q_percentiles(t: Tables) -> DataFrame:
    out = t("events").groupBy("event_type").agg(A.metric("percentiles", "value", percentiles=(25, 50, 90)).alias("p"), A.metric("median", "value").alias("m"))
    return out.select("event_type", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p25", "p50", "p90"))], F.round("m", 6).alias("med"))


@query("q_max_other", "A04", "select o_custkey, arg_min(o_orderkey, struct_pack(a := -o_totalprice, b := o_orderkey)) as dearest from orders group by 1")
def q_max_other(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(A.metric("max_other", "o_totalprice", "o_orderkey").alias("dearest"))


@query("q_min_other", "A04", "select resource, arg_min(company, struct_pack(a := publish_date, b := company)) as first_company from finance_news where company is not null and publish_date is not null and resource is not null group by 1")
def q_min_other(t: Tables) -> DataFrame:
    return t("finance_news").where("resource is not null").groupBy("resource").agg(A.metric("min_other", "publish_date", "company").alias("first_company")).where("first_company is not null")


@query("q_terms_topn", "A05 A10", "select p_brand, count(*) as doc_count from part where regexp_full_match(p_brand, 'Brand#[1-3].') and p_brand not in ('Brand#11') group by 1 order by doc_count desc, p_brand limit 8")
def q_terms_topn(t: Tables) -> DataFrame:
    return A.terms(t("part"), "p_brand", size=8, include="Brand#[1-3].", exclude=["Brand#11"])


@query("q_terms_order_metric", "A05 A10", "select p_type, count(*) as doc_count, round(avg(p_retailprice), 4) as price from part group by 1 order by avg(p_retailprice) desc, p_type limit 10")
def q_terms_order_metric(t: Tables) -> DataFrame:
    return A.terms(t("part"), "p_type", [F.avg("p_retailprice").alias("price")], size=10, order=(("price", "desc"),)).withColumn("price", F.round("price", 4))


@query("q_terms_missing", "A05", "select coalesce(round, 'none') as round, count(*) as doc_count from finance_news group by 1")
def q_terms_missing(t: Tables) -> DataFrame:
    return A.terms(t("finance_news"), "round", missing="none")


@query("q_terms_partition", "A05")
def q_terms_partition(t: Tables) -> DataFrame:
    return t("customer").where(A.bucket_filter("c_mktsegment", partition=(0, 2))).groupBy("c_mktsegment").agg(F.count("*").alias("doc_count"))


@query("q_keys_only", "A06", "select distinct o_orderpriority from orders where o_orderpriority is not null")
def q_keys_only(t: Tables) -> DataFrame:
    return A.terms(t("orders"), "o_orderpriority").select("o_orderpriority")


@query("q_composite_page", "A08 A13", "select l_returnflag, l_linestatus, l_linenumber, count(*) as doc_count, sum(l_quantity) as qty from lineitem group by 1, 2, 3 having (l_returnflag, l_linestatus, l_linenumber) > ('N', 'F', 3) order by 1, 2, 3 limit 6")
def q_composite_page(t: Tables) -> DataFrame:
    return A.composite(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], [F.sum("l_quantity").alias("qty")], after=["N", "F", 3], size=6)


@query("q_composite_all", "A08 A11 A13", "select resource, round, count(*) as doc_count from finance_news where resource is not null and round is not null group by 1, 2")
def q_composite_all(t: Tables) -> DataFrame:
    return A.composite(t("finance_news"), ["resource", "round"])


@query(
    "q_nested_terms_topn", "A09 W06",
    """
    with c as (select o_orderpriority, o_custkey, count(*) as doc_count from orders group by 1, 2),
    a as (select o_orderpriority, row_number() over (order by sum(doc_count) desc, o_orderpriority) as r from c group by 1),
    b as (select *, row_number() over (partition by o_orderpriority order by doc_count desc, o_custkey) as r from c)
    select b.o_orderpriority, b.o_custkey, b.doc_count from b join a using (o_orderpriority) where a.r <= 3 and b.r <= 4
    """,
)
def q_nested_terms_topn(t: Tables) -> DataFrame:
    return A.nested_terms(t("orders"), [("o_orderpriority", 3), ("o_custkey", 4)])


@query("q_bucket_page", "A12", "select o_custkey, count(*) as doc_count, round(sum(o_totalprice), 2) as spent from orders where o_orderstatus <> 'P' group by 1 order by sum(o_totalprice) desc, o_custkey limit 15 offset 10")
def q_bucket_page(t: Tables) -> DataFrame:
    buckets = A.terms(t("orders"), "o_custkey", [F.sum("o_totalprice").alias("spent")], query=where(Op.NE, "o_orderstatus", "P"))
    return A.paged(buckets, (("spent", "desc"), "o_custkey"), 10, 15).withColumn("spent", F.round("spent", 2))


@query("q_date_histogram", "A14", "select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, count(*) as doc_count, round(sum(o_totalprice), 2) as total from orders group by 1")
def q_date_histogram(t: Tables) -> DataFrame:
    return A.date_histogram(t("orders"), "o_orderdate", "month", [F.round(F.sum("o_totalprice"), 2).alias("total")]).select(F.date_format("bucket", "yyyy-MM-dd").alias("month"), "doc_count", "total")


@query("q_filter_aggs", "A14", "select count(*) filter (where o_totalprice > 300000) as dear, count(*) filter (where o_orderpriority = '1-URGENT') as urgent, count(*) filter (where o_orderstatus = 'Z') as none from orders")
def q_filter_aggs(t: Tables) -> DataFrame:
    return A.filters(t("orders"), {"dear": where(Op.GT, "o_totalprice", 300000), "urgent": where(Op.EQ, "o_orderpriority", "1-URGENT"), "none": where(Op.EQ, "o_orderstatus", "Z")})


@query("q_nested_agg", "A14", "select l_returnflag, count(*) as n, count(distinct o_orderkey) as docs from orders join lineitem on l_orderkey = o_orderkey where o_orderpriority = '2-HIGH' group by 1")
def q_nested_agg(t: Tables) -> DataFrame:
    docs = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("lines"))
    d = t("orders").where("o_orderpriority = '2-HIGH'").join(docs, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "lines")
    return A.nested(d, "lines", ["o_orderkey"]).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("docs"))


@query("q_group_many", "A15 A19 A20", "select user_id, count(*) as n, count(distinct event_type) as kinds, max(value) as top, min(event_id) as first_id, string_agg(event_type, '|' order by ts, event_id) as trail from events group by 1")
def q_group_many(t: Tables) -> DataFrame:
    e = t("events")
    base = e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.max("value").alias("top"), F.min("event_id").alias("first_id"))
    return base.join(A.ordered_concat(e, ["user_id"], "event_type", ["ts", "event_id"], into="trail"), "user_id")


@query("q_min_label", "A16", "select vec_id % 20 as article, min(label) as label from embeddings group by 1")
def q_min_label(t: Tables) -> DataFrame:
    return t("embeddings").groupBy((F.col("vec_id") % 20).alias("article")).agg(F.min("label").alias("label"))


@query("q_value_counts_pct", "A17 W07", "select lang, count(*) as count, round(100.0 * count(*) / sum(count(*)) over (), 4) as percent from documents group by 1")
def q_value_counts_pct(t: Tables) -> DataFrame:
    return A.value_counts(t("documents"), "lang")


@query("q_sorted_list", "A18", "select l_orderkey, array_to_string(list_sort(list(distinct l_partkey)), ',') as parts from lineitem group by 1")
def q_sorted_list(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",").alias("parts"))


@query("q_profile", "A21", "select coalesce(kind, '') as kind, count(*) as rows, count(distinct md5(text)) as texts, count(*) filter (where lang is null) as unlabelled, grouping(kind) as total from documents group by grouping sets ((kind), ())")
def q_profile(t: Tables) -> DataFrame:
    out = t("documents").withColumn("h", F.md5("text")).rollup("kind").agg(F.count("*").alias("rows"), F.count_distinct("h").alias("texts"), F.count_if(F.col("lang").isNull()).alias("unlabelled"), F.grouping("kind").cast("bigint").alias("total"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("")))


@query("q_group_all", "A22", "select l_orderkey, bool_and(coalesce(l_quantity >= 5, false)) as holds from lineitem group by 1")
def q_group_all(t: Tables) -> DataFrame:
    return A.all_in_group(t("lineitem"), "l_orderkey", F.col("l_quantity") >= 5)


@query("q_contradict", "A23", "select claim_id, claim_text, claim_class_pre from patent_claim where claim_text in (select claim_text from patent_claim group by 1 having count(distinct claim_class_pre) > 1)")
def q_contradict(t: Tables) -> DataFrame:
    return A.contradictory(t("patent_claim"), "claim_text", "claim_class_pre").select("claim_id", "claim_text", "claim_class_pre")


@query("q_sound_groups", "A24", "select main_id, claim_num, claim_id from patent_claim where main_id in (select main_id from (select main_id, claim_num, count(*) as n from patent_claim group by 1, 2) group by 1 having max(n) = 1)")
def q_sound_groups(t: Tables) -> DataFrame:
    return A.sound_groups(t("patent_claim"), "main_id", "claim_num").select("main_id", "claim_num", "claim_id")


@query("q_geometric_mean", "A25", "select round(exp(avg(ln(n))), 6) as gmean from (select count(*) as n from orders group by o_custkey)")
def q_geometric_mean(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.round(A.geometric_mean(F.col("n")), 6).alias("gmean"))


@query("q_pivot_mean", "A26 R04", "select o_orderpriority, round(avg(o_totalprice) filter (where o_orderstatus = 'F'), 4) as \"F\", round(avg(o_totalprice) filter (where o_orderstatus = 'O'), 4) as \"O\", round(avg(o_totalprice) filter (where o_orderstatus = 'P'), 4) as \"P\" from orders group by 1")
def q_pivot_mean(t: Tables) -> DataFrame:
    return t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("q_cube", "A28", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem group by cube (l_returnflag, l_linestatus)")
def q_cube(t: Tables) -> DataFrame:
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("q_rollup", "A28", "select n_regionkey, n_nationkey, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by rollup (n_regionkey, n_nationkey)")
def q_rollup(t: Tables) -> DataFrame:
    return t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("customers"))


@query("q_islands", "W04 C08", "with d as (select distinct l_orderkey, l_linenumber from lineitem where l_quantity > 15), i as (select *, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as g from d) select l_orderkey, min(l_linenumber) as lo, max(l_linenumber) as hi from i group by l_orderkey, g")
def q_islands(t: Tables) -> DataFrame:
    return R.islands(t("lineitem").where("l_quantity > 15"), ["l_orderkey"], "l_linenumber")


@query("q_first_per_key", "W05 S11", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey) as r from orders) where r = 1")
def q_first_per_key(t: Tables) -> DataFrame:
    return R.first_per_key(t("orders"), ["o_custkey"], [("o_orderdate", "desc"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("q_top_per_group", "W06", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) where r <= 3")
def q_top_per_group(t: Tables) -> DataFrame:
    return R.first_per_key(t("part"), ["p_brand"], [("p_retailprice", "desc"), "p_partkey"], 3).select("p_brand", "p_partkey")


@query("q_argmax", "W09", "select c_nationkey, max_by(c_custkey, struct_pack(a := c_acctbal, b := c_custkey)) as richest from customer group by 1")
def q_argmax(t: Tables) -> DataFrame:
    return t("customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("richest"))


@query("q_differences", "W02 W03 W08", "select event_id, round(value - lag(value) over w, 6) as step, lead(event_type) over w as next_type from events window w as (partition by user_id order by ts, event_id)")
def q_differences(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("step"), F.lead("event_type").over(w).alias("next_type"))


@query("q_spatial_sort", "T09 T10", "select page_id, row_number() over (partition by pdf_name order by (case when x0_t >= width / 2 * 1.05 then 1 else 0 end), y0_t, x0_t, page_id) as pos from title_page where x0_t is not null")
def q_spatial_sort(t: Tables) -> DataFrame:
    right = F.when(F.col("x0_t") >= F.col("width") / 2 * 1.05, 1).otherwise(0)
    w = Window.partitionBy("pdf_name").orderBy(right, "y0_t", "x0_t", "page_id")
    return t("title_page").where("x0_t is not null").select("page_id", F.row_number().over(w).alias("pos"))
