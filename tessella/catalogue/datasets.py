"""Reshaping, splits, balancing, negatives, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.operators import dataset as D
from tessella.operators import terms as G


@query("q_melt", "R01 R03", "select o_orderkey, 'status' as prefix, o_orderstatus as target_text from orders union all select o_orderkey, 'priority', o_orderpriority from orders")
def q_melt(t: Tables) -> DataFrame:
    return D.turn_columns(t("orders"), {"o_orderstatus": "status", "o_orderpriority": "priority"}, ["o_orderkey"])


@query("q_pivot", "R02 R04 J06", "select l_orderkey, min(l_shipdate_s) filter (where l_returnflag = 'R') as returned, min(l_shipdate_s) filter (where l_returnflag = 'N') as kept from (select *, strftime(l_shipdate, '%Y-%m-%d') as l_shipdate_s from lineitem) where l_returnflag in ('R', 'N') group by 1")
def q_pivot(t: Tables) -> DataFrame:
    long = t("lineitem").select("l_orderkey", F.col("l_returnflag").alias("prefix"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("target_text"))
    return D.turn_prefixes(long, {"R": "returned", "N": "kept"}, ["l_orderkey"])


@query("q_pivot_multi", "R04", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F_n\", max(o_totalprice) filter (where o_orderstatus = 'F') as \"F_top\", count(*) filter (where o_orderstatus = 'O') as \"O_n\", max(o_totalprice) filter (where o_orderstatus = 'O') as \"O_top\" from orders group by 1")
def q_pivot_multi(t: Tables) -> DataFrame:
    return D.pivot(t("orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], {"n": F.count(F.lit(1)), "top": F.max("o_totalprice")}).fillna(0, ["F_n", "O_n"])


@query("q_explode_delim", "R05", "select news_id, p from (select rec_id as news_id, unnest(coalesce(case when len(paragraphs) = 0 then null else paragraphs end, [null])) as p from news_body)")
def q_explode_delim(t: Tables) -> DataFrame:
    return t("news_body").select(F.col("rec_id").alias("news_id"), F.explode_outer("paragraphs").alias("p"))


@query("q_split_expand", "R06", "select p_partkey, split_part(p_type, ' ', 1) as a, nullif(split_part(p_type, ' ', 2), '') as b from part where len(string_split(p_type, ' ')) <= 3")
def q_split_expand(t: Tables) -> DataFrame:
    return D.split_expand(t("part").where(F.size(F.split("p_type", " ")) <= 3), "p_type", " ", ["a", "b", "c"]).select("p_partkey", "a", "b")


@query("q_hash_split", "R07", "with d as (select o_orderkey, row_number() over (order by md5(o_orderkey || ':0'), cast(o_orderkey as varchar)) as k, least(8000, floor(count(*) over () * 0.2)) as w from orders) select o_orderkey, case when k <= w then 'eval' else 'train' end as split from d")
def q_hash_split(t: Tables) -> DataFrame:
    return D.random_split(t("orders"), "o_orderkey").select("o_orderkey", "split")


@query("q_stratified_split", "R08 R22", "select o_orderkey, case when ('0x' || left(md5(o_orderkey || ':' || o_orderpriority || ':0'), 8))::bigint / 4294967296.0 < 0.2 then 'eval' else 'train' end as split from orders")
def q_stratified_split(t: Tables) -> DataFrame:
    return D.stratified_split(t("orders"), "o_orderkey", ["o_orderpriority"]).select("o_orderkey", "split")


_BALANCE = """with d as (select p_partkey, p_size, row_number() over (partition by p_size order by left(md5(p_partkey || ':0'), 2), md5(p_partkey || ':0'), cast(p_partkey as varchar)) as k from part), n as (select p_size, count(*) as n from part group by 1), m as (select {goal} as target from n)
select p_partkey, p_size, unnest(range(0, cast(target // n + case when k <= target % n then 1 else 0 end as bigint))) as copy from d join n using (p_size) cross join m"""


@query("q_balance_max", "R09 R10 R11 R16", _BALANCE.format(goal="max(n)"))
def q_balance_max(t: Tables) -> DataFrame:
    return D.balance(t("part").select("p_partkey", "p_size"), "p_size", "p_partkey")


@query("q_balance_geometric", "R10 A25", _BALANCE.format(goal="round(exp(avg(ln(n))))::bigint"))
def q_balance_geometric(t: Tables) -> DataFrame:
    return D.balance(t("part").select("p_partkey", "p_size"), "p_size", "p_partkey", how="geometric")


@query("q_balance_levels", "R12 R13 R14 R35", "with s as (select o_orderpriority, o_orderstatus = 'P' as empty, count(*) as n from orders group by 1, 2), t as (select o_orderpriority, empty, max(n) over (partition by o_orderpriority) as hi, min(n) over (partition by o_orderpriority) as lo from s) select o_orderpriority, empty, cast(case when hi < 5.0 * lo then hi else round((hi + lo) / 2) end as bigint) as n from t")
def q_balance_levels(t: Tables) -> DataFrame:
    d = t("orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "P").alias("empty"))
    return D.balance_two_levels(d, "o_orderpriority", "empty", "o_orderkey").groupBy("o_orderpriority", "empty").agg(F.count("*").alias("n"))


@query("q_tiered_sample", "R15", "with d as (select p_partkey, p_type, count(*) over (partition by p_type) as n, row_number() over (partition by p_type order by md5(p_partkey || ':0'), cast(p_partkey as varchar)) as k from part) select p_partkey, p_type from d where k <= case when n <= 20 then 1 when n <= 50 then 2 when n <= 100 then 4 else floor(n * 0.05) end")
def q_tiered_sample(t: Tables) -> DataFrame:
    return D.tiered_sample(t("part").select("p_partkey", "p_type"), "p_type", "p_partkey")


@query("q_negative_pairs", "R17", "with l as (select distinct o_orderpriority as o from orders), r as (select o_orderkey, o_orderpriority, o, row_number() over (partition by o_orderkey order by md5(o_orderkey || ':' || o || ':0'), o) as k from orders join l on o <> o_orderpriority) select o_orderkey, o_orderpriority, 1 as labels from orders union all select o_orderkey, o, 0 from r where k <= 2")
def q_negative_pairs(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_orderpriority")
    return D.negative_pairs(o, o.select("o_orderpriority").distinct(), "o_orderkey", "o_orderpriority", 2)


@query("q_fake_pairs", "R18 J11", "select a.p_brand, b.event_type from (select distinct p_brand from part) a cross join (select distinct event_type from events) b where not (a.p_brand = 'Brand#11' and b.event_type = 'view')")
def q_fake_pairs(t: Tables) -> DataFrame:
    pos = t.spark.createDataFrame([("Brand#11", "view")], "p_brand string, event_type string")
    return D.fake_pairs(t("part"), t("events"), pos, "p_brand", "event_type")


@query("q_hard_negatives", "R19 R20", "with h as (select o_custkey as q, o_orderkey as i, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders where o_orderstatus <> 'F'), r as (select *, row_number() over (partition by q order by rank) as r from h) select q, i, round(1.0 / count(*) over (partition by q), 6) as label from r where r <= 3")
def q_hard_negatives(t: Tables) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("i"), (-F.col("o_totalprice")).alias("rank0"), "o_orderstatus")
    out = D.hard_negatives(o.withColumn("rank", F.struct("rank0", "i")), o.where("o_orderstatus = 'F'"), "q", "i", 3)
    return D.soft_labels(out.select("q", "i"), "q").withColumn("label", F.round("label", 6))


@query("q_positive_pairs", "R21", "select distinct a.n_regionkey as entity, a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name")
def q_positive_pairs(t: Tables) -> DataFrame:
    return D.positive_pairs(t("nation").select(F.col("n_regionkey").alias("entity"), "n_name"), "entity", "n_name")


@query("q_dataset_stats", "R23 A21", "select o_orderpriority as prefix, count(*) as rows, count(distinct o_custkey) as texts, count(*) filter (where o_orderstatus <> '|') as positive, count(*) filter (where o_orderstatus = '|') as negative, 0::bigint as multiple from orders group by 1")
def q_dataset_stats(t: Tables) -> DataFrame:
    return D.profile(t("orders"), "o_orderpriority", "o_custkey", "o_orderstatus").withColumnRenamed("o_orderpriority", "prefix")


@query("q_one_hot", "R24", "with u as (select user_id, list(distinct event_type) as own from events where value > 80 group by 1) select user_id, array_to_string(list_transform(['click', 'error', 'purchase', 'view'], lambda x: cast(list_contains(own, x) as integer)), '') as hot from u")
def q_one_hot(t: Tables) -> DataFrame:
    own = t("events").where("value > 80").groupBy("user_id").agg(F.collect_set("event_type").alias("own"))
    return own.select("user_id", F.array_join(F.transform(D.one_hot(F.col("own"), ["click", "error", "purchase", "view"]), lambda x: x.cast("string")), "").alias("hot"))


@query("q_self_pairs", "V14", "select distinct title as a, title as b, 1 as label from news_body where title is not null and title <> ''")
def q_self_pairs(t: Tables) -> DataFrame:
    """The pairs that unsupervised contrastive training starts from: each different sentence with itself."""
    return D.self_pairs(t("news_body"), "title")


@query("q_label_map", "R25", "select p_brand, row_number() over (order by count(*) desc, p_brand) - 1 as number from part where p_brand is not null group by 1")
def q_label_map(t: Tables) -> DataFrame:
    return D.label_map(t("part"), "p_brand").withColumn("number", F.col("number").cast("bigint"))


@query("q_validate", "R26", "select count(*) as rows, count(*) filter (where text is null) as text_null, count(*) filter (where n_chars is null) as n_chars_null, count(*) filter (where trim(text, ' ') = '') as text_empty, 0::bigint as n_chars_no_int from documents")
def q_validate(t: Tables) -> DataFrame:
    return D.validate(t("documents"), ["text"], ["n_chars"])


@query("q_clean_claims", "R27", r"with n as (select main_id, claim_num from patent_claim group by 1, 2 having count(*) = 1), c as (select c.*, regexp_extract(claim_text, '^([0-9]*)', 1) as lead from patent_claim c join n on c.main_id = n.main_id and c.claim_num = n.claim_num where claim_text is not null) select claim_id, main_id, claim_num, case when lead = '' then claim_num || '. ' || claim_text else claim_text end as claim_text from c where (lead = '' or lead = cast(claim_num as varchar)) and (coalesce(claim_class_pre <> 'D', true) or trim(coalesce(claim_ref_pre, ''), ' ') <> '')")
def q_clean_claims(t: Tables) -> DataFrame:
    return D.clean_claims(t("patent_claim")).select("claim_id", "main_id", "claim_num", "claim_text")


@query("q_multi_task", "R28 F14 F05", "select news_id, 'round' as prefix, title as input_text, round as target_text from finance_news where round is not null union all select news_id, 'amount', title, amount from finance_news where amount is not null")
def q_multi_task(t: Tables) -> DataFrame:
    return D.multi_task(t("finance_news"), "news_id", {"round": F.col("round"), "amount": F.col("amount")}, "title")


@query("q_shuffle", "R29", "select o_orderkey, md5(o_orderkey || ':3') as draw from orders")
def q_shuffle(t: Tables) -> DataFrame:
    return D.shuffle(t("orders"), "o_orderkey", 3).select("o_orderkey", D.draw("o_orderkey", 3).alias("draw"))


@query("q_group_slice", "R30", "select o_orderkey, o_custkey from orders where o_custkey in (select distinct o_custkey from orders order by 1 limit 20 offset 10)")
def q_group_slice(t: Tables) -> DataFrame:
    return D.group_slice(t("orders").select("o_orderkey", "o_custkey"), "o_custkey", 10, 20)


@query("q_parent_pairs", "R31", "with l as (select l_orderkey as k, l_linenumber as n, case when l_linenumber > 1 then [l_linenumber - 1] else []::integer[] end as r from lineitem), p as (select k, n, unnest(range(1, n)) as parent, r from l) select k, n, parent, cast(list_contains(r, parent) as integer) as label from p")
def q_parent_pairs(t: Tables) -> DataFrame:
    refs = F.when(F.col("l_linenumber") > 1, F.array(F.col("l_linenumber") - 1)).otherwise(F.array().cast("array<int>"))
    rows = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), refs.alias("r"))
    return D.parent_pairs(rows, "k", "n", "r")


@query("q_triplets", "R32", "select distinct 'c' || c_custkey as anchor, 'n' || c_nationkey as positive, r_name as negative from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def q_triplets(t: Tables) -> DataFrame:
    pairs = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("anchor"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("positive"))
    edges = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    names = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("term"), F.col("r_name").alias("name"))
    return D.triplets(pairs, edges, "anchor", "positive", names)


@query("q_hierarchy_negatives", "R33", "select term, name, max(label) as label from (select 'n' || n_nationkey as term, n_name as name, 1 as label from nation union all select 'r' || r_regionkey, r_name, 1 from region union all select 'r' || n_regionkey, n_name, 0 from nation) group by 1, 2")
def q_hierarchy_negatives(t: Tables) -> DataFrame:
    edges = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    names = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("term"), F.col("n_name").alias("name")).unionByName(t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("term"), F.col("r_name").alias("name")))
    closed = G.closure(edges)
    return D.hierarchy_negatives(names, closed, G.aunts(edges, closed))


@query("q_settle_contradictions", "R34 A23", "select claim_id, case when min(y) over (partition by claim_text) <> max(y) over (partition by claim_text) then 1 else y end as y from (select claim_id, claim_text, case when claim_class_pre = 'D' then 1 else 0 end as y from patent_claim where claim_text is not null)")
def q_settle_contradictions(t: Tables) -> DataFrame:
    rows = t("patent_claim").where("claim_text is not null").select("claim_id", "claim_text", F.when(F.col("claim_class_pre") == "D", 1).otherwise(0).alias("y"))
    return D.settle_contradictions(rows, "claim_text", "y").select("claim_id", "y")


@query("q_append_version", "R36 U01", "select n_nationkey as k, case when n_nationkey % 2 = 0 then 'even' else n_name end as name from nation")
def q_append_version(t: Tables) -> DataFrame:
    old = t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return D.append_version(old, old.where("k % 2 = 0").withColumn("name", F.lit("E")), ["k"], "name", {"E": "even"})
