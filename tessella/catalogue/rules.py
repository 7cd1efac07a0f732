"""Rules over records, and round trips through files."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.catalogue.similarity import HEAD_ORDER
from tessella.functions.text import remove_controls
from tessella.operators import documents as D
from tessella.operators import inference as I
from tessella.operators import rules as R
from tessella.plans.query import Op, exact_one, where
from tessella.plans.runtime import scratch
from tessella.sources import tables as S
from tessella.streaming import streams as Z


@query("q_exact_one", "P24 S04", "select o_orderkey, o_totalprice from orders where o_orderkey = (select min(o_orderkey) from orders where o_orderkey > 0)")
def q_exact_one(t: Tables) -> DataFrame:
    o = t("orders")
    first = o.where("o_orderkey > 0").agg(F.min("o_orderkey")).first()[0]
    row = exact_one(o.groupBy("o_orderkey").agg(F.first("o_totalprice").alias("o_totalprice")), where(Op.EQ, "o_orderkey", first))
    return t.spark.createDataFrame([(row["o_orderkey"], row["o_totalprice"])], "o_orderkey bigint, o_totalprice double")


@query("q_is_head", "P25", "select news_id from finance_news where similar_esid is null or similar_esid = esid")
def q_is_head(t: Tables) -> DataFrame:
    return t("finance_news").where(R.is_head()).select("news_id")


@query("q_frame_predicates", "P26", "select p_partkey from part where (contains(p_name, 'ro') or starts_with(p_type, 'STANDARD')) and regexp_full_match(p_brand, 'Brand#\\d[1-3]') and p_size <> 7 and p_name is not null")
def q_frame_predicates(t: Tables) -> DataFrame:
    return t("part").where((F.contains("p_name", F.lit("ro")) | F.startswith("p_type", F.lit("STANDARD"))) & R.full_match(F.col("p_brand"), r"Brand#\d[1-3]") & (F.col("p_size") != 7) & F.col("p_name").isNotNull()).select("p_partkey")


@query("q_where_mask", "P27", "select news_id, case when is_new = '1' then round end as kept, case when coalesce(is_new = '1', false) then 'x' else amount end as masked from finance_news")
def q_where_mask(t: Tables) -> DataFrame:
    return t("finance_news").select("news_id", R.keep_where(F.col("round"), F.col("is_new") == "1").alias("kept"), R.mask_where(F.col("amount"), F.col("is_new") == "1", "x").alias("masked"))


@query("q_rename_map", "P28", "select o_orderkey as key, cast(o_custkey as varchar) as customer, case o_orderstatus when 'O' then 1 when 'F' then 2 end as status from orders")
def q_rename_map(t: Tables) -> DataFrame:
    return t("orders").withColumnsRenamed({"o_orderkey": "key"}).select("key", F.col("o_custkey").cast("string").alias("customer"), R.mapped(F.col("o_orderstatus"), {"O": 1, "F": 2}).alias("status"))


@query("q_language_filter", "P29")
def q_language_filter(t: Tables) -> DataFrame:
    return R.language_filter(t("documents"), "text", ["ja", "ru", "fr"]).select("doc_id")


@query("q_mentions", "P30", "select n.news_id, string_agg(distinct c.id, '|' order by c.id) as names from finance_news n join company c on contains(n.title, c.short_name) group by 1")
def q_mentions(t: Tables) -> DataFrame:
    return R.mentions(t("finance_news"), t("company"), "news_id", "title", "id", ["short_name"]).select("news_id", F.array_join("names", "|").alias("names"))


@query("q_cascade", "P31", "select news_id, case when contains(title, '产业') then 0 when resource = '医药魔方' then 1 else length(title) % 2 end as label from finance_news")
def q_cascade(t: Tables) -> DataFrame:
    return t("finance_news").select("news_id", R.cascade([(F.contains("title", F.lit("产业")), 0), (F.col("resource") == "医药魔方", 1)], F.length("title") % 2).alias("label"))


@query("q_taxonomy", "P32", "select doc_id, case when kind in ('news', 'trial') then kind else 'other' end as first, case when (kind = 'news' and lang in ('en', 'zh')) or (kind = 'trial' and lang = 'en') then lang else 'other' end as second from documents")
def q_taxonomy(t: Tables) -> DataFrame:
    v = R.valid_label(F.col("kind"), F.col("lang"), {"news": ["en", "zh"], "trial": ["en"]})
    return t("documents").select("doc_id", v["first"].alias("first"), v["second"].alias("second"))


@query("q_name_tokens", "P33")
def q_name_tokens(t: Tables) -> DataFrame:
    return t("title_page").where("text is not null").select("page_id", F.array_join(R.name_tokens(F.split("text", r"\s+")), " ").alias("names"))


@query("q_translate_flow", "K18", "select doc_id, md5(upper(text)) as h from documents where text is not null and text <> '' and not regexp_matches(text, '[^\\x00-\\x7f]')")
def q_translate_flow(t: Tables) -> DataFrame:
    d = t("documents").where("text is not null and text <> ''").where(~F.regexp_like("text", F.lit(r"[^\x00-\x7f]")))
    out = R.translated(d.select("doc_id", "text"), "doc_id", "text", F.lit("en"), lambda s: s.str.upper())
    return out.select("doc_id", F.md5("text").alias("h"))


@query("q_requests", "Z05 F01", "select n_nationkey, lower(n_name) as answer from nation")
def q_requests(t: Tables) -> DataFrame:
    return R.requests(t("nation").select("n_nationkey", "n_name"), "n_name", str.lower, "answer").select("n_nationkey", "answer")


@query("q_versions", "F13", "select r_regionkey, r_name || '!' as r_name from region")
def q_versions(t: Tables) -> DataFrame:
    I.VERSIONS.setdefault("v1", lambda df: df.withColumn("r_name", F.concat("r_name", F.lit("!"))))
    return I.VERSIONS["v1"](t("region")).select("r_regionkey", "r_name")


_GROUP = "case when coalesce(company <> '' and round <> '' and amount <> '', false) then company || chr(1) || round || chr(1) || amount else chr(2) || e end"
_LATE = "news_id % 2 = 1"


@query(
    "q_head_changes",
    "Z02 V12",
    f"""with n as (select *, lpad(cast(news_id as varchar), 12, '0') as e from finance_news), g as (select *, {_GROUP} as grp, coalesce({_LATE}, false) as late from n),
    b as (select e, first_value(e) over (partition by grp order by {HEAD_ORDER}) as was from g where not late), a as (select e, first_value(e) over (partition by grp order by {HEAD_ORDER}) as head from g)
    select a.e as esid, a.head, b.was from a join b on a.e = b.e where a.head <> b.was""",
)
def q_head_changes(t: Tables) -> DataFrame:
    """Heads after a late batch (every other news): news whose head is another one than before it."""
    from tessella.operators.similar import elect_heads

    n = t("finance_news").withColumn("esid", F.lpad(F.col("news_id").cast("string"), 12, "0"))
    before = elect_heads(n.where(f"not coalesce({_LATE}, false)")).select("esid", F.col("head").alias("was"))
    return elect_heads(n).select("esid", "head").join(before, "esid").where("head <> was")


# ------------------------------------------------------------------ files


@query("q_json_round_trip", "S20 S25 S26 S36", "select n_nationkey, n_name, n_regionkey from nation where n_nationkey % 2 = 0")
def q_json_round_trip(t: Tables) -> DataFrame:
    n = t("nation")
    return S.migrate(n, n.where("n_nationkey % 2 = 0").select("n_nationkey"), "n_nationkey", scratch(t.spark))


@query("q_csv_round_trip", "S24 X01", "select news_id, title, round from finance_news where news_id is not null")
def q_csv_round_trip(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    n = t("finance_news").where("news_id is not null").select("news_id", remove_controls(F.col("title")).alias("title"), "round")
    S.write_delimited(n, path, "|")
    return S.read_delimited(t.spark, path, n.schema, "|")


@query("q_sheets", "S21 S22", "select n_nationkey, n_name from nation")
def q_sheets(t: Tables) -> DataFrame:
    folder = scratch(t.spark)
    n = t("nation").select("n_nationkey", "n_name")
    S.write_sheet(n, folder, "nations")
    S.write_sheet(t("region"), folder, "regions")
    return S.read_sheets(t.spark, folder, "nations", schema=n.schema)


@query("q_versioned_store", "S23 S33 S19", "select c_custkey, c_mktsegment from customer")
def q_versioned_store(t: Tables) -> DataFrame:
    root = scratch(t.spark)
    c = t("customer").select("c_custkey", "c_mktsegment")
    S.save_dataset(c.where("c_custkey % 2 = 0"), root, "v1", "even")
    S.save_dataset(c.where("c_custkey % 2 = 1"), root, "v1", "odd")
    kept = S.pulled(t.spark, f"{root}/kept", lambda: S.load_dataset(t.spark, root, "v1", "even").unionByName(S.load_dataset(t.spark, root, "v1", "odd")))
    return kept.select("c_custkey", "c_mktsegment")


@query("q_xml_entries", "S27 S28 S29 C28", "select n_name as accession, md5(n_name) as esid, 'set ' || n_regionkey as dataset from nation")
def q_xml_entries(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    rows = t("nation").select(F.concat(F.lit("set "), F.col("n_regionkey").cast("string")).alias("_dataset"), F.array("n_name").alias("accession"))
    rows.write.format("xml").option("rootTag", "entries").option("rowTag", "entry").save(path)
    return D.project_entries(D.read_entries(t.spark, path)).select("accession", "esid", "dataset")


@query("q_list_files", "S30", "select 1 as n_tables")
def q_list_files(t: Tables) -> DataFrame:
    return S.list_files(t.spark, t.directory, "nation.parquet").agg(F.least(F.count("*"), F.lit(1)).cast("int").alias("n_tables"))


@query("q_batches", "S03 S07", "select count(*) as seen, cast(sum(o_orderkey) as bigint) as keys from orders")
def q_batches(t: Tables) -> DataFrame:
    keys = t.spark.sparkContext.accumulator(0)

    def see(batches) -> None:
        for batch in batches:
            keys.add(int(batch["o_orderkey"].sum()))

    seen = S.for_each_partition(t("orders").select("o_orderkey"), see)
    return t.spark.createDataFrame([(seen, keys.value)], "seen bigint, keys bigint")


@query("q_unzip", "S31 S30", "select n_nationkey, n_name from nation")
def q_unzip(t: Tables) -> DataFrame:
    """Archives in archives, as they come from a download: packed here, unpacked below the shared folder, read by extension."""
    packed = scratch(t.spark).removeprefix("file:")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("sub/nations.csv", t("nation").select("n_nationkey", "n_name").toPandas().to_csv(index=False, header=False, sep="|"))
    Path(packed).mkdir(parents=True)
    with zipfile.ZipFile(f"{packed}/outer.zip", "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("readme.txt", "no table")
    S.unzip(packed, f"{packed}/out")
    files = [r.path for r in S.list_files(t.spark, f"{packed}/out", "*.csv").select("path").collect()]
    return t.spark.read.schema("n_nationkey bigint, n_name string").option("sep", "|").csv(files)


@query("q_resumed_slices", "Z04", "select o_orderkey, o_totalprice * 2 as doubled from orders")
def q_resumed_slices(t: Tables) -> DataFrame:
    return Z.slices(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 3, lambda df: df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled")), scratch(t.spark))


@query("q_length_batches", "T08", "select doc_id, length(text) as n from documents where text is not null")
def q_length_batches(t: Tables) -> DataFrame:
    """Rows sorted by length within a task for a model, then told apart by key again: order doesn't matter to the result."""
    def by_length(b: pd.DataFrame) -> pd.DataFrame:
        ordered = b.iloc[b["text"].str.len().argsort()]
        return pd.DataFrame({"doc_id": ordered["doc_id"], "n": ordered["text"].str.len()})

    return I.map_rows(t("documents").where("text is not null").select("doc_id", "text"), by_length, "doc_id bigint, n bigint")
