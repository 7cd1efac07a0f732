"""Predicates, sorting, paging and projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.plans.query import NONE, Op, Page, Query, boolean, by_keys, every, get_page, inner_hits, nested_score, page_after, project, some, token_line, tokens, where


def _orders(t: Tables) -> DataFrame:
    return t("orders").withColumn("o_day", F.date_format("o_orderdate", "yyyy-MM-dd")).drop("o_orderdate")


def _order_docs(t: Tables) -> DataFrame:
    """Orders as documents with their lines nested, in the lines' order."""
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderpriority", "lines")


@query(
    "q_range_page", "S01 P01 P02 P03 P04 P08 P22 T01 T02 T03",
    """
    select o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as o_day from orders
    where o_orderpriority = '1-URGENT' and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-01-01' and o_totalprice >= 50000 and o_totalprice <= 300000
    order by o_totalprice desc nulls last, o_orderkey limit 20
    """,
)
def q_range_page(t: Tables) -> DataFrame:
    asked = every(where(Op.EQ, "o_orderpriority", "1-URGENT"), where(Op.GE, "o_orderdate", "1995-01-01"), where(Op.LT, "o_orderdate", "1997-01-01"), where(Op.GE, "o_totalprice", 50000), where(Op.LE, "o_totalprice", 300000))
    page = get_page(t("orders"), Page(asked, (("o_totalprice", "desc"), "o_orderkey"), 1, 20))
    return page.select("o_orderkey", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"))


@query("q_page_two", "S01 T03", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_totalprice desc, o_orderkey limit 25 offset 50")
def q_page_two(t: Tables) -> DataFrame:
    return get_page(t("orders"), Page(where(Op.EQ, "o_orderstatus", "O"), (("o_totalprice", "desc"), "o_orderkey"), 3, 25, "o_orderkey, o_totalprice"))


@query("q_keyset", "S02 S12", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey > 100 or (l_orderkey = 100 and l_linenumber > 1) order by 1, 2 limit 40")
def q_keyset(t: Tables) -> DataFrame:
    return page_after(t("lineitem"), ["l_orderkey", "l_linenumber"], [100, 1], 40).select("l_orderkey", "l_linenumber", "l_quantity")


@query("q_count", "S06 S05", "select count(*) as total from orders where o_totalprice > 200000 or o_orderpriority in ('1-URGENT', '2-HIGH')")
def q_count(t: Tables) -> DataFrame:
    return get_page(t("orders"), Page(where(Op.GT, "o_totalprice", 200000) | where(Op.IN, "o_orderpriority", "1-URGENT", "2-HIGH"), page_size=0))


@query("q_multi_get", "S04 S08 J09", "select o_orderkey, o_orderstatus from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def q_multi_get(t: Tables) -> DataFrame:
    keys = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return by_keys(t("orders"), "o_custkey", keys).select("o_orderkey", "o_orderstatus")


@query("q_between_swap", "P05", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity between 10 and 12")
def q_between_swap(t: Tables) -> DataFrame:
    return project(t("lineitem").where(where(Op.BETWEEN, "l_quantity", 12, 10).column()), "l_orderkey, l_linenumber, l_quantity")


@query("q_in_null", "P06", "select doc_id, lang from documents where lang is null or lang in ('en', 'de')")
def q_in_null(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.IN, "lang", None, "en", "de").column()).select("doc_id", "lang")


@query("q_in_empty", "P06", "select doc_id from documents where lang is null")
def q_in_empty(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.IN, "lang").column()).select("doc_id")


@query("q_not_in_null", "P07", "select doc_id, lang from documents where lang is null or lang not in ('en', 'zh')")
def q_not_in_null(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.NOT_IN, "lang", "en", "zh").column()).select("doc_id", "lang")


@query("q_not_in_listed_null", "P07", "select doc_id, lang from documents where lang is not null and lang not in ('en')")
def q_not_in_listed_null(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.NOT_IN, "lang", None, "en").column()).select("doc_id", "lang")


@query("q_eq_none", "P08", "select news_id, company from finance_news where company is null or company = ''")
def q_eq_none(t: Tables) -> DataFrame:
    return t("finance_news").where(where(Op.EQ, "company", NONE).column()).select("news_id", "company")


@query("q_eq_missing", "P08 P16", "select news_id from finance_news where amount is null")
def q_eq_missing(t: Tables) -> DataFrame:
    return t("finance_news").where(where(Op.EQ, "amount").column()).select("news_id")


@query("q_ne_null_passes", "P09", "select news_id, round from finance_news where round is distinct from 'A轮'")
def q_ne_null_passes(t: Tables) -> DataFrame:
    return t("finance_news").where(where(Op.NE, "round", "A轮").column()).select("news_id", "round")


@query("q_ne_none", "P09", "select news_id, company from finance_news where company is not null and company <> ''")
def q_ne_none(t: Tables) -> DataFrame:
    return t("finance_news").where(where(Op.NE, "company", NONE).column()).select("news_id", "company")


_TOKENS = r"regexp_extract_all(lower(text), '[぀-ヿ㐀-鿿]|[a-z0-9À-ɏͰ-ӿ]+')"


@query("q_like_phrase", "P10 P18 T05", f"with d as (select doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' as line from documents) select doc_id from d where contains(line, ' antibody ')")
def q_like_phrase(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.LIKE, "text", "Antibody").column()).select("doc_id")


@query("q_like_all_tokens", "P10", f"with d as (select doc_id, {_TOKENS} as w from documents) select doc_id from d where list_contains(w, 'gene') and list_contains(w, 'therapy') and list_contains(w, 'phase')")
def q_like_all_tokens(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.LIKE, "text", "gene therapy, phase").column()).select("doc_id")


@query("q_like_quorum", "P10 P17", f"with d as (select doc_id, {_TOKENS} as w from documents) select doc_id from d where len(list_intersect(w, ['gene', 'therapy', 'phase', 'safety'])) >= 3")
def q_like_quorum(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.LIKE, "text", "gene therapy phase safety", minimum="75%").column()).select("doc_id")


@query("q_match_quorum", "P17", f"with d as (select doc_id, {_TOKENS} as w from documents) select doc_id from d where len(list_intersect(w, ['complete', 'remission', 'placebo'])) >= 2")
def q_match_quorum(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.MATCH, "text", "complete remission", "placebo", minimum="-1").column()).select("doc_id")


@query("q_phrase", "P18", f"with d as (select doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' as line from documents) select doc_id from d where contains(line, ' gene therapy ')")
def q_phrase(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.PHRASE, "text", "gene therapy").column()).select("doc_id")


@query("q_phrase_slop", "P18", rf"with d as (select doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' as line from documents) select doc_id from d where regexp_matches(line, ' median (?:\S+ ){{0,2}}was ')")
def q_phrase_slop(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.PHRASE, "text", "median was", minimum=2).column()).select("doc_id")


@query("q_not_like", "P11", f"with d as (select doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' as line from documents) select doc_id from d where not coalesce(contains(line, ' patients '), false)")
def q_not_like(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.NOT_LIKE, "text", "patients").column()).select("doc_id")


@query("q_in_like", "P12", f"with d as (select doc_id, ' ' || array_to_string({_TOKENS}, ' ') || ' ' as line from documents) select doc_id from d where contains(line, ' psoriasis ') or contains(line, ' asthma ')")
def q_in_like(t: Tables) -> DataFrame:
    return t("documents").where(where(Op.IN_LIKE, "text", "psoriasis", "asthma").column()).select("doc_id")


@query("q_wildcard", "P13 P14", "select p_partkey, p_name from part where contains(p_name, 'ro')")
def q_wildcard(t: Tables) -> DataFrame:
    return t("part").where(where(Op.WILDCARD, "p_name", "ro").column()).select("p_partkey", "p_name")


@query("q_in_wildcard", "P13", "select p_partkey from part where contains(p_name, 'ring') or contains(p_name, 'ue b')")
def q_in_wildcard(t: Tables) -> DataFrame:
    return t("part").where(where(Op.IN_WILDCARD, "p_name", "ring", "ue b").column()).select("p_partkey")


@query("q_not_wildcard", "P14", "select news_id from finance_news where not coalesce(contains(company, '医'), false)")
def q_not_wildcard(t: Tables) -> DataFrame:
    return t("finance_news").where(where(Op.NOT_WILDCARD, "company", "医").column()).select("news_id")


@query("q_prefix", "P15", "select p_partkey, p_brand from part where starts_with(p_brand, 'Brand#1')")
def q_prefix(t: Tables) -> DataFrame:
    return t("part").where(where(Op.PREFIX, "p_brand", "Brand#1").column()).select("p_partkey", "p_brand")


@query("q_ids", "P16", "select o_orderkey from orders where cast(o_orderkey as varchar) in ('1', '2', '3', '32')")
def q_ids(t: Tables) -> DataFrame:
    return t("orders").where(where(Op.IDS, "o_orderkey", 1, 2, "3", 32, "", None).column()).select("o_orderkey")


@query("q_regexp_terms", "P03 P16", r"select rec_id from news_body where regexp_matches(title, '^[A-Z][a-z]+ [A-Z]') and len(paragraphs) is not null")
def q_regexp_terms(t: Tables) -> DataFrame:
    return t("news_body").where((where(Op.REGEXP, "title", "^[A-Z][a-z]+ [A-Z]") & where(Op.EXISTS, "paragraphs")).column()).select("rec_id")


_NESTED = "with o as (select l_orderkey as o_orderkey, list(struct_pack(n := l_linenumber, p := l_partkey, q := l_quantity, d := l_discount, f := l_returnflag) order by l_linenumber) as lines from lineitem join orders on o_orderkey = l_orderkey group by 1)"


@query("q_nested_exists", "P19 P02", f"{_NESTED} select o_orderkey from o where len(list_filter(lines, lambda x: x.q >= 45 and x.f = 'R')) > 0")
def q_nested_exists(t: Tables) -> DataFrame:
    return _order_docs(t).where(every(where(Op.GE, "l_quantity", 45), where(Op.EQ, "l_returnflag", "R"), nested="lines").column()).select("o_orderkey")


@query("q_nested_not", "P19", f"{_NESTED} select o_orderkey from o where not len(list_filter(lines, lambda x: x.f = 'R' or x.d > 0.09)) > 0")
def q_nested_not(t: Tables) -> DataFrame:
    return _order_docs(t).where((~some(where(Op.EQ, "l_returnflag", "R"), where(Op.GT, "l_discount", 0.09), nested="lines")).column()).select("o_orderkey")


@query("q_inner_hits", "P20 P23", f"{_NESTED}, h as (select o_orderkey, list_filter(lines, lambda x: x.q > 40)[1:100] as hits from o) select o_orderkey, len(hits) as n_hits, array_to_string(list_transform(hits, lambda x: cast(x.n as varchar)), ',') as numbers from h where len(hits) > 0")
def q_inner_hits(t: Tables) -> DataFrame:
    asked = where(Op.GT, "l_quantity", 40)
    hits = _order_docs(t).select("o_orderkey", inner_hits("lines", asked, ["l_linenumber"]).alias("hits")).where(F.size("hits") > 0)
    return hits.select("o_orderkey", F.size("hits").cast("bigint").alias("n_hits"), F.array_join(F.transform("hits", lambda x: x["l_linenumber"].cast("string")), ",").alias("numbers"))


@query("q_nested_score", "P19", f"{_NESTED}, h as (select o_orderkey, list_transform(list_filter(lines, lambda x: x.q > 30), lambda x: x.q) as s from o) select o_orderkey, round(list_sum(s) / len(s), 6) as avg_score, list_max(s) as max_score from h where len(s) > 0")
def q_nested_score(t: Tables) -> DataFrame:
    asked = where(Op.GT, "l_quantity", 30)
    d = _order_docs(t).where(every(asked, nested="lines").column())
    return d.select("o_orderkey", F.round(nested_score("lines", asked, lambda x: x["l_quantity"]), 6).alias("avg_score"), nested_score("lines", asked, lambda x: x["l_quantity"], "max").alias("max_score"))


@query("q_boolean", "P21", "select o_orderkey from orders where o_orderstatus = 'F' and not o_orderpriority = '5-LOW' and (case when o_totalprice > 150000 then 1 else 0 end + case when o_custkey % 2 = 0 then 1 else 0 end + case when o_orderpriority = '1-URGENT' then 1 else 0 end) >= 2")
def q_boolean(t: Tables) -> DataFrame:
    df = t("orders").withColumn("even", (F.col("o_custkey") % 2 == 0).cast("int"))
    asked = boolean(must=[where(Op.EQ, "o_orderstatus", "F")], must_not=[where(Op.EQ, "o_orderpriority", "5-LOW")], should=[where(Op.GT, "o_totalprice", 150000), where(Op.EQ, "even", 1), where(Op.EQ, "o_orderpriority", "1-URGENT")], minimum=2)
    return df.where(asked()).select("o_orderkey")


@query("q_or_and", "P02", "select o_orderkey from orders where (o_totalprice < 20000 or o_totalprice > 400000) and o_orderstatus <> 'P'")
def q_or_and(t: Tables) -> DataFrame:
    asked = (where(Op.LT, "o_totalprice", 20000) | where(Op.GT, "o_totalprice", 400000)) & ~where(Op.EQ, "o_orderstatus", "P")
    return t("orders").where(asked.column()).select("o_orderkey")


@query("q_sort_missing_last", "T01 T02 T11", "select news_id, publish_date from finance_news order by publish_date asc nulls last, news_id limit 500")
def q_sort_missing_last(t: Tables) -> DataFrame:
    return get_page(t("finance_news"), Page(Query(), ("publish_date", "news_id"), 1, 500, ["news_id", "publish_date"]))


@query("q_sort_desc_missing_last", "T01 T04", "select news_id, round from finance_news order by round desc nulls last, news_id limit 580")
def q_sort_desc_missing_last(t: Tables) -> DataFrame:
    return get_page(t("finance_news"), Page(Query(), (("round", "desc"), "news_id"), 1, 580, ["news_id", "round"]))


@query("q_relevance", "T05 P17 P23", f"with d as (select doc_id, len(list_intersect({_TOKENS}, ['gene', 'therapy', 'placebo', 'remission'])) as score from documents) select doc_id, score from d where score > 0 order by score desc, doc_id limit 30")
def q_relevance(t: Tables) -> DataFrame:
    wanted = F.array(*map(F.lit, ("gene", "therapy", "placebo", "remission")))
    scored = t("documents").select("doc_id", F.size(F.array_intersect(tokens("text"), wanted)).cast("bigint").alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(30)


@query("q_project_key", "P22", "select o_orderkey from orders where o_orderstatus = 'P'")
def q_project_key(t: Tables) -> DataFrame:
    return get_page(t("orders"), Page(where(Op.EQ, "o_orderstatus", "P"), fields=NONE, key="o_orderkey"))


@query("q_token_line", "P10", f"select doc_id, md5(' ' || array_to_string({_TOKENS}, ' ') || ' ') as line from documents where text is not null")
def q_token_line(t: Tables) -> DataFrame:
    return t("documents").where("text is not null").select("doc_id", F.md5(token_line("text")).alias("line"))
