"""Packed cells and hierarchies of the claim and news tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.operators import hierarchy, packed


@query("p3_found", "C07 R05")
def p3_found(t: Tables) -> DataFrame:
    return packed.packed_values(t("patent_claim"), t("finance_news"))


@query(
    "p3_numbers",
    "C07 R05",
    r"""
    with c as (select claim_id, regexp_replace(translate(lower(claim_ref_pre), '０１２３４５６７８９／，；－．～｜［］＂　', '0123456789/,;-.~|[]" '), '\s', ' ', 'g') as s from patent_claim where claim_id is not null),
    f as (select claim_id, regexp_extract_all(s, '\d+(?:\s*(?:-|‐|‑|–|—|~|〜|～|至|到|\bto\b|\bthrough\b)\s*\d+)?') as spans from c),
    e as (select claim_id, unnest(range(1, len(spans) + 1)) as i, unnest(spans) as span from f),
    n as (select claim_id, i, unnest(range(cast(regexp_extract(span, '^\d+') as bigint), cast(regexp_extract(span, '\d+$') as bigint) + 1)) as v from e),
    p as (select claim_id, row_number() over (partition by claim_id order by i, v) as pos, v from n where v >= 1)
    select claim_id as row_id, pos, cast(v as varchar) as val from p
    """,
)
def p3_numbers(t: Tables) -> DataFrame:
    return packed.split_numbers(t("patent_claim"), "claim_id", "claim_ref_pre").drop("n")


@query("p3_names", "C21 R05 N08")
def p3_names(t: Tables) -> DataFrame:
    return packed.split_names(t("finance_news"), "news_id", "invester").drop("n")


@query(
    "p6_found",
    "G01 G03 G04",
    r"""
    with recursive c as (
      select upper(regexp_replace(patent_code, '[\s 　\-‐-―]', '', 'g')) as code, claim_num, claim_id,
        list_filter(regexp_extract_all(regexp_replace(translate(lower(claim_ref_pre), '０１２３４５６７８９', '0123456789'), '\s', ' ', 'g'), '\d+'), lambda x: cast(x as bigint) >= 1) as nums
      from patent_claim where patent_code is not null and claim_num is not null),
    n as (select code, claim_num, try_cast(arg_min(nums, claim_id)[1] as integer) as parent from (select code, claim_num, claim_id, coalesce(nums, []) as nums from c) group by 1, 2),
    l as (select n.*, p.claim_num as there from n left join n p on p.code = n.code and p.claim_num = n.parent),
    walk as (
      select code, claim_num, claim_num as root_num, 0 as depth, cast(claim_num as varchar) as path from l where there is null
      union all
      select l.code, l.claim_num, w.root_num, w.depth + 1, w.path || '/' || l.claim_num from walk w join l on l.code = w.code and l.there = w.claim_num),
    anc as (select code, cast(unnest(string_split(path, '/')[1:depth]) as integer) as claim_num from walk where depth > 0),
    d as (select code, claim_num, cast(count(*) as integer) as n_desc from anc group by 1, 2)
    select w.code, w.claim_num, w.root_num, w.depth, w.path, coalesce(d.n_desc, 0) as n_desc from walk w left join d using (code, claim_num)
    union all
    select l.code, l.claim_num, -1, -1, '', -1 from l where not exists (select 1 from walk w where w.code = l.code and w.claim_num = l.claim_num)
    """,
)
def p6_found(t: Tables) -> DataFrame:
    return hierarchy.claim_trees(t("patent_claim"))


@query(
    "p6_descendants",
    "G03",
    r"""
    with recursive c as (
      select upper(regexp_replace(patent_code, '[\s 　\-‐-―]', '', 'g')) as code, claim_num, claim_id,
        list_filter(regexp_extract_all(regexp_replace(translate(lower(claim_ref_pre), '０１２３４５６７８９', '0123456789'), '\s', ' ', 'g'), '\d+'), lambda x: cast(x as bigint) >= 1) as nums
      from patent_claim where patent_code is not null and claim_num is not null),
    n as (select code, claim_num, try_cast(arg_min(nums, claim_id)[1] as integer) as parent from (select code, claim_num, claim_id, coalesce(nums, []) as nums from c) group by 1, 2),
    l as (select n.*, p.claim_num as there from n left join n p on p.code = n.code and p.claim_num = n.parent),
    walk as (
      select code, claim_num, [claim_num] as path from l where there is null
      union all
      select l.code, l.claim_num, list_append(w.path, l.claim_num) from walk w join l on l.code = w.code and l.there = w.claim_num),
    steps as (select code, claim_num, path, unnest(range(1, len(path))) as pos from walk)
    select code, path[pos] as ancestor, claim_num as descendant, cast(len(path) - pos as integer) as steps from steps
    """,
)
def p6_descendants(t: Tables) -> DataFrame:
    """``(code, ancestor, descendant, steps)`` of all claims that lie on or below no circle."""
    trees = hierarchy.claim_trees(t("patent_claim")).where("depth > 0")
    return trees.select("code", F.posexplode(F.slice(F.split("path", "/"), F.lit(1), F.col("depth"))).alias("i", "a"), F.col("claim_num").alias("descendant"), "depth").select("code", F.col("a").cast("int").alias("ancestor"), "descendant", (F.col("depth") - F.col("i")).alias("steps"))
