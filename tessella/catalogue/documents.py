"""Documents, layouts, patents, models' dataflow and summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.plans.runtime import scratch
from tessella.operators import documents as D
from tessella.operators import inference as I


@query("q_dom_nodes", "C27")
def q_dom_nodes(t: Tables) -> DataFrame:
    return D.nodes_table(t("news_page"), "page_id", "html").select("page_id", "n", "path", "depth", F.md5("text").alias("h"))


@query("q_dom_path", "C27")
def q_dom_path(t: Tables) -> DataFrame:
    nodes = D.nodes_table(t("news_page"), "page_id", "html")
    return D.by_path(nodes, "page_id", "/html[1]/head[1]/title[1]", "©").where("text is not null")


@query("q_common_ancestor", "C27")
def q_common_ancestor(t: Tables) -> DataFrame:
    nodes = D.nodes_table(t("news_page"), "page_id", "html").where("own")
    first_last = nodes.groupBy("page_id").agg(F.min_by("path", "n").alias("a"), F.max_by("path", "n").alias("b"))
    return first_last.select("page_id", D.common_ancestor(F.col("a"), F.col("b")).alias("ancestor"))


@query("q_label_fields", "D04 C01", "with d as (select doc_id, text from documents where kind = 'label' and text is not null) select * from (select doc_id, 'indication' as field, trim(left(text, 200), ' ') as value from d union all select doc_id, 'dosage', trim(right(text, 100), ' ') from d union all select doc_id, 'contraindication', 'none' from d) where value <> ''")
def q_label_fields(t: Tables) -> DataFrame:
    body = F.concat(F.lit("INDICATIONS AND USAGE "), F.left("text", F.lit(200)), F.lit(" DOSAGE AND ADMINISTRATION "), F.right("text", F.lit(100)), F.lit(" CONTRAINDICATIONS none"))
    return D.label_fields(t("documents").where("kind = 'label' and text is not null").select("doc_id", body.alias("text")), "doc_id", "text", "fda")


@query("q_front_page", "D05 D07 C38", "select claim_id, '22' as code, '2020.1.' || (1 + claim_id % 28) as value from patent_claim union all select claim_id, '54', main_id from patent_claim where main_id is not null")
def q_front_page(t: Tables) -> DataFrame:
    c = t("patent_claim").where("main_id is not null")
    text = F.concat(F.lit("(22) 2020.1."), (1 + F.col("claim_id") % 28).cast("string"), F.lit("\n(54) "), "main_id")
    return D.front_page(c.select("claim_id", text.alias("text")), "claim_id", "text")


@query("q_front_dates", "D05 C14 C16", "select claim_id, '22' as code, '2020-1-' || (1 + claim_id % 28) as date, true as valid from patent_claim")
def q_front_dates(t: Tables) -> DataFrame:
    text = F.concat(F.lit("(22) 2020.1."), (1 + F.col("claim_id") % 28).cast("string"), F.lit("\n(54) x"))
    return D.front_dates(D.front_page(t("patent_claim").select("claim_id", text.alias("text")), "claim_id", "text"), "claim_id")


@query("q_relations", "D06 D08 D15 C17", "with c as (select claim_id, lpad(cast(claim_id % 1000 as varchar), 3, '0') as nnn from patent_claim) select claim_id, md5(claim_id || ':0') as sub_id, 'continuation' as type, 'Continuation of application No. 12/' || nnn || ',456, filed on Jan. 5, 2012.' as piece, 'US12' || nnn || '45A' as application_key, 'Jan. 5, 2012' as date, 1325721600000 as date_ms, null as errors from c union all select claim_id, md5(claim_id || ':1'), 'division', 'Division of application No. 11/222,333, filed on May 6, 2010.', 'US1122233A', 'May 6, 2010', 1273104000000, null from c")
def q_relations(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Continuation of application No. 12/"), F.lpad((F.col("claim_id") % 1000).cast("string"), 3, "0"), F.lit(",456, filed on Jan. 5, 2012. Division of application No. 11/222,333, filed on May 6, 2010."))
    pieces = D.related_pieces(t("patent_claim").select("claim_id", text.alias("text")), "claim_id", "text", {"continuation of": "continuation", "division of": "division"})
    return D.relation_rows(pieces, "claim_id", "US")


@query("q_divisional", "D14 W08", "select claim_id, '62' as code, trim('(62) 分案原申请数据 ' || coalesce(patent_code, ''), ' ') || '续行' as found from patent_claim")
def q_divisional(t: Tables) -> DataFrame:
    text = F.concat(F.lit("(22) 2010\n(62) 分案原申请数据 "), F.coalesce("patent_code", F.lit("")), F.lit("\n续行\n(54) x"))
    return D.divisional_lines(t("patent_claim").select("claim_id", text.alias("text")), "claim_id", "text")


@query("q_reading_order", "T10 D02", "select page_id, row_number() over (partition by pdf_name, page_number order by (case when x0_t >= width / 2 * 1.05 then 1 else 0 end), y0_t, x0_t) as \"order\" from title_page where x0_t is not null and page_id in (select min(page_id) from title_page group by pdf_name, page_number)")
def q_reading_order(t: Tables) -> DataFrame:
    p = t("title_page")
    one = p.groupBy("pdf_name", "page_number").agg(F.min("page_id").alias("page_id")).select("page_id")
    return D.reading_order(p.where("x0_t is not null").join(one, "page_id", "left_semi"), "pdf_name").select("page_id", "order")


@query("q_in_box", "D02 D12", "select page_id from title_page where (x0_t + x1_t) / 2 between 0 and width / 1 and (x0_t + x1_t) / 2 between 0 and 300 and (y0_t + y1_t) / 2 between 0 and 400")
def q_in_box(t: Tables) -> DataFrame:
    return D.in_box(t("title_page"), 0, 0, 300, 400).where((F.col("x0_t") + F.col("x1_t")) / 2 <= F.col("width")).select("page_id")


@query("q_figure_titles", "D10")
def q_figure_titles(t: Tables) -> DataFrame:
    p = t("title_page")
    text = p.select("pdf_name", "page_number", "block_type", "x0_t", "y0_t", "text")
    caption = p.select("pdf_name", "page_number", F.lit("Text").alias("block_type"), "x0_t", (F.col("y1_t") + 1).alias("y0_t"), F.left("data", F.lit(28)).alias("text"))
    return D.figure_titles(text.unionByName(caption).where("y0_t is not null"), "pdf_name")


@query("q_form_cells", "D03 D09 D16", "select l_orderkey, 0 as page, 0 as \"table\", row_number() over (partition by l_orderkey order by l_linenumber % 3, l_linenumber % 2, l_returnflag) - 1 as cell, l_linenumber % 3 as \"row\", l_linenumber % 2 as col, l_returnflag as text from lineitem")
def q_form_cells(t: Tables) -> DataFrame:
    cell = F.struct((F.col("l_linenumber") % 3).alias("row"), (F.col("l_linenumber") % 2).alias("col"), F.col("l_returnflag").alias("text"))
    forms = t("lineitem").groupBy("l_orderkey").agg(F.array(F.struct(F.array(F.struct(F.sort_array(F.collect_list(cell)).alias("cells"))).alias("tables"), F.array(F.lit("a b")).alias("lines"))).alias("pages"))
    return D.form_rows(forms, "l_orderkey")["cells"]


@query("q_before_tables", "D13", "with l as (select page_id, regexp_split_to_array(text, '\\r?\\n') as v from title_page where text is not null), p as (select page_id, v, list_filter(range(1, len(v) + 1), lambda i: trim(v[i], ' ') in ('Results', 'Methods'))[1] as p from l) select page_id, array_to_string(case when p is null then v else v[1:p - 1] end, chr(10)) as text from p")
def q_before_tables(t: Tables) -> DataFrame:
    p = t("title_page").where("text is not null").select("page_id", "text", F.array(F.array(F.lit("Results")), F.array(F.lit("Methods"))).alias("rows"))
    return D.before_tables(p, "page_id", "text", "rows")


@query("q_first_fields", "D04 C02 C03", r"with f as (select doc_id, 'trial' as field, regexp_extract_all(text, 'TRX-[0-9]{8}') as v from documents union all select doc_id, 'dose', case when regexp_matches(text, '[0-9]+ mg') then regexp_extract_all(text, '[0-9]+ mg') else regexp_extract_all(text, '[0-9]+毫克') end from documents) select doc_id, field, array_to_string(v, '|') as values from f where len(v) > 0")
def q_first_fields(t: Tables) -> DataFrame:
    found = D.first_fields(t("documents"), "doc_id", "text", {"trial": [r"TRX-\d{8}"], "dose": [r"\d+ mg", r"\d+毫克"]})
    return found.select("doc_id", "field", F.array_join("values", "|").alias("values"))


def _scorer(s: pd.Series) -> pd.Series:
    """A stand-in for a model: the length of the text modulo three."""
    return s.str.len() % 3


@query("q_predict", "F01 F02 F03 F06 F08 K16", "select doc_id, length(text) % 3 as label from documents where text is not null")
def q_predict(t: Tables) -> DataFrame:
    return I.predict(t("documents").where("text is not null").select("doc_id", "text"), "text", _scorer, "bigint", "label").select("doc_id", "label")


@query("q_map_rows", "F01 F04", "select o_orderkey, o_totalprice * 2 as doubled from orders")
def q_map_rows(t: Tables) -> DataFrame:
    return I.map_rows(t("orders").select("o_orderkey", "o_totalprice"), lambda b: b.assign(doubled=b["o_totalprice"] * 2)[["o_orderkey", "doubled"]], "o_orderkey bigint, doubled double")


@query("q_expand_rows", "F05", "select r_regionkey, r_name || '-' || i as label from region, range(0, 3) x(i)")
def q_expand_rows(t: Tables) -> DataFrame:
    def three(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k, f"{n}-{i}") for k, n in zip(b["r_regionkey"], b["r_name"]) for i in range(3)], columns=["r_regionkey", "label"])

    return I.expand(t("region").select("r_regionkey", "r_name"), three, "r_regionkey int, label string")


@query("q_predict_chunks", "K13 K20 F08")
def q_predict_chunks(t: Tables) -> DataFrame:
    words = lambda s: s.str.findall(r"placebo|asthma|remission").map(lambda x: "|".join(x))
    return I.predict_chunks(t("documents").select("doc_id", "text"), "doc_id", "text", words, 300, 100)


@query("q_route_fuse", "N14 N20", "select doc_id, case when length(text) >= 500 then 'rule' else 'model' end as way, coalesce(nullif(kind, ''), 'other') as kind from documents where text is not null")
def q_route_fuse(t: Tables) -> DataFrame:
    return t("documents").where("text is not null").select("doc_id", I.route(F.length("text"), 500, F.lit("rule"), F.lit("model")).alias("way"), I.fuse(F.col("kind"), F.lit("other")).alias("kind"))


@query("q_round_default", "N17", "select news_id, case when trim(round, ' ') = '未披露' then '战略投资' else round end as round from finance_news")
def q_round_default(t: Tables) -> DataFrame:
    return t("finance_news").select("news_id", I.round_default(F.col("round")).alias("round"))


@query("q_content_labels", "N18", "select news_id, array_to_string(list_filter(list_distinct([resource, replace(company, '健康', '')]), lambda x: x is not null and x <> '' and contains(title, x)), '|') as labels from finance_news where title is not null and resource is not null and company is not null")
def q_content_labels(t: Tables) -> DataFrame:
    n = t("finance_news").where("title is not null and resource is not null and company is not null")
    return n.select("news_id", F.array_join(I.clean_content_labels(F.array("resource", "company"), F.col("title"), ["健康"]), "|").alias("labels"))


@query(
    "q_claim_pipeline",
    "F12 C06",
    r"""
    with p as (select main_id, claim_num, claim_text as t, '(?i)claims?\s+(\d+)\s*(?:-|–|to|through)\s*(\d+)|权利要求(\d+)\s*[-–~～至到]\s*(\d+)' as f, '(?i)claims?\s+(\d+(?:\s*(?:,|or|and|或|和|、)\s*\d+)*)|权利要求(\d+(?:\s*(?:,|or|and|或|和|、)\s*(?:权利要求)?\d+)*)' as l from patent_claim where claim_text is not null),
    g as (select main_id, claim_num, t, try_cast(regexp_extract(t, f, 1) || regexp_extract(t, f, 3) as integer) as lo, try_cast(regexp_extract(t, f, 2) || regexp_extract(t, f, 4) as integer) as hi, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract(t, l, 1) || regexp_extract(t, l, 2), '\d+'), lambda x: cast(x as integer)))) as listed from p),
    r as (select main_id, claim_num, t, array_to_string(case when lo is not null and hi is not null then range(least(lo, hi), greatest(lo, hi) + 1) else listed end, ',') as claim_ref from g)
    select main_id, claim_num, case when claim_ref <> '' then 'D' else 'I' end as claim_class, case when regexp_matches(t, '(?i)^use of|用途') then 'use' when regexp_matches(t, '(?i)^(a|the) (method|process)|方法') then 'method' when regexp_matches(t, '(?i)^(a|the) kit|试剂盒') then 'kit' when regexp_matches(t, '(?i)composition|组合物') then 'composition' end as claim_type, claim_ref from r
    """,
)
def q_claim_pipeline(t: Tables) -> DataFrame:
    out = I.claim_pipeline(t("patent_claim").where("claim_text is not null"))
    return out.withColumn("claim_ref", F.array_join(F.transform("claim_ref", lambda x: x.cast("string")), ","))


@query("q_news_pipeline", "F11 A16 N17", "with p as (select rec_id, i - 1 as pos, paragraphs[i] as para from (select rec_id, paragraphs, unnest(range(1, len(paragraphs) + 1)) as i from news_body where paragraphs is not null)), l as (select *, length(para) % 3 as l from p where length(para) > 50), m as (select rec_id, min(l) as label from l group by 1), c as (select l.rec_id, arg_min(para, pos) as chosen from l join m on l.rec_id = m.rec_id and l.l = m.label group by 1), b as (select n.rec_id, m.label, coalesce(c.chosen, n.paragraphs[1]) as para from news_body n left join m on m.rec_id = n.rec_id left join c on c.rec_id = n.rec_id) select cast(rec_id as varchar) as esid, coalesce(label, 0) as label, nullif(regexp_extract(para, '(series [A-Z]|[A-Z]轮)', 1), '') as round, nullif(regexp_extract(para, '([0-9.]+ (?:million|Millionen)|[0-9.]+亿元)', 1), '') as amount from b")
def q_news_pipeline(t: Tables) -> DataFrame:
    news = t("news_body").select(F.col("rec_id").cast("string").alias("esid"), "paragraphs")
    out = I.financing_news(news, _scorer, {"round": lambda s: s.str.extract(r"(series [A-Z]|[A-Z]轮)", expand=False), "amount": lambda s: s.str.extract(r"([\d.]+ (?:million|Millionen)|[\d.]+亿元)", expand=False)})
    return out.select("esid", "label", F.try_element_at("fields", F.lit("round")).alias("round"), F.try_element_at("fields", F.lit("amount")).alias("amount"))


@query("q_summary_lead", "F09 T06", r"with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?][\x22'')\]]*)\s+([A-Z0-9\x22''(])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') as s from documents where text is not null) select doc_id, s[1] as first_sentence from s where len(s) > 0")
def q_summary_lead(t: Tables) -> DataFrame:
    from tessella.functions.text import sentences_en

    return t("documents").where("text is not null").select("doc_id", F.get(sentences_en(F.col("text")), F.lit(0)).alias("first_sentence")).where("first_sentence is not null")


@query("q_topk_sent", "T06 F09")
def q_topk_sent(t: Tables) -> DataFrame:
    scored = I.sentence_scores(t("documents").where("lang = 'en'"), "doc_id", "text")
    return I.summary(scored, "doc_id", 3)


@query("q_topk_blocked", "T06 V15")
def q_topk_blocked(t: Tables) -> DataFrame:
    scored = I.sentence_scores(t("documents").where("lang = 'en'"), "doc_id", "text")
    return I.summary(scored, "doc_id", 3, block=True)


@query("q_answer", "F10")
def q_answer(t: Tables) -> DataFrame:
    return I.answer(I.sentence_scores(t("documents").where("lang = 'en'"), "doc_id", "text"), "doc_id", F.lit("Which adverse event was most common?"))


@query(
    "q_layout_records",
    "D11",
    "select pdf_name, page_number, page_id as block_id, case when block_type is null then 'OtherRegion' else block_type end as type, round(x1_t - x0_t, 4) as width, round(y1_t - y0_t, 4) as height, case when block_type = 'Text' then text when block_type = 'Table' then data when block_type = 'Figure' then 'ImageRegion' else 'OtherRegion' end as data from title_page where x0_t is not null",
)
def q_layout_records(t: Tables) -> DataFrame:
    return D.layout_records(t("title_page").withColumnsRenamed({"x0_t": "x_1", "x1_t": "x_2", "y0_t": "y_1", "y1_t": "y_2", "page_id": "block_id"})).select("pdf_name", "page_number", "block_id", "type", F.round("width", 4).alias("width"), F.round("height", 4).alias("height"), "data")


@query("q_file_text", "D01 D03", "select case when n_nationkey % 2 = 0 then n_name else '[no text]' end as text, case when n_nationkey % 2 = 0 then 1 else 0 end as tables from nation")
def q_file_text(t: Tables) -> DataFrame:
    """Text and tables of binary files by a stand-in for the caller's library, which fails on every other file."""
    path = scratch(t.spark)
    t("nation").select(F.concat_ws("|", F.when(F.col("n_nationkey") % 2 == 0, "good").otherwise("bad"), "n_name").alias("value")).repartition(25, "value").write.option("maxRecordsPerFile", 1).text(path)
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)

    def read(content: bytes) -> str:
        kind, _, name = content.decode().strip().partition("|")
        if kind != "good":
            raise ValueError("not readable")
        return name

    texts = D.pdf_text(files, read)
    tables = D.pdf_tables(files, lambda content: [[[read(content)]]]).groupBy("path").agg(F.count_distinct("table_no").alias("n"))
    return texts.join(tables, "path", "left").select("text", F.coalesce("n", F.lit(0)).alias("tables"))
