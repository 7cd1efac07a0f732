"""Cleaning, sentences, chunks, extraction, sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.functions import extract as X
from tessella.functions import sequences as B
from tessella.functions import text as T


def _docs(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", "text")


def _hash(df: DataFrame, key: str, value, into: str = "h") -> DataFrame:
    return df.select(key, F.md5(value).alias(into))


@query("q_controls", "X01 X02", r"select doc_id, md5(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]|ï|¿', '', 'g')) as h from documents where text is not null")
def q_controls(t: Tables) -> DataFrame:
    return _hash(_docs(t).where("text is not null"), "doc_id", T.remove_controls(F.col("text")))


@query("q_html_strip", "X03 X02 C27", r"select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^<]+?>', '', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')) as h from news_page where html is not null")
def q_html_strip(t: Tables) -> DataFrame:
    return _hash(t("news_page").where("html is not null"), "page_id", T.strip_tags_simple(F.col("html")))


@query("q_strip_tags", "X02 X06")
def q_strip_tags(t: Tables) -> DataFrame:
    return t("news_page").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("q_collapse", "X04", r"select doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0b\f\r\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f\x{85}]+', ' ', 'g'), ' ')) as h from documents where text is not null")
def q_collapse(t: Tables) -> DataFrame:
    return _hash(_docs(t).where("text is not null"), "doc_id", T.collapse(F.col("text")))


@query("q_clean_text", "X06")
def q_clean_text(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("q_clean_spaces_cjk", "X05")
def q_clean_spaces_cjk(t: Tables) -> DataFrame:
    return t("news_body").select("rec_id", T.clean_spaces_cjk(F.col("title")).alias("title"))


@query("q_fullwidth", "X07 X08", "select claim_id, translate(claim_ref_pre, '０１２３４５６７８９／，；－．～｜［］＂　', '0123456789/,;-.~|[]\" ') as ref from patent_claim where claim_ref_pre is not null")
def q_fullwidth(t: Tables) -> DataFrame:
    return t("patent_claim").where("claim_ref_pre is not null").select("claim_id", T.full_to_half(F.col("claim_ref_pre")).alias("ref"))


@query("q_half_digits", "X08", "select claim_id, translate(claim_ref_pre, '０１２３４５６７８９', '0123456789') as ref from patent_claim")
def q_half_digits(t: Tables) -> DataFrame:
    return t("patent_claim").select("claim_id", T.half_digits(F.col("claim_ref_pre")).alias("ref"))


@query("q_remove_punc", "X09", r"select news_id, regexp_replace(title, '[\p{P}\p{S}\s　]+', '', 'g') as title from finance_news")
def q_remove_punc(t: Tables) -> DataFrame:
    return t("finance_news").select("news_id", T.remove_punctuation(F.col("title")).alias("title"))


@query("q_replace_all", "X10", "select p_partkey, replace(replace(replace(p_type, 'STEEL', '#1'), 'BRASS', '#2'), 'TIN', '#3') as p_type from part")
def q_replace_all(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", T.replace_all(F.col("p_type"), {"STEEL": "#1", "BRASS": "#2", "TIN": "#3"}).alias("p_type"))


@query("q_tidy_label", "X11 X13")
def q_tidy_label(t: Tables) -> DataFrame:
    return t("title_page").select("page_id", T.tidy_label(F.col("text")).alias("text"))


@query("q_header_footer", "X12 X13 W08")
def q_header_footer(t: Tables) -> DataFrame:
    pages = t("title_page").where("text is not null")
    whole = pages.groupBy("pdf_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "page_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return T.drop_page_marks(whole, "pdf_name", "text")


@query("q_trim_field", "X14", r"select news_id, regexp_replace(regexp_replace(': )' || title || ' -', '^[\s:：)）]+', '', 'g'), '^[-\s]+|[-\s]+$', '', 'g') as title from finance_news where title is not null")
def q_trim_field(t: Tables) -> DataFrame:
    return t("finance_news").where("title is not null").select("news_id", T.trim_field(F.concat(F.lit(": )"), "title", F.lit(" -"))).alias("title"))


@query("q_char_tests", "X15", r"select news_id, regexp_matches(company, '^[一-龥]*$') as zh, regexp_matches(title, '[.!?。！？…]$') as ends from finance_news")
def q_char_tests(t: Tables) -> DataFrame:
    return t("finance_news").select("news_id", T.is_chinese(F.col("company")).alias("zh"), T.ends_sentence(F.col("title")).alias("ends"))


@query("q_blank_table", "X16", r"select doc_id, md5(translate(text, chr(160) || chr(9) || chr(10), '   ')) as h from documents where text is not null")
def q_blank_table(t: Tables) -> DataFrame:
    return _hash(_docs(t).where("text is not null"), "doc_id", T.blanks_to_space(F.col("text")))


@query("q_plain_name", "X17 X18", r"select p_partkey, lower(replace(replace(p_name, '-', ''), ' ', '')) as plain, regexp_replace(p_type, '[()\-–,\s]+', ' ', 'g') as kind from part")
def q_plain_name(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", T.plain_name(F.col("p_name")).alias("plain"), T.signs_to_space(F.col("p_type")).alias("kind"))


@query("q_before_marker", "X19", "select doc_id, md5(case when contains(text, 'Patients were excluded') then split_part(text, 'Patients were excluded', 1) when contains(text, 'placebo') then split_part(text, 'placebo', 1) else text end) as h from documents where text is not null")
def q_before_marker(t: Tables) -> DataFrame:
    return _hash(_docs(t).where("text is not null"), "doc_id", T.before_marker(F.col("text"), ["Patients were excluded", "placebo"]))


@query("q_map_codes", "X20", "select o_orderkey, array_to_string(list_filter([case o_orderstatus when 'O' then '1' when 'F' then '2' end, case left(o_orderpriority, 1) when '1' then '3' end], lambda x: x is not null), ',') as codes from orders")
def q_map_codes(t: Tables) -> DataFrame:
    text = F.concat_ws(",", "o_orderstatus", F.left("o_orderpriority", F.lit(1)))
    return t("orders").select("o_orderkey", F.array_join(T.map_codes(text, {"O": "1", "F": "2", "1": "3"}), ",").alias("codes"))


@query("q_round_label", "X21", "select news_id, list_max(list_filter(['A轮', 'A+轮', 'B轮', 'PRE-A轮', '天使轮'], lambda x: contains(upper(regexp_replace(round, '\\s', '', 'g')), upper(x)))) as label from finance_news")
def q_round_label(t: Tables) -> DataFrame:
    return t("finance_news").select("news_id", T.canonical_label(F.col("round"), ["A轮", "A+轮", "B轮", "PRE-A轮", "天使轮"]).alias("label"))


@query("q_english_date", "X23", "select o_orderkey, strftime(o_orderdate, '%B') || ', ' || day(o_orderdate) || (case when day(o_orderdate) between 11 and 13 then 'th' when day(o_orderdate) % 10 = 1 then 'st' when day(o_orderdate) % 10 = 2 then 'nd' when day(o_orderdate) % 10 = 3 then 'rd' else 'th' end) || ', ' || year(o_orderdate) as d from orders")
def q_english_date(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", T.english_date(F.col("o_orderdate")).alias("d"))


@query("q_area", "X24 X22", "select news_id, case when contains(replace(company, '北棠大学', ''), '北棠') then '北棠' when contains(company, '海汀') then '海汀' when contains(company, '医') then '医' end as area from finance_news")
def q_area(t: Tables) -> DataFrame:
    return t("finance_news").select("news_id", T.area_of(F.col("company"), ["北棠", "海汀", "医"]).alias("area"))


# ------------------------------------------------------------------ sentences, tokens, chunks


@query("q_hybrid_tokens", "K01 K02 K06")
def q_hybrid_tokens(t: Tables) -> DataFrame:
    return t("news_body").where("title is not null").select("rec_id", F.posexplode(T.token_offsets_column(F.col("title"))).alias("pos", "x")).select("rec_id", "pos", "x.token", "x.start", "x.end")


@query("q_sentences_zh", "K03")
def q_sentences_zh(t: Tables) -> DataFrame:
    return t("news_body").select("rec_id", F.explode("paragraphs").alias("p")).select("rec_id", F.posexplode(T.sentences_zh(F.col("p"))).alias("pos", "sentence"))


@query("q_sentences_naive", "K04", r"with s as (select doc_id, regexp_extract_all(text, '[^。！!.？?]*[。！!.？?]') as s from documents), e as (select doc_id, unnest(range(len(s))) as pos, unnest(s) as sentence from s) select doc_id, pos, sentence from e")
def q_sentences_naive(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", F.posexplode(T.sentences_naive(F.col("text"))).alias("pos", "sentence"))


@query(
    "q_sentences_en",
    "K05 K17",
    r"""
    with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]["'')\]]*)\s+([A-Z0-9"''(])', '\1' || chr(10) || '\2', 'g'), chr(10)), lambda x: trim(replace(trim(x, ' '), '*', ''), ' ')), lambda x: length(x) >= 10 and not regexp_matches(x, '(?i)^\s*(advert|figure|table|图|表|广告)')) as v from documents where text is not null)
    select doc_id, unnest(range(len(v))) as pos, unnest(v) as sentence from s
    """,
)
def q_sentences_en(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", F.posexplode(T.filter_sentences(T.sentences_en(F.col("text")))).alias("pos", "sentence"))


@query(
    "q_chunks_overlap", "K07 K10",
    "with w as (select doc_id, list_filter(list_transform(range(0, cast(floor(length(text) / 200) as bigint) + 1), lambda i: substring(text, i * 200 + 1, 400)), lambda x: x <> '') as c from documents where length(text) > 0), d as (select doc_id, case when len(c) > 1 and length(c[-1]) < 200 then c[1:-2] else c end as c from w), e as (select doc_id, unnest(range(len(c))) as pos, unnest(c) as chunk from d) select doc_id, pos, md5(chunk) as h from e",
)
def q_chunks_overlap(t: Tables) -> DataFrame:
    return T.chunk_rows(_docs(t), "text", 400, 200).select("doc_id", "pos", F.md5("chunk").alias("h"))


@query("q_token_windows", "K08", "with w as (select doc_id, len(string_split(text, ' ')) as m from documents where text is not null), e as (select doc_id, m, unnest(range(0, greatest(1, m), 40)) as b from w) select doc_id, cast(b / 40 as bigint) as pos, least(50, m - b) as n from e")
def q_token_windows(t: Tables) -> DataFrame:
    words = F.split(F.col("text"), " ")
    return _docs(t).where("text is not null").select("doc_id", F.posexplode(T.token_windows(words, 50)).alias("pos", "w")).select("doc_id", "pos", F.size("w").alias("n"))


@query("q_fixed_chunks", "K19", "with l as (select l_orderkey, list(l_linenumber order by l_linenumber) as v from lineitem group by 1), e as (select l_orderkey, v, unnest(range(0, len(v), 3)) as b from l) select l_orderkey, cast(b / 3 as bigint) as pos, array_to_string(v[b + 1:b + 3], ',') as chunk from e")
def q_fixed_chunks(t: Tables) -> DataFrame:
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("v"))
    return lines.select("l_orderkey", F.posexplode(T.chunks_of(F.col("v"), 3)).alias("pos", "c")).select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), F.array_join("c", ",").alias("chunk"))


@query("q_fraction_windows", "K09", "with w as (select doc_id, list_transform(range(0, greatest(1, cast(ceil(length(text) / 300) as bigint))), lambda i: substring(text, greatest(0, cast(trunc((i - 0.1) * 300) as bigint)) + 1, least(length(text), (i + 1) * 300) - greatest(0, cast(trunc((i - 0.1) * 300) as bigint)))) as c from documents where text is not null), e as (select doc_id, unnest(range(len(c))) as pos, unnest(c) as chunk from w) select doc_id, pos, md5(chunk) as h from e")
def q_fraction_windows(t: Tables) -> DataFrame:
    return _docs(t).where("text is not null").select("doc_id", F.posexplode(T.fraction_windows(F.col("text"), 300)).alias("pos", "c")).select("doc_id", "pos", F.md5("c").alias("h"))


@query("q_chunk_entities", "K11 C22", "with w as (select doc_id, pos, substring(text, cast(pos * 400 + 1 as bigint), 400) as chunk from (select doc_id, text, unnest(range(greatest(1, cast(ceil(length(text) / 400) as bigint)))) as pos from documents where text is not null)) select doc_id, pos, array_to_string(list_filter(['placebo', 'gene therapy', 'asthma', 'phase'], lambda e: contains(chunk, e)), '|') as found from w")
def q_chunk_entities(t: Tables) -> DataFrame:
    words = F.array(*map(F.lit, ("placebo", "gene therapy", "asthma", "phase")))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / 400).cast("int") - 1)), lambda i: F.substring(F.col("text"), i * 400 + 1, F.lit(400)))
    pieces = _docs(t).where("text is not null").select("doc_id", F.posexplode(chunks).alias("pos", "chunk"))
    return pieces.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.array_join(T.entities_inside(F.col("chunk"), words), "|").alias("found"))


@query("q_chunk_merge", "K12 K13 K20", "with e as (select user_id, list(distinct event_type order by event_type) as parts from events group by 1) select user_id, array_to_string(list_filter(parts, lambda x: x <> 'view'), '|') as merged from e")
def q_chunk_merge(t: Tables) -> DataFrame:
    outputs = t("events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("o"))
    return outputs.select("user_id", T.merge_windows(F.col("o"), "|", "view").alias("merged")).withColumn("merged", F.when(F.col("merged") == "view", "").otherwise(F.col("merged")))


@query("q_paragraphs", "K14", r"with p as (select page_id, list_filter(list_transform(string_split(regexp_replace(html, '(?i)</p\s*>|<br\s*/?>|</div\s*>|</h[1-6]\s*>|\n\s*\n', chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '[\r\n]+', '', 'g'), ' ')), lambda x: x <> '') as p from news_page where html is not null), e as (select page_id, unnest(range(len(p))) as pos, unnest(p) as paragraph from p) select page_id, pos, md5(paragraph) as h from e")
def q_paragraphs(t: Tables) -> DataFrame:
    return t("news_page").where("html is not null").select("page_id", F.posexplode(T.paragraphs(F.col("html"))).alias("pos", "p")).select("page_id", "pos", F.md5("p").alias("h"))


@query("q_titled", "K15", "select news_id, concat_ws(' ', 'Published on ' || strftime(spider_time, '%Y-%m-%d') || '.', title, company) as body, regexp_extract('Published on ' || strftime(spider_time, '%Y-%m-%d') || '.', '\\d{4}-\\d{2}-\\d{2}') as day from finance_news")
def q_titled(t: Tables) -> DataFrame:
    body = T.titled(F.col("title"), F.col("company"), F.col("spider_time"))
    return t("finance_news").select("news_id", body.alias("body"), F.regexp_extract(body, r"\d{4}-\d{2}-\d{2}", 0).alias("day"))


@query("q_len_gate", "K16", "select doc_id, case when length(text) > 50 then length(text) % 3 else 0 end as label from documents")
def q_len_gate(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", T.length_gate(F.col("text"), F.length("text") % 3).alias("label"))


@query("q_abstract_fallback", "K21")
def q_abstract_fallback(t: Tables) -> DataFrame:
    return t("news_body").select("rec_id", T.abstract_or_title(F.get("paragraphs", F.lit(0)), F.col("title")).alias("abstract"))


# ------------------------------------------------------------------ extraction


@query("q_between_markers", "C01", "select doc_id, trim(split_part(substring(text, instr(text, 'compared with') + 13), '.', 1), ' ') as part from documents where contains(text, 'compared with')")
def q_between_markers(t: Tables) -> DataFrame:
    return _docs(t).where("contains(text, 'compared with')").select("doc_id", X.between_markers(F.col("text"), ["compared with"], ["."]).alias("part"))


@query("q_regex_fields", "C02", r"with f as (select doc_id, regexp_extract_all(text, 'TRX-\d{8}') as a, regexp_extract_all(text, 'phase \d[a-z]?') as b from documents) select doc_id, array_to_string(case when len(a) > 0 then a else b end, '|') as found from f where len(a) > 0 or len(b) > 0")
def q_regex_fields(t: Tables) -> DataFrame:
    return _docs(t).select("doc_id", F.array_join(X.first_matches(F.col("text"), [r"TRX-\d{8}", r"phase \d[a-z]?"]), "|").alias("found")).where("found is not null")


@query("q_table_map", "C03 C04 C05", "select c_nationkey, max_by(c_mktsegment, c_custkey) as automobile from customer where c_mktsegment = 'AUTOMOBILE' group by 1")
def q_table_map(t: Tables) -> DataFrame:
    # The last row of each segment is all that the map keeps: a nation's rows are many, its segments few.
    last = t("customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_custkey").alias("c_custkey"))
    rows = last.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))).alias("r"))
    table = X.rows_to_map(F.transform("r", lambda x: F.array(x["c_mktsegment"], x["c_mktsegment"])))
    return rows.select("c_nationkey", F.get(X.table_lookup(table, "^auto"), F.lit(0)).alias("automobile")).where("automobile is not null")


@query(
    "q_claim_refs",
    "C06 F12",
    r"""
    with p as (select claim_id, claim_text as t, '(?i)claims?\s+(\d+)\s*(?:-|–|to|through)\s*(\d+)|权利要求(\d+)\s*[-–~～至到]\s*(\d+)' as f, '(?i)claims?\s+(\d+(?:\s*(?:,|or|and|或|和|、)\s*\d+)*)|权利要求(\d+(?:\s*(?:,|or|and|或|和|、)\s*(?:权利要求)?\d+)*)' as l from patent_claim where claim_text is not null),
    g as (select claim_id, try_cast(regexp_extract(t, f, 1) || regexp_extract(t, f, 3) as integer) as lo, try_cast(regexp_extract(t, f, 2) || regexp_extract(t, f, 4) as integer) as hi, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_extract(t, l, 1) || regexp_extract(t, l, 2), '\d+'), lambda x: cast(x as integer)))) as listed from p)
    select claim_id, array_to_string(case when lo is not null and hi is not null then range(least(lo, hi), greatest(lo, hi) + 1) else listed end, ',') as refs from g
    """,
)
def q_claim_refs(t: Tables) -> DataFrame:
    return t("patent_claim").where("claim_text is not null").select("claim_id", F.array_join(F.transform(X.claim_parents(F.col("claim_text")), lambda x: x.cast("string")), ",").alias("refs"))


@query("q_ranges_to_values", "C07", "select l_orderkey, string_agg(distinct l_linenumber, ',' order by l_linenumber) as vals from lineitem group by 1")
def q_ranges_to_values(t: Tables) -> DataFrame:
    listed = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"))
    return listed.select("l_orderkey", F.array_join(F.transform(X.ranges_to_values(X.values_to_ranges(F.col("n"))), lambda x: x.cast("string")), ",").alias("vals"))


@query("q_values_to_ranges", "C08 W04", "with d as (select distinct l_orderkey, l_linenumber from lineitem where l_quantity > 20), i as (select *, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as g from d), r as (select l_orderkey, min(l_linenumber) as lo, max(l_linenumber) as hi from i group by l_orderkey, g) select l_orderkey, string_agg(case when lo = hi then cast(lo as varchar) else lo || '-' || hi end, ',' order by lo) as ranges from r group by 1")
def q_values_to_ranges(t: Tables) -> DataFrame:
    listed = t("lineitem").where("l_quantity > 20").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("n"))
    return listed.select("l_orderkey", X.values_to_ranges(F.col("n")).alias("ranges"))


@query("q_document_number", "C09 C11", r"select news_id, nullif(regexp_extract('<p>' || title || '</p><p>药监〔2021〕' || news_id || '号</p>', '>\s*([^<>]{1,20}[〔\[（(]\d{4}[〕\]）)]\s*\d+\s*号)\s*<', 1), '') as number, string_split(concat_ws('||', resource, round, amount), '||')[2] as second from finance_news")
def q_document_number(t: Tables) -> DataFrame:
    html = F.concat(F.lit("<p>"), "title", F.lit("</p><p>药监〔2021〕"), F.col("news_id").cast("string"), F.lit("号</p>"))
    return t("finance_news").select("news_id", X.document_number(html).alias("number"), X.part(F.concat_ws("||", "resource", "round", "amount"), "||", 2).alias("second"))


@query("q_table_wins", "C10", "select news_id, coalesce(nullif(trim(round, ' '), ''), amount) as v from finance_news")
def q_table_wins(t: Tables) -> DataFrame:
    return t("finance_news").select("news_id", X.table_or_text(F.col("round"), F.col("amount")).alias("v"))


@query("q_typed_result", "C12 C23", "select o_orderkey, case when o_orderstatus in ('O', 'F') then o_orderstatus end as kind, case when o_orderstatus in ('O', 'F') then o_orderpriority end as result from orders")
def q_typed_result(t: Tables) -> DataFrame:
    r = X.typed_result(F.concat_ws(", ", "o_orderstatus", "o_orderpriority"), ["O", "F"])
    return t("orders").select("o_orderkey", r["type"].alias("kind"), r["result"].alias("result"))


@query("q_epoch_days", "C13", "select news_id, strftime(make_timestamp(publish_date * 1000), '%Y-%m-%d') as day, epoch_ms(cast(strftime(make_timestamp(publish_date * 1000), '%Y-%m-%d') as timestamp)) as ms from finance_news where publish_date is not null")
def q_epoch_days(t: Tables) -> DataFrame:
    day = X.ms_to_day(F.col("publish_date"))
    return t("finance_news").where("publish_date is not null").select("news_id", day.alias("day"), X.day_to_ms(day).alias("ms"))


@query("q_repair_date", "C14 C16", "select o_orderkey, strftime(o_orderdate, '%Y-') || month(o_orderdate) || '-' || day(o_orderdate) as d from orders")
def q_repair_date(t: Tables) -> DataFrame:
    written = F.date_format("o_orderdate", "y.M.d")
    return t("orders").select("o_orderkey", X.repair_date_column(written).alias("d"))


@query("q_repair_month", "C15", "select o_orderkey, month(o_orderdate) as m from orders")
def q_repair_month(t: Tables) -> DataFrame:
    name = F.date_format("o_orderdate", "MMMM")
    misread = F.concat(F.left(name, F.lit(2)), F.lit("x"), F.substring(name, 4, 20))
    return t("orders").select("o_orderkey", F.coalesce(X.repair_month(misread), X.repair_month(name)).cast("bigint").alias("m"))


@query("q_valid_date", "C16", "select o_orderkey, o_orderkey % 2 = 0 as ok from orders")
def q_valid_date(t: Tables) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "y-M-d")).otherwise(F.lit("1899-13-40"))
    return t("orders").select("o_orderkey", X.valid_date(d).alias("ok"))


@query("q_combination_key", "C17 C37", "select o_orderkey, 'US' || left(cast(o_orderkey * 1000 as varchar), length(cast(o_orderkey * 1000 as varchar)) - 1) || 'A' as combo, cast(1988 + 5 as varchar) || lpad(cast(o_orderkey as varchar), 6, '0') as western from orders")
def q_combination_key(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", X.combination_key(F.lit("US"), (F.col("o_orderkey") * 1000).cast("string")).alias("combo"), X.western_number(F.concat(F.lit("平05-"), F.col("o_orderkey").cast("string"))).alias("western"))


@query("q_softmax", "C18", "select vec_id, round(exp(embedding[1]) / (exp(embedding[1]) + exp(embedding[2]) + exp(embedding[3])), 6) as p from embeddings")
def q_softmax(t: Tables) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return t("embeddings").select("vec_id", F.round(X.softmax(v)[0], 6).alias("p"))


@query("q_list_median", "C19", "select l_orderkey, round(median(l_quantity), 6) as m from lineitem group by 1")
def q_list_median(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q")).select("l_orderkey", F.round(X.list_median(F.col("q")), 6).alias("m"))


@query("q_calendar_difference", "C20", "with n as (select o_orderkey, cast(o_orderdate as date) as d, datesub('month', cast(o_orderdate as date), date '2000-01-01') as n from orders), m as (select o_orderkey, d, n - case when d + to_months(cast(n as integer)) > date '2000-01-01' then 1 else 0 end as m from n) select o_orderkey, cast(floor(m / 12) as integer) as years, cast(m - 12 * floor(m / 12) as integer) as months, datediff('day', cast(d + to_months(cast(m as integer)) as date), date '2000-01-01') as days from m")
def q_calendar_difference(t: Tables) -> DataFrame:
    d = X.calendar_difference(F.to_date("o_orderdate"), F.lit("2000-01-01").cast("date"))
    return t("orders").select("o_orderkey", d["years"].alias("years"), d["months"].alias("months"), d["days"].alias("days"))


@query("q_decode_set", "C21", r"with s as (select o_orderkey, list_distinct(list_filter(list_transform(string_split(o_orderstatus || '| ' || o_orderpriority || ' ||' || o_orderstatus, '|'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> '')) as v from orders) select o_orderkey, array_to_string(list_sort(v), ';') as v from s")
def q_decode_set(t: Tables) -> DataFrame:
    s = F.concat("o_orderstatus", F.lit("| "), "o_orderpriority", F.lit(" ||"), "o_orderstatus")
    return t("orders").select("o_orderkey", F.array_join(F.array_sort(X.decode_set(s)), ";").alias("v"))


@query("q_levenshtein", "C24 C35", "select p_partkey, levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) as d from part")
def q_levenshtein(t: Tables) -> DataFrame:
    return t("part").select("p_partkey", F.levenshtein(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))).cast("bigint").alias("d"))


@query("q_repair_entity", "C25 C26")
def q_repair_entity(t: Tables) -> DataFrame:
    entity = F.concat(F.left("p_name", F.lit(4)), F.lit("x"), F.substring("p_name", 6, 6))
    return t("part").select("p_partkey", X.repair_entity_column(F.col("p_name"), entity).alias("entity"), F.round(X.sequence_ratio_column(F.col("p_name"), entity), 6).alias("ratio"))


@query("q_json_props", "C29", "select event_id, json_keys(props) is not null as has, md5(props) as h from events where props is not null")
def q_json_props(t: Tables) -> DataFrame:
    return t("events").where("props is not null").select("event_id", F.from_json("props", "map<string,string>").isNotNull().alias("has"), F.md5("props").alias("h"))


@query("q_id_path", "C30 C31", "select c_custkey, md5(c_name) as esid, r_name || '/' || n_name as path from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def q_id_path(t: Tables) -> DataFrame:
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.md5("c_name").alias("esid"), F.concat_ws("/", "r_name", "n_name").alias("path"))


@query("q_merge_maps", "C32 C33", "select o_custkey, count(*) filter (where o_orderstatus = 'O') as n_o, greatest(max(o_totalprice) filter (where o_orderstatus = 'O'), max(o_totalprice) filter (where o_orderstatus = 'F')) as top from orders group by 1 having n_o > 0 and top is not null")
def q_merge_maps(t: Tables) -> DataFrame:
    pick = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    g = t("orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "O").alias("n_o"), pick("O").alias("a"), pick("F").alias("b"))
    merged = X.merge_maps(F.create_map(F.lit("top"), "a"), F.create_map(F.lit("top"), "b"), "greatest")
    return g.where("n_o > 0").select("o_custkey", "n_o", merged["top"].alias("top")).where("top is not null")


@query("q_parameter_grid", "C34", "select a, b, c from (values (100), (10)) x(a), (values (10)) y(b), (values (100), (30)) z(c)")
def q_parameter_grid(t: Tables) -> DataFrame:
    return X.parameter_grid(t.spark, {"a": [100, 10], "b": [10], "c": [100, 30]})


@query("q_split_at_keywords", "C36")
def q_split_at_keywords(t: Tables) -> DataFrame:
    return _docs(t).where("text is not null").select("doc_id", F.posexplode(X.split_at_keywords(F.col("text"), ["compared with", "patients", "approximately"])).alias("pos", "piece"))


@query("q_keyword_date", "C38")
def q_keyword_date(t: Tables) -> DataFrame:
    return X.keyword_then_date(t("documents").where("kind = 'tender'"), "doc_id", "text", "bids", r"[A-Z][a-z]+ \d{1,2}, \d{4}")


@query("q_box_cm", "C39", "select page_id, round(x0_t * 2.54, 6) as x0_t, round(y0_t * 2.54, 6) as y0_t from title_page where x0_t is not null")
def q_box_cm(t: Tables) -> DataFrame:
    return t("title_page").where("x0_t is not null").select("page_id", *X.inches_to_cm("x0_t", "y0_t")).withColumns({"x0_t": F.round("x0_t", 6), "y0_t": F.round("y0_t", 6)})


@query("q_url_parts", "C02", "select page_id, site as host, '/p/' || page_id as path from news_page")
def q_url_parts(t: Tables) -> DataFrame:
    parts = X.url_parts(F.concat(F.lit("https://"), "site", F.lit("/p/"), F.col("page_id").cast("string"), F.lit("?q=1")))
    return t("news_page").select("page_id", parts["host"].alias("host"), parts["path"].alias("path"))


# ------------------------------------------------------------------ sequences


@query("q_seq_normalise", "B05 B01", "select doc_id, regexp_replace(translate(regexp_replace(lower(text), '[\\s\\d]', '', 'g'), 'u', 't'), '[^acgtn]', 'n', 'g') as dna from documents where length(text) between 1 and 400 and not regexp_matches(text, '[^\\x00-\\x7f]')")
def q_seq_normalise(t: Tables) -> DataFrame:
    return _docs(t).where(F.length("text").between(1, 400) & ~F.regexp_like("text", F.lit(r"[^\x00-\x7f]"))).select("doc_id", B.normalise_dna(F.col("text")).alias("dna"))


@query("q_seq_records", "B01 B02 B03 B04")
def q_seq_records(t: Tables) -> DataFrame:
    """Sequence lines made of claim numbers and parts' names: header, residues, next header."""
    lines = t("part").select((F.col("p_partkey") % 20).cast("string").alias("patent_id"), F.explode(F.array(F.struct((F.col("p_partkey") * 2).alias("line_no"), F.lit("<400》 1").alias("line")), F.struct((F.col("p_partkey") * 2 + 1).alias("line_no"), F.lit("Arg Met Phe Pro Ala").alias("line")))).alias("x")).select("patent_id", "x.line_no", "x.line")
    merged = B.merge_lines(lines)
    return merged.select("patent_id", "seq_no", "kind", B.one_letter(F.regexp_replace("sequence", " ", "")).alias("residues"), B.repair_amino(F.lit("Sor Va ala g Met")).alias("repaired"))


@query("q_motif_expand", "B06")
def q_motif_expand(t: Tables) -> DataFrame:
    return t("region").select("r_regionkey", F.explode(B.expand_motif_column(F.concat(F.lit("DA[EF]X{2,3}"), F.left("r_name", F.lit(1))))).alias("sequence"))
