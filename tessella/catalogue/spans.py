"""Dictionary tagging, spans, BIO, keyword scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.operators import dictionary as D
from tessella.operators import keywords as K
from tessella.operators import metrics as M

_WORDS = ("placebo", "gene therapy", "therapy", "asthma", "severe asthma", "phase", "patients", "antibody")


def _dictionary(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(w,) for w in _WORDS], "entry string")


def _texts(t: Tables) -> DataFrame:
    return t("documents").where("lang = 'en'").select("doc_id", "text")


_SQL_WORDS = ", ".join(f"('{w}')" for w in _WORDS)


@query("q_dict_tag", "N01 N02 N03 N05 P33 D12", f"with w(entry) as (values {_SQL_WORDS}) select doc_id, '|' || string_agg(entry, '|' order by entry) || '|' as encoded from documents join w on contains(text, entry) where lang = 'en' group by 1")
def q_dict_tag(t: Tables) -> DataFrame:
    return D.tag(_texts(t), _dictionary(t), "doc_id", "text").select("doc_id", "encoded")


_OCC = f"""with w(entry) as (values {_SQL_WORDS}), p as (select doc_id, text, entry, unnest(range(0, length(text) - length(entry) + 1)) as start from documents join w on contains(text, entry) where lang = 'en'),
o as (select doc_id, entry, start, start + length(entry) as "end" from p where substring(text, start + 1, length(entry)) = entry)"""


@query("q_spans", "N04 N23", f'{_OCC} select doc_id, entry, start, "end" from o')
def q_spans(t: Tables) -> DataFrame:
    return D.occurrences(_texts(t), _dictionary(t), "doc_id", "text")


@query("q_spans_unnested", "N04", f'{_OCC} select doc_id, entry, start, "end" from o a where not exists (select 1 from o b where b.doc_id = a.doc_id and b.start <= a.start and b."end" >= a."end" and (b.start < a.start or b."end" > a."end"))')
def q_spans_unnested(t: Tables) -> DataFrame:
    return D.outermost(D.occurrences(_texts(t), _dictionary(t), "doc_id", "text"), "doc_id").select("doc_id", "entry", "start", "end")


@query("q_leftmost_longest", "N05")
def q_leftmost_longest(t: Tables) -> DataFrame:
    return D.leftmost_longest(D.occurrences(_texts(t), _dictionary(t), "doc_id", "text"), "doc_id")


@query("q_containing_groups", "N01 G05", f"with w(entry) as (values {_SQL_WORDS}) select a.entry as inner, b.entry as outer from w a join w b on a.entry <> b.entry and contains(b.entry, a.entry)".replace(" as inner", ' as "inner"').replace(" as outer", ' as "outer"'))
def q_containing_groups(t: Tables) -> DataFrame:
    return D.containing_groups(_dictionary(t))


@query("q_synonym_rule", "N09", r"with w(node_id, name) as (values (1, 'il-17'), (2, 'asthma'), (3, 'mab'), (4, '17')) select distinct doc_id, node_id from documents join w on regexp_matches(lower(text), '(^|[^a-z])' || name || '([^a-z]|$)') where lang = 'en' and not regexp_matches(name, '^\d*$')")
def q_synonym_rule(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(1, "IL-17"), (2, "Asthma"), (3, "mab"), (4, "17")], "node_id int, name string")
    return D.synonym_rule(_texts(t), names, "doc_id", "text")


@query("q_labelled_lines", "N21")
def q_labelled_lines(t: Tables) -> DataFrame:
    rows = t("documents").where("lang = 'zh' and length(text) < 500").select("doc_id", "text", F.array(F.lit("药物"), F.lit("患者"), F.lit("融资")).alias("entities"))
    return D.labelled_lines(rows, "doc_id", "text", "entities")


def _bio(t: Tables) -> DataFrame:
    """A token table made of events: each user's events in time order, labelled by value."""
    e = t("events").select("user_id", "event_id", "event_type", "value")
    kind = F.when(F.col("value") < 30, "O").when(F.col("value") < 50, "b-low").when(F.col("value") < 70, "i-low").when(F.col("value") < 85, "b-high").otherwise("i-high")
    return e.select(F.col("user_id").alias("sentence_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("words"), kind.alias("labels"))


_BIO = """with b as (select user_id as sentence_id, event_id as pos, event_type as words, case when value < 30 then 'O' when value < 50 then 'b-low' when value < 70 then 'i-low' when value < 85 then 'b-high' else 'i-high' end as l from events),
k as (select *, case when l <> 'O' then substring(l, 3) end as k from b), p as (select *, lag(k) over (partition by sentence_id order by pos) as pk from k),
s as (select *, case when k is not null and (l like 'b-%' or pk is null or pk <> k) then 1 else 0 end as st from p), n as (select *, sum(st) over (partition by sentence_id order by pos) as n from s where k is not null)"""


@query("q_bio_decode", "W02 N11 N13 N22", f"{_BIO} select sentence_id, k as kind, min(pos) as start, max(pos) + 1 as \"end\", string_agg(words, ' ' order by pos) as phrase from n group by sentence_id, n, k")
def q_bio_decode(t: Tables) -> DataFrame:
    return D.bio_spans(_bio(t), ["sentence_id"])


@query("q_bio_indices", "N22")
def q_bio_indices(t: Tables) -> DataFrame:
    return D.index_strings(D.bio_spans(_bio(t).withColumn("pos", F.col("pos").cast("int")), ["sentence_id"]).where("end - start < 50"), ["sentence_id"], "high")


@query("q_bio_settle", "N12")
def q_bio_settle(t: Tables) -> DataFrame:
    return D.settle_classes(_bio(t), ["sentence_id"]).select("sentence_id", "pos", "labels")


@query("q_classes_once", "N16", "with a as (select o_custkey, list(distinct o_orderpriority order by o_orderpriority) filter (where o_orderstatus = 'F') as c1, list(distinct o_orderpriority order by o_orderpriority) filter (where o_orderstatus = 'O') as c2 from orders group by 1) select o_custkey, array_to_string(coalesce(c1, []), ';') as c1, array_to_string(list_filter(coalesce(c2, []), lambda x: not list_contains(coalesce(c1, []), x)), ';') as c2 from a")
def q_classes_once(t: Tables) -> DataFrame:
    pick = lambda s: F.sort_array(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))))
    a = t("orders").groupBy("o_custkey").agg(pick("F").alias("c1"), pick("O").alias("c2"))
    out = D.classes_once({"c1": F.col("c1"), "c2": F.col("c2")})
    return a.select("o_custkey", *[F.array_join(c, ";").alias(n) for n, c in out.items()])


@query("q_align_roles", "J20 N15", "select l_orderkey, string_agg(l_linenumber, ';' order by l_linenumber) filter (where l_returnflag = 'R') as lead from lineitem group by 1 having lead is not null")
def q_align_roles(t: Tables) -> DataFrame:
    rows = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    roles = D.align_roles(F.transform("x", lambda r: F.struct(r["l_returnflag"].alias("behavior"))), F.transform("x", lambda r: r["l_linenumber"].cast("string")), {"R": "lead"})
    return rows.select("l_orderkey", F.try_element_at(roles, F.lit("lead")).alias("lead")).where("lead is not null")


@query("q_term_statistics", "N06")
def q_term_statistics(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([("asthma", "asthma"), ("asthma", "severe asthma"), ("gene", "gene therapy")], "term string, name string")
    return K.term_statistics(_texts(t), names, "doc_id", "text")


@query("q_keyword_score", "N07 T07", "with w(term) as (values ('placebo'), ('asthma'), ('phase'), ('patients')), d as (select doc_id, left(text, 200) as a, text as c from documents where lang = 'en' and text is not null), s as (select doc_id, term, (length(a) - length(replace(a, term, ''))) // length(term) as n1, case when contains(a, term) then null else length(a) end as m1, (length(c) - length(replace(c, term, ''))) // length(term) as n2, length(c) as lc, a, c from d cross join w) select doc_id, term, n1, n2 from s where n1 + n2 > 0")
def q_keyword_score(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(x, x) for x in ("placebo", "asthma", "phase", "patients")], "term string, name string")
    d = _texts(t).where("text is not null")
    a = K.term_statistics(d.withColumn("text", F.left("text", F.lit(200))), names, "doc_id", "text")
    c = K.term_statistics(d, names, "doc_id", "text")
    scored = K.score(a, c, "doc_id").join(a.select("doc_id", "term", F.col("n").alias("n1")), ["doc_id", "term"]).join(c.select("doc_id", "term", F.col("n").alias("n2")), ["doc_id", "term"])
    return scored.where("n1 + n2 > 0").select("doc_id", "term", "n1", "n2")


@query("q_keyword_rank", "N07 T07")
def q_keyword_rank(t: Tables) -> DataFrame:
    names = t.spark.createDataFrame([(x, x) for x in ("placebo", "asthma", "phase", "patients")], "term string, name string")
    d = _texts(t).where("text is not null")
    a, c = K.term_statistics(d.withColumn("text", F.left("text", F.lit(200))), names, "doc_id", "text"), K.term_statistics(d, names, "doc_id", "text")
    return K.rank(K.score(a, c, "doc_id"), "doc_id").withColumn("score", F.round("score", 6))


_SETS = """with s as (select o_custkey, o_custkey % 5 as prefix, coalesce(list(distinct o_orderpriority) filter (where o_orderstatus = 'F'), []) as t, coalesce(list(distinct o_orderpriority) filter (where o_orderstatus = 'O'), []) as p from orders group by 1)"""


def _sets(t: Tables) -> DataFrame:
    pick = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return t("orders").groupBy("o_custkey").agg(pick("F").alias("t"), pick("O").alias("p")).withColumn("prefix", F.col("o_custkey") % 5)


@query(
    "q_entity_score", "M01 M13",
    f"""{_SETS}, c as (select prefix, len(t) as nt, len(p) as np, len(list_intersect(t, p)) as c from s),
    a as (select prefix, grouping(prefix) as total, count(*) filter (where nt > 0) as pos_n, count(*) filter (where nt = 0) as neg_n, coalesce(sum(c) filter (where nt > 0), 0) as correct, coalesce(sum(least(nt, np) - c) filter (where nt > 0), 0) as wrong,
      coalesce(sum(greatest(nt - np, 0)) filter (where nt > 0), 0) as omitted, coalesce(sum(greatest(np - nt, 0)) filter (where nt > 0), 0) as redundant, count(*) filter (where nt = 0 and np = 0) as neg_correct, coalesce(sum(np) filter (where nt = 0), 0) as neg_redundant from c group by grouping sets ((prefix), ())),
    r as (select *, coalesce(correct / nullif(correct + wrong + omitted + redundant, 0), 0.0) as ps, coalesce(neg_correct / nullif(neg_correct + neg_redundant, 0), 0.0) as ns from a)
    select prefix, pos_n, neg_n, correct::bigint as correct, wrong::bigint as wrong, omitted::bigint as omitted, redundant::bigint as redundant, round(ps, 6) as pos_score, round(ns, 6) as neg_score, round((pos_n * ps + neg_n * ns) / (pos_n + neg_n), 6) as score from r""",
)
def q_entity_score(t: Tables) -> DataFrame:
    return M.entity_score(_sets(t), "t", "p", ["prefix"]).drop("neg_correct", "neg_redundant")


@query("q_loose_score", "M02 M03", f"{_SETS} select prefix, round(sum(case when len(t) = 0 and len(p) = 0 then 1 else len(list_intersect(t, p)) end) / sum(case when len(t) = 0 and len(p) = 0 then 1 else greatest(len(t), len(p)) end), 6) as score from s group by 1")
def q_loose_score(t: Tables) -> DataFrame:
    return M.set_accuracy(_sets(t), "t", "p", ["prefix"])


@query("q_recall_at_k", "M04", f"{_SETS} select round(avg(case when list_has_all(p, t) then 1.0 else 0.0 end), 6) as recall from s")
def q_recall_at_k(t: Tables) -> DataFrame:
    return M.retrieval_recall(_sets(t), "t", "p")


@query(
    "q_prf_macro_micro", "M05 A27",
    f"""{_SETS}, c as (select len(t) as nt, len(p) as np, len(list_intersect(t, p)) as c from s), r as (select *, case when nt = 0 and np = 0 then 1.0 else coalesce(c / nullif(np, 0), 0.0) end as pr, case when nt = 0 and np = 0 then 1.0 else coalesce(c / nullif(nt, 0), 0.0) end as rc from c)
    select round(avg(pr), 6) as macro_p, round(avg(rc), 6) as macro_r, round(avg(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0.0)), 6) as macro_f, round(sum(c) / sum(np), 6) as micro_p, round(sum(c) / sum(nt), 6) as micro_r, round(2 * (sum(c) / sum(np)) * (sum(c) / sum(nt)) / (sum(c) / sum(np) + sum(c) / sum(nt)), 6) as micro_f from r""",
)
def q_prf_macro_micro(t: Tables) -> DataFrame:
    return M.keyword_prf(_sets(t), "t", "p")


@query("q_classification_report", "M06 M07")
def q_classification_report(t: Tables) -> DataFrame:
    return M.classification_report(t("orders").withColumn("guess", F.when(F.col("o_orderkey") % 4 == 0, F.lit("F")).otherwise(F.col("o_orderstatus"))), "o_orderstatus", "guess")


@query("q_accuracy", "M07 A27", "with a as (select o_orderpriority, avg(case when case when o_orderkey % 4 = 0 then 'F' else o_orderstatus end = o_orderstatus then 1.0 else 0.0 end) as a, count(*) as n from orders group by 1) select round(avg(a), 6) as macro, round(sum(a * n) / sum(n), 6) as micro from a")
def q_accuracy(t: Tables) -> DataFrame:
    d = t("orders").withColumn("guess", F.when(F.col("o_orderkey") % 4 == 0, F.lit("F")).otherwise(F.col("o_orderstatus")))
    return M.macro_micro(d, "o_orderpriority", "o_orderstatus", "guess")


@query("q_phrase_report", "M06")
def q_phrase_report(t: Tables) -> DataFrame:
    true = D.bio_spans(_bio(t), ["sentence_id"])
    guess = D.bio_spans(_bio(t).withColumn("labels", F.when(F.col("pos") % 17 == 0, "O").otherwise(F.col("labels"))), ["sentence_id"])
    return M.phrase_report(true, guess, ["sentence_id"])


@query("q_rouge", "M08 M09")
def q_rouge(t: Tables) -> DataFrame:
    r = M.rouge_n(F.col("p_name"), F.col("p_type"), 1)
    return t("part").select("p_partkey", r["p"].alias("p"), r["r"].alias("r"), r["f"].alias("f"), F.round(M.rouge_l(F.col("p_name"), F.col("p_type")), 6).alias("l"))


@query("q_edit_ratio_mean", "M09")
def q_edit_ratio_mean(t: Tables) -> DataFrame:
    return M.average_edit_ratio(t("part"), "p_name", "p_type")


@query("q_reference_accuracy", "M10", "with r as (select l_orderkey, count(*) as n from lineitem group by 1), s as (select n, case when l_orderkey % 3 = 0 then 1 else n end as ok from r) select round(avg(case when ok = n then 1.0 else 0.0 end), 6) as article_accuracy, round(cast(sum(ok) as double) / sum(n), 6) as flat_accuracy from s")
def q_reference_accuracy(t: Tables) -> DataFrame:
    refs = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"))
    return M.reference_accuracy(refs.withColumn("b", F.when(F.col("l_orderkey") % 3 == 0, F.slice("a", 1, 1)).otherwise(F.col("a"))), "l_orderkey", "a", "b")


@query("q_version_table", "M11", "select o_orderstatus as subproject, left(o_orderpriority, 1) as metric, round(avg(o_totalprice) filter (where o_custkey % 2 = 0), 6) as v0, round(avg(o_totalprice) filter (where o_custkey % 2 = 1), 6) as v1 from orders group by 1, 2")
def q_version_table(t: Tables) -> DataFrame:
    s = t("orders").select(F.col("o_orderstatus").alias("subproject"), F.left("o_orderpriority", F.lit(1)).alias("metric"), F.concat(F.lit("v"), (F.col("o_custkey") % 2).cast("string")).alias("version"), F.col("o_totalprice").alias("value"))
    return M.version_table(s, ["v0", "v1"])
