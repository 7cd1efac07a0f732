"""Retrieval, duplicates, folding and hierarchies of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.catalogue.registry import Tables, query
from tessella.operators import similar as V
from tessella.operators import terms as G

_DOT = "list_sum(list_transform(range(1, 65), lambda i: cast(a.embedding[i] as double) * cast(b.embedding[i] as double)))"
_HITS = f"with s as (select a.vec_id as query_id, b.vec_id as item_id, round({_DOT}, 9) as score from embeddings a join embeddings b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), h as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)"


def _hits(t: Tables, k: int = 10) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    e = t("embeddings")
    return V.nearest(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding"), k, exclude_self=True)


@query("q_vec_topk", "V01 V13 J16 S34", f"{_HITS} select query_id, item_id, round(score, 6) as score, rank from h where rank <= 10")
def q_vec_topk(t: Tables) -> DataFrame:
    return _hits(t).withColumn("score", F.round("score", 6))


#: Cells of the inverted index and cells that a query probes.
CELLS, PROBES = 16, 11


@query("q_ivf_topk", "V01 S34")
def q_ivf_topk(t: Tables) -> DataFrame:
    """The inverted index over all vectors; its recall against the exact search is tested to be 0.9 or more."""
    e = t("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    centres = V.fit_cells(e, CELLS)
    asked = t("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.nearest_in_cells(asked, V.index_cells(e, centres), centres, 10, PROBES)


@query("q_vec_threshold", "V02 V03", f"{_HITS} select query_id, item_id from h where rank <= 20 and score > 0.3")
def q_vec_threshold(t: Tables) -> DataFrame:
    return V.over_threshold(_hits(t, 20), 0.3).select("query_id", "item_id")


@query("q_vec_label_vote", "V04 V07", f"{_HITS}, v as (select query_id, label, count(*) as n, sum(score) as s from h join embeddings on vec_id = item_id where rank <= 10 group by 1, 2) select query_id, arg_min(label, struct_pack(a := -n, b := -round(s, 6), c := label)) as label from v group by 1")
def q_vec_label_vote(t: Tables) -> DataFrame:
    return V.vote(_hits(t), t("embeddings").select(F.col("vec_id").alias("item_id"), "label"))


@query("q_best_or_positive", "V04 V06", f"{_HITS}, m as (select *, max(score) over (partition by query_id) as top from h where rank <= 10) select query_id, item_id from m where (top >= 0.35 and score >= 0.35) or (top < 0.35 and score = top)")
def q_best_or_positive(t: Tables) -> DataFrame:
    return V.best_or_positive(_hits(t), "query_id", "score", 0.35).select("query_id", "item_id")


_TOK = r"regexp_extract_all(lower(text), '[぀-ヿ㐀-鿿]|[a-z0-9À-ɏͰ-ӿ]+')"


@query(
    "q_bm25_topk", "V05 V08",
    f"""with d as (select doc_id, {_TOK} as t from documents where text is not null), l as (select doc_id, len(t) as len from d), n as (select count(*) as N, avg(len) as a from l),
    q as (select distinct item_id, unnest({_TOK}) as term from eval_item where item_id % 20 = 0), p as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from d) where term in (select term from q) group by 1, 2), f as (select term, count(*) as df from p group by 1),
    w as (select p.doc_id, p.term, ln((N - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / a)) as w from p join f using (term) join l using (doc_id) cross join n),
    s as (select item_id, doc_id, round(sum(w), 6) as score from w join q using (term) group by 1, 2), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) select item_id, doc_id, rank from r where rank <= 5""",
)
def q_bm25_topk(t: Tables) -> DataFrame:
    asked = t("eval_item").where("item_id % 20 = 0").select("item_id", F.col("text").alias("q"))
    return V.bm25(t("documents"), asked, "doc_id", "text", "item_id", "q", 5).select("item_id", "doc_id", "rank")


@query("q_dedup_exact", "V09 U02", r"with f as (select doc_id, coalesce(md5(lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g'))), '#' || doc_id) as h from documents) select doc_id, min(doc_id) over (partition by h) as class_id, count(*) over (partition by h) as copies from f")
def q_dedup_exact(t: Tables) -> DataFrame:
    return V.exact_classes(t("documents"), "doc_id", "text")


@query("q_dedup_contain", "V09")
def q_dedup_contain(t: Tables) -> DataFrame:
    return V.contained_titles(t("finance_news"), "news_id", "title")


@query("q_trigram_overlap", "V15 T06", "with w as (select p_partkey, string_split(lower(p_name || ' of ' || replace(p_brand, '#', '') || ' with ' || p_type), ' ') as t from part), g as (select p_partkey, list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) as g from w) select a.p_partkey, list_has_any(a.g, b.g) as blocked from g a join g b on b.p_partkey = a.p_partkey + 1")
def q_trigram_overlap(t: Tables) -> DataFrame:
    """Whether each part's description shares a trigram with the next part's."""
    described = F.concat_ws(" ", "p_name", F.lit("of"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit("with"), "p_type")
    p = t("part").select("p_partkey", described.alias("d"))
    following = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("d").alias("e"))
    return p.join(following, "p_partkey").select("p_partkey", V.blocks_trigram(F.col("d"), F.col("e")).alias("blocked"))


@query("q_minhash", "V09 V15")
def q_minhash(t: Tables) -> DataFrame:
    return V.near_duplicates(t("documents"), "doc_id", "text")


_RANK = "case resource " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(V.SOURCES)) + " end"
HEAD_ORDER = f"coalesce(try_cast(is_publish as integer), 0) desc, coalesce(try_cast(is_new as integer), 1) asc, {_RANK} asc nulls last, publish_date asc nulls last, e"


def _news(t: Tables) -> DataFrame:
    """News with the row's id as the document id, as esids repeat."""
    return t("finance_news").withColumn("esid", F.lpad(F.col("news_id").cast("string"), 12, "0"))


@query("q_head_election", "W01 V12", f"with n as (select *, lpad(cast(news_id as varchar), 12, '0') as e, case when coalesce(company <> '' and round <> '' and amount <> '', false) then company || chr(1) || round || chr(1) || amount else chr(2) || lpad(cast(news_id as varchar), 12, '0') end as g from finance_news) select e as esid, first_value(e) over w as head, first_value(e) over w = e as is_head from n window w as (partition by g order by {HEAD_ORDER})")
def q_head_election(t: Tables) -> DataFrame:
    return V.elect_heads(_news(t)).select("esid", "head", "is_head")


@query(
    "q_fold_week", "V12 J15 W01",
    f"""with n as (select *, lpad(cast(news_id as varchar), 12, '0') as e from finance_news), q as (select e as article_id, publish_date as d, nullif(company, '') as qc, nullif(round, '') as qr, nullif(amount, '') as qa from n where news_id % 20 = 0 and publish_date is not null),
    f as (select article_id, e, row_number() over (partition by article_id order by {HEAD_ORDER}) as r from q join n on n.publish_date between d - 604800000 and d + 86400000 and (qc is null or qc = company) and (qr is null or coalesce(qr = round, false)) and (qa is null or coalesce(qa = amount, false)) and coalesce(label <> '非相关', true) and coalesce(is_new <> '-1', true))
    select q.article_id, coalesce(f.e, q.article_id) as head, coalesce(f.e, q.article_id) = q.article_id as is_head from q left join f on f.article_id = q.article_id and f.r = 1""",
)
def q_fold_week(t: Tables) -> DataFrame:
    n = _news(t)
    asked = n.where("news_id % 20 = 0 and publish_date is not null").select(F.col("esid").alias("article_id"), F.col("publish_date").alias("date_ms"), F.col("company").alias("investee"), "round", "amount")
    return V.fold(asked, n)


@query("q_week_clusters", "V10 V11 Z01")
def q_week_clusters(t: Tables) -> DataFrame:
    n = t("finance_news").where("news_id is not null")
    classes = V.contained_titles(n, "news_id", "title", 1).join(n.select("news_id", "publish_date"), "news_id")
    # Neighbours in time are linked; a row without a time links with all of its class.
    in_time = Window.partitionBy("class_id").orderBy("publish_date", "news_id")
    timed = classes.where("publish_date is not null").select(F.lag("news_id").over(in_time).alias("a"), F.col("news_id").alias("b")).where("a is not null")
    timeless = classes.where("publish_date is null").groupBy("class_id").agg(F.min("news_id").alias("a"))
    rest = classes.join(timeless, "class_id").where("news_id <> a").select("a", F.col("news_id").alias("b"))
    pairs = timed.unionByName(rest).withColumn("score", F.lit(1.0))
    return V.week_clusters(pairs, n.select("news_id", "publish_date"), "news_id", "publish_date", 0.8)


@query("q_cluster_update", "V11 S14", "select cast(o_custkey as varchar) as clusterid, string_agg(o_orderkey, ',' order by cast(o_orderkey as varchar)) as members from orders where o_orderstatus <> 'F' or o_orderkey % 5 <> 0 group by 1")
def q_cluster_update(t: Tables) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").cast("string").alias("clusterid"), F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus", "o_orderkey")
    base = o.where("o_orderstatus = 'F'").groupBy("clusterid").agg(F.collect_set("id").alias("cluster"))
    changes = o.where("o_orderstatus <> 'F'").select("clusterid", "id", F.lit(True).alias("add")).unionByName(o.where("o_orderstatus = 'F' and o_orderkey % 5 = 0").select("clusterid", "id", F.lit(False).alias("add")))
    return V.update_clusters(base, changes).select("clusterid", F.array_join("cluster", ",").alias("members"))


# ------------------------------------------------------------------ hierarchies of terms


def _edges(t: Tables) -> DataFrame:
    """region > nation > customer, and nations under a second parent by their key."""
    n = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"))
    second = t("nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"), F.lit("x").alias("parent"))
    c = t("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"))
    return n.unionByName(second).unionByName(c)


_EDGES = "with recursive e as (select 'n' || n_nationkey as child, 'r' || n_regionkey as parent from nation union all select 'n' || n_nationkey, 'x' from nation where n_nationkey % 3 = 0 union all select 'c' || c_custkey, 'n' || c_nationkey from customer), a as (select child as descendant, parent as ancestor, 1 as depth from e union select a.descendant, e.parent, a.depth + 1 from a join e on e.child = a.ancestor)"


@query("q_closure", "G01 G03 G06", f"{_EDGES} select descendant, ancestor, min(depth) as depth from a group by 1, 2")
def q_closure(t: Tables) -> DataFrame:
    return G.closure(_edges(t))


@query("q_drop_parent", "G02 N05", f"{_EDGES}, tg as (select o_custkey as k, 'c' || o_custkey as term from orders where o_orderkey % 3 = 0 union select o_custkey, 'n' || (o_custkey % 25) from orders union select o_custkey, 'r' || (o_custkey % 5) from orders) select tg.k, tg.term from tg where not exists (select 1 from tg b join a on a.descendant = b.term where b.k = tg.k and a.ancestor = tg.term)")
def q_drop_parent(t: Tables) -> DataFrame:
    o = t("orders")
    k = F.col("o_custkey").alias("k")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string")).alias("term")
    tags = o.where("o_orderkey % 3 = 0").select(k, text("c", F.col("o_custkey"))).unionByName(o.select(k, text("n", F.col("o_custkey") % 25))).unionByName(o.select(k, text("r", F.col("o_custkey") % 5))).distinct()
    return G.drop_ancestors(tags, G.closure(_edges(t)), "k", "term")


@query("q_drop_included", "G05 J19", "with tg as (select c_custkey as k, unnest([c_nationkey, (c_nationkey + 1) % 25]) as term from customer), inside as (select a.n_nationkey as i, b.n_nationkey as o from nation a join nation b on lower(a.n_name) <> lower(b.n_name) and contains(lower(b.n_name), lower(a.n_name))), covered as (select distinct k, i as term from tg join inside on tg.term = o) select k, term from tg where (k, term) not in (select k, term from covered)")
def q_drop_included(t: Tables) -> DataFrame:
    names = t("nation").select(F.col("n_nationkey").alias("term"), F.lower("n_name").alias("name"))
    tags = t("customer").select(F.col("c_custkey").alias("k"), F.explode(F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25)).alias("term"))
    return G.drop_included(tags, names, "k", "term")


@query("q_roots", "G04", f"{_EDGES} select distinct parent as node from e where parent not in (select child from e)")
def q_roots(t: Tables) -> DataFrame:
    return G.roots(_edges(t))


@query("q_siblings", "G03", "select a.n_nationkey as node, b.n_nationkey as sibling from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey <> b.n_nationkey")
def q_siblings(t: Tables) -> DataFrame:
    return G.siblings(t("nation").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent")))


@query("q_aunts", "G03", f"{_EDGES}, s as (select distinct x.child as node, y.child as sibling from e x join e y on x.parent = y.parent and x.child <> y.child) select distinct a.descendant as node, s.sibling as aunt from a join s on s.node = a.ancestor where not exists (select 1 from a z where z.descendant = a.descendant and z.ancestor = s.sibling) and a.descendant <> s.sibling")
def q_aunts(t: Tables) -> DataFrame:
    e = _edges(t)
    return G.aunts(e, G.closure(e))


@query("q_infer_area", "G07 N19", "select c_custkey, n_name as city, r_name as province from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def q_infer_area(t: Tables) -> DataFrame:
    areas = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("province"), F.col("n_name").alias("city"), F.col("n_nationkey").cast("string").alias("district"))
    rows = t("customer").select("c_custkey", F.lit(None).cast("string").alias("province"), F.lit(None).cast("string").alias("city"), F.col("c_nationkey").cast("string").alias("district"))
    return G.infer_area(rows, areas).select("c_custkey", "city", "province")
