"""Similarity, lexical and vector retrieval, duplicates and folding."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.operators.components import components
from tessella.plans.pairs import GROUP_BLOCK, split_join
from tessella.plans.query import tokens
from tessella.plans.runtime import broadcast_if_small, cut, let, spread

#: Query vectors in one block that meets the corpus.
QUERY_BLOCK = 4096


def inner_product(a: Column, b: Column) -> Column:
    """The inner product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``(query_id, item_id, score, rank)``: the k items of greatest inner product for each query, ties by id; exact.

    The queries are a stated set: they travel in blocks of ``QUERY_BLOCK``, and
    each task keeps its own k best before anything is shuffled, so what moves is
    tasks × queries × k rows, whatever the size of the corpus. Null vectors fall out.
    """
    spark = corpus.sparkSession
    q_kind, i_kind = queries.schema[query_id].dataType.simpleString(), corpus.schema[item_id].dataType.simpleString()
    rows = spread(corpus.where(F.col(vector).isNotNull()).select(F.col(item_id).alias("i"), F.col(vector).alias("v")))

    def meet(ids: list, vectors: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, np.asarray(vectors, np.float64)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            keep_scores: np.ndarray | None = None
            keep_items: np.ndarray | None = None
            for batch in batches:
                if batch.empty:
                    continue
                items = batch["i"].to_numpy()
                scores = matrix @ np.stack(batch["v"].to_numpy()).astype(np.float64).T
                scores = np.round(scores, 9)
                if exclude_self:
                    scores[np.asarray(names)[:, None] == items[None, :]] = -np.inf
                tiled = np.broadcast_to(items, scores.shape)
                if keep_scores is not None:
                    scores, tiled = np.hstack([keep_scores, scores]), np.hstack([keep_items, tiled])
                order = np.lexsort((tiled, -scores), axis=1)[:, :k]
                keep_scores, keep_items = np.take_along_axis(scores, order, 1), np.take_along_axis(tiled, order, 1)
            if keep_scores is not None:
                n = keep_scores.shape[1]
                out = pd.DataFrame({"q": np.repeat(np.asarray(names), n), "i": keep_items.ravel(), "score": keep_scores.ravel()})
                yield out[np.isfinite(out["score"])]

        return rows.mapInPandas(run, f"q {q_kind}, i {i_kind}, score double")

    out, ids, vectors = None, [], []
    for row in queries.where(F.col(vector).isNotNull()).select(query_id, vector).toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == QUERY_BLOCK:
            out = meet(ids, vectors) if out is None else out.unionByName(meet(ids, vectors))
            ids, vectors = [], []
    if ids or out is None:
        last = meet(ids, vectors) if ids else rows.limit(0).select(F.lit(None).cast(q_kind).alias("q"), "i", F.lit(0.0).alias("score"))
        out = last if out is None else out.unionByName(last)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("i").alias(item_id), "score", "rank")


#: Vectors that the centroids of an inverted index are fitted on, at most.
INDEX_SAMPLE = 20_000


def fit_cells(corpus: DataFrame, cells: int, vector: str = "embedding", sample: int = INDEX_SAMPLE, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Unit centroids of an inverted index, by spherical k-means on a hashed sample of at most ``sample`` vectors."""
    drawn = corpus.where(F.col(vector).isNotNull()).select(vector).orderBy(F.xxhash64(vector)).limit(sample).collect()
    x = np.asarray([r[0] for r in drawn], np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.linalg.norm(sums, axis=1) == 0
        sums[empty] = centres[empty]
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return centres


def index_cells(corpus: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``corpus`` with the ``cell`` of every vector; write it partitioned by cell, and a search reads probed cells only."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    @pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series((np.stack(vectors.to_numpy()).astype(np.float64) @ shared.value.T).argmax(1)) if len(vectors) else pd.Series([], dtype="int32")

    return corpus.where(F.col(vector).isNotNull()).withColumn("cell", cell(F.col(vector)))


def nearest_in_cells(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int, probes: int, query_id: str = "query_id", item_id: str = "item_id", vector: str = "embedding") -> DataFrame:
    """Approximate ``nearest``: each query meets the vectors of its ``probes`` nearest cells only.

    The queries are a stated set in blocks, as in ``nearest``; a hot cell is
    spread over its partitions, each of which keeps its own k best.
    """
    spark = indexed.sparkSession
    q_kind, i_kind = queries.schema[query_id].dataType.simpleString(), indexed.schema[item_id].dataType.simpleString()
    rows = queries.where(F.col(vector).isNotNull()).select(query_id, vector)
    out, ids, vectors = None, [], []

    def meet() -> DataFrame:
        matrix = np.asarray(vectors, np.float64)
        probed = np.argsort(-(matrix @ centres.T), axis=1)[:, :probes]
        shared = spark.sparkContext.broadcast((np.asarray(ids), matrix, probed))
        wanted = sorted({int(c) for c in probed.ravel()})
        part = indexed.where(F.col("cell").isin(wanted)).select(F.col(item_id).alias("i"), F.col(vector).alias("v"), "cell")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, m, cells = shared.value
            for b in batches:
                found = []
                for c, g in b.groupby("cell"):
                    asking = np.flatnonzero((cells == c).any(1))
                    if not len(asking):
                        continue
                    items = g["i"].to_numpy()
                    scores = np.round(m[asking] @ np.stack(g["v"].to_numpy()).astype(np.float64).T, 9)
                    order = np.lexsort((np.broadcast_to(items, scores.shape), -scores), axis=1)[:, :k]
                    found.append(pd.DataFrame({"q": np.repeat(names[asking], order.shape[1]), "i": items[order].ravel(), "score": np.take_along_axis(scores, order, 1).ravel()}))
                if found:
                    yield pd.concat(found)

        return spread(part).mapInPandas(run, f"q {q_kind}, i {i_kind}, score double")

    for row in rows.toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == QUERY_BLOCK:
            out = meet() if out is None else out.unionByName(meet())
            ids, vectors = [], []
    if ids:
        out = meet() if out is None else out.unionByName(meet())
    if out is None:
        out = indexed.limit(0).select(F.lit(None).cast(q_kind).alias("q"), F.col(item_id).alias("i"), F.lit(0.0).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("i").alias(item_id), "score", "rank")


def over_threshold(hits: DataFrame, least: float, score: str = "score", distance: bool = False) -> DataFrame:
    """Hits over a score; under it if the score is a distance."""
    return hits.where(F.col(score) < least if distance else F.col(score) > least)


def vote(hits: DataFrame, labels: DataFrame, query_id: str = "query_id", item_id: str = "item_id", label: str = "label") -> DataFrame:
    """``(query_id, label)``: the label of most hits, of equals that of the greatest summed score, then the least label."""
    sums = hits.join(labels.select(item_id, label), item_id).groupBy(query_id, label).agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    return sums.groupBy(query_id).agg(F.min_by(label, F.struct(-F.col("n"), -F.round("s", 6), F.col(label))).alias(label))


def best_or_positive(pairs: DataFrame, query_id: str, score: str = "probability", least: float = 0.5) -> DataFrame:
    """The candidates that a pair classifier calls positive; the best one where there is none."""
    w = Window.partitionBy(query_id)
    marked = pairs.withColumn("__any", F.max(F.col(score) >= least).over(w)).withColumn("__top", F.max(score).over(w))
    return marked.where((F.col("__any") & (F.col(score) >= least)) | (~F.col("__any") & (F.col(score) == F.col("__top")))).drop("__any", "__top")


def bm25(documents: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query_text: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: lexical relevance; ties by id.

    Only postings of the queries' terms are built: the corpus is cut to them by
    a join on the term before anything is counted per document.
    """
    doc = documents.where(F.col(text).isNotNull()).select(F.col(doc_id), tokens(text).alias("t"))
    lengths = doc.select(doc_id, F.size("t").alias("len"))
    stats = lengths.agg(F.count("*").alias("N"), F.avg("len").alias("avg"))
    wanted = queries.select(F.col(query_id), F.explode(F.array_distinct(tokens(query_text))).alias("term"))
    from tessella.plans.runtime import broadcast_if_small

    terms = wanted.select("term").distinct()
    postings = doc.select(doc_id, F.explode("t").alias("term")).join(broadcast_if_small(terms), "term", "left_semi").groupBy(doc_id, "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weighed = postings.join(broadcast_if_small(df), "term").join(lengths, doc_id).join(F.broadcast(stats), F.lit(True))
    idf = F.ln((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    scored = weighed.select(doc_id, "term", weight.alias("w")).join(wanted, "term").groupBy(query_id, doc_id).agg(F.round(F.sum("w"), 6).alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# ------------------------------------------------------------------ duplicates


def plain_title(text: Column) -> Column:
    """A title for comparison: lower case, letters and digits only."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", ""))


def exact_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, class_id, copies)``: the least key among the rows of equal plain text; a null text is a class of its own."""
    form = F.coalesce(F.md5(plain_title(F.col(text))), F.concat(F.lit("#"), F.col(key).cast("string")))
    rows = df.select(key, form.alias("__h"))
    heads = rows.groupBy("__h").agg(F.min(key).alias("class_id"), F.count("*").alias("copies"))
    return rows.join(heads, "__h").select(key, "class_id", "copies")


def contained_titles(df: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """``(key, class_id)``: titles equal in plain form, or one holding the other with at most so many characters more, as components.

    A title that holds another with k characters more becomes it by cutting i
    from the front and k - i from the end: so the pairs are an equi-join of cut
    forms with forms, and no title meets all others. Null titles stand alone.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), plain_title(F.col(text)).alias("f"))
    forms = rows.where("f <> ''").groupBy("f").agg(F.min("k").alias("head"))
    cuts = [(i, n - i) for n in range(1, most + 1) for i in range(n + 1)]
    shorter = forms.select("head", "f", F.explode(F.array(*[F.substring("f", F.lit(i + 1), F.greatest(F.lit(0), F.length("f") - (i + j))) for i, j in cuts])).alias("g")).where("g <> ''")
    edges = shorter.join(forms.select(F.col("f").alias("g"), F.col("head").alias("other")), "g").where("head <> other").select(F.col("head").alias("a"), F.col("other").alias("b")).distinct()
    comp = components(edges)
    least = comp.groupBy("component").agg(F.min("vertex").alias("class_id"))
    mapped = comp.join(least, "component").select(F.col("vertex").alias("head"), "class_id")
    placed = rows.join(forms, "f", "left").join(mapped, "head", "left")
    return placed.select(F.col("k").alias(key), F.coalesce("class_id", "head", "k").alias("class_id"))


def shingles(text: Column, n: int = 5) -> Column:
    """The distinct word n-grams of a text; one of all its words if there are fewer."""
    def grams(t: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t) - n + 1))
        return F.when(F.size(t) > 0, F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " ")))).otherwise(F.array().cast("array<string>"))

    return let(tokens(text), grams)


def blocks_trigram(a: Column, b: Column) -> Column:
    """Whether two texts share a word trigram."""
    return F.arrays_overlap(shingles(a, 3), shingles(b, 3))


#: Words of 64 bits in which a set's hashes are counted by parity.
PARITY = 4


def _marks(bands: int, rows: int):
    """An Arrow UDF from an array of distinct hashes to ``PARITY`` words of parities and one hash per band of minima.

    An element that only one of two sets has turns one of the parities' bits: they differ in no more bits than the sets in elements.
    """
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64)
    mix = rng.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @pandas_udf("array<bigint>")
    def run(sets: pd.Series) -> pd.Series:
        out = []
        with np.errstate(over="ignore"):
            for one in sets:
                x = np.asarray(one, np.int64).astype(np.uint64)
                low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(x), 4096):
                    h = (x[at : at + 4096, None] ^ masks) * factors
                    h ^= h >> np.uint64(32)
                    low = np.minimum(low, (h * factors).min(0))
                band = (low.reshape(bands, rows) * mix).sum(1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                odd = np.bincount((x >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
                parity = np.packbits(odd.astype(np.uint8)).view(np.int64)
                out.append(np.concatenate([parity, (band ^ (band >> np.uint64(29))).astype(np.int64)]))
        return pd.Series(out, dtype=object)

    return run


def near_duplicates(df: DataFrame, key: str, text: str, least: float = 0.8, n: int = 5, bands: int = 24, rows: int = 4) -> DataFrame:
    """``(key, class_id, links)``: classes of texts whose word 5-gram sets have a Jaccard similarity of ``least`` or more.

    Exact copies are folded first, so a hot text is one row. MinHash bands give
    candidates: all different texts of a band are compared, through an equi-join
    whose hot buckets are dealt out, and linked where the exact similarity holds. A pair at 0.8 meets with
    probability 1 - (1 - 0.8^4)^24 > 0.9999. ``links`` counts the different
    texts at ``least`` or more. Texts without words stand alone.

    What travels is small: keys by band, and sizes and parities where several
    texts share one. These rule out most candidates where they meet (by
    necessary conditions, so none is lost; less often beyond some 600 n-grams).
    Sets are made again for the rest alone.
    """
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    set_of = F.transform(shingles(F.col("t"), n), lambda x: F.xxhash64(x))
    hash_of = F.when(F.size("s") > 0, F.xxhash64(F.array_sort("s")))
    made = spread(docs).withColumn("s", set_of).select("k", hash_of.alias("h"), F.size("s").alias("n"), _marks(bands, rows)("s").alias("m"))
    parities = [f"p{i}" for i in range(PARITY)]
    marks = cut(made.select("k", "h", "n", *[F.get("m", F.lit(i)).alias(p) for i, p in enumerate(parities)], F.slice("m", PARITY + 1, bands).alias("bands")))
    folded = cut(marks.where("h is not null").groupBy("h").agg(F.min("k").alias("head")))
    copies = cut(marks.join(folded, "h").where("k <> head").select("k", "h"))
    heads = marks.where("h is not null").join(broadcast_if_small(copies), ["k", "h"], "left_anti")
    # One shuffle by band; keys alone in one fall out where they lie.
    members = heads.select(F.explode("bands").alias("g"), "k").repartition("g").distinct()
    met = members.withColumn("c", F.count("*").over(Window.partitionBy("g"))).where("c > 1").select("g", "k", F.ceil(F.col("c") / GROUP_BLOCK).cast("int").alias("blocks"))
    kept = met.join(heads.select("k", "n", *parities), "k")
    left = kept.select("g", F.col("k").alias("a"), F.col("n").alias("na"), *[F.col(p).alias(f"a{p}") for p in parities], F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    right = kept.select("g", F.col("k").alias("b"), F.col("n").alias("nb"), *[F.col(p).alias(f"b{p}") for p in parities], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    turned = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{p}").bitwiseXOR(F.col(f"b{p}"))) for p in parities])
    # As least <= shared / (na + nb - shared), and na + nb - 2 shared elements are in one set only; a little is left for rounding.
    fits = (F.least("na", "nb") >= F.greatest("na", "nb") * (least - 1e-9)) & (turned <= (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least) + 1e-9))
    pairs = cut(left.join(right, ["g", "block"]).where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct())
    asked = cut(heads.select("k", "h").join(pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "k", "left_semi").distinct())
    # Cut, else the hash becomes a key of the join and all texts' sets are made.
    sets = cut(docs.join(broadcast_if_small(asked), "k")).withColumn("s", set_of).where(hash_of == F.col("h")).select("k", "h", "s")
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("h").alias("ha"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("h").alias("hb"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = cut(both.where(shared / (F.size("sa") + F.size("sb") - shared) >= least).select("a", "b", "ha", "hb").distinct()).select("a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count("*").alias("links"))
    comp = components(links)
    least_of = comp.groupBy("component").agg(F.min("vertex").alias("class_id"))
    classes = comp.join(least_of, "component").select(F.col("vertex").alias("head"), "class_id")
    out = marks.select("k", "h").join(folded, "h", "left").join(classes, "head", "left").join(degree, "head", "left")
    return out.select(F.col("k").alias(key), F.coalesce("class_id", "head", "k").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


# ------------------------------------------------------------------ folding of news

# Sources by precedence.
SOURCES = ("医药魔方", "商业资讯", "美通社", "全球通", "Biospace", "FinSMEs", "Seekingalpha", "Xconomy", "36氪", "投资界", "动脉网", "智通财经", "亿欧", "猎云网")
DAY_MS = 24 * 3600 * 1000


def source_rank(source: Column, sources: Sequence[str] = SOURCES) -> Column:
    """The precedence of a source; null if it has none."""
    lookup = F.create_map(*[x for i, s in enumerate(sources) for x in (F.lit(s), F.lit(i))])
    return F.try_element_at(lookup, source)


def head_order(sources: Sequence[str] = SOURCES) -> list[Column]:
    """Order in which a head is chosen: published, not new, source by precedence (unknown last), earliest, then id."""
    return [F.desc(F.coalesce(F.col("is_publish").try_cast("int"), F.lit(0))), F.asc(F.coalesce(F.col("is_new").try_cast("int"), F.lit(1))), F.asc_nulls_last(source_rank(F.col("resource"), sources)), F.asc_nulls_last("publish_date"), F.asc("esid")]


def elect_heads(news: DataFrame, keys: Sequence[str] = ("company", "round", "amount"), sources: Sequence[str] = SOURCES) -> DataFrame:
    """``news`` with ``head`` (the id of its group's head) and ``is_head``; rows that lack a key are heads of their own."""
    known = functools.reduce(lambda a, b: a & b, [F.coalesce(F.col(k) != "", F.lit(False)) for k in keys])
    group = F.when(known, F.concat_ws("\u0001", *keys)).otherwise(F.concat(F.lit("\u0002"), F.col("esid")))
    # The least by the order, found where the rows lie: a hot group is no window of one task.
    rank, late = source_rank(F.col("resource"), sources), F.lit(2**63 - 1).cast("bigint")
    order = F.struct((-F.coalesce(F.col("is_publish").try_cast("int"), F.lit(0))).alias("a"), F.coalesce(F.col("is_new").try_cast("int"), F.lit(1)).alias("b"), F.coalesce(rank.cast("bigint"), late).alias("c"), F.coalesce(F.col("publish_date").cast("bigint"), late).alias("d"), F.col("esid").alias("e"))
    marked = news.withColumn("__g", group)
    heads = marked.groupBy("__g").agg(F.min(order)["e"].alias("head"))
    out = split_join(marked, heads, "__g").select(*news.columns, "head")
    return out.withColumn("is_head", F.col("head") == F.col("esid"))


def fold_candidates(requests: DataFrame, history: DataFrame, back: int = 7, ahead: int = 1) -> DataFrame:
    """For each request (article_id, date_ms, investee, round, amount) the earlier news of equal non-empty fields within [date - back, date + ahead] days.

    Fields that are empty in the request ask nothing. News marked irrelevant or
    withdrawn (is_new -1) fall out. The join is on the investee and the week, so
    a hot investee is cut by time; requests without one are joined on the week.
    """
    width = (back + ahead) * DAY_MS
    ask = requests.select(F.col("article_id"), F.col("date_ms"), *[F.nullif(F.col(c), F.lit("")).alias(f"q_{c}") for c in ("investee", "round", "amount")])
    ask = ask.withColumn("week", F.explode(F.sequence(F.floor((F.col("date_ms") - back * DAY_MS) / width), F.floor((F.col("date_ms") + ahead * DAY_MS) / width))))
    old = history.where(F.coalesce(F.col("label") != "非相关", F.lit(True)) & F.coalesce(F.col("is_new") != "-1", F.lit(True)) & F.col("publish_date").isNotNull()).withColumn("week", F.floor(F.col("publish_date") / width))
    timed = F.col("publish_date").between(F.col("date_ms") - back * DAY_MS, F.col("date_ms") + ahead * DAY_MS)
    named = ask.where("q_investee is not null").join(old, (ask["week"] == old["week"]) & (F.col("q_investee") == F.col("company")))
    unnamed = ask.where("q_investee is null").join(old, ask["week"] == old["week"])
    both = named.drop(old["week"]).unionByName(unnamed.drop(old["week"]))
    same = F.coalesce(F.col("q_round") == F.col("round"), F.col("q_round").isNull()) & F.coalesce(F.col("q_amount") == F.col("amount"), F.col("q_amount").isNull())
    return both.where(timed & same).drop("week", "q_investee", "q_round", "q_amount")


def fold(requests: DataFrame, history: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """``(article_id, head, is_head)``: the head of each request's week window, by ``head_order``; itself if there is no other."""
    found = fold_candidates(requests, history)
    w = Window.partitionBy("article_id").orderBy(*head_order(sources))
    heads = found.withColumn("r", F.row_number().over(w)).where("r = 1").select("article_id", F.col("esid").alias("found"))
    out = requests.select("article_id").join(heads, "article_id", "left")
    return out.select("article_id", F.coalesce("found", "article_id").alias("head"), (F.coalesce("found", "article_id") == F.col("article_id")).alias("is_head"))


def week_clusters(pairs: DataFrame, items: DataFrame, key: str, time: str, least: float, days: int = 7) -> DataFrame:
    """``(key, cluster)``: items linked by pairs (a, b, score) of a least score published less than ``days`` apart; an item without a time links by score alone."""
    a = items.select(F.col(key).alias("a"), F.col(time).alias("ta"))
    b = items.select(F.col(key).alias("b"), F.col(time).alias("tb"))
    near = F.coalesce(F.abs(F.col("ta") - F.col("tb")) < days * DAY_MS, F.lit(True))
    links = pairs.where(F.col("score") >= least).join(a, "a").join(b, "b").where(near).select("a", "b")
    comp = components(links)
    least_of = comp.groupBy("component").agg(F.min("vertex").alias("cluster"))
    mapped = comp.join(least_of, "component").select(F.col("vertex").alias(key), "cluster")
    return items.select(key).join(mapped, key, "left").select(key, F.coalesce("cluster", key).alias("cluster"))


def update_clusters(clusters: DataFrame, changes: DataFrame) -> DataFrame:
    """``(clusterid, cluster)`` after changes (clusterid, id, add): additions and removals applied; empty clusters vanish."""
    delta = changes.groupBy("clusterid").agg(F.collect_set(F.when(F.col("add"), F.col("id"))).alias("plus"), F.collect_set(F.when(~F.col("add"), F.col("id"))).alias("minus"))
    out = clusters.join(delta, "clusterid", "full_outer")
    none = F.array().cast("array<string>")
    merged = F.array_sort(F.array_except(F.array_union(F.coalesce("cluster", none), F.coalesce("plus", none)), F.coalesce("minus", none)))
    return out.select("clusterid", merged.alias("cluster")).where(F.size("cluster") > 0)
