"""Dictionary tagging, located spans and BIO sequences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.runtime import spread

#: Characters of dictionary entries in one automaton; a larger dictionary is met block by block.
BLOCK_CHARS = 2_000_000


def build_dictionary(entries: DataFrame, entry: str = "entry", stop_words: Sequence[str] = ()) -> DataFrame:
    """``(entry, length)`` without stop words, blanks trimmed, in lower case, distinct; longest first by ``length``."""
    plain = entries.select(F.lower(F.trim(entry)).alias("entry")).where("entry <> ''").distinct()
    out = plain.where(~F.col("entry").isin(list(stop_words))) if stop_words else plain
    return out.withColumn("length", F.length("entry"))


def containing_groups(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """``(inner, outer)``: entries that occur in another one, found by the automaton."""
    own = entries.select(F.col(entry).alias("outer")).distinct()
    hits = occurrences(own, own.select(F.col("outer").alias("entry")), key="outer", text="outer")
    return hits.where("entry <> outer").select(F.col("entry").alias("inner"), "outer").distinct()


def occurrences(texts: DataFrame, entries: DataFrame, key: str, text: str, entry: str = "entry", lower: bool = False) -> DataFrame:
    """``(key, entry, start, end)``: every occurrence, half-open, overlapping ones too.

    One pass of a multi-pattern automaton over each text per block of the
    dictionary, so the cost doesn't grow with the number of entries. Null and
    empty texts and entries match nothing.
    """
    spark = texts.sparkSession
    kind = texts.schema[key].dataType.simpleString()
    rows = spread(texts.where(F.length(text) > 0).select(F.col(key).alias("__key"), F.col(text).alias("__text")))
    words = entries.where(F.length(entry) > 0).select(F.col(entry).alias("w")).distinct()

    def meet(block: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            a = ahocorasick.Automaton()
            for w in shared.value:
                a.add_word(w.lower() if lower else w, w)
            a.make_automaton()
            for batch in batches:
                out = [(k, w, end + 1 - len(w), end + 1) for k, t in zip(batch["__key"], batch["__text"]) for end, w in a.iter(t.lower() if lower else t)]
                yield pd.DataFrame(out, columns=["__key", "entry", "start", "end"])

        return rows.mapInPandas(run, f"__key {kind}, entry string, start int, end int")

    out, block, size = None, [], 0
    for row in words.toLocalIterator():
        block.append(row[0])
        size += len(row[0])
        if size >= BLOCK_CHARS:
            out = meet(block) if out is None else out.unionByName(meet(block))
            block, size = [], 0
    if block:
        out = meet(block) if out is None else out.unionByName(meet(block))
    if out is None:
        out = rows.select("__key", F.lit("").alias("entry"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    return out.withColumnRenamed("__key", key)


def outermost(spans: DataFrame, key: str) -> DataFrame:
    """Spans that lie in no other, different span of the same text.

    A span is inside an earlier or longer one exactly if, in order of start and
    falling end, some span before it ends at or after its end: one window, no
    self-join.
    """
    w = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    once = spans.groupBy(key, "start", "end").agg(F.min("entry").alias("entry"))
    return once.withColumn("__reach", F.max("end").over(w)).where(F.col("__reach").isNull() | (F.col("__reach") < F.col("end"))).drop("__reach")


def leftmost_longest(spans: DataFrame, key: str) -> DataFrame:
    """Spans chosen from the left, the longest at each place, none overlapping: a greedy choice in one pass per text."""
    kind = spans.schema[key].dataType.simpleString()

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start", "end"], ascending=[True, False])
        kept, reach = [], -1
        for i, (a, b) in enumerate(zip(group["start"], group["end"])):
            if a >= reach:
                kept.append(i)
                reach = b
        return group.iloc[kept]

    return spans.select(key, "entry", "start", "end").groupBy(key).applyInPandas(choose, f"{key} {kind}, entry string, start int, end int")


def tag(texts: DataFrame, entries: DataFrame, key: str, text: str, nested: bool = True) -> DataFrame:
    """``(key, entries, encoded)``: the distinct entries of each text, ascending, and as ``|a|b|``; texts without one are left out."""
    spans = occurrences(texts, entries, key, text)
    if not nested:
        spans = outermost(spans, key)
    found = spans.groupBy(key).agg(F.sort_array(F.collect_set("entry")).alias("entries"))
    return found.withColumn("encoded", F.concat(F.lit("|"), F.array_join("entries", "|"), F.lit("|")))


def locate_all(text: Column, word: Column) -> Column:
    """All starts (from 0) of a literal word in a text, those that overlap too."""
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(text) - F.length(word))), lambda i: F.when((F.length(word) > 0) & (F.substring(text, i + 1, F.length(word)) == word), i)), lambda i: i.isNotNull())


def labelled_lines(df: DataFrame, key: str, text: str, entities: str) -> DataFrame:
    """``(key, line)``: a JSON line of the text and its labels [start, end, entity], sorted by start; Chinese texts only."""
    rows = df.where(F.regexp_like(text, F.lit("[一-龥]"))).select(key, text, F.explode_outer(F.array_distinct(F.col(entities))).alias("e"))
    spans = rows.select(key, text, "e", F.explode_outer(locate_all(F.col(text), F.col("e"))).alias("start"))
    label = F.when(F.col("start").isNotNull(), F.struct(F.col("start"), (F.col("start") + F.length("e")).alias("end"), F.col("e").alias("entity")))
    packed = spans.groupBy(key, text).agg(F.sort_array(F.collect_list(label)).alias("labels"))
    return packed.select(key, F.to_json(F.struct(F.col(text).alias("text"), "labels")).alias("line"))


def synonym_rule(texts: DataFrame, names: DataFrame, key: str, text: str, node: str = "node_id", name: str = "name") -> DataFrame:
    """``(key, node)``: nodes whose synonym stands in the text, not inside a Latin word; names of digits alone don't count."""
    usable = names.where(~F.regexp_like(name, F.lit(r"^\d*$"))).select(F.col(node), F.lower(name).alias("entry"))
    lowered = texts.select(F.col(key), F.lower(text).alias("__t"))
    hits = occurrences(lowered, usable.select("entry").distinct(), key, "__t").join(lowered, key)
    before, after = F.substring("__t", F.col("start"), F.lit(1)), F.substring("__t", F.col("end") + 1, F.lit(1))
    free = ~(F.regexp_like(before, F.lit("[a-z]")) & (F.col("start") > 0)) & ~F.regexp_like(after, F.lit("[a-z]"))
    return hits.where(free).join(usable, "entry").select(key, node).distinct()


# ------------------------------------------------------------------ BIO


def bio_spans(tokens: DataFrame, keys: Sequence[str], pos: str = "pos", word: str = "words", label: str = "labels") -> DataFrame:
    """``(keys, kind, start, end, phrase)``: entities of a token table with labels ``b-x``, ``i-x``, ``O``.

    An entity begins at ``b-``, or at ``i-`` that continues nothing of its
    class; it ends before ``O``, another class or a new ``b-``. Words are joined
    by a blank, but not next to a Chinese character or a digit. Null labels are O.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    t = tokens.withColumn("__l", F.lower(F.coalesce(label, F.lit("o")))).withColumn("__k", F.when(F.col("__l") != "o", F.substring("__l", 3, 1000)))
    t = t.withColumn("__p", F.lag("__k").over(w)).where("__k is not null")
    starts = F.startswith("__l", F.lit("b-")) | F.col("__p").isNull() | (F.col("__p") != F.col("__k"))
    t = t.withColumn("__n", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    tight = r"[一-龥\d]"
    packed = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(word).alias("w"))))
    glue = lambda a, x: F.when((a == ""), x["w"]).when(F.regexp_like(F.right(a, F.lit(1)), F.lit(tight)) | F.regexp_like(F.left(x["w"], F.lit(1)), F.lit(tight)), F.concat(a, x["w"])).otherwise(F.concat(a, F.lit(" "), x["w"]))
    out = t.groupBy(*keys, "__n", F.col("__k").alias("kind")).agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"), F.aggregate(packed, F.lit(""), glue).alias("phrase"))
    return out.drop("__n")


def index_strings(spans: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """``(keys, indices)``: each entity of a class as ``-i-j-k`` of its positions."""
    return spans.where(F.col("kind") == kind).select(*keys, F.concat(F.lit("-"), F.array_join(F.transform(F.sequence("start", F.col("end") - 1), lambda i: i.cast("string")), "-")).alias("indices"))


def settle_classes(tokens: DataFrame, keys: Sequence[str], pos: str = "pos", label: str = "labels") -> DataFrame:
    """Labels in which one entity has one class: a class switch inside a run takes the class of most tokens (of equals the first by name)."""
    w = Window.partitionBy(*keys).orderBy(pos)
    t = tokens.withColumn("__l", F.lower(F.coalesce(label, F.lit("o")))).withColumn("__k", F.when(F.col("__l") != "o", F.substring("__l", 3, 1000)))
    t = t.withColumn("__open", F.lag("__k").over(w)).withColumn("__n", F.sum(F.when(F.col("__k").isNull() | F.startswith("__l", F.lit("b-")) | F.col("__open").isNull(), 1).otherwise(0)).over(w))
    most = t.where("__k is not null").groupBy(*keys, "__n", "__k").agg(F.count("*").alias("c")).groupBy(*keys, "__n").agg(F.min_by("__k", F.struct(-F.col("c"), F.col("__k"))).alias("__best"))
    fixed = t.join(most, [*keys, "__n"], "left").withColumn(label, F.when(F.col("__k").isNull(), F.lit("O")).otherwise(F.concat(F.substring("__l", 1, 2), F.col("__best"))))
    return fixed.drop("__l", "__k", "__open", "__n", "__best")


def classes_once(roles: dict[str, Column]) -> dict[str, Column]:
    """Arrays of entities by class, in order of precedence: an entity stays only in the first class that has it."""
    out: dict[str, Column] = {}
    seen = F.array().cast("array<string>")
    for name, c in roles.items():
        own = F.coalesce(c, F.array().cast("array<string>"))
        out[name] = F.array_distinct(F.array_except(own, seen))
        seen = F.array_union(seen, own)
    return out


def align_roles(records: Column, names: Column, roles: dict[str, str], separator: str = ";") -> Column:
    """Records (structs with ``behavior``) and names by position, as a map from role to its names joined; roles unknown fall out."""
    lookup = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    pairs = F.filter(F.transform(F.arrays_zip(records.alias("r"), names.alias("n")), lambda z: F.struct(F.try_element_at(lookup, z["r"]["behavior"]).alias("role"), z["n"].alias("name"))), lambda p: p["role"].isNotNull() & p["name"].isNotNull())
    present = F.array_distinct(F.transform(pairs, lambda p: p["role"]))
    return F.map_from_arrays(present, F.transform(present, lambda k: F.array_join(F.transform(F.filter(pairs, lambda p: p["role"] == k), lambda p: p["name"]), separator)))
