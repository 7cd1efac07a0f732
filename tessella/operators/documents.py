"""Fields, tables and layout of documents: markup, labels of drugs, patents' front pages, recognised forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from tessella.functions.extract import between_markers, combination_key, first_matches, repair_date_column, valid_date

# ------------------------------------------------------------------ markup


class _Nodes(HTMLParser):
    """Elements of a page: (path, parent index, text of the whole element, whether some is its own)."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[int] = []
        self.nodes: list[list] = []
        self.counts: list[dict[str, int]] = [{}]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        n = self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        above = self.open[-1] if self.open else -1
        self.nodes.append([(self.nodes[above][0] if above >= 0 else "") + f"/{tag}[{n}]", above, [], False])
        if tag not in self.VOID:
            self.open.append(len(self.nodes) - 1)
            self.counts.append({})

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]][0].rsplit("/", 1)[1].startswith(tag + "["):
                del self.open[depth:], self.counts[depth + 1 :]
                return

    def handle_data(self, data: str) -> None:
        for i in self.open:
            self.nodes[i][2].append(data)
        if self.open and data.strip():
            self.nodes[self.open[-1]][3] = True


def dom_nodes(html: str | None) -> list[tuple[str, str, bool]]:
    """(path, text, whether some of it is outside its child elements) of every element of a page in document order."""
    if not html:
        return []
    parser = _Nodes()
    parser.feed(html)
    parser.close()
    return [(path, " ".join("".join(text).split()), own) for path, _, text, own in parser.nodes]


def nodes_table(pages: DataFrame, key: str, html: str, most: int | None = None) -> DataFrame:
    """``(key, n, path, depth, text, own)`` of all elements with text, where given only those with at most ``most`` characters; own: some is outside the child elements."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(k, n, p, p.count("/"), t, own) for k, h in zip(b["__k"], b["__h"]) for n, (p, t, own) in enumerate(dom_nodes(h)) if t and (most is None or len(t) <= most)]
            yield pd.DataFrame(rows, columns=[key, "n", "path", "depth", "text", "own"])

    return pages.where(F.col(html).isNotNull()).select(F.col(key).alias("__k"), F.col(html).alias("__h")).mapInPandas(run, f"{key} {kind}, n int, path string, depth int, text string, own boolean")


def common_ancestor(a: Column, b: Column) -> Column:
    """The path of the nearest element that holds both paths."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.transform(F.arrays_zip(x.alias("p"), y.alias("q")), lambda z: F.coalesce(z["p"] == z["q"], F.lit(False)))
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, v: F.struct(F.when(s["on"] & v, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & v).alias("on")))["n"]
    return F.array_join(F.slice(x, F.lit(1), n), "/")


def by_path(nodes: DataFrame, key: str, path: str, fallback: str | None = None) -> DataFrame:
    """The text at a path; where a page has none there, its first node whose text begins with ``fallback``."""
    at = F.when(F.col("path") == path, F.struct(F.lit(0).alias("r"), "n", "text"))
    if fallback is not None:
        at = at.when(F.startswith("text", F.lit(fallback)), F.struct(F.lit(1).alias("r"), "n", "text"))
    return nodes.groupBy(key).agg(F.min(at)["text"].alias("text"))


# ------------------------------------------------------------------ XML entries

#: The nested parts of an entry of the protein collection that are read.
ENTRY_SCHEMA = "_dataset string, _created string, _modified string, accession array<string>, name array<string>, protein struct<recommendedName: struct<fullName: string, shortName: array<string>>, alternativeName: array<struct<fullName: string, shortName: array<string>>>>, gene array<struct<name: array<struct<_VALUE: string, _type: string>>>>, organism struct<name: array<struct<_VALUE: string, _type: string>>>, proteinExistence struct<_type: string>"


def read_entries(spark, path: str, row_tag: str = "entry") -> DataFrame:
    """Entries of (compressed) XML files, one row each, streamed by row tag."""
    return spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", "true").schema(ENTRY_SCHEMA).load(path)


def project_entries(entries: DataFrame) -> DataFrame:
    """``(esid, accession, accession_secondary, dataset, created, modified, organism, gene, names, evidence_level)``; esid is the md5 of the accession, times are epoch milliseconds."""
    millis = lambda c: F.unix_millis(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
    alternative = F.coalesce(F.transform("protein.alternativeName", lambda x: x["fullName"]), F.array().cast("array<string>"))
    names = F.array_distinct(F.array_compact(F.concat(F.array(F.col("protein.recommendedName.fullName")), alternative)))
    first = F.get("accession", F.lit(0))
    pairs = lambda c: F.transform(c, lambda x: F.struct(x["_type"].alias("type"), x["_VALUE"].alias("name")))
    return entries.where(F.size("accession") > 0).select(
        F.md5(first).alias("esid"), first.alias("accession"), F.slice("accession", 2, 1000000).alias("accession_secondary"), F.col("_dataset").alias("dataset"), millis(F.col("_created")).alias("created"), millis(F.col("_modified")).alias("modified"),
        pairs(F.col("organism.name")).alias("organism"), pairs(F.flatten(F.transform("gene", lambda g: g["name"]))).alias("gene"), names.alias("names"), F.col("proteinExistence._type").alias("evidence_level"),
    )


# ------------------------------------------------------------------ labels of drugs

# Sections of drug labels by agency: where a field begins and ends.
LABEL_FIELDS: dict[str, dict[str, tuple[tuple[str, ...], tuple[str, ...]]]] = {
    "fda": {"indication": (("INDICATIONS AND USAGE",), ("DOSAGE AND ADMINISTRATION", "CONTRAINDICATIONS")), "dosage": (("DOSAGE AND ADMINISTRATION",), ("DOSAGE FORMS AND STRENGTHS", "CONTRAINDICATIONS")), "contraindication": (("CONTRAINDICATIONS",), ("WARNINGS AND PRECAUTIONS", "WARNINGS"))},
    "ema": {"indication": (("4.1 Therapeutic indications", "Therapeutic indications"), ("4.2 Posology",)), "dosage": (("4.2 Posology and method of administration",), ("4.3 Contraindications",)), "contraindication": (("4.3 Contraindications",), ("4.4 Special warnings",))},
    "pmda": {"indication": (("効能又は効果", "効能・効果"), ("用法及び用量", "用法・用量")), "dosage": (("用法及び用量", "用法・用量"), ("使用上の注意", "禁忌")), "contraindication": (("禁忌",), ("効能", "用法"))},
}


def label_fields(df: DataFrame, key: str, text: str, agency: str) -> DataFrame:
    """``(key, field, value)`` of the sections of a drug label."""
    parts = [F.struct(F.lit(f).alias("field"), between_markers(F.col(text), list(s), list(e)).alias("value")) for f, (s, e) in LABEL_FIELDS[agency].items()]
    return df.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.field", "x.value").where("value <> ''")


# ------------------------------------------------------------------ patents


def front_page(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, code, value)`` of the numbered fields ``(nn) …`` of a front page, up to the next one; codes as text."""
    fields = F.regexp_extract_all(F.concat(F.lit("\n"), F.col(text)), F.lit(r"(?s)\((\d{2})\)\s*(?:(?!\(\d{2}\)).)*"), F.lit(0))
    rows = df.where(F.col(text).isNotNull()).select(key, F.explode(fields).alias("f"))
    return rows.select(key, F.regexp_extract("f", r"^\((\d{2})\)", 1).alias("code"), F.trim(F.regexp_replace(F.regexp_replace("f", r"^\(\d{2}\)\s*", ""), r"\s+", " ")).alias("value"))


def front_dates(fields: DataFrame, key: str, codes: Sequence[str] = ("22", "43", "45")) -> DataFrame:
    """``(key, code, date, valid)``: the repaired dates of the fields that hold one."""
    found = F.regexp_extract("value", r"\d{4}年\d{1,2}月\d{1,2}日|\d{2,4}\.\d{1,2}\.\d{1,2}|\d{6,8}", 0)
    dated = fields.where(F.col("code").isin(list(codes))).select(key, "code", repair_date_column(found).alias("date"))
    return dated.withColumn("valid", valid_date(F.col("date")))


def related_pieces(df: DataFrame, key: str, text: str, keywords: Mapping[str, str], number: str = r"(?:PCT/[A-Z]{2}\d{2,4}/\d{4,6}|\d{2}/\d{3},\d{3})", date: str = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*\.? \d{1,2}, \d{4}") -> DataFrame:
    """``(key, n, type, piece, application, date)``: pieces of a relationship paragraph, each from a keyword to the next one, in order."""
    pattern = "|".join(sorted(keywords, key=len, reverse=True))
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"(?is)(?:{pattern})(?:(?!{pattern}).)*"), F.lit(0))
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(pieces).alias("n", "piece"))
    kind = F.lit(None).cast("string")
    for k, v in keywords.items():
        kind = F.when(kind.isNull() & F.regexp_like("piece", F.lit(rf"(?is)^(?:{k})")), F.lit(v)).otherwise(kind)
    empty = F.lit("")
    return rows.select(key, "n", kind.alias("type"), F.trim("piece").alias("piece"), F.nullif(F.translate(F.regexp_extract("piece", rf"(?i){number}", 0), "o", "0"), empty).alias("application"), F.nullif(F.regexp_extract("piece", date, 0), empty).alias("date"))


def relation_rows(pieces: DataFrame, key: str, nation: str) -> DataFrame:
    """Standard relation rows: a sub id, the combined key of the application, the date in milliseconds, and errors joined by ``|``."""
    number = F.regexp_replace(F.coalesce("application", F.lit("")), r"[^\dA-Za-z]", "")
    when = F.coalesce(F.try_to_timestamp("date", F.lit("MMM d, yyyy")), F.try_to_timestamp("date", F.lit("MMMM d, yyyy")), F.try_to_timestamp(F.replace("date", F.lit("."), F.lit("")), F.lit("MMM d, yyyy")))
    faults = F.array_join(F.array_compact(F.array(F.when(F.col("application").isNull(), "no application number"), F.when(F.col("date").isNull(), "no date"), F.when(F.col("date").isNotNull() & when.isNull(), "date can't be read"))), " | ")
    return pieces.select(key, F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("n").cast("string"))).alias("sub_id"), "type", "piece", F.when(F.length(number) > 0, combination_key(F.lit(nation), number)).alias("application_key"), "date", F.unix_millis(when).alias("date_ms"), F.nullif(faults, F.lit("")).alias("errors"))


def divisional_lines(df: DataFrame, key: str, text: str, keyword: str = "分案") -> DataFrame:
    """``(key, code, found)``: the first line with the keyword, the two-digit code before it, and up to two lines that go on without a code of their own."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    code = F.nullif(F.regexp_extract("line", r"^\s*[(（]?(\d{2})[)）]", 1), F.lit(""))
    t = lines.withColumn("c", F.last(code, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumns({"n1": F.lead("line", 1).over(w), "n2": F.lead("line", 2).over(w)})
    goes_on = lambda c: F.coalesce(~F.regexp_like(c, F.lit(r"^\s*[(（]\d{2}[)）]")) & (F.trim(c) != ""), F.lit(False))
    one, two = goes_on(F.col("n1")), goes_on(F.col("n2"))
    found = F.concat(F.trim("line"), F.when(one, F.trim("n1")).otherwise(""), F.when(one & two, F.trim("n2")).otherwise(""))
    return t.where(F.contains("line", F.lit(keyword))).groupBy(key).agg(F.min_by(F.struct(F.col("c").alias("code"), found.alias("found")), "n").alias("x")).select(key, "x.code", "x.found")


# ------------------------------------------------------------------ layout


def reading_order(blocks: DataFrame, doc: str, page: str = "page_number", x: str = "x0_t", y: str = "y0_t", width: str = "width") -> DataFrame:
    """``blocks`` with ``order`` of a two-column page: the left column from top to bottom, then the right."""
    right = (F.col(x) >= F.col(width) / 2 * 1.05).cast("int")
    return blocks.withColumn("order", F.row_number().over(Window.partitionBy(doc, page).orderBy(right, y, x)))


def in_box(words: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The words whose middle is in a box."""
    mx, my = (F.col("x0_t") + F.col("x1_t")) / 2, (F.col("y0_t") + F.col("y1_t")) / 2
    return words.where(mx.between(x0, x1) & my.between(y0, y1))


def left_column_names(words: DataFrame, doc: str, share: float = 0.4, names: Column | None = None) -> DataFrame:
    """``(doc, page_number, line)``: the text of the left part of each line (words of one y), in order; only listed names where given."""
    left = words.where(F.col("x0_t") < F.col("width") * share)
    line = left.groupBy(doc, "page_number", F.round("y0_t", 0).alias("y")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0_t", "text"))), lambda w: w["text"]), " ").alias("line"))
    return line.where(names) if names is not None else line


def figure_titles(blocks: DataFrame, doc: str, most: int = 30) -> DataFrame:
    """``(doc, page_number, n, title)``: for figures and tables the nearest neighbouring text block of up to ``most`` characters, the one below first."""
    w = Window.partitionBy(doc, "page_number").orderBy("y0_t", "x0_t")
    fits = lambda c, k: F.when((k == "Text") & (F.length(c) <= most), c)
    t = blocks.withColumns({"n": F.row_number().over(w), "__a": F.lead("text").over(w), "__ak": F.lead("block_type").over(w), "__b": F.lag("text").over(w), "__bk": F.lag("block_type").over(w)})
    return t.where(F.col("block_type").isin("Figure", "Table")).select(doc, "page_number", "n", F.coalesce(fits(F.col("__a"), F.col("__ak")), fits(F.col("__b"), F.col("__bk"))).alias("title"))


def form_rows(forms: DataFrame, key: str) -> dict[str, DataFrame]:
    """Frames of pages, tables, cells and lines of recognised forms.

    ``forms`` holds ``pages: array<struct<tables: array<struct<cells:
    array<struct<row, col, text>>>>, lines: array<string>>>``; positions are kept.
    """
    pages = forms.select(key, F.posexplode("pages").alias("page", "p"))
    tables = pages.select(key, "page", F.posexplode("p.tables").alias("table", "t"))
    cells = tables.select(key, "page", "table", F.posexplode("t.cells").alias("cell", "c")).select(key, "page", "table", "cell", "c.*")
    lines = pages.select(key, "page", F.posexplode("p.lines").alias("line_no", "line"))
    words = lines.select(key, "page", "line_no", F.posexplode(F.filter(F.split("line", r"\s+"), lambda x: x != "")).alias("word_no", "word"))
    return {"pages": pages.select(key, "page"), "tables": tables.select(key, "page", "table"), "cells": cells, "lines": lines, "words": words}


def before_tables(df: DataFrame, key: str, text: str, table_rows: str) -> DataFrame:
    """``(key, text)``: the lines before the first one that is the first cell of a table's row; the whole text without tables."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"), F.transform(table_rows, lambda r: F.trim(F.get(r, F.lit(0)))).alias("heads"))
    first = lines.groupBy(key).agg(F.min(F.when(F.array_contains("heads", F.trim("line")) & (F.trim("line") != ""), F.col("n"))).alias("at"))
    kept = lines.join(first, key).where(F.col("at").isNull() | (F.col("n") < F.col("at")))
    out = kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias(text))
    return df.select(key).join(out, key, "left").select(key, F.coalesce(text, F.lit("")).alias(text))


# What stands for the data of a block that holds no text.
LAYOUT_DATA = {"Figure": "ImageRegion", "ImageRegion": "ImageRegion", "MathsRegion": "MathsRegion", "SeparatorRegion": "SeparatorRegion"}


def layout_records(blocks: DataFrame) -> DataFrame:
    """``(pdf_name, page_number, block_id, type, x_1, y_1, x_2, y_2, width, height, data)`` of the blocks that a layout model or a scanner's table found.

    Text blocks carry their text, tables their content, others the name of
    their kind. Blocks without a place fall out; one without a type is an OtherRegion.
    """
    kind = F.coalesce("block_type", F.lit("OtherRegion"))
    lookup = F.create_map(*[F.lit(x) for kv in LAYOUT_DATA.items() for x in kv])
    data = F.when(kind.isin("Text", "TextRegion", "Title", "List"), F.col("text")).when(kind.isin("Table", "TableRegion"), F.col("data")).otherwise(F.coalesce(F.try_element_at(lookup, kind), F.lit("OtherRegion")))
    return blocks.where("x_1 is not null").select("pdf_name", "page_number", "block_id", kind.alias("type"), "x_1", "y_1", "x_2", "y_2", (F.col("x_2") - F.col("x_1")).alias("width"), (F.col("y_2") - F.col("y_1")).alias("height"), data.alias("data"))


def pdf_text(files: DataFrame, extract, failed: str = "[no text]") -> DataFrame:
    """``(path, text)`` of binary files by a function bytes → text; a failure gives the marker. The library for it is the caller's."""
    @pandas_udf(StringType())
    def run(contents: pd.Series) -> pd.Series:
        def one(x: bytes) -> str:
            try:
                return extract(x)
            except Exception:  # noqa: BLE001 - one bad file must not end the job
                return failed

        return contents.map(one)

    return files.select("path", run("content").alias("text"))


def pdf_tables(files: DataFrame, extract) -> DataFrame:
    """``(path, table_no, rows)`` of binary files by a function bytes → list of tables of rows; a failure gives none."""
    kind = ArrayType(ArrayType(ArrayType(StringType())))

    @pandas_udf(kind)
    def run(contents: pd.Series) -> pd.Series:
        def one(x: bytes) -> list:
            try:
                return extract(x)
            except Exception:  # noqa: BLE001
                return []

        return contents.map(one)

    return files.select("path", F.posexplode(run("content")).alias("table_no", "rows"))


def first_fields(df: DataFrame, key: str, text: str, patterns: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(key, field, values)``: for each field the matches of its first pattern that has any."""
    parts = [F.struct(F.lit(f).alias("field"), first_matches(F.col(text), p).alias("values")) for f, p in patterns.items()]
    return df.select(key, F.explode(F.array(*parts)).alias("x")).select(key, "x.field", "x.values").where("values is not null")
