"""Reading, writing and changing tables of documents."""

from __future__ import annotations

import functools
import uuid
import zipfile
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.plans.query import Query

# ------------------------------------------------------------------ reading


def read_table(spark: SparkSession, path: str, fields: Sequence[str] | None = None, query: Query | None = None) -> DataFrame:
    """A Parquet table; filter and projection reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(query.column()) if query else df
    return df.select(*fields) if fields else df


def read_delimited(spark: SparkSession, path: str, schema: str | StructType, separator: str = ",", header: bool = True) -> DataFrame:
    """Delimited text, compressed or not."""
    return spark.read.schema(schema).option("sep", separator).option("header", header).option("multiLine", True).option("escape", '"').csv(path)


def write_delimited(df: DataFrame, path: str, separator: str = ",", compression: str = "gzip") -> None:
    """Delimited text with a header, a file per partition."""
    df.write.mode("overwrite").option("sep", separator).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("compression", compression).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """A file that is one JSON array, a row per element."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.mode("overwrite").json(path)


def read_sheets(spark: SparkSession, folder: str, sheet: str | None = None, columns: Sequence[str] | None = None, schema: str | StructType | None = None) -> DataFrame:
    """Sheets kept as delimited files under ``sheet=<name>``; one of them, or all with a column ``sheet``."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(f"{folder}/sheet={sheet}" if sheet else folder)
    return df.select(*columns) if columns else df


def write_sheet(df: DataFrame, folder: str, sheet: str) -> None:
    """Writes or replaces one sheet of a folder; the others stay."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/sheet={sheet}")


def save_dataset(df: DataFrame, root: str, version: str, category: str) -> None:
    """A dataset under its version and category."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}/category={category}")


def load_dataset(spark: SparkSession, root: str, version: str, category: str) -> DataFrame:
    """The dataset of a version and category."""
    return spark.read.parquet(f"{root}/version={version}/category={category}")


def list_files(spark: SparkSession, folder: str, extension: str = "") -> DataFrame:
    """``(path, modificationTime, length)`` of the files below a folder, by extension; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", f"*{extension}") if extension else reader).load(folder).select("path", "modificationTime", "length")


def unzip(source: str, target: str) -> list[str]:
    """Unpacks all archives below a folder, archives in archives too; the files written. Members that point outside are refused."""
    out: list[str] = []
    for archive in sorted(Path(source).rglob("*.zip")):
        place = Path(target) / archive.stem
        with zipfile.ZipFile(archive) as z:
            for m in z.infolist():
                if not (place / m.filename).resolve().is_relative_to(place.resolve()):
                    raise ValueError(f"{m.filename} points outside")
            z.extractall(place)
        out += [str(p) for p in place.rglob("*") if p.is_file() and p.suffix != ".zip"]
        if any(place.rglob("*.zip")):
            out += unzip(str(place), str(place))
    return sorted(set(out))


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str | StructType | None = None, skip: int = 0, into: str | None = None, per_file: int = 2_500_000) -> DataFrame:
    """Elements of XML files, one row each, streamed by tag; with ``into`` written as compressed delimited text of ``per_file`` rows a file.

    ``skip`` leaves out files that a first run has done, in the order of names.
    """
    reader = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true")
    files = [r[0] for r in list_files(spark, path).select("path").orderBy("path").collect()][skip:] if skip else [path]
    df = (reader.schema(schema) if schema else reader).load(files)
    if into:
        df.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", "gzip").option("header", True).csv(into)
    return df


def xml_to_json(df: DataFrame, column: str, schema: str) -> DataFrame:
    """An XML string column as JSON."""
    return df.withColumn(column, F.to_json(F.from_xml(F.col(column), schema)))


def request_log(lines: DataFrame, prefix: str, pattern: str, names: Sequence[str], since: str | None = None) -> DataFrame:
    """Request records of a service's log (column ``value``): lines with the prefix, fields by the groups of a pattern; from the last line on that begins with ``since``.

    ``lines`` carry ``line_no``, as a distributed read has no order of its own.
    """
    if since is not None:
        start = lines.where(F.startswith("value", F.lit(since))).agg(F.max("line_no").alias("__s"))
        lines = lines.crossJoin(F.broadcast(start)).where(F.col("__s").isNull() | (F.col("line_no") >= F.col("__s"))).drop("__s")
    hit = lines.where(F.contains("value", F.lit(prefix)))
    return hit.select("line_no", *[F.nullif(F.regexp_extract("value", pattern, i), F.lit("")).alias(n) for i, n in enumerate(names, 1)])


def pulled(spark: SparkSession, path: str, query: Callable[[], DataFrame]) -> DataFrame:
    """The table kept at a path, or the query's result, kept there first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        query().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def each_batch(df: DataFrame, functions: Sequence[Callable[[list[Row]], bool | None]], size: int = 1000, most: int | None = None) -> int:
    """Streams rows to the driver in batches through functions; stops when one returns True, or after ``most`` rows. The rows seen. One partition at a time is held."""
    seen, batch = 0, []

    def flush() -> bool:
        return any([f(batch) is True for f in functions])

    for row in (df.limit(most) if most is not None else df).toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        seen += 1
        if len(batch) == size:
            if flush():
                return seen
            batch = []
    if batch:
        flush()
    return seen


def for_each_partition(df: DataFrame, function: Callable[[Iterable[pd.DataFrame]], None]) -> int:
    """A function with side effects over the batches of each partition, on the executors; the rows seen. A partition may run again."""
    def run(batches):
        n = 0

        def counted():
            nonlocal n
            for b in batches:
                n += len(b)
                yield b

        function(counted())
        yield pd.DataFrame({"n": [n]})

    return df.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def lookup_titles(df: DataFrame, titles: DataFrame, title: str = "title") -> DataFrame:
    """All documents that have one of the titles, compared in plain form, with the title asked for."""
    from tessella.operators.similar import plain_title

    asked = titles.select(F.col(title).alias("asked"), plain_title(F.col(title)).alias("__p")).distinct()
    return df.withColumn("__p", plain_title(F.col(title))).join(asked, "__p").drop("__p")


# ------------------------------------------------------------------ changing


def with_key(df: DataFrame, key: str) -> DataFrame:
    """Missing keys filled with fresh ones. Fresh keys differ when computed again, so write the result before using it twice."""
    return df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))


def replaced(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key; of several rows of one key any."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows.dropDuplicates([key]), allowMissingColumns=True)


def updated(table: DataFrame, rows: DataFrame, key: str, upsert: bool = False) -> DataFrame:
    """Non-null fields of rows merged over the table's by key; with ``upsert`` unknown keys are added."""
    fields = [c for c in rows.columns if c != key]
    renamed = rows.dropDuplicates([key]).select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = table.join(renamed, key, "full_outer" if upsert else "left")
    columns = [*table.columns, *[c for c in fields if c not in table.columns]]
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields and c in table.columns else (F.col(f"__{c}").alias(c) if c in fields else F.col(c)) for c in columns])


def without(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without some keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def without_query(table: DataFrame, query: Query) -> DataFrame:
    """The table without the rows that match."""
    return table.where((~query).column())


def bulk(table: DataFrame, operations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A batch of operations (``op`` in index, update, upsert, delete; ``seq`` orders those of one key, the last counts): the new table and the operations that failed (update or delete of an unknown key)."""
    last = operations.groupBy(key).agg(F.max_by(F.struct(*[c for c in operations.columns if c != key]), "seq").alias("o")).select(key, "o.*")
    fields = [c for c in last.columns if c not in (key, "op", "seq")]
    known = last.join(table.select(key).withColumn("__known", F.lit(True)), key, "left").withColumn("__known", F.coalesce("__known", F.lit(False)))
    failed = known.where(~F.col("__known") & F.col("op").isin("update", "delete")).select(*operations.columns)
    out = without(table, known.where(F.col("op") == "delete"), key)
    merge = known.where(F.col("op").isin("update", "upsert") & F.col("__known")).select(key, *fields)
    out = updated(out, merge, key)
    fresh = known.where((F.col("op") == "index") | ((F.col("op") == "upsert") & ~F.col("__known"))).select(key, *fields)
    return replaced(out, fresh, key), failed


def overwrite(df: DataFrame, path: str) -> None:
    """Replaces the table at a path by a result that may be computed from it: written beside it first, then moved."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    target, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    fs = target.getFileSystem(conf)
    fs.delete(target, True)
    if not fs.rename(new, target):
        raise OSError(f"{beside} couldn't be moved to {path}")
    spark.catalog.refreshByPath(path)


def create_table(spark: SparkSession, name: str, schema: str, rows: DataFrame | None = None) -> DataFrame:
    """A table of a schema, filled with rows where given."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")
    if rows is not None:
        rows.select(*spark.table(name).columns).write.mode("append").insertInto(name)
    return spark.table(name)


def migrate(source: DataFrame, keys: DataFrame, key: str, path: str) -> DataFrame:
    """The documents of some keys, by way of JSON at a path: written, then read with the same schema."""
    source.join(keys.select(key).distinct(), key, "left_semi").write.mode("overwrite").json(path)
    return source.sparkSession.read.schema(source.schema).json(path)


def export_for_labelling(df: DataFrame, key: str, skip: int, size: int, path: str) -> DataFrame:
    """The documents ``skip`` … ``skip + size - 1`` in the order of their key, as JSON."""
    out = df.orderBy(key).offset(skip).limit(size)
    out.write.mode("overwrite").json(path)
    return out


def union_of(frames: Sequence[DataFrame], order: Column | None = None) -> DataFrame:
    """Result lists of several services as one, ordered where given."""
    out = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.orderBy(order) if order is not None else out
