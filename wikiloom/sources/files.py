"""Readers and writers of the relations' file formats. Schemas are declared, columns of delimited files are taken by position."""

from __future__ import annotations

from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wikiloom import schemas as S


def json_lines(spark: SparkSession, folder: str, schema: str = S.RAW_PAGE) -> DataFrame:
    """All JSON-lines files below a folder."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(folder)


def json_records(spark: SparkSession, path: str, schema: str = S.CLEAN_PAGE) -> DataFrame:
    """Files that hold an array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files as write_json_array() and write_json_keyed() make them, without what frames them."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^[\[{,]", "").alias("value")).where("value not in ('', ']', '}')")


def json_records_by_line(spark: SparkSession, path: str, schema: str = S.CLEAN_PAGE) -> DataFrame:
    """What json_records() gives, of files with one record a line, by any number of tasks a file."""
    return _entries(spark, path).select(F.from_json("value", schema).alias("v")).select("v.*")


def json_keyed_by_line(spark: SparkSession, path: str, schema: str, key: str = "wid") -> DataFrame:
    """What json_keyed() gives, of files with one entry a line, by any number of tasks a file."""
    rows = _entries(spark, path).select(F.regexp_extract("value", r'^"((?:[^"\\]|\\.)*)":', 1).alias("k"), F.regexp_replace("value", r'^"(?:[^"\\]|\\.)*":', "").alias("v"))
    return rows.select(F.col("k").cast("long").alias(key), F.from_json("v", schema).alias("v")).select(key, "v.*")


def json_keyed(spark: SparkSession, path: str, schema: str, key: str = "wid") -> DataFrame:
    """Files that hold one object of records by id."""
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema)
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string, struct<{fields}>>")).alias("k", "v"))
    return rows.select(F.col("k").cast("long").alias(key), "v.*")


def delimited(spark: SparkSession, path: str, schema: str, header: bool = True, line_ends: bool = True) -> DataFrame:
    """TSV or CSV by the file's ending; the first columns by position, under the given names.

    line_ends: whether cells may hold line ends. Without them a file is read by many tasks.
    """
    end = PurePath(path).suffix.lower()
    if end == ".json":
        raise ValueError("relations are not read from JSON")
    want = spark.createDataFrame([], schema).schema
    raw = spark.read.option("sep", "," if end == ".csv" else "\t").option("header", header).option("escape", '"').option("multiLine", line_ends).csv(path)
    if len(raw.columns) < len(want):
        raise ValueError(f"{path} has {len(raw.columns)} columns, not {len(want)}")
    return raw.toDF(*(f"c{i}" for i in range(len(raw.columns)))).select(*(F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(want)))


def passages(spark: SparkSession, path: str, ignore_wid: bool = False) -> DataFrame:
    """pid, passage, wid; rows with an empty passage are dropped."""
    df = delimited(spark, path, "pid long, passage string" if ignore_wid else S.PASSAGES)
    return df.where(F.col("pid").isNotNull() & (F.coalesce("passage", F.lit("")) != ""))


def queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, query; a missing query is the empty string."""
    return delimited(spark, path, S.QUERIES).na.fill("", ["query"])


def triples(spark: SparkSession, path: str, mode: str = "QQP", passages_per_query: int | None = None) -> DataFrame:
    """QQP: qid_pos, qid_neg, pid. QPP: qid, pid_pos, pid_neg, with passages_per_query passages in all."""
    mode = mode.upper()
    if mode == "QQP":
        return delimited(spark, path, S.TRIPLES_QQP)
    if mode != "QPP":
        raise ValueError("mode is QQP or QPP")
    width = len(spark.read.option("sep", "," if path.endswith(".csv") else "\t").option("header", True).csv(path).columns)
    n = min(width, (passages_per_query or width) + 1)
    raw = delimited(spark, path, ", ".join(f"c{i} long" for i in range(n)))
    return raw.select(F.col("c0").alias("qid"), F.col("c1").alias("pid_pos"), F.array(*(f"c{i}" for i in range(2, n))).alias("pid_neg"))


def write_delimited(df: DataFrame, folder: str, names: list[str] | None = None) -> None:
    """TSV with a header; names: the header's names by position."""
    (df.toDF(*names) if names else df).write.mode("overwrite").option("sep", "\t").option("header", True).option("escape", '"').csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def _framed(df: DataFrame, lines, first: str, last: str, folder: str) -> None:
    """Text files of a frame's lines, separated by commas, between first and last; a file a partition."""

    def run(batches):
        before = first
        for b in batches:
            rows = b.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([before + rows[0], *("," + x for x in rows[1:])])], names=["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array([last if before == "," else first + last])], names=["value"])

    df.select(lines).mapInArrow(run, "value string").write.mode("overwrite").text(folder)


def write_json_array(df: DataFrame, folder: str) -> None:
    """Every file one JSON array of records, as json_records() reads it."""
    _framed(df, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), "[", "]", folder)


def write_json_keyed(df: DataFrame, folder: str, key: str = "wid") -> None:
    """Every file one JSON object of records by id, as json_keyed() reads it. Keys must be unique and not null."""
    rest = [c for c in df.columns if c != key]
    line = F.concat(F.lit('"'), F.col(key).cast("string"), F.lit('":'), F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))
    _framed(df.where(F.col(key).isNotNull()), line, "{", "}", folder)


def write_relations(df: DataFrame, folder: str, by: tuple[str, ...] = ("wiki", "split")) -> None:
    """Parquet, partitioned as the relations are asked for; so are `all` and the union of the wikis just other partition filters."""
    df.write.mode("overwrite").partitionBy(*by).parquet(folder)


def dataset(spark: SparkSession, folder: str, mode: str = "QQP") -> dict[str, DataFrame]:
    """The three relations of a folder, found by their names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = [f.getPath() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    at = {}
    for p in files:
        for kind in ("triples", "queries", "passages"):
            if kind in p.getName() and p.getName().endswith((".tsv", ".csv")):
                at[kind] = p.toString()
    if len(at) < 3:
        raise FileNotFoundError(f"{folder} lacks one of triples, queries, passages")
    return {"triples": triples(spark, at["triples"], mode), "queries": queries(spark, at["queries"]), "passages": passages(spark, at["passages"])}


def question_cells(spark: SparkSession, path: str) -> DataFrame:
    """i, j, positive, negative, passage of a CSV with lists written in its cells; what does not parse is an empty list."""
    from wikiloom.functions.text import list_literal

    df = delimited(spark, path, "i long, j long, positive string, negative string, passage string")
    none = F.array().cast("array<string>")
    return df.select("i", "j", F.coalesce(list_literal("positive"), none).alias("positive"), F.coalesce(list_literal("negative"), none).alias("negative"), "passage")
