"""JSON Lines, run folders and report sinks."""

from __future__ import annotations

import json
import tomllib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Typed rows; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> int:
    """Write and count in one pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).json(path, ignoreNullFields=False)
    return seen.get["rows"]


def append_new(todo: DataFrame, path: str, key: str, schema: StructType | str) -> int:
    """Append the rows of ``todo`` whose key the folder does not have yet; the first call creates it."""
    spark = todo.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        todo = todo.join(read_jsonl(spark, path, schema).select(key).distinct(), key, "left_anti")
    return write_jsonl(todo, path, "append")


def read_runs(spark: SparkSession, root: str, schema: StructType | str, file: str = "items.jsonl") -> DataFrame:
    """Items of all run folders below ``root`` with run_id, the folder's name. A key that repeats in a run is for ``check_unique``."""
    rows = spark.read.schema(schema).json(f"{root}/*/{file}", mode="FAILFAST")
    return rows.withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_manifests(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    rows = spark.read.schema(schema).json(f"{root}/*/manifest.json", multiLine=True)
    return rows.withColumn("run_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by key; reading it fails if a key repeats."""
    from ..operators.guarded import unique

    return unique(df, keys)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def fixed(x: Column, places: int = 1, scale: float = 1.0) -> Column:
    """Text with fixed places, '-' if undefined, no negative zero."""
    text = F.format_string(f"%.{places}f", F.round(x * scale, places) + F.lit(0.0))
    return F.when(x.isNull(), "-").otherwise(F.regexp_replace(text, r"^-(0(?:\.0+)?)$", "$1"))


def metric_line(line: Column) -> Column:
    """struct(a, b) of a line 'a, b' of two integers, else NULL."""
    pattern = r"^\s*(\d+)\s*,\s*(\d+)\s*$"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).cast("long").alias("a"), F.regexp_extract(line, pattern, 2).cast("long").alias("b")))


def matching_lines(spark: SparkSession, path: str, words: list[str], offset: int = 0) -> DataFrame:
    """Lines of a log that have one of the words, from a byte offset on, which begins a line. Logs are read as whole files, one a row."""
    raw = spark.read.format("binaryFile").load(path).select(F.explode(F.split(F.substring(F.col("content"), offset + 1, 2**31 - 1).cast("string"), "\r?\n")).alias("value"))
    return raw.filter(F.exists(F.array(*map(F.lit, words)), lambda w: F.col("value").contains(w)))


#: A data set's rows. ``meta`` has no fixed keys and stays JSON text.
ITEM = (
    "item_id string, split string, domain string, spec struct<slots:array<struct<slot:string,type:string,value:string>>,actions:array<string>,follow_up:array<string>,events:array<string>,"
    "distractor:struct<slot:string,type:string,value:string>,facts:array<string>>, turns array<struct<speaker:string,text:string>>, summary string, source string, meta string"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Typed items with ord, their place in file order; items without an id or turns fail the read."""
    rows = read_jsonl(spark, path, ITEM)
    bad = F.col("item_id").isNull() | F.col("turns").isNull()
    return rows.filter(F.when(bad, F.raise_error(F.lit("an item needs item_id and turns"))).otherwise(F.lit(True))).withColumn("ord", F.monotonically_increasing_id())


def canonical_key(columns: list[str]) -> Column:
    """JSON text of the columns in the order of their names: equal settings are equal texts."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def load_declarations(text: str, tables: tuple[str, ...]) -> list[dict]:
    """Rows of a TOML file of arrays of tables; an unknown top-level key is an error."""
    data = tomllib.loads(text)
    if odd := sorted(set(data) - set(tables)):
        raise ValueError(f"unknown keys: {', '.join(odd)}")
    return [{"table": t, **row} for t in tables for row in data.get(t, [])]


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row as an indented JSON document on the driver."""
    (row,) = report.limit(2).collect()
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(row.asDict(recursive=True), f, ensure_ascii=False, indent=2)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A finished report as a Markdown table; more than ``most`` rows are an error, none is left out."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    line = lambda cells: "| " + " | ".join("-" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(report.columns), line("---" for _ in report.columns), *map(line, rows)])
