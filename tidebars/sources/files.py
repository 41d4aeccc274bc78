"""Readers and writers: JSON arrays of bars, universes, zipped CSV days, score tables, reports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebars.sources.schema import BAR, nan_to_null


def json_bars(spark: SparkSession, path: str | list[str], schema: str = BAR, suffix: str = r"-15m\.json$") -> DataFrame:
    """Bars of all files at ``path`` (globs allowed), each a JSON array; asset is the file's name without ``suffix``. A missing
    change is 0."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = rows.withColumn("asset", F.regexp_replace(name, suffix, ""))
    return nan_to_null(rows).withColumn("change", F.coalesce("change", F.lit(0.0)))


def merged_bars(parts: list[DataFrame]) -> DataFrame:
    """Union of sources in which a later one replaces an earlier one's bar of the same datetime; an error without sources."""
    if not parts:
        raise ValueError("no source")
    ranked = reduce(lambda a, b: a.unionByName(b, True), [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)])
    last = F.row_number().over(W.partitionBy("asset", "datetime").orderBy(F.desc("_rank")))
    return ranked.withColumn("_n", last).where("_n = 1").drop("_n", "_rank")


def span(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Bars whose date lies between two dates, both included."""
    return rows.where(F.substring("datetime", 1, 10).between(start, end))


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists in its file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def universe(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) of a list with one or more names in a line and # comments; lower case, dots as dashes."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    names = spark.read.text(path).select(F.explode(F.split(line, r"\s+")).alias("s")).where("s <> ''")
    return names.select(F.regexp_replace(F.lower("s"), r"\.", "-").alias("symbol"))


def zip_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of zipped CSV files, with file and line, the order within the file. One archive is one row of the scan."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for file, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        rows = pd.read_csv(z.open(member), header=0 if header else None, names=None if header else names)[names]
                        yield rows.assign(file=f"{file}!{member}", line=range(len(rows)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema + ", file STRING, line LONG")


def snapshots(rows: DataFrame, level: str, ts: Column, seconds: int) -> DataFrame:
    """Order-book rows with their bucket; order within a bucket is the order in the file."""
    return rows.withColumn("slot", F.floor(ts / seconds)).withColumn("level", F.col(level))


def write_scores(rows: DataFrame, path: str) -> None:
    """Out-of-sample scores by class; scores as FLOAT, so that ties are the same wherever they are read."""
    rows.withColumn("p_ising", F.col("p_ising").cast("float")).withColumn("p_free", F.col("p_free").cast("float")).write.partitionBy("cls").mode("ignore").parquet(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def report_json(rows: DataFrame, indent: int = 1) -> str:
    """A result table as JSON; results are a few rows for each series."""
    return json.dumps([r.asDict(True) for r in rows.collect()], indent=indent, default=str)


def report_markdown(rows: DataFrame, key: str, column: str, value: str, best: str = "max", places: int = 4) -> str:
    """A pivot as a Markdown table, the best cell of each row in bold."""
    got: dict = {}
    for r in rows.select(key, column, value).collect():
        got.setdefault(r[key], {})[r[column]] = r[value]
    heads = sorted({c for x in got.values() for c in x})
    lines = ["| " + " | ".join([key, *map(str, heads)]) + " |", "|" + "---|" * (len(heads) + 1)]
    for k in sorted(got):
        known = [v for v in got[k].values() if v is not None]
        top = (max if best == "max" else min)(known) if known else None
        cells = [("" if (v := got[k].get(h)) is None else f"**{v:.{places}f}**" if v == top else f"{v:.{places}f}") for h in heads]
        lines.append("| " + " | ".join([str(k), *cells]) + " |")
    return "\n".join(lines)
