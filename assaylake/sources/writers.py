"""Sinks: Parquet tables first, delimited exports where people need them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """A Parquet table, optionally in folders per batch; sorting inside files makes later filters skip row groups."""
    if partition_by:
        df = df.repartition(*partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def widen(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The wide matrix of an export. Give the columns where they are known, else one more pass finds them."""
    p = df.groupBy(row).pivot(column, list(columns)) if columns is not None else df.groupBy(row).pivot(column)
    return p.agg(F.first(value))


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited parts with header; arrays are joined by semicolons."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    df.select([F.array_join(F.col(f"`{c}`").cast("array<string>"), ";").alias(c) if c in arrays else F.col(f"`{c}`") for c in df.columns]).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_wide(df: DataFrame, rows: Sequence[str], column: str, value: str, path: str, sep: str = ",") -> None:
    """The wide matrix of an export as delimited parts with header, for any number of columns: one line per distinct ``rows``, one column per
    value of ``column``.

    Columns are in order of their names. Nothing is planned per column: each line is put together from its own cells, so a line, not
    the table, is what a task holds. Of several values of a cell one is written.
    """
    spark = df.sparkSession
    name = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("null"))
    names = [r.name for r in df.select(name.alias("name")).distinct().orderBy("name").collect()]
    first, last = len(rows), len(rows) + len(names) - 1
    header = spark.createDataFrame([(list(rows), names)], "a array<string>, b array<string>")
    header = header.select(F.array_join(F.transform(F.concat("a", "b"), lambda x: _written(x, sep)), sep).alias("_header"))
    if not names:
        header.coalesce(1).write.mode("overwrite").text(path)
        return
    # The names of one line, so they may be broadcast.
    at = spark.createDataFrame([(n, i) for i, n in enumerate(names, first)], "_name string, _pos int")
    keys = [F.col(f"`{c}`").cast("string").alias(f"_k{i}") for i, c in enumerate(rows)]
    cells = df.select(*keys, name.alias("_name"), F.col(f"`{value}`").cast("string").alias("_text")).join(F.broadcast(at), "_name")
    cell = F.when(F.col("_text").isNotNull(), F.struct("_pos", F.col("_text")))
    lines = cells.groupBy(*[f"_k{i}" for i in range(first)]).agg(F.collect_list(cell).alias("_c"))
    # Sorted in a step of its own: the next one reads it for every cell.
    lines = lines.withColumn("_c", F.sort_array("_c"))
    before = lambda i: F.coalesce(F.get("_c", i - 1)["_pos"], F.lit(first - 1))
    piece = lambda x, i: F.when(x["_pos"] > before(i), F.concat(F.repeat(F.lit(sep), x["_pos"] - before(i)), _written(x["_text"], sep))).otherwise("")
    end = F.repeat(F.lit(sep), F.lit(last) - before(F.size("_c")))
    line = F.concat(F.array_join(F.array(*[F.coalesce(_written(F.col(f"_k{i}"), sep), F.lit("")) for i in range(first)]), sep), F.array_join(F.transform("_c", piece), ""), end)
    # The first row of a part carries the header.
    leads = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines.select(line.alias("_line")).crossJoin(F.broadcast(header)).select(F.when(leads, F.concat_ws("\n", "_header", "_line")).otherwise(F.col("_line")).alias("value")).write.mode("overwrite").text(path)


def _written(text: Column, sep: str) -> Column:
    """A text as a field: in quotes if it is empty or holds a quote or the separator."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when((text == "") | text.contains('"') | text.contains(sep), quoted).otherwise(text)


def save_run(folder: str, **tables: DataFrame) -> None:
    """The tables of a run, each under its name, for ``readers.load_run``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def write_json(values: dict[str, Any], path: str) -> None:
    """Small results from the driver; numpy numbers and arrays become plain ones."""

    def plain(x: Any) -> Any:
        return x.item() if isinstance(x, np.generic) else x.tolist() if isinstance(x, np.ndarray) else str(x)

    Path(path).write_text(json.dumps(values, default=plain, indent=1), encoding="utf-8")


def markdown_report(title: str, tables: dict[str, DataFrame], rows: int = 50) -> str:
    """A report with the first rows of each table."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(rows).collect()]
        out.append("")
    return "\n".join(out)


def save_model(spark: SparkSession, path: str, kind: str, **arrays: np.ndarray) -> None:
    """Model parameters as rows (kind, name, shape, numbers), no pickles."""
    rows = [(kind, n, list(np.shape(a)), np.asarray(a, dtype=float).ravel().tolist()) for n, a in arrays.items()]
    spark.createDataFrame(rows, "kind string, name string, shape array<int>, numbers array<double>").write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[str, dict[str, np.ndarray]]:
    rows = spark.read.parquet(path).collect()
    return rows[0].kind, {r.name: np.array(r.numbers).reshape(r.shape) for r in rows}
