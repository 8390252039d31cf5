"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the column order of a sheet export.
SHEET_COLUMNS = ["category", "sub_category", "url", "title", "description", "content", "date", "words"]


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, overwritten or appended to; either way each line is a valid object."""
    rows.write.mode("append" if append else "overwrite").json(path)


write_jsonl = write_json


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_index(entries: DataFrame, path: str) -> None:
    """Vectors, keys, texts and chunk ids in one table."""
    entries.write.mode("overwrite").parquet(path)


def write_xlsx(rows: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """One sheet, of at most `limit` rows, as a sheet can't hold more. Needs openpyxl where the driver runs."""
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"a sheet holds at most {limit} rows")
    rows.toPandas().to_excel(path, index=False)


def sheet_columns(rows: DataFrame) -> DataFrame:
    """The columns of a sheet export that there are, in its order."""
    return rows.select(*(c for c in SHEET_COLUMNS if c in rows.columns))


def convert_to_xlsx(rows: DataFrame, path: str) -> None:
    """Records, as read from JSON or JSON lines, as a sheet in the order of its columns."""
    write_xlsx(sheet_columns(rows), path)


def to_json_text(value: Column, pretty: bool = False) -> Column:
    return F.to_json(value, {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})


def to_jsonl_text(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A text of JSON lines for each group, in order."""
    line = F.struct(F.col(order).alias("o"), F.to_json(F.struct(*(c for c in rows.columns if c not in keys))).alias("j"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["j"]), "\n").alias("jsonl"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    write_json(metrics, path)
