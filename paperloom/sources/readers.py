"""Sources: files, rule assets, text pages, and parsers as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPANS = "doc_id long, page_no int, block_no int, line_no int, span_no int, text string, size double, flags int, bbox struct<x0:double,y0:double,x1:double,y1:double>"


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON with a schema, which keeps the fields' order. A missing file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """An object per line; a malformed line raises."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns, as strings, of the lines that are well formed and have them all."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).select(*columns).dropna()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header row, all values strings, line breaks inside quotes."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def read_rules(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """`key, pos, value` of a rule asset {type, items: [{key, values}]}; a value that isn't a string is its JSON."""
    schema = "type string, items array<struct<key:string,values:array<string>>>"
    rows = read_json(spark, path, schema).select(F.explode("items").alias("i")).select("i.key", F.posexplode("i.values").alias("pos", "value"))
    return rows.where(F.col("key").isin(wanted)) if wanted is not None else rows


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """`index, base_key, key, text, chunk_ids[, embedding]`: vectors and sidecars are columns of one table."""
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_pages(documents: DataFrame, doc: str = "doc_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """A document's pages that aren't blank, in order, each with a line break after it."""
    rows = documents.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(page), F.col(text).alias("t")))), lambda x: F.concat(x["t"], F.lit("\n")))
    return rows.groupBy(doc).agg(F.array_join(parts, "").alias("text"))


def read_uploads(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """`path, length, content` of the files with this suffix, however it is written."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.lower("path").endswith(suffix)).select("path", "length", "content")


Parser = Callable[[bytes], Iterator[dict]]


def parse_spans(files: DataFrame, parser: Parser) -> DataFrame:
    """Spans of binary files (`doc_id, content`); the parser yields dicts of a span's columns but doc_id. No PDF
    library is bundled, so the parser is the caller's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SPANS.split(", ")]
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                yield pd.DataFrame([{"doc_id": doc_id, **s} for s in parser(bytes(content))], columns=columns)

    return files.select("doc_id", "content").mapInPandas(run, SPANS)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """The Arrow files under a folder, as data set libraries save them, with `split`, the name of the folder that a file
    is in. Any of the files has the schema; each is read whole where a task is, so none may exceed 2 GB."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.arrow").load(path)
    first = files.select("content").limit(1).collect()
    if not first:
        raise ValueError(f"no Arrow files under {path}")

    def opened(content: bytes) -> Iterator[pa.RecordBatch]:
        try:
            yield from pa.ipc.open_stream(content)
        except pa.ArrowInvalid:  # the format with a footer
            found = pa.ipc.open_file(content)
            yield from (found.get_batch(i) for i in range(found.num_record_batches))

    try:
        arrow = pa.ipc.open_stream(first[0].content).schema
    except pa.ArrowInvalid:
        arrow = pa.ipc.open_file(first[0].content).schema
    schema = from_arrow_schema(arrow).add("split", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split, content in zip(batch.column("split").to_pylist(), batch.column("content"), strict=True):
                for rows in opened(content.as_buffer()):
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([split] * rows.num_rows, pa.string())], [*rows.schema.names, "split"])

    return files.select(F.element_at(F.split("path", "/"), -2).alias("split"), "content").mapInArrow(run, schema)


def read_training_set(spark: SparkSession, source: DataFrame | str, schema: T.StructType | str | None = None) -> DataFrame:
    """Training rows from a table, a folder of Arrow files, a Parquet folder or JSON lines; anything else raises."""
    if isinstance(source, DataFrame):
        return source
    if not isinstance(source, str):
        raise TypeError("a DataFrame or a path is needed")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise ValueError(f"{source} doesn't exist")
    if not fs.getFileStatus(fs_path).isDirectory():
        return read_jsonl(spark, source, schema)
    found = fs.listFiles(fs_path, True)
    while found.hasNext():
        name = found.next().getPath().getName()
        if name.endswith(".arrow"):
            return read_arrow(spark, source)
        if name.endswith(".parquet"):
            return spark.read.parquet(source)
    return read_jsonl(spark, source, schema)


def read_xlsx(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """First row the header. Needs openpyxl where the driver runs."""
    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))
