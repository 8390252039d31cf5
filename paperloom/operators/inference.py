"""Types of JSON records, from the values that are there.

Types depend on a record's shape, not on its values, and records have few shapes. So every text is parsed to see that it is JSON,
and then only the different shapes, texts with values of one kind made equal, are parsed to VARIANT; where nearly every record has a
shape of its own, they move once. Each round explodes what the one before found nested, so there are as many rounds as levels of nesting.
A round's types are summed up where they arise: a path has few, however many records there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cuts, drop_cuts
from .nested import merge_types

POLICIES = ("first", "union")


def value_type(value: Column) -> Column:
    """string, boolean, null, object, array or number."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    known = {"STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}
    return F.coalesce(*(F.when(name == k, v) for k, v in known.items()), F.lit("number"))


#: In JSON, a key with its colon, a text, a truth value or a number; and what stays of each, a mark after it.
_VALUE = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:)|(")[^"\\]*+(?:\\.[^"\\]*+)*+(")|tru(e)|fals(e)|-?[0-9][0-9.eE+-]*+'
_MARK = "\x01"  # JSON has none as it is


def json_shape(text: Column) -> Column:
    """JSON of the same structure whose texts are empty, numbers 0 and truth values true."""
    kept = F.regexp_replace(text, _VALUE, f"$1$2$3$4$5{_MARK}")
    for end, whole in ((f":{_MARK}", ":"), (f'"{_MARK}', '"'), (f"e{_MARK}", "true"), (_MARK, "0")):
        kept = F.replace(kept, F.lit(end), F.lit(whole))
    return kept


def infer_json_types(texts: DataFrame, column: str, policy: str = "first", lenient: bool = False) -> DataFrame:
    """`path, type` over all records: JSON objects as text in `column`, of any shape.

    The path of a field has its parents' names with dots between. Null gives way to any type, and types that differ
    make "mixed". Of a list the first element decides: if it is an object, its fields are looked at (`first`), or those of all
    objects in the list (`union`); if it is a list, likewise; otherwise nothing inside is. Records that aren't objects, and nulls, have
    no fields. Text that isn't JSON raises, or with `lenient` counts as null. An empty table has no paths.
    """
    if policy not in POLICIES:
        raise ValueError(f"{policy} isn't one of {POLICIES}")
    spark, begun = texts.sparkSession, cuts()
    parse = F.try_parse_json if lenient else F.parse_json
    # parse_json of a column without nulls is never null, so a test for that wouldn't run it
    valid = lambda v: v.isNotNull() if lenient else ~F.is_variant_null(v)
    # inside a lambda, or what makes the texts and this are one generated method, too long for the JVM to compile
    shape = F.transform(F.array(column), lambda x: F.when(valid(parse(x)), json_shape(x)))[0]
    whole = texts.select(shape.alias("shape")).distinct().select(F.parse_json("shape").alias("v")).where("v is not null")
    todo = cut_lineage(whole.where(value_type(F.col("v")) == "object").select(F.lit("").alias("prefix"), "v", F.lit(None).cast("string").alias("first")))
    found = None
    while True:
        inside = todo.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).withColumn("type", value_type(F.col("value")))
        fields = inside.where("first is null").select(F.concat("prefix", "key").alias("path"), "type")
        counted = cut_lineage(fields.distinct())
        found = counted if found is None else found.unionByName(counted)
        named = inside.where("first is null").select(F.concat("prefix", "key", F.lit(".")).alias("prefix"), F.col("value").alias("v"), "type")
        listed = inside.where("type = first" + ("" if policy == "union" else " and pos = 0")).select("prefix", F.col("value").alias("v"), "type")
        deeper = named.unionByName(listed).where("type in ('object', 'array')")
        # of an array, what its first element is; arrays of anything but objects and arrays end here
        head = F.when(F.col("type") == "array", F.coalesce(value_type(F.try_variant_get("v", "$[0]", "variant")), F.lit("null")))
        todo = cut_lineage(deeper.select("prefix", "v", head.alias("first")).where("first is null or first in ('object', 'array')"))
        if todo.isEmpty():
            break
    result = cut_lineage(merge_types(found))
    drop_cuts(spark, begun)
    return result
