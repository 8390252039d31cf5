"""Nested records: flattening in document order, schema inference, field drops and paths.

Everything is built from the DataFrame's schema, whose field order is the document's; JSON inference would sort the keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = "array<struct<base:string,key:string,text:string>>"


def _text(value: Column, kind: T.DataType) -> Column:
    return value if isinstance(kind, T.StringType) else value.cast("string")


def _join(base: str, name: str) -> str:
    return f"{base}.{name}" if base else name


def flatten_pairs(value: Column, kind: T.DataType, mode: str = "split", separator: str = "\n", base: str = "", key: Column | None = None, merge: bool = False) -> Column:
    """The leaves of a column as an array of (base path, path with subscripts, text), in document order.

    Lists are split into subscripted elements, joined into one text (blank elements left out), or kept as JSON. With `merge`, lists
    of nothing but plain values, none of them null, become one text as they are, whatever the mode; a list without elements an empty one.
    """
    key = F.lit(base) if key is None else key
    if isinstance(kind, T.StructType):
        inside = lambda f: F.concat(key, F.lit(f".{f.name}")) if base else F.lit(f.name)
        if kind.fields and not any(isinstance(f.dataType, (T.StructType, T.ArrayType)) for f in kind.fields):
            # of nothing but leaves: one array, not one for each that are then joined
            leaves = F.array(*(_one(_join(base, f.name), inside(f), _text(value[f.name], f.dataType)) for f in kind.fields))
            return F.when(value.isNotNull(), leaves).otherwise(F.array().cast(PAIR))
        parts = []
        for f in kind.fields:
            parts.append(flatten_pairs(value[f.name], f.dataType, mode, separator, _join(base, f.name), inside(f), merge))
        return F.when(value.isNotNull(), F.flatten(F.array(*parts))).otherwise(F.array().cast(PAIR)) if parts else F.array().cast(PAIR)
    if isinstance(kind, T.ArrayType):
        if merge and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            shown = F.transform(value, lambda x: F.initcap(x.cast("string")) if isinstance(kind.elementType, T.BooleanType) else _text(x, kind.elementType))
            whole = _pair(base, key, F.array_join(shown, separator), value.isNotNull())
            return F.when(F.exists(value, lambda x: x.isNull()), flatten_pairs(value, kind, mode, separator, base, key)).otherwise(whole)
        if mode == "split":
            if not isinstance(kind.elementType, (T.StructType, T.ArrayType)):
                return F.coalesce(F.transform(value, lambda x, i: _one(base, F.concat(key, F.lit("["), i.cast("string"), F.lit("]")), _text(x, kind.elementType))), F.array().cast(PAIR))
            nested = F.transform(value, lambda x, i: flatten_pairs(x, kind.elementType, mode, separator, base, F.concat(key, F.lit("["), i.cast("string"), F.lit("]")), merge))
            return F.coalesce(F.flatten(nested), F.array().cast(PAIR))
        if mode == "join":
            simple = not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType))
            text = F.transform(value, lambda x: F.trim(_text(x, kind.elementType) if simple else F.to_json(x)))
            joined = F.array_join(F.filter(text, lambda t: t != ""), separator)
            return _pair(base, key, joined, value.isNotNull())
        return _pair(base, key, F.to_json(value), value.isNotNull())
    return _pair(base, key, _text(value, kind), F.lit(True))


def _one(base: str, key: Column, text: Column) -> Column:
    return F.struct(F.lit(base).alias("base"), key.alias("key"), text.alias("text"))


def _pair(base: str, key: Column, text: Column, there: Column) -> Column:
    return F.when(there, F.array(_one(base, key, text))).otherwise(F.array().cast(PAIR))


def flatten(rows: DataFrame, id_col: str, mode: str = "split", separator: str = "\n", merge: bool = False) -> DataFrame:
    """`id, ord, base_key, key, text`: a row per leaf of each record, ord counted from 0; `flatten_pairs` says how lists are treated."""
    fields = [f for f in rows.schema.fields if f.name != id_col]
    pairs = F.flatten(F.array(*(flatten_pairs(F.col(f.name), f.dataType, mode, separator, f.name, F.lit(f.name), merge) for f in fields)))
    return rows.select(F.col(id_col), F.posexplode(pairs).alias("ord", "p")).select(id_col, "ord", F.col("p.base").alias("base_key"), F.col("p.key").alias("key"), F.col("p.text").alias("text"))


# --- schema inference

_NAMES = {T.StringType: "string", T.BooleanType: "boolean", T.NullType: "null", T.StructType: "object", T.ArrayType: "array", T.MapType: "object"}


def _type_name(kind: T.DataType) -> str:
    return next((n for k, n in _NAMES.items() if isinstance(kind, k)), "number")


def _paths(value: Column, kind: T.StructType, prefix: str, policy: str) -> list[Column]:
    """Columns, each an array of (path, type), one for each field at any depth."""
    entry = lambda path, t: F.array(F.struct(F.lit(path).alias("path"), t.alias("type")))
    empty = F.array().cast("array<struct<path:string,type:string>>")
    out = []
    for f in kind.fields:
        path, v = prefix + f.name, value[f.name]
        out.append(F.when(value.isNotNull(), entry(path, F.when(v.isNull(), "null").otherwise(_type_name(f.dataType)))).otherwise(empty))
        if isinstance(f.dataType, T.StructType):
            out += _paths(v, f.dataType, f"{path}.", policy)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            inner = f.dataType.elementType
            every = v if policy == "union" else F.slice(v, 1, 1)
            out.append(F.coalesce(F.flatten(F.transform(every, _element(inner, f"{path}.", policy))), empty))
    return out


def _element(kind: T.StructType, prefix: str, policy: str) -> Callable[[Column], Column]:
    return lambda x: F.flatten(F.array(*_paths(x, kind, prefix, policy)))


def infer_types(rows: DataFrame, policy: str = "first", exclude: tuple[str, ...] = ()) -> DataFrame:
    """`path, type` over all records: null gives way to any type, and types that differ make "mixed"."""
    fields = T.StructType([f for f in rows.schema.fields if f.name not in exclude])
    record = F.struct(*fields.names)
    seen = rows.select(record.alias("r")).select(F.explode(F.flatten(F.array(*_paths(F.col("r"), fields, "", policy)))).alias("x"))
    return merge_types(seen.select("x.path", "x.type"))


def merge_types(seen: DataFrame) -> DataFrame:
    """`path, type` from any number of (path, type) rows."""
    kinds = F.collect_set(F.when(F.col("type") != "null", F.col("type")))
    return seen.groupBy("path").agg(kinds.alias("k")).select("path", F.when(F.size("k") == 0, "null").when(F.size("k") == 1, F.col("k")[0]).otherwise("mixed").alias("type"))


# --- dropping and reaching fields


def drop_fields(value: Column, kind: T.DataType, names: set[str]) -> Column:
    """The value without the fields of these names (lower case) at any depth, however they are written."""
    if isinstance(kind, T.StructType):
        kept = [drop_fields(value[f.name], f.dataType, names).alias(f.name) for f in kind.fields if f.name.lower() not in names]
        return F.when(value.isNotNull(), F.struct(*kept)) if kept else F.lit(None)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: drop_fields(x, kind.elementType, names))
    return value


def drop_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    lower = {n.lower() for n in names}
    return rows.select(*(drop_fields(F.col(f.name), f.dataType, lower).alias(f.name) for f in rows.schema.fields if f.name.lower() not in lower))


def by_path(rows: DataFrame, path: str) -> Column:
    """The value at A.B.C; through lists the values of all elements, without nulls, one level flatter. A missing path is null."""

    def step(value: Column, kind: T.DataType, parts: list[str]) -> Column:
        if not parts:
            return value
        if isinstance(kind, T.StructType):
            found = next((f for f in kind.fields if f.name == parts[0]), None)
            return F.lit(None) if found is None else step(value[found.name], found.dataType, parts[1:])
        if isinstance(kind, T.ArrayType):
            end = _reach(kind.elementType, parts)
            got = F.transform(value, lambda x: step(x, kind.elementType, parts))
            got = F.filter(got, lambda x: x.isNotNull())
            return F.flatten(got) if isinstance(end, T.ArrayType) else got
        return F.lit(None)

    parts = path.split(".")
    field = next((f for f in rows.schema.fields if f.name == parts[0]), None)
    return F.lit(None) if field is None else step(F.col(field.name), field.dataType, parts[1:])


def _reach(kind: T.DataType, parts: list[str]) -> T.DataType | None:
    """The type that a path leads to."""
    if not parts:
        return kind
    if isinstance(kind, T.ArrayType):
        inner = _reach(kind.elementType, parts)
        return inner if inner is None or isinstance(inner, T.ArrayType) else T.ArrayType(inner)
    if isinstance(kind, T.StructType):
        found = next((f for f in kind.fields if f.name == parts[0]), None)
        return _reach(found.dataType, parts[1:]) if found else None
    return None


def leaf_text(value: Column, kind: T.DataType) -> Column:
    """All leaf values without their keys, one to a line, in document order."""
    lines = F.transform(flatten_pairs(value, kind, "split"), lambda p: F.coalesce(p["text"], F.lit("None")))
    return F.array_join(lines, "\n")
