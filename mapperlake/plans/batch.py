"""Statements rendered and run for a whole table of parameters.

A statement's dynamic tags are compiled to columns over the parameter table: each condition to a boolean, each iteration
to its number of items, each raw substitution to its text. Together they are a row's shape, which decides the statement's text. Only one
parameter row for each distinct shape is rendered, by the renderer for single calls; every row of the shape has that text, and
its arguments are expressions over the row. So all rows are rendered by joins and built-in functions, and a run joins
each shape's rows laterally with the shape's statement. Older dialect.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapperlake.functions.inline import parameters
from mapperlake.functions.sqltokens import tokenize
from mapperlake.operators.runtime import render
from mapperlake.plans.engine import for_spark

#: Distinct shapes that one table of parameters may have; each is a plan of its own.
SHAPES = 1000


class CannotCompile(ValueError):
    """A statement that only single calls can render."""


def kind_of(schema: T.StructType, path: str) -> T.DataType | None:
    """The type of a property path of the parameter table, None if it has no such column."""
    kind: T.DataType | None = schema
    for part in path.split("."):
        kind = next((f.dataType for f in kind.fields if f.name == part), None) if isinstance(kind, T.StructType) else None
    return kind


def value(schema: T.StructType, path: str) -> Column:
    """A property as a column, null if the table has no such column."""
    if kind_of(schema, path) is None:
        return F.lit(None).cast("string")
    head, *rest = path.split(".")
    return reduce(lambda c, f: c.getField(f), rest, F.col(f"`{head}`"))


def condition(schema: T.StructType, a: dict) -> Column:
    """An older-dialect condition over a parameter row; true or false, never null."""
    kind, name = a["condition"], a.get("property") or ""
    if kind in ("PARAMETER_PRESENT", "NOT_PARAMETER_PRESENT"):
        return F.lit(kind == "PARAMETER_PRESENT")
    if kind in ("PROPERTY_AVAILABLE", "NOT_PROPERTY_AVAILABLE"):
        return F.lit((kind_of(schema, name.split(".")[0]) is not None) == (kind == "PROPERTY_AVAILABLE"))
    v = value(schema, name)
    if kind in ("IS_NULL", "IS_NOT_NULL"):
        return v.isNull() if kind == "IS_NULL" else v.isNotNull()
    if kind in ("IS_EMPTY", "IS_NOT_EMPTY"):
        held = kind_of(schema, name)
        empty = v.isNull() | (F.size(v) == 0) if isinstance(held, (T.ArrayType, T.MapType)) else v.isNull() | (v == "") if isinstance(held, T.StringType) else v.isNull()
        return F.coalesce(empty if kind == "IS_EMPTY" else ~empty, F.lit(kind == "IS_EMPTY"))
    other = value(schema, a["compareProperty"]) if a.get("compareProperty") else F.lit(a.get("compareValue"))
    compare = {"EQUAL": "__eq__", "NOT_EQUAL": "__ne__", "GREATER_THAN": "__gt__", "GREATER_EQUAL": "__ge__", "LESS_THAN": "__lt__", "LESS_EQUAL": "__le__"}.get(kind)
    if compare is None:
        raise CannotCompile(f"condition {kind}")
    texts, numbers = (v.cast("string"), other.cast("string")), [x.cast("string").try_cast("double") for x in (v, other)]
    told = F.when(numbers[0].isNotNull() & numbers[1].isNotNull(), getattr(numbers[0], compare)(numbers[1])).otherwise(getattr(texts[0], compare)(texts[1]))
    both = v.isNull() & other.isNull()
    none = both if kind in ("EQUAL", "GREATER_EQUAL", "LESS_EQUAL") else ~both if kind == "NOT_EQUAL" else F.lit(False)
    return F.when(v.isNull() | other.isNull(), none).otherwise(told)


def shape(schema: T.StructType, nodes: list[dict]) -> Column:
    """What decides a statement's text for a parameter row, as a text: conditions (- below one that doesn't hold), numbers of items and raw values in order."""
    parts: list[Column] = []

    def walk(siblings: list[dict], under: Column | None, within: bool) -> None:
        for n in siblings:
            a = n["attrs"]
            if n["type"] == "Text":
                for p in parameters(n["text"]):
                    if p["binding"] == "DOLLAR":
                        if "[]" in p["property"]:
                            raise CannotCompile("raw values of an iteration's items")
                        raw = F.coalesce(value(schema, p["property"]).cast("string"), F.lit(""))
                        parts.append(F.concat(F.length(raw).cast("string"), F.lit(":"), raw))
            elif n["type"] == "Conditional":
                if within:
                    raise CannotCompile("conditions within an iteration")
                holds = condition(schema, a)
                parts.append(F.when(holds if under is None else under & holds, "1").otherwise("0"))
                walk(n["children"], holds if under is None else under & holds, within)
            elif n["type"] == "Iterate":
                name = a.get("property") or ""
                if within or not isinstance(kind_of(schema, name), T.ArrayType):
                    if within or kind_of(schema, name) is not None or not name:
                        raise CannotCompile("an iteration within another, or over what is no array")
                    parts.append(F.lit("0"))
                    continue
                n_items = F.greatest(F.size(value(schema, name)), F.lit(0))
                parts.append(F.concat(F.lit("#"), (n_items if under is None else F.when(under, n_items).otherwise(0)).cast("string")))
                walk(n["children"], under, True)
            else:
                walk(n["children"], under, within)

    walk(nodes, None, False)
    return F.concat_ws(",", *parts) if parts else F.lit("")


def reference(schema: T.StructType, path: str, null_value: str | None, row: str = "") -> str:
    """A property of a parameter row as SQL; the turn of an iteration is an index from 0."""
    m = re.match(r"([^.\[]+)((?:\[\d+\]|\.[^.\[]+)*)$", path)
    if not m or kind_of(schema, m[1]) is None:
        return "NULL"
    said = f"{row}`{m[1]}`" + re.sub(r"\.([^.\[]+)", r".`\1`", m[2])
    return said if null_value is None else f"(CASE WHEN CAST({said} AS STRING) = '{null_value.replace(chr(39), chr(39) * 2)}' THEN NULL ELSE {said} END)"


class Batch:
    """A statement over a parameter table: `shaped` has its rows with `shape`; texts: shape to (sql, [(property, null value)])."""

    def __init__(self, nodes: list[dict], params: DataFrame, dialect: str = "ibatis"):
        if dialect != "ibatis":
            raise CannotCompile("only the older dialect is compiled")
        self.schema = params.schema
        self.shaped = params.withColumn("shape", shape(params.schema, nodes))
        one = self.shaped.groupBy("shape").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in params.columns])).alias("row")).limit(SHAPES + 1).collect()
        if len(one) > SHAPES:
            raise CannotCompile(f"the parameters have more than {SHAPES} shapes")
        self.texts: dict[str, tuple[str, list]] = {}
        for r in sorted(one, key=lambda r: r["shape"]):
            paths: list = []
            sql, _ = render(nodes, r["row"].asDict(recursive=True), dialect, paths)
            self.texts[r["shape"]] = sql, paths

    def rendered(self) -> DataFrame:
        """The parameter rows with sql string and args array<string>."""
        spark = self.shaped.sparkSession
        if not self.texts:
            return self.shaped.select("*", F.lit("").alias("sql"), F.array().cast("array<string>").alias("args"))
        texts = spark.createDataFrame([(k, sql) for k, (sql, _) in self.texts.items()], "shape string, sql string")
        args = reduce(lambda c, k: c.when(F.col("shape") == k, F.array(*[F.expr(f"CAST({reference(self.schema, *p)} AS STRING)") for p in self.texts[k][1]]).cast("array<string>")), self.texts, F.when(F.lit(False), F.array().cast("array<string>")))
        return self.shaped.withColumn("args", args).join(F.broadcast(texts), "shape")

    def run(self, key: list[str]) -> DataFrame:
        """The statement's rows for every parameter row, with the key columns of that row; a plan for each shape, none for each row."""
        spark, out = self.shaped.sparkSession, []
        for k, (sql, paths) in self.texts.items():
            view = f"parameters_{uuid.uuid4().hex}"
            self.shaped.where(F.col("shape") == k).drop("shape").createOrReplaceTempView(view)
            sql, refs = for_spark(sql, [reference(self.schema, *p, row="parameter_row.") for p in paths])
            refs = iter(refs)
            body = "".join(next(refs) if t.text == "?" else t.text for t in tokenize(sql))
            keys = ", ".join(f"parameter_row.`{c}`" for c in key)
            out.append(spark.sql(f"SELECT {keys}, statement_row.* FROM {view} parameter_row, LATERAL ({body}) statement_row"))
        if not out:
            raise ValueError("a table without parameter rows has no statement to run")
        return reduce(DataFrame.unionByName, out)
