"""Identifier scheme and column lists of the graph's tables. The id formats are fixed values that join everything."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KINDS = ("Module", "Class", "Function", "External")
EDGE_KINDS = ("CONTAINS", "IMPORTS", "CALLS", "INHERITS")
DOC_LIMIT, CONDITION_LIMIT, RENDER_ID_LIMIT = 300, 160, 300

NODES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "kind", "name", "file")]
    + [T.StructField("lineno", T.LongType()), T.StructField("end_lineno", T.LongType()), T.StructField("docstring", T.StringType())]
)
EDGES = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "dst", "kind")])


def module_id(file: Column) -> Column:
    return F.concat(F.lit("module::"), file)


def class_id(file: Column, qualname: Column) -> Column:
    return F.concat(F.lit("class::"), file, F.lit("::"), qualname)


def function_id(file: Column, qualname: Column) -> Column:
    return F.concat(F.lit("function::"), file, F.lit("::"), qualname)


def external_id(name: Column) -> Column:
    return F.concat(F.lit("external::"), name)


def concept_id(app: Column, code: Column) -> Column:
    return F.concat_ws("::", F.lit("concept"), app, code)


def route_id(kind: Column, source_file: Column, lineno: Column, http_method: Column, pattern: Column) -> Column:
    return F.concat_ws("::", F.lit("route"), kind, source_file, lineno.cast("string"), http_method, pattern)


def render_id(source_file: Column, lineno: Column, view_arg: Column) -> Column:
    return F.substring(F.concat_ws("::", F.lit("render"), source_file, lineno.cast("string"), view_arg), 1, RENDER_ID_LIMIT)
