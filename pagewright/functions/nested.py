"""Nested form-reader output (N01-N03): layout, tables, key-value pairs.

Input is the reader's JSON text per page; ``from_json`` with a fixed schema
turns it into structs, and higher-order functions (``transform``,
``filter``) reshape it -- all JVM-side, one row at a time, no shuffle.
Duplicate keys in key-value pairs resolve last-write-wins (the session sets
``spark.sql.mapKeyDedupPolicy=LAST_WIN``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
REGION = f"struct<page_number:int,polygon:array<{POINT}>>"
PARAGRAPH = f"struct<content:string,bounding_regions:array<{REGION}>>"
CELL = "struct<content:string,row_index:int,column_index:int,row_span:int,column_span:int,kind:string>"
TABLE = f"struct<row_count:int,column_count:int,cells:array<{CELL}>>"
KV = "struct<key:string,value:string>"
FORM_SCHEMA = (f"struct<pages:array<struct<width:double,height:double>>,paragraphs:array<{PARAGRAPH}>,"
               f"tables:array<{TABLE}>,key_value_pairs:array<{KV}>>")


def parse_form(json_text: Column) -> Column:
    return F.from_json(json_text, FORM_SCHEMA)


# N01 -------------------------------------------------------------------------
def layout_info(form: Column) -> Column:
    """First page's width/height (0 when absent) and the paragraphs with
    their polygons."""
    first = F.try_element_at(F.coalesce(form["pages"], F.array().cast("array<struct<width:double,height:double>>")), F.lit(1))
    paras = F.transform(F.coalesce(form["paragraphs"], F.array().cast(f"array<{PARAGRAPH}>")),
                        lambda p: F.struct(p["content"].alias("content"),
                                           F.coalesce(p["bounding_regions"], F.array().cast(f"array<{REGION}>"))
                                           .alias("bounding_regions")))
    return F.struct(F.coalesce(first["width"], F.lit(0.0)).alias("page_width"),
                    F.coalesce(first["height"], F.lit(0.0)).alias("page_height"),
                    paras.alias("paragraphs"),
                    F.array().cast("array<string>").alias("lines"))


# N02 -------------------------------------------------------------------------
def tables(form: Column) -> Column:
    """Tables with dimensions and cells; spans default to 1, kind to 'content'."""
    def cell(c):
        return F.struct(c["content"].alias("content"), c["row_index"].alias("row_index"),
                        c["column_index"].alias("column_index"),
                        F.coalesce(c["row_span"], F.lit(1)).alias("row_span"),
                        F.coalesce(c["column_span"], F.lit(1)).alias("column_span"),
                        F.coalesce(c["kind"], F.lit("content")).alias("kind"))
    return F.transform(F.coalesce(form["tables"], F.array().cast(f"array<{TABLE}>")),
                       lambda t: F.struct(t["row_count"].alias("row_count"), t["column_count"].alias("column_count"),
                                          F.transform(F.coalesce(t["cells"], F.array().cast(f"array<{CELL}>")), cell)
                                          .alias("cells")))


def table_cells(df: DataFrame, keys, tables_col: str = "tables") -> DataFrame:
    """Long form: one row per cell with its table index (two explodes, narrow)."""
    keys = list(keys)
    t = df.select(*keys, F.posexplode(tables_col).alias("table_index", "t"))
    return t.select(*keys, "table_index", F.explode("t.cells").alias("c")).select(
        *keys, "table_index", "c.row_index", "c.column_index", "c.row_span", "c.column_span", "c.kind",
        "c.content")


# N03 -------------------------------------------------------------------------
def key_value_pairs(form: Column) -> Column:
    """Pairs with both a key and a value, as a map; a repeated key keeps its
    last value."""
    kv = F.filter(F.coalesce(form["key_value_pairs"], F.array().cast(f"array<{KV}>")),
                  lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    return F.map_from_entries(F.transform(kv, lambda p: F.struct(p["key"], p["value"])))


def key_value_rows(df: DataFrame, keys, kv_col: str = "key_value_pairs") -> DataFrame:
    keys = list(keys)
    return df.select(*keys, F.explode(kv_col).alias("key", "value"))


def extract_form(df: DataFrame, json_col: str = "form_json", table_extraction: bool = True,
                 key_value_extraction: bool = True, advanced: bool = True) -> DataFrame:
    """N01-N03 with the P09 feature flags: a switched-off part is an empty
    value (and its parsing is pruned from the plan)."""
    form = parse_form(F.col(json_col))
    empty_layout = F.struct(F.lit(0.0).alias("page_width"), F.lit(0.0).alias("page_height"),
                            F.array().cast(f"array<{PARAGRAPH}>").alias("paragraphs"),
                            F.array().cast("array<string>").alias("lines"))
    lay = layout_info(form) if advanced else empty_layout
    tab = tables(form) if (advanced and table_extraction) else F.array().cast(f"array<{TABLE}>")
    kvs = key_value_pairs(form) if (advanced and key_value_extraction) else F.create_map().cast("map<string,string>")
    return df.select("*", lay.alias("layout"), tab.alias("tables"), kvs.alias("key_value_pairs"))
