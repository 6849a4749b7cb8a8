"""Inputs of the registered queries.

The given tables hold no missing cell, blank or repeated row, so the rules are run on
views that damage whole tables by a rule on their keys.  The expressions are valid in
Spark SQL and in DuckDB alike, and both sides of a comparison use the same text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prevuelo.sources.frames import Frame, from_table

TABLES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


@dataclass(frozen=True)
class View:
    """``source`` (a FROM clause), the dataset (a name, or an expression) and the cells by header."""

    source: str
    dataset: str
    cells: dict[str, str]
    many: bool = False  # ``dataset`` is an expression
    pos: str = "0"

    @property
    def dataset_sql(self) -> str:
        return self.dataset if self.many else f"'{self.dataset}'"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def plain(table: str, columns: list[str] | None = None, dataset: str | None = None, pos: str = "0") -> View:
    """A table as it is, every cell as text."""
    return View(table, dataset or table, {c: text(c) for c in columns or TABLES[table]}, pos=pos)


_DAY = text("o_orderdate")
_Y, _M, _D = f"substr({_DAY}, 1, 4)", f"substr({_DAY}, 6, 2)", f"substr({_DAY}, 9, 2)"

# Dates in valid and invalid layouts, mixed types, missing and blank cells.
DIRTY_ORDERS = View(
    "orders",
    "orders_dirty",
    {
        "order_id": text("o_orderkey"),
        "customer_ref": f"CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE {text('o_custkey')} END",
        "status": "CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '   ' ELSE o_orderstatus END",
        "total": text("o_totalprice"),
        "updated_at": f"CASE o_orderkey % 7 WHEN 0 THEN {_Y} || '-' || {_M} || '-' || {_D}"
        f" WHEN 1 THEN {_D} || '/' || {_M} || '/' || {_Y} WHEN 2 THEN {_D} || '-' || {_M} || '-' || {_Y}"
        f" WHEN 3 THEN {_Y} || '-13-01' WHEN 4 THEN '30/02/' || {_Y} WHEN 5 THEN {_DAY}"
        f" ELSE {_Y} || '-02-30' END",
        "created_at": f"CASE o_orderkey % 3 WHEN 0 THEN {_Y} || '-' || {_M} || '-' || {_D} || 'T10:00:00Z'"
        f" WHEN 1 THEN ' ' || {_Y} || '-' || {_M} || '-' || {_D} || ' ' ELSE {_Y} || '-' || {_M} || '-' || {_D} END",
        "priority": "CASE o_orderkey % 9 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN '12.50' WHEN 3 THEN '-7'"
        " WHEN 4 THEN '+5' WHEN 5 THEN '1e5' WHEN 6 THEN ' 42' ELSE o_orderpriority END",
    },
    pos="o_orderkey",
)

# Blank rows, and repeated rows of few columns.
DIRTY_PART = View(
    "part",
    "part_dirty",
    {
        "name": "CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 50 = 7 THEN ' ' ELSE p_name END",
        "brand": "CASE WHEN p_partkey % 50 = 0 THEN '' WHEN p_partkey % 50 = 7 THEN NULL"
        " WHEN p_partkey % 6 = 1 THEN NULL WHEN p_partkey % 6 = 2 THEN '' ELSE p_brand END",
    },
    pos="p_partkey",
)

# One dataset per supplier, each damaged to a different degree.
_SHIP = text("l_shipdate")
SUPPLIERS = View(
    "lineitem",
    "'supplier-' || CAST(l_suppkey AS STRING)",
    {
        "l_orderkey": text("l_orderkey"),
        "line_id": f"{text('l_orderkey')} || '-' || {text('l_linenumber')} || '-' || {text('l_partkey')}",
        "l_quantity": text("l_quantity"),
        "l_returnflag": "CASE WHEN (l_orderkey + l_linenumber) % 40 < l_suppkey % 12 THEN NULL ELSE l_returnflag END",
        "l_linestatus": "CASE WHEN l_partkey % 30 < l_suppkey % 7 THEN '  ' ELSE l_linestatus END",
        "last_update": f"CASE WHEN l_orderkey % 25 < l_suppkey % 5 THEN substr({_SHIP}, 1, 4) || '-13-01'"
        f" ELSE substr({_SHIP}, 1, 10) END",
    },
    many=True,
    pos="l_orderkey",
)

# Repeated rows split by supplier: few columns, many copies.
SUPPLIER_FLAGS = View(
    "lineitem",
    "'supplier-' || CAST(l_suppkey AS STRING)",
    {"returnflag": "l_returnflag", "linestatus": "l_linestatus", "linenumber": text("l_linenumber")},
    many=True,
)

# Natural gaps: documents without a label.
LABELLED = View(
    "documents LEFT JOIN labels ON documents.doc_id = labels.doc_id",
    "labelled",
    {"doc_id": text("documents.doc_id"), "quality": text("quality"), "toxic": text("toxic")},
)

ALL_TABLES = [plain(t) for t in TABLES]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frame(spark: SparkSession, sf_dir: str, view: View) -> Frame:
    """The view as a frame of the audit."""
    for table in [t for t in TABLES if t in view.source.split()]:
        load(spark, sf_dir, table).createOrReplaceTempView(table)
    cells = ", ".join(f"{expr} AS `{header}`" for header, expr in view.cells.items())
    df = spark.sql(f"SELECT {view.dataset_sql} AS ds, {view.pos} AS at, {cells} FROM {view.source}")
    return from_table(df, F.col("ds") if view.many else view.dataset, F.col("at"), list(view.cells))
