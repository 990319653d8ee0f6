"""Readers and writers of geometry, netlist and graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType

from ..plans.netlist import sheeted
from . import snapshots

#: A netlist document: one JSON object with a list for each table.
NETLIST = """
drawing struct<drawing_number:string,revision:string,title:string,date:string,assembly:string,proprietary_notice:string,references:array<string>,notes:array<string>>,
components array<struct<id:string,class:string,description:string,ratings:map<string,string>,function:string,power_domain:string,normal_state:string,location:struct<x:double,y:double,zone:string>,part_number:string,manufacturer:string,aliases:array<string>>>,
terminals array<struct<id:string,parent_component:string,function:string,net:string,description:string>>,
nets array<struct<id:string,signal_type:string,nominal_voltage:string,member_terminals:array<string>,description:string>>,
wires array<struct<id:string,color:string,gauge:string,from_terminal:string,to_terminal:string,cable:string,net:string,description:string>>,
cables array<struct<id:string,description:string,member_wires:array<string>>>,
subsystems array<struct<id:string,description:string,member_components:array<string>>>,
relationships array<struct<type:string,src:string,tgt:string,description:string,properties:map<string,string>,weight:double>>
"""
TABLES = ("components", "terminals", "nets", "wires", "cables", "subsystems", "relationships")


def read_netlist(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """The tables of netlist documents, each row with its drawing_no and its place in the list.

    A file holds one document, or, with lines, a document in each line, as ``write_netlist`` writes them.  Where the
    ids of sheets clash, ``netlist.qualified`` tells them apart.
    """
    docs = spark.read.schema(NETLIST).json(path, multiLine=not lines)
    number = F.col("drawing.drawing_number").alias("drawing_no")
    out = {"drawing": docs.select("drawing.*")}
    pairs = lambda c: F.coalesce(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))
    for name in TABLES:
        rows = docs.select(number, F.posexplode(name).alias("ord", "r")).select("drawing_no", "r.*", (F.col("ord") + 1).alias("ord"))
        for c in ("ratings", "properties"):
            if c in rows.columns:
                rows = rows.withColumn(c, pairs(c))
        if name == "components":
            rows = rows.withColumn("zone", F.col("location.zone"))
        if name == "relationships":
            rows = rows.withColumn("section", F.lit(0))
        out[name] = rows
    return out


def write_netlist(netlist: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """A JSON document in each line for each sheet, which ``read_netlist`` reads back; a sheet's rows are gathered, sheets are not."""
    netlist = sheeted(netlist)
    kinds = {f.name: f.dataType for f in StructType.fromDDL(NETLIST)}
    docs = netlist["drawing"].select("drawing_no", F.struct(*[_field(netlist["drawing"], f) for f in kinds["drawing"]]).alias("drawing"))
    before = lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)  # noqa: E731  rows hold maps, which have no order
    for name in TABLES:
        df = netlist[name]
        order = [c for c in ("section", "ord", "id", "type", "src", "tgt") if c in df.columns]
        row = F.struct(*[_field(df, f) for f in kinds[name].elementType])
        held = df.groupBy(F.col("drawing_no").alias("of")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), row.alias("row"))), before), lambda x: x["row"]).alias(name))
        docs = docs.join(held, F.col("of") == F.col("drawing_no"), "left").drop("of").withColumn(name, F.coalesce(name, F.array().cast(kinds[name])))
    docs.drop("drawing_no").write.mode(mode).json(path)


def _field(df: DataFrame, field: StructField) -> Column:
    """A document's field from a table's column of that name, or null."""
    if field.name == "location" and "location" not in df.columns and "zone" in df.columns:
        return F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.col("zone").alias("zone")).alias("location")
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType).alias(field.name)
    value = F.col(field.name)
    if isinstance(field.dataType, MapType) and isinstance(df.schema[field.name].dataType, ArrayType):
        value = F.map_from_entries(F.transform(value, lambda p: F.struct(p["k"], p["v"])))
    return value.cast(field.dataType).alias(field.name)


def write_geometry(tables: dict[str, DataFrame], path: str, mode: str = "error", only_counts: bool = False) -> None:
    """The tables of the geometry layer as Parquet by page; only_counts leaves out all but the counters and parameters."""
    for name, df in tables.items():
        if not only_counts or name in ("counters", "params"):
            writer = df.write.mode(mode)
            (writer.partitionBy("page") if "page" in df.columns else writer).parquet(f"{path}/{name}")


def read_geometry(spark: SparkSession, path: str, name: str, page: int | None = None) -> DataFrame:
    """One table of a written geometry layer; a page is pruned at the scan."""
    df = spark.read.parquet(f"{path}/{name}")
    return df if page is None else df.filter(F.col("page") == page)


def read_primitives(spark: SparkSession, path: str, page: int | None = None) -> DataFrame:
    """Drawing primitives written as Parquet; a page is pruned at the scan."""
    df = spark.read.parquet(path)
    return df if page is None else df.filter(F.col("page") == page)


def primitives_from_groups(groups: DataFrame) -> DataFrame:
    """Primitives from drawing groups (page, group_id, layer, items array<struct<op,x0,y0,x1,y1>>, group_x0 .. group_y1)."""
    return groups.select("page", "group_id", "layer", F.posexplode("items").alias("item", "i"), "group_x0", "group_y0", "group_x1", "group_y1").select("page", "group_id", "item", "layer", "i.*", "group_x0", "group_y0", "group_x1", "group_y1")


def page_geometry(spark: SparkSession, path: str, page: int, schema: str) -> DataFrame:
    """One page of a geometry document, which is a JSON object with a list of pages."""
    return spark.read.schema(f"pages array<struct<page:int,{schema}>>").json(path, multiLine=True).select(F.explode("pages").alias("p")).select("p.*").filter(F.col("page") == page)


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables of a graph's last commit; relationships without keywords or tables without their columns are an error."""
    need = {"chunks": {"content", "source_id"}, "entities": {"entity_name", "entity_type", "source_id"}, "relationships": {"src_id", "tgt_id", "keywords", "source_id"}}
    graph = snapshots.tables(spark, path) or {name: spark.read.parquet(f"{path}/{name}") for name in need}  # or tables that were written one by one
    for name, columns in need.items():
        if lacking := columns - set(graph[name].columns):
            raise ValueError(f"{name} lacks {sorted(lacking)}")
    if not graph["relationships"].filter("keywords IS NULL").isEmpty():
        raise ValueError("there are relationships without keywords")
    return graph
