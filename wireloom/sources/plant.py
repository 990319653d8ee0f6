"""The star-schema tables as the authored netlist of many sheets, with the faults that a reviewer looks for.

A market segment and nation is a sheet, an order of its customers a net, a customer a cable.  The parts of a sheet's
orders are its components, each (order, part) is a terminal, and consecutive terminals of a net are joined by a wire.
Ids are those of a sheet, so they clash between sheets; ``netlist.qualified`` tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut
from .bridge import table, tasks

#: A component's class, by the remainder of its part's size.
CLASSES = ["relay", "circuit_breaker", "push_button", "external_drawing", "external_machine", "power_supply", "terminal_block", "ground"]
#: Every so many-th order is on no net; of every so many, one's wires end at no terminal and one's name another net.
BARE, FAULTY, UNLISTED = 10, 50, 97
#: Line items of a task.
DEALT = 50_000


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _named(letter: str, c: Column | str) -> Column:
    return F.concat(F.lit(letter), _text(c))


def authored(spark: SparkSession, sf_dir: str, once: bool = True) -> dict[str, DataFrame]:
    """The authored tables, as ``netlist.derive`` takes them, with drawing_no in each.

    The rows of orders and parts that they are made of are written once, unless they are read at most once.
    """
    sheet = F.concat("c_mktsegment", _text("c_nationkey")).alias("drawing_no")
    customers = table(spark, sf_dir, "customer").select("c_custkey", sheet)
    orders = table(spark, sf_dir, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    orders = orders.select("drawing_no", F.col("o_orderkey").alias("order"), "o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("power"))
    part = table(spark, sf_dir, "part").withColumn("class", F.get(F.array(*map(F.lit, CLASSES)), F.col("p_size") % len(CLASSES)))
    lead = F.when(F.col("order") % BARE > 0, F.lead("part").over(Window.partitionBy("order").orderBy("part")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("part"))
    items = rows.repartition(tasks(rows, DEALT), "order").distinct().join(orders, "order").withColumn("next", lead)
    if once:  # terminals, wires and components are all made of these rows, some of them many times
        items = cut(items, "plant-items")
    ord_ = (F.col("order") * 1_000_000 + F.col("part")).alias("ord")
    net = F.when(F.col("order") % BARE > 0, _named("N", "order"))
    terminals = items.select("drawing_no", _named("P", "part").alias("component"), _text("order").alias("terminal"), F.when(F.col("power"), "supply_in").alias("function"), net.alias("net"), ord_)

    joined = items.filter("next IS NOT NULL")
    end = lambda p: F.concat_ws(":", _named("P", p), _text("order"))
    wires = joined.select(
        "drawing_no", end("part").alias("from_terminal"), F.when(F.col("order") % FAULTY == 1, F.concat(_named("P", "next"), F.lit(":X"))).otherwise(end("next")).alias("to_terminal"),
        F.get(F.array(F.lit(None), F.lit("BLUE"), F.lit("RED")), (F.col("order") % 3).cast("int")).alias("color"), F.when(F.col("part") % 2 == 0, "16AWG").otherwise("18AWG").alias("gauge"),
        F.when(F.col("order") % FAULTY == 2, _named("N", F.col("order") + 1)).otherwise(_named("N", "order")).alias("net"), F.when(F.col("part") % 4 > 0, _named("C", "o_custkey")).alias("cable"), ord_,
    )

    rated = F.array(F.struct(F.lit("current").alias("k"), F.concat(_text("p_size"), F.lit("A")).alias("v")))
    none = F.array().cast("array<struct<k:string,v:string>>")
    own = items.select("drawing_no", "part").distinct().join(part, F.col("part") == F.col("p_partkey"))
    components = own.filter(F.col("part") % UNLISTED != 5).select(
        "drawing_no", _named("P", "part").alias("id"), "class", F.col("p_name").alias("description"), F.when(F.col("p_size") % 3 > 0, rated).otherwise(none).alias("ratings"),
        F.array("p_type").alias("aliases"), F.concat_ws("-", "p_type", _text("p_size")).alias("part_number"), F.col("p_brand").alias("power_domain"), F.col("part").alias("ord"),
    )
    sheets = orders.select("drawing_no").distinct()
    spare = sheets.select(
        "drawing_no", F.lit("SPARE").alias("id"), F.lit("ground").alias("class"), F.lit(None).cast("string").alias("description"), none.alias("ratings"), F.array().cast("array<string>").alias("aliases"),
        F.lit(None).cast("string").alias("part_number"), F.lit(None).cast("string").alias("power_domain"), F.lit(-1).cast("long").alias("ord"),
    )
    brand = F.regexp_extract("power_domain", r"(\d+)$", 1)
    groups = components.groupBy("drawing_no", brand.alias("brand")).agg(F.sort_array(F.collect_list("id")).alias("member_components"))

    cls = part.select(F.col("p_partkey").alias("part"), "class")
    after = cls.select(F.col("part").alias("next"), F.col("class").alias("next_class"))
    on = items.filter(F.col("order") % BARE > 0).join(cls, "part")
    pairs = joined.join(cls, "part").join(after, "next")
    edge = lambda df, kind, src, tgt: df.select("drawing_no", F.lit(kind).alias("type"), src.alias("src"), tgt.alias("tgt"), ord_)
    p, q, n = _named("P", "part"), _named("P", "next"), _named("N", "order")
    edges = edge(on.filter("power AND class = 'power_supply'"), "POWERS", p, n)
    edges = edges.union(edge(on.filter("power AND class = 'circuit_breaker'"), "PROTECTS", p, n))
    edges = edges.union(edge(on.filter("class = 'relay'"), "COIL_CONTROLS_CONTACT", p, end("part")))
    edges = edges.union(edge(pairs.filter("class IN ('push_button', 'external_machine') AND next_class = 'relay'"), "ACTUATES", p, q))
    edges = edges.union(edge(pairs.filter("next_class IN ('external_drawing', 'external_machine')"), "REFERENCES", p, q))
    return {
        "drawing": sheets.select("drawing_no", F.col("drawing_no").alias("drawing_number"), F.lit("A").alias("revision"), F.concat(F.lit("Sheet "), "drawing_no").alias("title"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("assembly"), F.array(F.reverse("drawing_no")).alias("references"), F.array(F.lit("As built.")).alias("notes")),
        "components": components.union(spare), "terminals": terminals,
        "nets": orders.select("drawing_no", _named("N", "order").alias("id"), F.when(F.col("power"), "power").otherwise("signal").alias("signal_type"), F.when(F.col("power"), "24V").alias("nominal_voltage"), F.col("order").alias("ord")),
        "wires": wires, "cables": customers.select("drawing_no", _named("C", "c_custkey").alias("id"), F.col("c_custkey").alias("ord")),
        "subsystems": groups.select("drawing_no", _named("S", "brand").alias("id"), "member_components", F.col("brand").cast("long").alias("ord")), "edges": edges,
    }
