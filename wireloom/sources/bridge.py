"""Star-schema tables seen as netlists, so that the netlist operators run at any scale.

A part is a component (class: its type, subsystem: its brand), an order a net, a distinct (order, part) a terminal, and
consecutive terminals of a net are joined by a wire.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Line items that one task deals by net, so that what it holds does not grow with the table.
ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(items: DataFrame, rows: int | None = None) -> int:
    """Tasks that items are dealt to, so that each gets about so many of them, else ``ROWS``."""
    return -(-items.count() // (rows or ROWS)) or 1


def terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, part, net)."""
    items = table(spark, sf_dir, "lineitem")
    rows = items.select(F.col("l_orderkey").alias("net"), F.col("l_partkey").alias("part")).repartition(tasks(items), "net").distinct()  # the distinct and what follows by net share one exchange
    return rows.select(F.concat_ws(":", F.col("part").cast("string"), F.col("net").cast("string")).alias("id"), "part", "net")


def wires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(net, from_part, to_part): one task for each net's terminals, not for each net."""
    order = Window.partitionBy("net").orderBy("part")
    return terminals(spark, sf_dir).withColumn("to_part", F.lead("part").over(order)).filter("to_part IS NOT NULL").select("net", F.col("part").alias("from_part"), "to_part")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y, label) in the plane, from the first two components of each vector."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"), "label")


def net_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): orders and parts of all terminals, as vertices o and -1 - p; keys begin at 0, so -p would meet order 0."""
    return terminals(spark, sf_dir).select(F.col("net").alias("a"), (-1 - F.col("part")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")


def sheet_terminals(spark: SparkSession, sf_dir: str, component: str) -> DataFrame:
    """(sheet, component, at, urgency, first): a customer is a sheet, this column of part a component, an order a net.

    A row for each component and order of a sheet.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col(component).alias("component"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("sheet"), F.col("o_orderpriority").alias("urgency"))
    return items.join(parts, "l_partkey").join(orders, "l_orderkey").select("sheet", "component", F.col("l_orderkey").alias("at"), "urgency").distinct()


# Which pins a component has, by the remainder of its brand's number, in the order of its nets.
RELAY_PINS = {0: "A1 A2 11 14 21 24", 1: "A1 11 12 A2 21 22", 2: "1 4", 3: "1 2", 4: "11 14 A1 A2 21 22"}
RELAY_CLASSES = {0: "relay", 1: "relay", 2: "push_button", 3: "circuit_breaker", 4: "relay"}


def relay_sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A sheet of relays, buttons and breakers for each customer: brands are components, orders nets.

    Urgent orders are all the source, low ones all the return.  A brand's nets, by their first order, are its pins.
    """
    brand = F.regexp_extract("component", r"(\d+)$", 1).cast("int")
    net = F.when(F.col("urgency") == "1-URGENT", "24E-1").when(F.col("urgency") == "5-LOW", "0V").otherwise(F.col("at").cast("string"))
    rows = sheet_terminals(spark, sf_dir, "p_brand").select("sheet", brand.alias("brand"), net.alias("net"), "at").groupBy("sheet", "brand", "net").agg(F.min("at").alias("at"))
    most = max(len(p.split()) for p in RELAY_PINS.values())
    place = F.row_number().over(Window.partitionBy("sheet", "brand").orderBy("at"))
    rows = rows.withColumn("place", place).filter(F.col("place") <= most)
    pins = F.element_at(F.create_map(*[F.lit(x) for k, p in RELAY_PINS.items() for x in (k, p)]), F.col("brand") % 5)
    own = lambda c: F.concat_ws("#", F.col("sheet").cast("string"), c)
    component = own(F.col("brand").cast("string"))
    rows = rows.withColumn("pin", F.get(F.split(pins, " "), F.col("place") - 1)).filter("pin IS NOT NULL")
    # made once: each device's pairs of terminals read it again
    terminals_ = cut(rows.select(F.concat_ws(":", component, "pin").alias("id"), component.alias("parent_component"), own(F.col("net")).alias("net"), "sheet", "brand"), "relay-terminals")
    kind = F.element_at(F.create_map(*[F.lit(x) for k, c in RELAY_CLASSES.items() for x in (k, c)]), F.col("brand") % 5)
    return {
        "terminals": terminals_, "nets": terminals_.select(F.col("net").alias("id")).distinct(),
        "components": terminals_.select(F.col("parent_component").alias("id"), kind.alias("class"), "sheet", "brand").distinct(),
    }


def relay_settings(netlist: dict[str, DataFrame], scenarios: int) -> tuple[DataFrame, DataFrame]:
    """Masks (block, live) and (block, component, opened): in scenario s a switch is open if (7 brand + sheet + s(s + 1)) % 5 > 2."""
    spark = netlist["components"].sparkSession
    blocks = [(b, (1 << min(64, scenarios - 64 * b)) - 1) for b in range(-(-scenarios // 64))]
    live = spark.createDataFrame([(b, m - (1 << 64) if m >> 63 else m) for b, m in blocks], "block long, live long")
    s = lambda j: F.col("block") * 64 + j
    is_open = lambda j: (F.col("brand") * 7 + F.col("sheet") + s(j) * (s(j) + 1)) % 5 > 2
    bit = lambda j: F.when(is_open(j), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(F.lit(0).cast("long"))
    hand = netlist["components"].filter("class IN ('push_button', 'circuit_breaker')").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(len(blocks) - 1))))
    opened = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, j: a.bitwiseOR(bit(j)))
    return live, hand.select(F.col("block").cast("long").alias("block"), F.col("id").alias("component"), opened.alias("opened"))


def breaker_sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A sheet of breakers for each customer: a size of part joins the nets of its orders, one after another.

    Urgent orders are ``sources`` (net); each pair of a size's consecutive orders is a breaker named by the first one.
    """
    # rows and breakers are made once, as several steps read each again
    rows = cut(sheet_terminals(spark, sf_dir, "p_size"), "breaker-rows")
    lead = F.lead("at").over(Window.partitionBy("sheet", "component").orderBy("at"))
    name = F.concat(F.concat_ws("#", F.col("sheet").cast("string"), F.col("component").cast("string")), F.lit("-"), F.col("at").cast("string"))
    pairs = rows.select("sheet", "component", "at").withColumn("net_2", lead).filter("net_2 IS NOT NULL")
    breakers = cut(pairs.select(name.alias("id"), F.col("at").alias("net_1"), "net_2"), "breakers")
    pins = F.explode(F.array(F.struct(F.lit("1").alias("pin"), F.col("net_1").alias("net")), F.struct(F.lit("2").alias("pin"), F.col("net_2").alias("net")))).alias("p")
    ends = breakers.select("id", pins).select(F.concat_ws(":", "id", "p.pin").alias("id"), F.col("id").alias("parent_component"), F.col("p.net").cast("string").alias("net"))
    return {
        "components": breakers.select("id", F.lit("circuit_breaker").alias("class")), "terminals": ends,
        "relationships": spark.createDataFrame([], "type string, src string, tgt string"),
        "sources": rows.filter("urgency = '1-URGENT'").select(F.col("at").cast("string").alias("net")).distinct(),
    }
