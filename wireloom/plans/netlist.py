"""The netlist: terminals, nets, wires, cables and typed edges, derived from the authored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Between the number of a drawing and an id of it.
SHEET = "#"
#: Columns that hold ids, alone or in arrays.
IDS = ("id", "parent_component", "component", "net", "from_terminal", "to_terminal", "cable", "src", "tgt")
ID_LISTS = ("member_terminals", "member_wires", "member_components")


def sheeted(netlist: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The netlist with drawing_no in every table; tables without it must belong to one drawing."""
    out = {"drawing": netlist["drawing"].withColumn("drawing_no", F.col("drawing_number"))}
    bare = [name for name, df in netlist.items() if name != "drawing" and "drawing_no" not in df.columns]
    number = None
    if bare:
        rows = netlist["drawing"].select("drawing_number").limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{bare} have no drawing_no, and there is not one drawing")
        number = rows[0][0]
    return out | {name: df.withColumn("drawing_no", F.lit(number).cast("string")) if name in bare else df for name, df in netlist.items() if name != "drawing"}


def qualified(netlist: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The netlist of several sheets with each id as drawing#id, so that equal ids of different sheets never meet.

    Every derivation, check and question joins on ids, so it then holds for all sheets at once, sheet by sheet.
    """
    own = lambda c: F.concat(F.coalesce(F.col("drawing_no"), F.lit("")), F.lit(SHEET), c)  # noqa: E731  null ids stay null
    out = {}
    for name, df in sheeted(netlist).items():
        for c in df.columns:
            if c in IDS:
                df = df.withColumn(c, own(F.col(c)))
            elif c in ID_LISTS:
                df = df.withColumn(c, F.transform(F.col(c), own))
        out[name] = df
    return out


def bare(column: Column) -> Column:
    """An id without its drawing."""
    return F.substring_index(column, SHEET, -1)


def terminal_id(component: Column, terminal: Column) -> Column:
    return F.concat_ws(":", component, terminal)


def _listed(rows: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """(wireloom_key, name): the sorted members of each key among rows (key, member)."""
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("wireloom_key")).agg(F.sort_array(F.collect_list(member)).alias(name))


def members(groups: DataFrame, rows: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """groups (id, ...) with the sorted members among rows (key, member); groups without any keep an empty list."""
    listed = _listed(rows, key, member, name)
    return groups.join(listed, F.col("wireloom_key") == F.col("id"), "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("wireloom_key")


def wires_of(terminals: DataFrame) -> DataFrame:
    """Wires between consecutive terminals of a net, for netlists that list terminals only."""
    order = Window.partitionBy("net").orderBy("ord")
    return terminals.filter("net IS NOT NULL").withColumn("to_terminal", F.lead("id").over(order)).filter("to_terminal IS NOT NULL").select("net", F.col("id").alias("from_terminal"), "to_terminal", "ord")


def _sheet(df: DataFrame) -> list[str]:
    return ["drawing_no"] if "drawing_no" in df.columns else []


def _wire_id(wires: DataFrame) -> Column:
    """W and the wire's number; after its drawing where the ends are qualified."""
    own = F.when(F.col("ord") >= 100, F.concat(F.lit("W"), F.col("ord").cast("string"))).otherwise(F.format_string("W%03d", "ord"))
    return F.when(F.contains("from_terminal", F.lit(SHEET)), F.concat(F.substring_index("from_terminal", SHEET, 1), F.lit(SHEET), own)).otherwise(own)


def derive(authored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The eight tables of a netlist from its authored tables."""
    terminals = authored["terminals"].select(*_sheet(authored["terminals"]), terminal_id(F.col("component"), F.col("terminal")).alias("id"), F.col("component").alias("parent_component"), "function", "net", "ord")
    wires = authored["wires"].select(*_sheet(authored["wires"]), _wire_id(authored["wires"]).alias("id"), "color", "gauge", "from_terminal", "to_terminal", "cable", "net", "ord")
    nets = members(authored["nets"], terminals, "net", "id", "member_terminals")
    cables = members(authored["cables"], wires, "cable", "id", "member_wires")
    return {
        "drawing": authored["drawing"], "components": authored["components"], "terminals": terminals, "nets": nets, "wires": wires,
        "cables": cables, "subsystems": authored["subsystems"], "relationships": edges(authored, terminals, authored["nets"], wires),  # whose nets need no members
    }


def _edge(df: DataFrame, section: int, kind: str, src: str, tgt: str, description: Column, properties: dict[str, str] | None = None) -> DataFrame:
    kv = "array<struct<k:string,v:string>>"
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (properties or {}).items()]).cast(kv) if properties else F.array().cast(kv)
    return df.select(*_sheet(df), F.lit(section).alias("section"), "ord", F.lit(kind).alias("type"), F.col(src).alias("src"), F.col(tgt).alias("tgt"), description.alias("description"), pairs.alias("properties"), F.lit(1.0).alias("weight"))


def edges(authored: dict[str, DataFrame], terminals: DataFrame, nets: DataFrame, wires: DataFrame) -> DataFrame:
    """Typed edges in one order: terminals of components, terminals on nets, wires, parts of subsystems, authored edges."""
    has = terminals.join(authored["components"].select(F.col("id").alias("c")), F.col("c") == F.col("parent_component"))
    on = terminals.filter("net IS NOT NULL").join(nets.select(F.col("id").alias("n")), F.col("n") == F.col("net"))
    part = authored["subsystems"].select(*_sheet(authored["subsystems"]), F.col("id").alias("s"), "ord", F.posexplode("member_components").alias("at", "m")).withColumn("ord", F.col("ord") * 1000 + F.col("at"))
    own = authored["edges"]
    own = own.select(*_sheet(own), F.lit(5).alias("section"), "ord", "type", "src", "tgt", F.concat_ws(" ", "src", F.lower(F.replace("type", F.lit("_"), F.lit(" "))), F.concat("tgt", F.lit("."))).alias("description"), F.array().cast("array<struct<k:string,v:string>>").alias("properties"), F.lit(1.0).alias("weight"))
    text = F.concat_ws
    parts = [
        _edge(has, 1, "HAS_TERMINAL", "parent_component", "id", text(" ", "parent_component", F.lit("has terminal"), F.concat("id", F.lit("."))), {"function": "function"}),
        _edge(on, 2, "ON_NET", "id", "net", text(" ", F.lit("Terminal"), "id", F.lit("is on net"), F.concat("net", F.lit(".")))),
        _edge(wires, 3, "CONNECTS_TO", "from_terminal", "to_terminal", text(" ", F.lit("Wire"), "id", F.lit("joins"), "from_terminal", F.lit("and"), F.concat("to_terminal", F.lit("."))), {"wire": "id", "wire_color": "color", "wire_gauge": "gauge", "net": "net"}),
        _edge(part, 4, "PART_OF", "m", "s", text(" ", "m", F.lit("is part of"), F.concat("s", F.lit(".")))),
        own,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _dealt(rows: DataFrame, parts: int | None) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt by key, and the window of those with the same key.

    Ids of a sheet begin alike, which makes them slow to sort, so each task sorts them by a hash first.
    """
    rows = rows.repartition(parts, "key") if parts else rows.repartition("key")
    return rows.withColumn("hash", F.xxhash64("key")), Window.partitionBy("hash", "key")


def _ends_checked(t: DataFrame, w: DataFrame, parts: int | None) -> DataFrame:
    """(check, id) of the checks that hold wire ends against terminals.

    Both are dealt by terminal once, for all these checks; each row is judged by what else has its terminal.
    """
    ends = w.select(F.explode(F.array("from_terminal", "to_terminal")).alias("key"), F.lit(True).alias("is_end"), F.col("id").alias("wire"), "net")
    rows, own = _dealt(ends.union(t.select("id", F.lit(False), F.lit(None).cast("string"), "net")), parts)
    net = F.when(~F.col("is_end"), F.col("net"))
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("is_end"))).withColumns(
        {"ends": F.count_if("is_end").over(own), "terminals": F.count_if(F.col("key").isNotNull() & ~F.col("is_end")).over(own), "bare": F.count_if(~F.col("is_end") & F.col("net").isNull()).over(own), "low": F.min(net).over(own), "high": F.max(net).over(own)}
    )
    first = F.col("place") == 1  # speaks for its terminal
    apart = F.when(F.col("net").isNull(), F.col("low").isNotNull()).otherwise((F.col("bare") > 0) | (F.col("low") != F.col("net")) | (F.col("high") != F.col("net")))
    said = lambda when, check, c: F.when(when, F.struct(F.lit(check).alias("check"), F.col(c).alias("id")))
    found = F.array_compact(F.array(
        said(first & (F.col("ends") > 0) & (F.col("terminals") == 0), "wire end is no terminal", "key"),
        said(first & (F.col("ends") > 1), "terminal with several wires", "key"),
        said(first & (F.col("bare") > 0), "terminal without a net", "key"),
        said(F.col("is_end") & (F.col("terminals") > 0) & apart, "wire and end are on different nets", "wire"),
    ))
    return rows.select(F.explode(found).alias("found")).select("found.*")


def _components_checked(t: DataFrame, c: DataFrame, parts: int | None) -> DataFrame:
    """(check, id) of components without terminals and of terminals without a component, dealt by component once."""
    rows, own = _dealt(t.select(F.col("parent_component").alias("key"), F.lit(True).alias("is_terminal"), "id").union(c.select("id", F.lit(False), F.lit(None).cast("string"))), parts)
    other = F.when(F.col("is_terminal"), F.count_if(~F.col("is_terminal")).over(own)).otherwise(F.count_if("is_terminal").over(own))
    alone = rows.withColumn("other", other).filter("key IS NULL OR other = 0")
    return alone.select(F.when(F.col("is_terminal"), "terminal of an unknown component").otherwise("component without terminals").alias("check"), F.when(F.col("is_terminal"), F.col("id")).otherwise(F.col("key")).alias("id"))


def completeness(netlist: dict[str, DataFrame], parts: int | None = None) -> DataFrame:
    """(check, id): what a reviewer of a netlist has to look at; a clean netlist has no problems but may have notes.

    parts: of the shuffles that bring terminals together with wire ends and with components; else as the session has it.
    """
    t, n = netlist["terminals"], netlist["nets"]
    # nets' members are listed as derive() lists them, so the two can share a shuffle
    unknown = _listed(t, "net", "id", "ids").join(n.select(F.col("id").alias("n")), F.col("n") == F.col("wireloom_key"), "left_anti").select(F.lit("terminal on an unknown net"), F.explode("ids"))
    empty = n.filter(F.size("member_terminals") == 0).select(F.lit("net without members"), "id")
    return _ends_checked(t, netlist["wires"], parts).union(_components_checked(t, netlist["components"], parts)).union(unknown).union(empty).distinct()
