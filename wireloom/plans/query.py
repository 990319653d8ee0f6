"""Questions about a netlist: every answer carries the ids it rests on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bridges import cut_off
from ..operators.components import components
from ..operators.paths import trace
from ..shared import Tables, walk

EXTERNAL = ("external_drawing", "external_machine")


def metadata(netlist: dict[str, DataFrame]) -> DataFrame:
    """(field, value) of a drawing; with drawing_no, where the netlist has it, of each drawing."""
    d = netlist["drawing"]
    own = ["drawing_no"] if "drawing_no" in d.columns else []
    flat = d.select(*own, F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value")) for k in ("drawing_number", "revision", "title", "date", "assembly")])).alias("x")).select(*own, "x.*")
    for name, field in (("references", "reference"), ("notes", "note")):
        flat = flat.union(d.select(*own, F.lit(field), F.explode(name)))
    return flat


def inventory(netlist: dict[str, DataFrame]) -> DataFrame:
    return netlist["components"].groupBy("class").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("ids"))


def attribute(netlist: dict[str, DataFrame], name: str) -> DataFrame:
    """(id, value) of a rating."""
    return netlist["components"].select("id", F.explode("ratings").alias("r")).filter(F.col("r.k") == name).select("id", F.col("r.v").alias("value"))


def net_explorer(netlist: dict[str, DataFrame], net: str | None = None) -> DataFrame:
    """(net, kind, id, component) of the wires and terminals of a net, or of all nets."""
    asked = F.col("net").isNotNull() if net is None else F.col("net") == net
    wires = netlist["wires"].filter(asked).select("net", F.lit("wire").alias("kind"), "id", F.lit(None).cast("string").alias("component"))
    return wires.union(netlist["terminals"].filter(asked).select("net", F.lit("terminal"), "id", "parent_component"))


def _part(terminal: Column) -> Column:
    return F.regexp_extract(terminal, r"^(.*?):", 1)


def wires_at(netlist: dict[str, DataFrame], component: str | None = None) -> DataFrame:
    """The wires that end at a component; or, with ``component`` before their columns, at each."""
    if component is None:
        w = netlist["wires"].drop("ord")
        ends = F.array_distinct(F.array(_part(F.col("from_terminal")), _part(F.col("to_terminal"))))
        return w.select(F.explode(ends).alias("component"), *w.columns).filter("component <> ''")
    return netlist["wires"].filter((_part(F.col("from_terminal")) == component) | (_part(F.col("to_terminal")) == component)).drop("ord")


def pin_out(netlist: dict[str, DataFrame], component: str) -> DataFrame:
    """(terminal, net, other): each terminal of a component and what shares its net."""
    t = netlist["terminals"]
    own = t.filter(F.col("parent_component") == component).select(F.col("id").alias("terminal"), F.col("net").alias("own_net"))
    return own.join(t, (F.col("net") == F.col("own_net")) & (F.col("id") != F.col("terminal")), "left").select("terminal", F.col("own_net").alias("net"), F.col("id").alias("other"))


def shared_nets(netlist: dict[str, DataFrame], one: str, two: str) -> DataFrame:
    t = netlist["terminals"].filter("net IS NOT NULL")
    a = t.filter(F.col("parent_component") == one).select("net", F.col("id").alias("terminal_1"))
    return a.join(t.filter(F.col("parent_component") == two).select("net", F.col("id").alias("terminal_2")), "net")


def shared_by_pairs(netlist: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """pairs (one, two) of components with each net that both are on: (one, two, net, terminal_1, terminal_2).

    The terminals of the first meet those of the second by (component, net), so no net's terminals meet each other.
    """
    t = netlist["terminals"].filter("net IS NOT NULL").select("parent_component", "net", "id")
    first = pairs.join(t.select(F.col("parent_component").alias("one"), "net", F.col("id").alias("terminal_1")), "one")
    return first.join(t.select(F.col("parent_component").alias("two"), "net", F.col("id").alias("terminal_2")), ["two", "net"]).select("one", "two", "net", "terminal_1", "terminal_2")


def power_domains(netlist: dict[str, DataFrame]) -> DataFrame:
    return netlist["components"].groupBy("power_domain").agg(F.count("*").alias("n"))


def loses_power(netlist: dict[str, DataFrame], breaker: str) -> DataFrame:
    """(component, net) on the power nets that a breaker protects, itself or through supplies that it feeds.

    A supply on a net that is lost, which it does not power itself, loses its own nets too, and so on.
    """
    tables = Tables(netlist["terminals"].sparkSession)
    r = netlist["relationships"]
    powers = r.filter("type = 'POWERS'").select("src", "tgt")
    on = netlist["terminals"].filter("net IS NOT NULL").select("parent_component", "net").distinct()
    feeds = on.join(powers, F.col("src") == F.col("parent_component")).select("net", "src", "tgt")
    fed = feeds.join(powers.select(F.col("src").alias("s"), F.col("tgt").alias("t")), (F.col("s") == F.col("src")) & (F.col("t") == F.col("net")), "left_anti").select("net", "tgt")
    # from anything lost to what it powers: a supply to its nets, a net to the nets of supplies that live on it
    onward = tables.cut(powers.select(F.col("src").alias("from"), "tgt").union(fed).distinct(), "onward")
    new = tables.cut(r.filter((F.col("type") == "PROTECTS") & (F.col("src") == breaker)).select(F.col("tgt").alias("at")).distinct(), "round-0")
    lost, grown, turn = new, 1, 0
    while grown:
        turn += 1
        new = onward.join(new, F.col("from") == F.col("at"), "left_semi").select(F.col("tgt").alias("at")).distinct()
        new, grown = tables.counted(new.join(lost, "at", "left_anti"), f"round-{turn}", F.lit(True))
        lost = lost.union(new)
    nets = netlist["nets"].filter("signal_type = 'power'").select(F.col("id").alias("at")).join(lost, "at", "left_semi")
    return netlist["terminals"].join(nets, F.col("net") == F.col("at"), "left_semi").select(F.col("parent_component").alias("component"), "net").distinct()


def breaker_impact(netlist: dict[str, DataFrame], sources: DataFrame) -> DataFrame:
    """(component, switch, lost_nets, lost_terminals) of each hand switch: what has no way to sources (net) with it open.

    Nets are joined by hand switches, and by supplies from the nets that they live on to those that they power.
    Everything is found in one pass over all switches; those that cut nothing off have zeros.
    """
    from .simulate import switch_edges

    hand = switch_edges(netlist).filter("hand").select("component", "switch", "net_1", "net_2")
    powers = netlist["relationships"].filter("type = 'POWERS'").select("src", "tgt")
    on = netlist["terminals"].filter("net IS NOT NULL").select(F.col("parent_component").alias("src"), "net").distinct()
    supply = on.join(powers, "src").filter("net <> tgt").select(F.concat_ws(" ", F.lit("supply"), "src", "net", "tgt").alias("edge"), F.col("net").alias("a"), F.col("tgt").alias("b"))
    edges = hand.select(F.concat_ws(" ", F.lit("switch"), "switch").alias("edge"), F.col("net_1").alias("a"), F.col("net_2").alias("b")).union(supply)
    weights = netlist["terminals"].filter("net IS NOT NULL").groupBy(F.col("net").alias("vertex")).agg(F.count("*").alias("weight"))
    losses = cut_off(edges, sources.select(F.col("net").alias("vertex")), weights)["losses"]
    every = hand.join(losses, F.concat_ws(" ", F.lit("switch"), "switch") == F.col("edge"), "left")
    none = F.lit(0).cast("long")
    return every.select("component", "switch", F.coalesce("lost_vertices", none).alias("lost_nets"), F.coalesce("lost_weight", none).alias("lost_terminals"))


def actuation(netlist: dict[str, DataFrame]) -> DataFrame:
    """(device, relay, contact, status): what switches a relay and what its coil moves; off-page devices are undetermined."""
    r, c = netlist["relationships"], netlist["components"]
    acts = r.filter("type = 'ACTUATES'").select(F.col("src").alias("device"), F.col("tgt").alias("relay"))
    moves = r.filter("type = 'COIL_CONTROLS_CONTACT'").select(F.col("src").alias("relay"), F.col("tgt").alias("contact"))
    outside = c.filter(F.col("class").isin(*EXTERNAL)).select(F.col("id").alias("outside"))
    both = acts.join(moves, "relay", "left").join(outside, F.col("outside") == F.col("device"), "left")
    return both.select("device", "relay", "contact", F.when(F.col("outside").isNotNull(), "undetermined").otherwise("shown").alias("status"))


def boundary_nets(netlist: dict[str, DataFrame]) -> DataFrame:
    """(net, interface, beyond): nets that leave the sheet."""
    out = netlist["components"].filter(F.col("class").isin(*EXTERNAL)).select(F.col("id").alias("beyond"))
    leads = netlist["relationships"].filter("type = 'REFERENCES'").join(out, F.col("beyond") == F.col("tgt")).select(F.col("src").alias("interface"), "beyond")
    return netlist["terminals"].filter("net IS NOT NULL").join(leads, F.col("interface") == F.col("parent_component")).select("net", "interface", "beyond").distinct()


def cables(netlist: dict[str, DataFrame]) -> DataFrame:
    return netlist["wires"].filter("cable IS NOT NULL").groupBy("cable").agg(F.count("*").alias("wires"), F.array_join(F.array_sort(F.collect_set("gauge")), ", ").alias("gauges"))


def subsystems(netlist: dict[str, DataFrame]) -> DataFrame:
    return netlist["relationships"].filter("type = 'PART_OF'").groupBy(F.col("tgt").alias("subsystem")).agg(F.count("*").alias("n"))


def bill_of_materials(netlist: dict[str, DataFrame]) -> DataFrame:
    return netlist["components"].filter(~F.col("class").isin(*EXTERNAL)).groupBy("class", "part_number").agg(F.count("*").alias("quantity"))


def wire_labels(netlist: dict[str, DataFrame]) -> DataFrame:
    """A row for each end of each wire, as it is pulled and labelled."""
    w = netlist["wires"]
    end = F.explode(F.array(F.struct(F.lit(1).alias("end"), F.col("from_terminal").alias("terminal")), F.struct(F.lit(2).alias("end"), F.col("to_terminal").alias("terminal")))).alias("e")
    return w.select("id", "color", "gauge", "net", "cable", end).select("id", "e.end", "e.terminal", "color", "gauge", "net", "cable")


def search(netlist: dict[str, DataFrame], text: str) -> DataFrame:
    """(kind, id) whose id, description or alias holds the text, in any case."""
    out = None
    for kind in ("components", "terminals", "nets", "wires", "cables", "subsystems"):
        df = netlist[kind]
        said = F.concat_ws(" ", "id", *[F.col(c) for c in ("description", "aliases") if c in df.columns])
        part = df.filter(F.contains(F.lower(said), F.lit(text.lower()))).select(F.lit(kind).alias("kind"), "id")
        out = part if out is None else out.union(part)
    return out


def counts(netlist: dict[str, DataFrame]) -> DataFrame:
    out = None
    for kind, df in netlist.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = part if out is None else out.union(part)
    return out


#: Terminals and wires of a net that one task holds.
HELD = 20_000


def _pieces_walk():
    """Terminals and wires of one net, joined as they come; (net, pieces) at its end, if it has terminals."""
    net, above, own = None, {}, set()

    def top(v):
        while (up := above.setdefault(v, v)) != v:
            above[v] = v = above[up]
        return v

    def step(row):
        nonlocal net
        if row is None:
            return [(net, len({top(v) for v in own}))] if own else []
        net, a, b = row
        if b is None:
            own.add(a)
        else:
            above[top(a)] = top(b)
        return []

    return step


def wire_fragments(netlist: dict[str, DataFrame]) -> DataFrame:
    """(net, pieces): components of a net's terminals over its wires alone; terminal blocks join what wires leave apart.

    A net of up to ``HELD`` terminals and wires is settled in the task that it is dealt to, larger ones by rounds of
    components.  Terminals without an id and wires without an end are left out.
    """
    tables = Tables(netlist["terminals"].sparkSession)
    t = netlist["terminals"].filter("net IS NOT NULL AND id IS NOT NULL").select("net", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    w = netlist["wires"].filter("net IS NOT NULL AND from_terminal IS NOT NULL AND to_terminal IS NOT NULL").select("net", "from_terminal", "to_terminal")
    rows = t.union(w)
    large, n = tables.counted(rows.groupBy("net").count().filter(F.col("count") > HELD).select("net"), "large", F.lit(True))
    small = rows.join(large, "net", "left_anti") if n else rows
    found = walk(small, ["net"], [], _pieces_walk, "net string, pieces long", pa.schema([("net", pa.string()), ("pieces", pa.int64())]))
    if not n:
        return found
    v = lambda c, name: F.xxhash64("net", c).alias(name)
    beyond = rows.join(large, "net", "left_semi")
    named = beyond.filter("b IS NULL").select("net", v("a", "v")).join(components(beyond.filter("b IS NOT NULL").select(v("a", "a"), v("b", "b")), tables), F.col("vertex") == F.col("v"), "left")
    return found.union(named.groupBy("net").agg(F.count_distinct(F.coalesce("component", "v")).alias("pieces")))


def path_status(netlist: dict[str, DataFrame], start: str, goal: str) -> DataFrame:
    """(start, goal, status): connected, undetermined or none.

    It is undetermined where switches don't join the nets on the sheet, but one of them leads to a net that leaves it.
    """
    from .simulate import switch_edges

    edges = switch_edges(netlist).select(F.xxhash64("net_1").alias("a"), F.xxhash64("net_2").alias("b"))
    nets = netlist["nets"].select("id", F.xxhash64("id").alias("v")).join(components(edges), F.col("vertex") == F.col("v"), "left").select("id", F.coalesce("component", "v").alias("group"))
    beyond = nets.join(boundary_nets(netlist).select(F.col("net").alias("id")).distinct(), "id", "left_semi").select("group").distinct().withColumn("leaves", F.lit(True))
    ends = nets.filter(F.col("id").isin(start, goal)).join(beyond, "group", "left")
    found = ends.agg(F.count_distinct("group").alias("groups"), F.count("*").alias("n"), F.bool_or(F.coalesce("leaves", F.lit(False))).alias("leaves"))
    status = F.when((F.col("groups") == 1) & (F.col("n") == (1 if start == goal else 2)), "connected").when(F.col("leaves"), "undetermined").otherwise("none")
    return found.select(F.lit(start).alias("start"), F.lit(goal).alias("goal"), status.alias("status"))


def path(netlist: dict[str, DataFrame], start: str, goal: str) -> DataFrame:
    """(step, at, via): a chain of nets from one net to another through switches and contacts.

    Nets are joined where one component has a switching pair of terminals on both; wires within nets are not steps.
    """
    from .simulate import switch_edges

    edges = switch_edges(netlist).select(F.col("net_1").alias("a"), F.col("net_2").alias("b"), F.col("switch").alias("via"))
    found = trace(edges, start, goal)  # one of the shortest paths, the first by name
    return found.select(F.posexplode("vertices").alias("step", "at"), "via").select("step", "at", F.get("via", F.col("step") - 1).alias("via"))
