"""Relay logic to a fixpoint, 64 scenarios in a long: closed contacts join nets, joined nets energise coils.

A switch has a mask of the scenarios in which it is closed, a net one of those in which it is tied to the source and one
for the return, a coil one of those in which it is energised, so scenarios multiply no rows but for each further block of
64.  Nothing passes from sheet to sheet: a sheet of a bounded number of devices is settled in the task it is dealt to.
Larger ones run in rounds for all of them, where masks spread by joins on (block, net) of what a round added.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import Tables, walk
from .netlist import SHEET, bare

SOURCE, RETURN = "24E-1", "0V"
#: Blocks of 64 scenarios that one run takes: their masks are literals of its plans.
BLOCKS = 4096
#: Switches that masks pass in one job.
HOPS = 2
FULL = (1 << 64) - 1
#: Switches, coils and poles of a sheet in a block up to which one task settles it; larger sheets run in rounds.
HELD = 20_000


def _pairs(netlist: dict[str, DataFrame], ends: list[tuple[str, str, str]], name: str) -> DataFrame:
    """(component, switch, net_1, net_2) for pairs (class pattern, terminal, terminal) of a component's terminals."""
    t = netlist["terminals"].filter("net IS NOT NULL").select("parent_component", F.regexp_extract("id", r":(.*)$", 1).alias("pin"), "net")
    classes = netlist["components"].select(F.col("id").alias("component"), "class")
    rule = t.sparkSession.createDataFrame(ends, "rule_class string, pin_1 string, pin_2 string")
    own = classes.join(F.broadcast(rule), F.col("class") == F.col("rule_class"))
    one = t.select(F.col("parent_component").alias("component"), F.col("pin").alias("pin_1"), F.col("net").alias("net_1"))
    two = t.select(F.col("parent_component").alias("component"), F.col("pin").alias("pin_2"), F.col("net").alias("net_2"))
    return own.join(one, ["component", "pin_1"]).join(two, ["component", "pin_2"]).select("component", F.concat_ws(" ", "component", F.concat_ws("-", "pin_1", "pin_2")).alias(name), "pin_1", "pin_2", "net_1", "net_2")


# Which terminals a device joins.
SWITCHES = [("push_button", "1", "4"), ("circuit_breaker", "1", "2"), ("switch", "L1", "T1"), ("switch", "L3", "T3")]
CONTACTS = [("relay", f"{x}1", f"{x}{y}") for x in "12" for y in "24"]
COILS = [("relay", "A1", "A2")]


def switch_edges(netlist: dict[str, DataFrame]) -> DataFrame:
    """Hand switches (hand = true) and relay contacts, with their nets; x1-x4 closes and x1-x2 opens with the coil."""
    hand = _pairs(netlist, SWITCHES, "switch").select("component", "switch", "net_1", "net_2", F.lit(True).alias("hand"), F.lit(True).alias("when_on"))
    relay = _pairs(netlist, CONTACTS, "switch").select("component", "switch", "net_1", "net_2", F.lit(False).alias("hand"), F.endswith("pin_2", F.lit("4")).alias("when_on"))
    return hand.union(relay)


def scenarios(spark: SparkSession, devices: list[str]) -> DataFrame:
    """(scenario, component, closed): every setting of the devices."""
    n = len(devices)
    bits = F.transform(F.array(*map(F.lit, devices)), lambda d, k: F.struct(d.alias("component"), (F.call_function("shiftright", F.col("id"), k).bitwiseAND(F.lit(1)) == 1).alias("closed")))
    return spark.range(1 << n).select(F.col("id").alias("scenario"), F.explode(bits).alias("d")).select("scenario", "d.*")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def packed(settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """settings (scenario, component, closed) as (block, live) and (block, component, opened), masks of 64 scenarios."""
    own = settings.select(F.shiftright("scenario", 6).alias("block"), _bit(F.col("scenario").bitwiseAND(F.lit(63))).alias("bit"), "component", "closed")
    live = own.groupBy("block").agg(F.bit_or("bit").alias("live"))
    return live, own.filter("NOT closed").groupBy("block", "component").agg(F.bit_or("bit").alias("opened"))


def expanded(masks: DataFrame, live: str, *names: str) -> DataFrame:
    """A row for each scenario of live, with the bits of the named masks as booleans."""
    has = lambda c, j: F.call_function("shiftright", F.col(c), j).bitwiseAND(F.lit(1)) == 1
    rows = masks.withColumn("wireloom_bit", F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda j: has(live, j))))
    flags = [has(n, F.col("wireloom_bit")).alias(n) for n in names]
    kept = [c for c in masks.columns if c not in ("block", live, *names)]
    return rows.select((F.col("block") * 64 + F.col("wireloom_bit")).alias("scenario"), *kept, *flags)


def _hop(labels: DataFrame, closed: DataFrame) -> DataFrame:
    """labels (block, net, p, z, dp, dz) after what is new in them (dp, dz) has passed one switch."""
    new = labels.filter("dp <> 0 OR dz <> 0").join(closed, ["block", "net"])
    came = new.select("block", F.col("other").alias("net"), F.expr("dp & mask").alias("mp"), F.expr("dz & mask").alias("mz")).filter("mp <> 0 OR mz <> 0")
    none = F.lit(0).cast("long")
    both = labels.select("block", "net", "p", "z", none.alias("mp"), none.alias("mz")).union(came.select("block", "net", none, none, "mp", "mz"))
    met = both.groupBy("block", "net").agg(*[F.bit_or(c).alias(c) for c in ("p", "z", "mp", "mz")])
    return met.select("block", "net", F.expr("p | mp").alias("p"), F.expr("z | mz").alias("z"), F.expr("mp & ~p").alias("dp"), F.expr("mz & ~z").alias("dz"))


def _settled(devices: list[tuple], live: int) -> list[tuple]:
    """The nets, coils and oscillating scenarios of one sheet and block, by the rounds of ``simulate_masks``."""
    coils = [(c, a, b) for role, c, a, b, *_ in devices if role == "coil"]
    switches = [d[1:] for d in devices if d[0] == "switch"]
    start = {SOURCE: {}, RETURN: {}}
    for role, name, net, *_ in devices:
        if role == "pole":
            start[name][net] = live
    on, saved, done, turn = {}, {}, 0, 0
    while True:
        ways: dict[str, list[tuple[str, int]]] = {}
        for component, a, b, hand, when_on, opened in switches:
            lit_up = on.get(component, 0)
            mask = live & (~opened if hand else lit_up if when_on else ~lit_up)
            if mask:
                ways.setdefault(a, []).append((b, mask))
                ways.setdefault(b, []).append((a, mask))
        tied = {}
        for pole, nets in start.items():
            has, new = dict(nets), dict(nets)
            while new:
                net, bits = new.popitem()
                for other, mask in ways.get(net, ()):
                    if came := bits & mask & ~has.get(other, 0):
                        has[other] = has.get(other, 0) | came
                        new[other] = new.get(other, 0) | came
            tied[pole] = has
        p, z = tied[SOURCE], tied[RETURN]
        fed: dict[str, int] = {}
        for component, a, b in coils:
            fed[component] = fed.get(component, 0) | (p.get(a, 0) & z.get(b, 0)) | (z.get(a, 0) & p.get(b, 0))
        if turn & (turn - 1) == 0:
            saved = on
        changed = differ = 0
        for component, bits in fed.items():
            changed |= bits ^ on.get(component, 0)
            differ |= bits ^ saved.get(component, 0)
        on, turn, done = fed, turn + 1, done | (live & ~changed) | (live & ~differ)
        if done == live:
            break
    out = [("net", n, p.get(n, 0), z.get(n, 0)) for n in {**p, **z}]
    out += [("coil", c, bits, 0) for c, bits in on.items() if bits]
    return out + ([("oscillates", None, changed, 0)] if changed else [])


def _sheet_walk():
    at, devices = None, []

    def step(row):
        nonlocal at
        if row is not None:
            at = row[:3]
            devices.append(row[3:])
            return []
        block, sheet, live = at
        long = lambda m: m - (1 << 64) if m >> 63 else m
        # masks are without sign here, so that ~ and & keep to 64 bits
        mine = [(*d[:6], d[6] & FULL) for d in devices]
        return [(kind, block, sheet, name, long(x), long(y)) for kind, name, x, y in _settled(mine, live & FULL)]

    return step


def simulate(netlist: dict[str, DataFrame], settings: DataFrame) -> dict[str, DataFrame]:
    """``simulate_masks`` for settings (scenario, component, closed), scenario by scenario.

    nets (scenario, net, has24, has0), coils (scenario, component) that are energised, oscillating (scenario, sheet), and
    settled, whether the latter is empty.
    """
    masks = simulate_masks(netlist, *packed(settings))
    coils = expanded(masks["coils"].withColumn("energised", F.col("on")), "on", "energised").select("scenario", "component")
    oscillating = expanded(masks["oscillating"].withColumn("o", F.col("changed")), "changed", "o").select("scenario", "sheet")
    nets = expanded(masks["nets"], "live", "has24", "has0").select("scenario", "net", "has24", "has0")
    return {"nets": nets, "coils": coils, "settled": oscillating.isEmpty(), "oscillating": oscillating}


def simulate_masks(netlist: dict[str, DataFrame], live: DataFrame, opened: DataFrame) -> dict[str, DataFrame]:
    """nets (block, net, live, has24, has0), coils (block, component, on), oscillating (block, sheet, changed): masks.

    live (block, live) tells which of a block's 64 scenarios there are, opened (block, component, opened) in which of
    them a hand switch is open; else it is closed.  Rounds go on until the coils of each sheet and scenario are as they
    were a round before, or as they were in the last round whose number is a power of two: those still changing
    oscillate, and their nets and coils are those of one round of their cycle.
    """
    spark = netlist["terminals"].sparkSession
    tables = Tables(spark)
    found = live.filter("live <> 0").limit(BLOCKS + 1).collect()
    if len(found) > BLOCKS:
        raise ValueError(f"more than {BLOCKS} blocks of 64 scenarios: simulate them in parts")
    blocks = F.explode(F.arrays_zip(F.lit([r["block"] for r in found]).cast("array<long>").alias("block"), F.lit([r["live"] for r in found]).cast("array<long>").alias("live")))
    dealt = lambda df: df.withColumn("wireloom_block", blocks).select("wireloom_block.block", "wireloom_block.live", *df.columns)
    none = F.lit(0).cast("long")
    sheet = lambda c: F.when(F.contains(c, F.lit(SHEET)), F.substring_index(c, SHEET, 1)).otherwise("")
    switches = switch_edges(netlist).filter("net_1 <> net_2").select("component", "net_1", "net_2", "hand", "when_on").distinct()
    switches = dealt(tables.cut(switches, "edges")).join(opened, ["block", "component"], "left").withColumn("opened", F.coalesce("opened", none))
    coil_of = dealt(_pairs(netlist, COILS, "coil").select("component", "net_1", "net_2").distinct())
    poles = dealt(netlist["terminals"].select("net").filter(bare(F.col("net")).isin(SOURCE, RETURN)).distinct())
    no = F.lit(None)
    rows = switches.select("block", sheet("component").alias("sheet"), "live", F.lit("switch").alias("role"), "component", "net_1", "net_2", "hand", "when_on", "opened")
    rows = rows.union(coil_of.select("block", sheet("component"), "live", F.lit("coil"), "component", "net_1", "net_2", no, no, none))
    rows = rows.union(poles.select("block", sheet("net"), "live", F.lit("pole"), bare(F.col("net")), "net", "net", no, no, none))
    # a device whose nets lie on another sheet ties sheets together, which then all run in rounds
    strays = (sheet("net_1") != F.col("sheet")) | (sheet("net_2") != F.col("sheet"))
    rows, astray = tables.counted(rows, "devices", strays)
    size = rows.groupBy("block", "sheet").agg(F.count("*").alias("size")).filter(F.lit(bool(astray)) | (F.col("size") > HELD))
    large = tables.cut(size.select("block", "sheet"), "large")
    if large.isEmpty():
        held, beyond = rows, None
    else:
        held, beyond = rows.join(large, ["block", "sheet"], "left_anti"), rows.join(large, ["block", "sheet"], "left_semi")
    out = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("sheet", pa.string()), ("name", pa.string()), ("x", pa.int64()), ("y", pa.int64())])
    key = ["block", "sheet", "live"]
    made = tables.cut(walk(held.select(*key, "role", "component", "net_1", "net_2", "hand", "when_on", "opened"), key, [], _sheet_walk, "kind string, block long, sheet string, name string, x long, y long", out), "made")
    labels = made.filter("kind = 'net'").select("block", F.col("name").alias("net"), F.col("x").alias("p"), F.col("y").alias("z"))
    coils = made.filter("kind = 'coil'").select("block", F.col("name").alias("component"), F.col("x").alias("on"))
    moving = made.filter("kind = 'oscillates'").select("block", "sheet", F.col("x").alias("changed"))
    if beyond is not None:
        more = _rounds(beyond, tables)
        labels, coils, moving = labels.union(more[0]), coils.union(more[1]), moving.union(more[2])
    tables.drop("edges", "devices", "large")
    nets = dealt(netlist["nets"].select(F.col("id").alias("net"))).join(labels.select("block", "net", F.col("p").alias("has24"), F.col("z").alias("has0")), ["block", "net"], "left")
    nets = nets.select("block", "net", "live", F.coalesce("has24", none).alias("has24"), F.coalesce("has0", none).alias("has0"))
    return {"nets": nets, "coils": coils, "oscillating": moving}


def _rounds(devices: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(block, net, p, z), (block, component, on), (block, sheet, changed) of sheets of any size, in rounds for all of them."""
    none = F.lit(0).cast("long")
    switches = tables.cut(devices.filter("role = 'switch'").select("block", "component", "live", "net_1", "net_2", "hand", "when_on", "opened"), "switches")
    coil_of = tables.cut(devices.filter("role = 'coil'").select("block", "live", "component", "net_1", "net_2"), "coil_of")
    pole = lambda name: F.when(F.col("component") == name, F.col("live")).otherwise(none)
    poles = tables.cut(devices.filter("role = 'pole'").select("block", F.col("net_1").alias("net"), pole(SOURCE).alias("p"), pole(RETURN).alias("z"), pole(SOURCE).alias("dp"), pole(RETURN).alias("dz")), "poles")
    sheet = F.when(F.contains("component", F.lit(SHEET)), F.substring_index("component", SHEET, 1)).otherwise("")
    state = tables.cut(coil_of.select("block", "live", "component", *[none.alias(c) for c in ("on", "was", "saved")]).limit(0), "state")
    done = tables.cut(state.select("block", sheet.alias("sheet"), none.alias("done")), "done")
    turn = 0
    while True:
        lit_up = F.coalesce("on", none)
        mask = F.when(F.col("hand"), F.expr("live & ~opened")).otherwise(F.when(F.col("when_on"), lit_up).otherwise(F.col("live").bitwiseAND(F.bitwise_not(lit_up))))
        acting = switches.join(state.select("block", "component", "on"), ["block", "component"], "left").withColumn("mask", mask).filter("mask <> 0")
        ends = F.explode(F.array(F.struct(F.col("net_1").alias("net"), F.col("net_2").alias("other")), F.struct(F.col("net_2").alias("net"), F.col("net_1").alias("other"))))
        closed = acting.select("block", "mask", ends.alias("e")).groupBy("block", "e.net", "e.other").agg(F.bit_or("mask").alias("mask"))
        closed = tables.cut(closed, "closed")
        labels, new = poles, 1
        while new:
            for _ in range(HOPS):
                labels = _hop(labels, closed)
            labels, new = tables.counted(labels, "labels", F.expr("dp <> 0 OR dz <> 0"))
        one = labels.select("block", F.col("net").alias("net_1"), F.col("p").alias("p1"), F.col("z").alias("z1"))
        two = labels.select("block", F.col("net").alias("net_2"), F.col("p").alias("p2"), F.col("z").alias("z2"))
        fed = coil_of.join(one, ["block", "net_1"]).join(two, ["block", "net_2"]).select("block", "live", "component", F.expr("(p1 & z2) | (z1 & p2)").alias("on"), none.alias("was"), none.alias("saved")).filter("on <> 0")
        keep = turn & (turn - 1) == 0  # this turn's coils are what later turns are compared with, until the next power of two
        before = state.select("block", "live", "component", none.alias("on"), F.col("on").alias("was"), F.col("on" if keep else "saved").alias("saved"))
        state = fed.union(before).groupBy("block", "live", "component").agg(*[F.bit_or(c).alias(c) for c in ("on", "was", "saved")])
        state = tables.cut(state.filter("(on | was | saved) <> 0"), "state")
        marks = state.groupBy("block", "live", sheet.alias("sheet")).agg(F.bit_or(F.expr("on ^ was")).alias("changed"), F.bit_or(F.expr("on ^ saved")).alias("differ"))
        done = marks.join(done.select("block", "sheet", "done"), ["block", "sheet"], "left").select("block", "sheet", "live", "changed", F.expr("coalesce(done, 0) | (live & ~changed) | (live & ~differ)").alias("done"))
        done, moving = tables.counted(done, "done", F.expr("(live & ~done) <> 0"))
        if not moving:
            break
        turn += 1
    tables.drop("switches", "closed", "coil_of", "poles")
    return labels.select("block", "net", "p", "z"), state.filter("on <> 0").select("block", "component", "on"), done.filter("changed <> 0").select("block", "sheet", "changed")
