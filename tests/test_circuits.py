"""Masks of scenarios, many paths at once and what breakers cut off, against plain versions."""

from __future__ import annotations

import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wireloom import shared
from wireloom.operators import graph, paths
from wireloom.operators.bridges import cut_off
from wireloom.operators.paths import shortest, within
from wireloom.params import Params
from wireloom.plans import circuits, query, simulate
from wireloom.sources import bridge


@pytest.fixture
def small(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def tables_left(spark) -> int:
    folder = Path(shared.run_dir(spark).removeprefix("file://"))
    return len([p for p in folder.glob("*/*") if p.is_dir()]) if folder.exists() else 0


def reached(edges, starts, without=None):
    around = defaultdict(list)
    for name, a, b in edges:
        if name != without:
            around[a].append(b)
            around[b].append(a)
    seen, todo = set(starts), list(starts)
    while todo:
        for w in around[todo.pop()]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


# relay logic


def circuit(rnd: random.Random, sheet: str):
    """Relays, buttons and breakers with terminals on random nets of a sheet; and one coil that opens its own feed."""
    nets = [f"{sheet}#{n}" for n in ("24E-1", "0V", *(f"N{k}" for k in range(7)))]
    parts, pins = [("B", "relay"), ("P", "push_button")], []
    for k in range(9):
        parts.append((f"X{k}", rnd.choice(["relay", "relay", "push_button", "circuit_breaker"])))
    for name, kind in parts[2:]:
        for pin in {"relay": "A1 A2 11 12 14 21 24", "push_button": "1 4", "circuit_breaker": "1 2"}[kind].split():
            if rnd.random() < 0.8:
                pins.append((name, pin, rnd.choice(nets)))
    pins += [("P", "1", nets[0]), ("P", "4", f"{sheet}#W"), ("B", "11", f"{sheet}#W"), ("B", "12", f"{sheet}#V"), ("B", "A1", f"{sheet}#V"), ("B", "A2", nets[1])]
    return [(f"{sheet}#{c}", kind) for c, kind in parts], [(f"{sheet}#{c}", p, n) for c, p, n in pins]


def plain(parts, pins, is_open):
    """(coils of the last round, whether it is like the one before) once coils recur."""
    at = {(c, p): n for c, p, n in pins}
    on, seen = frozenset(), [frozenset()]
    while True:
        shut = []
        for c, kind in parts:
            for a, b, when in {"relay": [(f"{x}1", f"{x}{y}", y == "4") for x in "12" for y in "24"], "push_button": [("1", "4", None)], "circuit_breaker": [("1", "2", None)]}[kind]:
                if (c, a) in at and (c, b) in at and (not is_open(c) if when is None else (c in on) == when):
                    shut.append((len(shut), at[c, a], at[c, b]))
        tied = {pole: reached(shut, {n for _, _, n in pins if n.endswith(f"#{pole}")}) for pole in (simulate.SOURCE, simulate.RETURN)}
        p, z = tied[simulate.SOURCE], tied[simulate.RETURN]
        ends = [(c, at[c, "A1"], at[c, "A2"]) for c, kind in parts if kind == "relay" and (c, "A1") in at and (c, "A2") in at]
        new = frozenset(c for c, a, b in ends if (a in p and b in z) or (a in z and b in p))
        if new in seen:
            return new, new == on
        seen.append(new)
        on = new


def test_masks_are_plain_simulation(small):
    rnd = random.Random(3)
    made = [circuit(rnd, sheet) for sheet in ("A", "B", "C", "D")]
    parts, pins = [p for m in made for p in m[0]], [p for m in made for p in m[1]]
    hand = [c for c, kind in parts if kind != "relay"]
    scenarios = [-3, *range(60, 131), 1000]
    is_open = {(s, c): rnd.random() < 0.4 for s in scenarios for c in hand}
    settings = small.createDataFrame([(s, c, not gone) for (s, c), gone in is_open.items() if gone or rnd.random() < 0.5] + [(s, hand[0], not is_open[s, hand[0]]) for s in scenarios], "scenario long, component string, closed boolean").distinct()
    netlist = {
        "components": small.createDataFrame(parts, "id string, class string"),
        "terminals": small.createDataFrame([(f"{c}:{p}", c, n) for c, p, n in pins] + [("A#X0:spare", "A#X0", None)], "id string, parent_component string, net string"),
        "nets": small.createDataFrame([(n,) for n in sorted({n for _, _, n in pins})], "id string"),
    }
    out = simulate.simulate(netlist, settings)
    got, moving = defaultdict(set), {(r.scenario, r.sheet) for r in out["oscillating"].collect()}
    for r in out["coils"].collect():
        got[r.scenario].add(r.component)
    want_moving = set()
    for s in scenarios:
        for own, ends in made:
            sheet = own[0][0][0]
            coils, settled = plain(own, ends, lambda c, s=s: is_open[s, c])
            if not settled:
                want_moving.add((s, sheet))
            else:
                assert {c for c in got[s] if c.startswith(f"{sheet}#")} == coils, (s, sheet)
    assert moving == want_moving and moving and not out["settled"]
    assert out["nets"].count() == len(scenarios) * len({n for _, _, n in pins})


def test_more_scenarios_than_a_run_takes(small, monkeypatch):
    monkeypatch.setattr(simulate, "BLOCKS", 2)
    parts, pins = circuit(random.Random(1), "A")
    netlist = {"components": small.createDataFrame(parts, "id string, class string"), "terminals": small.createDataFrame([(f"{c}:{p}", c, n) for c, p, n in pins], "id string, parent_component string, net string"), "nets": small.createDataFrame([], "id string")}
    with pytest.raises(ValueError, match="blocks"):
        simulate.simulate(netlist, small.createDataFrame([(64 * k, "A#P", True) for k in range(3)], "scenario long, component string, closed boolean"))


@pytest.mark.parametrize("held", [0, 40])
def test_sheets_settle_in_tasks_as_in_rounds(small, monkeypatch, held):
    rnd = random.Random(5)
    made = [circuit(rnd, sheet) for sheet in ("A", "B")]
    parts, pins = [p for m in made for p in m[0]], [p for m in made for p in m[1]]
    parts += [(f"C#Y{k}", "push_button") for k in range(60)]  # a larger sheet
    pins += [(f"C#Y{k}", p, f"C#{n}") for k in range(60) for p, n in (("1", "24E-1" if k == 0 else f"N{k}"), ("4", f"N{k + 1}"))]
    settings = small.createDataFrame([(s, c, rnd.random() < 0.9 and (s % 2 > 0 or not c.endswith("#P"))) for s in range(8) for c, kind in parts if kind != "relay"], "scenario long, component string, closed boolean")
    netlist = {
        "components": small.createDataFrame(parts, "id string, class string"),
        "terminals": small.createDataFrame([(f"{c}:{p}", c, n) for c, p, n in pins], "id string, parent_component string, net string"),
        "nets": small.createDataFrame([(n,) for n in sorted({n for _, _, n in pins})], "id string"),
    }

    def shown():
        out = simulate.simulate(netlist, settings)
        moving = {(r.scenario, r.sheet) for r in out["oscillating"].collect()}
        settled = lambda r, c: (r.scenario, r[c].split("#")[0]) not in moving
        return moving, {tuple(r) for r in out["coils"].collect() if settled(r, "component")}, {tuple(r) for r in out["nets"].collect() if settled(r, "net")}

    whole, in_rounds = shown(), []
    monkeypatch.setattr(simulate, "HELD", held)
    rounds = simulate._rounds
    monkeypatch.setattr(simulate, "_rounds", lambda devices, tables: in_rounds.append({r.sheet for r in devices.select("sheet").distinct().collect()}) or rounds(devices, tables))
    assert shown() == whole and whole[1]
    assert in_rounds == [{"C"} if held else {"A", "B", "C"}]


# paths


def test_shortest_paths_of_many_pairs(small):
    rnd = random.Random(8)
    edges = [(f"v{rnd.randrange(60)}", f"v{rnd.randrange(60)}", f"e{rnd.randrange(40)}") for _ in range(75)]
    edges += [(f"c{k}", f"c{k + 1}", "c") for k in range(23)] + [("v1", "v1", "loop"), ("v2", None, "x"), (None, "v3", "y")]
    asked = [(k, f"v{rnd.randrange(62)}", f"v{rnd.randrange(62)}") for k in range(150)] + [(200, "c0", "c23"), (201, "c5", "c5"), (202, None, "v1"), (203, "c22", "v1"), (None, "v1", "v2")]
    got = {r["query"]: r for r in shortest(small.createDataFrame(edges, "a string, b string, via string"), small.createDataFrame(asked, "query long, start string, goal string")).collect()}
    assert set(got) == {q for q, _, _ in asked if q is not None}
    around = defaultdict(set)
    for a, b, _ in edges:
        if a and b and a != b:
            around[a].add(b)
            around[b].add(a)
    names = {(x, y): min(v for a, b, v in edges if {a, b} == {x, y}) for x in around for y in around[x]}
    for q, start, goal in asked:
        if q is None:
            continue
        far, ring = {start: 0} if start else {}, [start] if start else []
        while ring:
            ring = [w for w in {w for v in ring for w in around[v]} if w not in far and far.setdefault(w, far[ring[0]] + 1)]
        if start is None or goal not in far:
            assert (got[q].status, got[q].steps, got[q].vertices) == ("none", None, None)
            continue
        r = got[q]
        assert (r.status, r.steps, r.vertices[0], r.vertices[-1], len(r.vertices)) == ("connected", far[goal], start, goal, far[goal] + 1)
        assert r.via == [names[step] for step in zip(r.vertices, r.vertices[1:], strict=False)]


def test_small_components_are_searched_in_their_task_and_large_ones_in_rounds(small, monkeypatch):
    rnd = random.Random(5)
    edges = [(rnd.randrange(40), rnd.randrange(40), rnd.randrange(9)) for _ in range(34)] + [(100 + k, 101 + k, 0) for k in range(45)]
    asked = [(k, rnd.randrange(41), rnd.randrange(41)) for k in range(80)] + [(90, 100, 145), (91, 120, 3), (92, 500, 500)]
    in_rounds, rounds = [], paths._rounds

    def noted(known, queries, tables):
        in_rounds.extend(r["query"] for r in queries.select("query").collect())
        return rounds(known, queries, tables)

    monkeypatch.setattr(paths, "_rounds", noted)
    found = lambda: {tuple(r.asDict().values()) for r in shortest(small.createDataFrame(edges, "a long, b long, via long"), small.createDataFrame(asked, "query long, start long, goal long")).withColumn("vertices", F.array_join("vertices", " ")).withColumn("via", F.array_join("via", " ")).collect()}
    whole = found()
    assert len(whole) == len(asked) and not in_rounds
    monkeypatch.setattr(paths, "VISITS", 100)
    assert found() == whole and not in_rounds
    monkeypatch.setattr(paths, "HELD", 40)
    assert found() == whole and in_rounds == [90]


def test_all_chains_of_few_steps(small):
    edges = [("a", "b", "1"), ("b", "c", "2"), ("c", "a", "3"), ("a", "b", "4"), ("c", "d", "5"), ("d", None, "6")]
    got = {(r.start, tuple(r.vertices), tuple(r.via)) for r in within(small.createDataFrame(edges, "a string, b string, via string"), small.createDataFrame([("a",), ("d",), (None,), ("z",)], "start string"), 2).collect()}
    assert got == {
        ("a", ("a", "b"), ("1",)), ("a", ("a", "b"), ("4",)), ("a", ("a", "c"), ("3",)), ("a", ("a", "b", "c"), ("1", "2")), ("a", ("a", "b", "c"), ("4", "2")), ("a", ("a", "c", "b"), ("3", "2")),
        ("a", ("a", "c", "d"), ("3", "5")), ("d", ("d", "c"), ("5",)), ("d", ("d", "c", "b"), ("5", "2")), ("d", ("d", "c", "a"), ("5", "3")),
    }


# breakers


@pytest.mark.parametrize("seed", [1, 2])
def test_losses_are_those_of_removal(small, seed):
    rnd = random.Random(seed)
    edges = [(f"e{k}", rnd.randrange(80), rnd.randrange(80)) for k in range(85)] + [(f"c{k}", 100 + k, 101 + k) for k in range(14)] + [("p1", 105, 106), ("x", 300, 301), (None, 1, 2), ("n", None, 4)]
    sources = [(0,), (1,), (100,), (None,), (400,)]
    weights = [(v, rnd.randrange(4)) for v in range(110)] + [(5, 2), (None, 9)]
    before = tables_left(small)
    out = cut_off(small.createDataFrame(edges, "edge string, a long, b long"), small.createDataFrame(sources, "vertex long"), small.createDataFrame(weights, "vertex long, weight long"))
    got = {r.edge: (r.lost_vertices, r.lost_weight) for r in out["losses"].collect()}
    known, starts = [e for e in edges if None not in e], [v for (v,) in sources if v is not None]
    every, total = reached(known, starts), defaultdict(int)
    for v, w in weights:
        total[v] += w
    lost = {e: every - reached(known, starts, e) for e, _, _ in known}
    assert got == {e: (len(gone), sum(total[v] for v in gone)) for e, gone in lost.items() if gone}
    guards = {r.vertex: r.guard for r in out["guards"].collect()}
    assert set(guards) == every
    for v, guard in guards.items():  # the nearest edge that cuts a vertex off is the one that loses least
        cuts = [e for e, gone in lost.items() if v in gone]
        assert guard == (min(cuts, key=lambda e: len(lost[e])) if cuts else None)
    assert tables_left(small) - before == 2


def test_no_sources_and_no_edges(small):
    empty = cut_off(small.createDataFrame([("e", 1, 2)], "edge string, a long, b long"), small.createDataFrame([], "vertex long"), small.createDataFrame([], "vertex long, weight long"))
    assert empty["losses"].isEmpty() and empty["guards"].isEmpty()


def supplies(spark, second_feed: bool):
    """A breaker feeds a supply, whose net feeds another supply."""
    pins = [("CB", "1", "IN"), ("CB", "2", "F1"), ("PS1", "L", "F1"), ("PS1", "+", "N1"), ("PS2", "L", "N1"), ("PS2", "+", "N2"), ("LAMP1", "1", "N1"), ("LAMP2", "1", "N2")]
    powers = [("POWERS", "PS1", "N1"), ("POWERS", "PS2", "N2"), ("PROTECTS", "CB", "PS1")]
    if second_feed:
        pins += [("PS3", "L", "IN"), ("PS3", "+", "N2")]
        powers.append(("POWERS", "PS3", "N2"))
    return {
        "components": spark.createDataFrame([("CB", "circuit_breaker"), *((x, "power_supply") for x in ("PS1", "PS2", "PS3")), ("LAMP1", "lamp"), ("LAMP2", "lamp")], "id string, class string"),
        "terminals": spark.createDataFrame([(f"{c}:{p}", c, n) for c, p, n in pins], "id string, parent_component string, net string"),
        "nets": spark.createDataFrame([(n, "power") for n in ("IN", "F1", "N1", "N2")], "id string, signal_type string"),
        "relationships": spark.createDataFrame(powers, "type string, src string, tgt string"),
    }


def test_a_supply_fed_by_a_supply_is_lost(small):
    assert {(r.component, r.net) for r in query.loses_power(supplies(small, False), "CB").collect()} == {("PS1", "N1"), ("PS2", "N1"), ("LAMP1", "N1"), ("PS2", "N2"), ("LAMP2", "N2")}


@pytest.mark.parametrize(("second", "want"), [(False, ("CB", 3, 7)), (True, ("CB", 0, 0))])
def test_impact_of_a_breaker(small, second, want):
    made = supplies(small, second)
    got = [(r.component, r.lost_nets, r.lost_terminals) for r in query.breaker_impact(made, small.createDataFrame([("IN",)], "net string")).collect()]
    assert got == [want]


# runs of conductors


def walked(edges):
    """(nodes, conductor, length) of the runs of (edge, a, b, length) on one page; parallel edges are runs of their own."""
    around = defaultdict(list)
    for e in edges:
        around[e[1]].append((e[0], e[2], e[3]))
        around[e[2]].append((e[0], e[1], e[3]))
    used, out = set(), []

    def walk(start, step):
        nodes, length, edge = [start], 0.0, step
        while True:
            used.add(edge[0])
            nodes.append(edge[1])
            length += edge[2]
            if len(around[edge[1]]) != 2 or edge[1] == start:
                return nodes, length
            edge = next(x for x in around[edge[1]] if x[0] != edge[0])

    for end in (True, False):  # runs between nodes of another degree first, then loops from their least node
        for start in sorted(v for v in around if (len(around[v]) != 2) == end):
            for step in sorted(around[start]):
                if step[0] not in used:
                    nodes, length = walk(start, step)
                    out.append((nodes, end, length))
    return sorted(out)


@pytest.mark.parametrize("long", [0, 100_000])
def test_runs_are_those_of_a_walk(small, long):
    rnd = random.Random(5)
    edges = [(k, *rnd.sample(range(90), 2)) for k in range(80)]
    edges += [(1000 + k, 200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(1100, 300, 301), (1101, 301, 300), (1102, 310, 311), (1103, 311, 312), (1104, 312, 310), (1105, 310, 320)]
    edges += [(5000 + k, 10**6 + k, 10**6 + k + 1) for k in range(long)] + [(10**6 + k, 5 * 10**6 + k, 5 * 10**6 + (k + 1) % (long // 4)) for k in range(long // 4)]
    names = {v: v for e in edges for v in e[1:]}
    if long:  # ids along the run are in no order
        far = [v for v in names if v >= 10**6]
        names |= dict(zip(far, rnd.sample(far, len(far)), strict=True))
    made = [(e, names[a], names[b], float(e % 7 + 1)) for e, a, b in edges]
    rows = small.createDataFrame(made, "edge long, a long, b long, length double").selectExpr("7 AS page", "*", "double(a) AS ax", "0D AS ay", "double(b) AS bx", "1D AS by").repartition(4)
    assert sorted((r.node_ids, r.conductor, r.length) for r in graph.contract(rows).collect()) == walked(made)


# ends of segments


@pytest.mark.parametrize("rounds", [6, 1])
def test_cells_snap_as_one_end_after_another(small, monkeypatch, rounds):
    """Ends are one to two tolerances apart, at random and along lines drawn in order; few rounds leave a walk."""
    monkeypatch.setattr(graph, "ROUNDS", rounds)
    rnd, tol = random.Random(rounds), 0.35
    rows = [(page, k, *(rnd.uniform(0, 9) for _ in range(4))) for page in (1, 2) for k in range(260)]
    rows += [(3, k, 0.4 * k, 1.0, 0.4 * k + 0.4, 1.0) for k in range(60)] + [(3, 100 + k, 20 - 0.55 * k, 3.0, 20.0, 3.0 + 0.5 * k) for k in range(40)] + [(3, 7, 0.0, 0.0, 0.175, 0.525), (3, 7, 5.0, 5.0, 5.0, 5.0)]
    want, nodes, cells = [], defaultdict(list), defaultdict(dict)
    for page, seg, x0, y0, x1, y1 in sorted(rows, key=lambda r: r[:2]):
        pair = []
        for x, y in ((x0, y0), (x1, y1)):
            cx, cy = round(x / tol), round(y / tol)
            near = [cells[page][cx + dx, cy + dy] for dx in (0, -1, 1) for dy in (0, -1, 1) if (cx + dx, cy + dy) in cells[page]]
            if not near:
                near = [cells[page].setdefault((cx, cy), len(nodes[page]))]
                nodes[page].append((x, y))
            pair.append(near[0])
        if pair[0] != pair[1]:
            want.append((page, seg, *pair))
    made = small.createDataFrame(rows, "page int, seg long, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    got = graph.snap_cells(made, Params(node_tol=tol)).collect()
    assert sorted((r.page, r.edge, r.a, r.b) for r in got) == sorted(want)
    for r in got:
        assert (r.ax, r.ay) == pytest.approx(nodes[r.page][r.a], abs=0.0051)


def test_parameter_files_load():
    prm = Params.merged('{"node_snap": 0.5, "ortho_tol": 0.1, "ocr_dpi": 300, "word_gap_ratio": 2}', bind_radius=9.0)
    assert (prm.node_tol, prm.ortho_tol, prm.ocr_dpi, prm.gap_factor, prm.bind_radius, prm.ocr_pad) == (0.5, 0.1, 300, 2, 9.0, 2.5)
    with pytest.raises(TypeError):
        Params.merged('{"nowhere": 1}')


def test_short_runs_are_ordered_in_their_task_and_long_ones_in_rounds(small, monkeypatch):
    rnd = random.Random(11)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(36)] + [(100 + k, 101 + k) for k in range(9)] + [(200 + k, 200 + (k + 1) % 7) for k in range(7)] + [(300, 300), (301, 302), (301, 302)]
    rows = [("p", f"e{k}", a, b, float(a), 0.0, float(b), 0.0, 1.0) for k, (a, b) in enumerate(pairs)]
    edges = small.createDataFrame(rows, "page string, edge string, a long, b long, ax double, ay double, bx double, by double, length double")
    long_, rounds = [], graph._ordered

    def noted(own, tables):
        long_.append(own.count())
        return rounds(own, tables)

    monkeypatch.setattr(graph, "_ordered", noted)
    found = lambda: sorted(tuple(r) for r in graph.ordered(edges).drop("run").collect())
    whole = found()
    assert len(whole) == len(pairs) and not long_
    monkeypatch.setattr(graph, "HELD", 5)
    assert found() == whole and long_ and long_[0] < len(pairs)
    monkeypatch.setattr(graph, "HELD", 0)
    assert found() == whole


def test_pieces_of_small_nets_are_found_in_their_task(small, monkeypatch):
    rnd = random.Random(3)
    names = [(f"t{k}", f"n{k % 4}") for k in range(40)] + [("alone", None), (None, "n1")]
    wires = [(f"n{n}", f"t{4 * rnd.randrange(10) + n}", f"t{4 * rnd.randrange(10) + n}") for n in range(3) for _ in range(6)] + [("n1", None, "t1"), ("n1", "t5", None), (None, "t2", "t6"), ("n3", "t3", "off"), ("n3", "off", "t7")]
    netlist = {"terminals": small.createDataFrame(names, "id string, net string"), "wires": small.createDataFrame(wires, "net string, from_terminal string, to_terminal string")}
    want = {}
    for net in {n for _, n in names if n}:
        own = {t for t, n in names if n == net and t}
        edges = [(k, a, b) for k, (n, a, b) in enumerate(wires) if n == net and a and b]
        want[net] = len({min(reached(edges, [t])) for t in own})
    monkeypatch.setattr(query, "components", None)
    assert dict(tuple(r) for r in query.wire_fragments(netlist).collect()) == want
    monkeypatch.undo()
    monkeypatch.setattr(query, "HELD", 14)
    assert dict(tuple(r) for r in query.wire_fragments(netlist).collect()) == want


def test_sheets_of_breakers_are_made_once(small):
    """What impact reads again comes from tables in the shared folder, not from the line items."""
    made = bridge.breaker_sheets(small, "/root/testdata/sf0.001")
    for what in ("components", "terminals", "sources"):
        assert not [f for f in made[what].inputFiles() if "/lineitem" in f], what


def test_short_chains_run_in_tasks_of_a_bounded_share(small, monkeypatch):
    """Parts of shuffles follow from the line items, and the session's own settings come back."""
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    settings = lambda: [small.conf.get(n, None) for n in names]
    before, seen = settings(), []
    monkeypatch.setattr(bridge, "tasks", lambda *a: 50)
    monkeypatch.setattr(circuits, "within", lambda *a: seen.append(settings()) or within(*a))
    circuits.short_chains(small, "/root/testdata/sf0.001")
    assert seen == [[shared.TASK_BYTES, "50"]]
    assert settings() == before
