"""What a reviewer has to look at, on odd netlists, and how often terminals are dealt for it."""

from __future__ import annotations

import random

from wireloom.plans import netlist


def _odd(spark, seed: int = 4):
    """Terminals under one id on two nets, ids and ends that are null or unknown, wires whose ends are both elsewhere."""
    rnd = random.Random(seed)
    some = lambda letter, n: rnd.choice([None, *[f"{letter}{k}" for k in range(n)]])
    terminals = [(f"t{k}", some("c", 12), some("n", 9)) for k in range(40)] + [("t1", "c1", "n2"), ("t1", "c1", "n3"), ("t2", "c1", None), ("t2", "c1", None), (None, "c2", "n1"), (None, None, None)]
    wires = [(some("w", 30), some("t", 44), some("t", 44), some("n", 9)) for _ in range(60)] + [("own", "t1", "t1", "n2"), ("far", None, "zz", "n1"), ("end", "t2", "t2", None)]
    components = [(f"c{k}",) for k in range(3, 16)] + [(None,), ("c14",)]
    nets = [(f"n{k}", [f"t{k}"] * (k % 3)) for k in range(7)] + [("n20", None)]
    return terminals, wires, components, nets, {
        "terminals": spark.createDataFrame(terminals, "id string, parent_component string, net string"), "wires": spark.createDataFrame(wires, "id string, from_terminal string, to_terminal string, net string"),
        "components": spark.createDataFrame(components, "id string"), "nets": spark.createDataFrame(nets, "id string, member_terminals array<string>"),
    }


def test_odd_netlists(spark):
    for seed in (4, 5):
        terminals, wires, components, nets, made = _odd(spark, seed)
        ends = [(w, t, net) for w, a, b, net in wires for t in (a, b)]
        at = {i: [n for j, _, n in terminals if j == i] for i, _, _ in terminals if i is not None}
        own, held, known = {c for (c,) in components} - {None}, {p for _, p, _ in terminals} - {None}, {n for n, _ in nets}
        want = {("wire end is no terminal", t) for _, t, _ in ends if t not in at}
        want |= {("wire and end are on different nets", w) for w, t, net in ends if any(n != net for n in at.get(t, []))}
        want |= {("component without terminals", c) for (c,) in components if c not in held}
        want |= {("terminal of an unknown component", i) for i, p, _ in terminals if p not in own}
        want |= {("terminal on an unknown net", i) for i, _, n in terminals if n is not None and n not in known}
        want |= {("net without members", n) for n, m in nets if m == []}
        want |= {("terminal with several wires", t) for t in {t for _, t, _ in ends} if sum(t == u for _, u, _ in ends) > 1}
        want |= {("terminal without a net", i) for i, _, n in terminals if n is None}
        assert len({check for check, _ in want}) == 8
        for parts in (None, 3):
            got = [tuple(r) for r in netlist.completeness(made, parts).collect()]
            assert set(got) == want and len(got) == len(want)


def test_each_table_is_dealt_once_for_all_checks_of_two(spark):
    *_, made = _odd(spark)
    plan = netlist.completeness(made, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("RepartitionByExpression") == 2
