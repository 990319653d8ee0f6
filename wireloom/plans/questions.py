"""Registered queries that ask the questions about a netlist over many sheets, made of the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import greedy_match
from ..sources import plant
from ..sources.bridge import table, tasks
from . import kg, netlist, query
from .registry import registered

_CLASSES = ", ".join(f"'{c}'" for c in plant.CLASSES)
#: Sheets (s), terminals (t), components (c), wires (w), subsystems (g) and authored edges (a) of the plant.
BASE = f"""s AS MATERIALIZED (
  SELECT o_orderkey AS o, concat(c_mktsegment, c_nationkey) AS sh, o_custkey AS k, o_orderpriority = '1-URGENT' AS power FROM orders JOIN customer ON c_custkey = o_custkey
), t AS MATERIALIZED (
  SELECT DISTINCT sh, o, k, power, l_partkey AS part, concat(sh, '#P', l_partkey) AS component, concat(sh, '#P', l_partkey, ':', o) AS id, CASE WHEN o % {plant.BARE} > 0 THEN concat(sh, '#N', o) END AS net,
    CASE WHEN power THEN 'supply_in' END AS function FROM lineitem JOIN s ON o = l_orderkey
), p AS MATERIALIZED (
  SELECT p_partkey AS part, [{_CLASSES}][p_size % {len(plant.CLASSES)} + 1] AS class, p_name, p_type, p_size, p_brand FROM part
), c AS MATERIALIZED (
  SELECT DISTINCT sh, part, component AS id, class, p_name AS description, CASE WHEN p_size % 3 > 0 THEN concat(p_size, 'A') END AS rating, p_type AS alias, concat(p_type, '-', p_size) AS part_number, p_brand AS power_domain
  FROM t JOIN p USING (part) WHERE part % {plant.UNLISTED} <> 5
  UNION ALL SELECT DISTINCT sh, -1, concat(sh, '#SPARE'), 'ground', NULL, NULL, NULL, NULL, NULL FROM s
), j AS MATERIALIZED (
  SELECT * FROM (SELECT *, lead(part) OVER (PARTITION BY net ORDER BY part) AS next FROM t WHERE net IS NOT NULL) WHERE next IS NOT NULL
), w AS MATERIALIZED (
  SELECT sh, concat(sh, '#W', o * 1000000 + part) AS id, [NULL, 'BLUE', 'RED'][o % 3 + 1] AS color, CASE WHEN part % 2 = 0 THEN '16AWG' ELSE '18AWG' END AS gauge, id AS from_terminal,
    concat(sh, '#P', next, ':', CASE WHEN o % {plant.FAULTY} = 1 THEN 'X' ELSE CAST(o AS VARCHAR) END) AS to_terminal, concat(sh, '#N', CASE WHEN o % {plant.FAULTY} = 2 THEN o + 1 ELSE o END) AS net,
    CASE WHEN part % 4 > 0 THEN concat(sh, '#C', k) END AS cable, component AS from_component, concat(sh, '#P', next) AS to_component FROM j
), g AS MATERIALIZED (
  SELECT sh, concat(sh, '#S', regexp_extract(coalesce(power_domain, ''), '(\\d+)$', 1)) AS id, c.id AS member FROM c WHERE part >= 0
), x AS MATERIALIZED (
  SELECT j.*, p.class, n.class AS next_class FROM j JOIN p ON p.part = j.part JOIN p n ON n.part = j.next
), a AS MATERIALIZED (
  SELECT sh, CASE class WHEN 'power_supply' THEN 'POWERS' ELSE 'PROTECTS' END AS type, component AS src, net AS tgt FROM t JOIN p USING (part) WHERE net IS NOT NULL AND power AND class IN ('power_supply', 'circuit_breaker')
  UNION ALL SELECT sh, 'COIL_CONTROLS_CONTACT', component, id FROM t JOIN p USING (part) WHERE net IS NOT NULL AND class = 'relay'
  UNION ALL SELECT sh, 'ACTUATES', component, concat(sh, '#P', next) FROM x WHERE class IN ('push_button', 'external_machine') AND next_class = 'relay'
  UNION ALL SELECT sh, 'REFERENCES', component, concat(sh, '#P', next) FROM x WHERE next_class IN ('external_drawing', 'external_machine')
)"""


def _with(sql: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{BASE}{sql}"


def _plant(spark, sf_dir, once: bool = True) -> dict[str, DataFrame]:
    return netlist.derive(netlist.qualified(plant.authored(spark, sf_dir, once)))


_SHEETS = "(SELECT DISTINCT sh FROM s)"


@registered("plant_metadata", _with(f""" SELECT sh AS drawing_no, unnest(['drawing_number', 'revision', 'title', 'date', 'assembly', 'reference', 'note']) AS field,
  unnest([sh, 'A', concat('Sheet ', sh), NULL, NULL, reverse(sh), 'As built.']) AS value FROM {_SHEETS}"""))
def plant_metadata(spark, sf_dir):
    return query.metadata(_plant(spark, sf_dir, once=False))


@registered("plant_inventory", _with(" SELECT class, count(*) AS n FROM c GROUP BY 1"))
def plant_inventory(spark, sf_dir):
    return query.inventory(_plant(spark, sf_dir, once=False)).select("class", "n")


@registered("plant_breakers", _with(" SELECT id, rating AS value, id IN (SELECT src FROM a WHERE type = 'PROTECTS') AS protects FROM c WHERE class = 'circuit_breaker' AND rating IS NOT NULL"))
def plant_breakers(spark, sf_dir):
    """Each rated breaker, its current, and whether it protects a net."""
    n = _plant(spark, sf_dir)
    guards = n["relationships"].filter("type = 'PROTECTS'").select(F.col("src").alias("g")).distinct()
    own = n["components"].filter("class = 'circuit_breaker'").select(F.col("id").alias("c"))
    rated = query.attribute(n, "current").join(own, F.col("c") == F.col("id"), "left_semi")
    return rated.join(guards, F.col("g") == F.col("id"), "left").select("id", "value", F.col("g").isNotNull().alias("protects"))


_EDGES = """, r AS (
  SELECT 'HAS_TERMINAL' AS type, component AS src, t.id AS tgt, concat(component, ' has terminal ', t.id, '.') AS description, concat_ws('=', 'function', function) AS properties FROM t JOIN c ON c.id = t.component
  UNION ALL SELECT 'ON_NET', id, net, concat('Terminal ', id, ' is on net ', net, '.'), '' FROM t WHERE net IS NOT NULL
  UNION ALL SELECT 'CONNECTS_TO', from_terminal, to_terminal, concat('Wire ', id, ' joins ', from_terminal, ' and ', to_terminal, '.'), concat_ws(',', concat('wire=', id), concat_ws('=', 'wire_color', color), concat('wire_gauge=', gauge), concat('net=', net)) FROM w
  UNION ALL SELECT 'PART_OF', member, id, concat(member, ' is part of ', id, '.'), '' FROM g
  UNION ALL SELECT type, src, tgt, concat(src, ' ', lower(replace(type, '_', ' ')), ' ', tgt, '.'), '' FROM a
)"""


@registered("plant_counts", _with(_EDGES + f""" SELECT 'drawing' AS kind, count(*) AS n FROM {_SHEETS} UNION ALL SELECT 'components', count(*) FROM c UNION ALL SELECT 'terminals', count(*) FROM t UNION ALL SELECT 'nets', count(*) FROM s
UNION ALL SELECT 'wires', count(*) FROM w UNION ALL SELECT 'cables', count(*) FROM customer UNION ALL SELECT 'subsystems', count(DISTINCT id) FROM g UNION ALL SELECT 'relationships', count(*) FROM r"""))
def plant_counts(spark, sf_dir):
    return query.counts(_plant(spark, sf_dir))


@registered("plant_edges", _with(_EDGES + " SELECT * FROM r"))
def plant_edges(spark, sf_dir):
    """All typed edges: of terminals, nets, wires, subsystems and the authored ones, with their prose and properties."""
    r = _plant(spark, sf_dir)["relationships"]
    return r.select("type", "src", "tgt", "description", F.array_join(F.transform("properties", lambda p: F.concat_ws("=", p["k"], p["v"])), ",").alias("properties"))


@registered("plant_nets", _with(" SELECT net, 'wire' AS kind, id, NULL AS component FROM w UNION ALL SELECT net, 'terminal', id, component FROM t WHERE net IS NOT NULL"))
def plant_nets(spark, sf_dir):
    """What is on each net."""
    return query.net_explorer(_plant(spark, sf_dir))


@registered("plant_wires_at", _with(" SELECT DISTINCT component, id, from_terminal, to_terminal, color, gauge, cable, net FROM (SELECT *, unnest([from_component, to_component]) AS component FROM w)"))
def plant_wires_at(spark, sf_dir):
    """The wires that end at each component."""
    return query.wires_at(_plant(spark, sf_dir)).drop("drawing_no")


@registered("plant_shared_nets", _with(""", q AS (SELECT DISTINCT from_component AS one, to_component AS two FROM w)
SELECT one, two, m.net, m.id AS terminal_1, n.id AS terminal_2 FROM q JOIN t m ON m.component = one JOIN t n ON n.component = two AND n.net = m.net"""))
def plant_shared_nets(spark, sf_dir):
    """For each two components that a wire joins, all nets that both are on."""
    n = _plant(spark, sf_dir)
    part = lambda c: F.regexp_extract(c, "^(.*?):", 1)
    return query.shared_by_pairs(n, n["wires"].select(part("from_terminal").alias("one"), part("to_terminal").alias("two")).distinct())


@registered("plant_cables", _with(" SELECT cable, count(*) AS wires, string_agg(DISTINCT gauge, ', ' ORDER BY gauge) AS gauges FROM w WHERE cable IS NOT NULL GROUP BY 1"))
def plant_cables(spark, sf_dir):
    return query.cables(_plant(spark, sf_dir))


@registered("plant_power_domains", _with(" SELECT power_domain, count(*) AS n FROM c GROUP BY 1"))
def plant_power_domains(spark, sf_dir):
    return query.power_domains(_plant(spark, sf_dir, once=False))


@registered("plant_subsystems", _with(" SELECT id AS subsystem, count(*) AS n FROM g GROUP BY 1"))
def plant_subsystems(spark, sf_dir):
    return query.subsystems(_plant(spark, sf_dir))


@registered("plant_boundary", _with(" SELECT DISTINCT net, src AS interface, tgt AS beyond FROM a JOIN c ON c.id = tgt JOIN t ON t.component = src WHERE type = 'REFERENCES' AND c.class LIKE 'external%' AND net IS NOT NULL"))
def plant_boundary(spark, sf_dir):
    """Nets that leave their sheet, through what and to where."""
    return query.boundary_nets(_plant(spark, sf_dir))


@registered("plant_actuation", _with(""" SELECT d.src AS device, d.tgt AS relay, m.tgt AS contact, CASE WHEN c.id IS NULL THEN 'shown' ELSE 'undetermined' END AS status
FROM (SELECT * FROM a WHERE type = 'ACTUATES') d LEFT JOIN (SELECT * FROM a WHERE type = 'COIL_CONTROLS_CONTACT') m ON m.src = d.tgt LEFT JOIN c ON c.id = d.src AND c.class LIKE 'external%'"""))
def plant_actuation(spark, sf_dir):
    return query.actuation(_plant(spark, sf_dir))


@registered("plant_completeness", _with(""", e AS (SELECT id AS wire, net AS wire_net, unnest([from_terminal, to_terminal]) AS terminal FROM w)
SELECT DISTINCT 'wire end is no terminal' AS "check", terminal AS id FROM e WHERE terminal NOT IN (SELECT id FROM t)
UNION ALL SELECT DISTINCT 'wire and end are on different nets', wire FROM e JOIN t ON t.id = terminal WHERE net IS DISTINCT FROM wire_net
UNION ALL SELECT 'component without terminals', id FROM c WHERE id NOT IN (SELECT component FROM t)
UNION ALL SELECT 'terminal of an unknown component', id FROM t WHERE component NOT IN (SELECT id FROM c)
UNION ALL SELECT 'net without members', concat(sh, '#N', o) FROM s WHERE concat(sh, '#N', o) NOT IN (SELECT net FROM t WHERE net IS NOT NULL)
UNION ALL SELECT 'terminal with several wires', terminal FROM e GROUP BY terminal HAVING count(*) > 1
UNION ALL SELECT 'terminal without a net', id FROM t WHERE net IS NULL"""))
def plant_completeness(spark, sf_dir):
    """What a reviewer has to look at: the faults that the plant has."""
    return netlist.completeness(_plant(spark, sf_dir), tasks(table(spark, sf_dir, "lineitem")))


@registered("plant_fragments", _with(""", e AS MATERIALIZED (
  SELECT a.net, a.id AS a, b.id AS b FROM w JOIN t a ON a.id = w.from_terminal AND a.net = w.net JOIN t b ON b.id = w.to_terminal AND b.net = w.net
), d AS MATERIALIZED (
  SELECT net, a, b FROM e UNION ALL SELECT net, b, a FROM e
), r(net, v, o) AS (
  SELECT net, id, id FROM t WHERE net IS NOT NULL UNION SELECT r.net, r.v, d.b FROM r JOIN d ON d.net = r.net AND d.a = r.o
) SELECT net, count(DISTINCT least) AS pieces FROM (SELECT net, v, min(o) AS least FROM r GROUP BY ALL) GROUP BY 1""", True))
def plant_fragments(spark, sf_dir):
    """Into how many pieces each net falls if only its wires join terminals."""
    return query.wire_fragments(_plant(spark, sf_dir))


@registered("plant_prose", _with(f""", m AS (SELECT net, string_agg(id, ', ' ORDER BY id) AS members FROM t WHERE net IS NOT NULL GROUP BY 1), h AS (SELECT cable, string_agg(id, ', ' ORDER BY id) AS members FROM w WHERE cable IS NOT NULL GROUP BY 1), e AS (
  SELECT sh, sh AS id, 'drawing' AS kind, concat('Schematic ', sh, ': Sheet ', sh, '. Issue A. See also ', reverse(sh), '. Notes: As built.') AS description FROM {_SHEETS}
  UNION ALL SELECT sh, id, class, concat_ws(' ', concat(replace(class, '_', ' '), ' ', id, ', sheet ', sh, '.'), description, CASE WHEN rating IS NOT NULL THEN concat('Rated current = ', rating, '.') END,
    'Supplied from ' || power_domain || '.', 'Order as ' || part_number || '.', 'Other names: ' || alias || '.') FROM c
  UNION ALL SELECT sh, id, 'terminal', concat_ws(' ', concat('Terminal ', id, ' of ', component, '.'), 'Role: ' || replace(function, '_', ' ') || '.', coalesce('Wired to net ' || net || '.', 'No net.')) FROM t
  UNION ALL SELECT sh, concat(sh, '#N', o), 'net', concat_ws(' ', concat('Net ', sh, '#N', o, ' joins its terminals.'), CASE WHEN power THEN 'Signal: power. Rated voltage: 24V.' ELSE 'Signal: signal.' END, coalesce('Terminals: ' || members || '.', 'It has no terminals.')) FROM s LEFT JOIN m ON net = concat(sh, '#N', o)
  UNION ALL SELECT sh, id, 'wire', concat_ws(' ', concat('Wire ', id, ', ', concat_ws(' ', color, gauge), '.'), concat('From ', from_terminal, ' to ', to_terminal, '.'), 'Cable: ' || cable || '.', 'Net: ' || net || '.') FROM w
  UNION ALL SELECT concat(c_mktsegment, c_nationkey), concat(c_mktsegment, c_nationkey, '#C', c_custkey), 'cable', concat_ws(' ', concat('Cable ', c_mktsegment, c_nationkey, '#C', c_custkey, '.'), 'Its wires: ' || members || '.') FROM customer LEFT JOIN h ON cable = concat(c_mktsegment, c_nationkey, '#C', c_custkey)
  UNION ALL SELECT sh, id, 'subsystem', concat('Subsystem ', id, '. Its components: ', string_agg(member, ', ' ORDER BY member), '.') FROM g GROUP BY sh, id
) SELECT id AS entity_name, kind AS entity_type, description, concat(sh, '::entity::', id) AS source_id FROM e"""))
def plant_prose(spark, sf_dir):
    """The entity, with its prose, of every row of every sheet."""
    return kg.build(_plant(spark, sf_dir))["entities"].drop("file_path")


@registered("sheet_matching", """
WITH RECURSIVE c AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY page ORDER BY gap, label, role) AS n FROM (
    SELECT o_custkey AS page, l_partkey AS label, l_suppkey % 10 AS role, min(l_extendedprice) AS gap FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
), s(page, n, labels, roles, took) AS (
  SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false FROM c
  UNION ALL
  SELECT page, n, CASE WHEN free THEN list_append(labels, label) ELSE labels END, CASE WHEN free THEN list_append(roles, role) ELSE roles END, free FROM (
    SELECT c.*, labels, roles, NOT list_contains(labels, label) AND NOT list_contains(roles, role) AS free FROM s JOIN c ON c.page = s.page AND c.n = s.n + 1)
) SELECT page, label, role, gap FROM s JOIN c USING (page, n) WHERE took""")
def sheet_matching(spark, sf_dir):
    """Parts of each customer's orders given to groups of its suppliers, the cheapest first, each once."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = items.groupBy(F.col("o_custkey").alias("page"), F.col("l_partkey").alias("label"), (F.col("l_suppkey") % 10).alias("role")).agg(F.min("l_extendedprice").alias("gap"))
    return greedy_match(pairs, ["page", "label"], ["page", "role"], ["page", "gap", "label", "role"])
