"""Registered queries of the netlist library, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import graph, lines
from ..operators.components import components
from ..operators.matching import greedy_match
from ..operators.spatial import band_join, nearest
from ..shared import Tables, small_tasks
from ..sources import sheet
from ..sources.bridge import net_edges, points, table, terminals, wires
from ..streaming.events import sessions, windowed
from . import circuits, extract, kg, netlist, query, questions, simulate, tiles  # circuits and questions register their queries
from .registry import ORACLES, QUERIES, registered


def _values(columns: str, rows: list[tuple]) -> str:
    def shown(v):
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) AS t({columns})"


# Scale: star-schema tables as netlists

T_SQL = "(SELECT DISTINCT l_orderkey AS net, l_partkey AS part, concat(l_partkey, ':', l_orderkey) AS id FROM lineitem)"
W_SQL = f"(SELECT net, part AS from_part, to_part FROM (SELECT *, lead(part) OVER (PARTITION BY net ORDER BY part) AS to_part FROM {T_SQL}) WHERE to_part IS NOT NULL)"


@registered("net_members", f"SELECT o_orderkey AS net, coalesce(string_agg(id, ',' ORDER BY id), '') AS members, count(id) AS n FROM orders LEFT JOIN {T_SQL} ON net = o_orderkey GROUP BY 1")
def net_members(spark, sf_dir):
    nets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    out = netlist.members(nets, terminals(spark, sf_dir).withColumnRenamed("id", "member"), "net", "member", "members")
    return out.select(F.col("id").alias("net"), F.array_join("members", ",").alias("members"), F.size("members").cast("long").alias("n"))


@registered("wires_derived", f"SELECT * FROM {W_SQL}")
def wires_derived(spark, sf_dir):
    return wires(spark, sf_dir)


@registered("net_wire_vs_terminal_counts", f"SELECT t.net, t.n AS terminals, coalesce(w.n, 0) AS wires FROM (SELECT net, count(*) AS n FROM {T_SQL} GROUP BY 1) t LEFT JOIN (SELECT net, count(*) AS n FROM {W_SQL} GROUP BY 1) w USING (net)")
def net_wire_vs_terminal_counts(spark, sf_dir):
    t = terminals(spark, sf_dir).groupBy("net").agg(F.count("*").alias("terminals"))
    w = wires(spark, sf_dir).groupBy("net").agg(F.count("*").alias("wires"))
    return t.join(w, "net", "left").select("net", "terminals", F.coalesce("wires", F.lit(0)).alias("wires"))


@registered("component_fanout", f"SELECT part, count(DISTINCT net) AS nets FROM {T_SQL} GROUP BY 1")
def component_fanout(spark, sf_dir):
    return terminals(spark, sf_dir).groupBy("part").agg(F.count("net").alias("nets"))  # terminals are distinct already


@registered("double_landed_terminals", f"SELECT concat(part, ':', net) AS id, count(*) AS n FROM (SELECT net, from_part AS part FROM {W_SQL} UNION ALL SELECT net, to_part FROM {W_SQL}) GROUP BY 1 HAVING count(*) > 1")
def double_landed_terminals(spark, sf_dir):
    ends = wires(spark, sf_dir).select("net", F.explode(F.array("from_part", "to_part")).alias("part"))
    landed = ends.groupBy("net", "part").agg(F.count("*").alias("n")).filter("n > 1")
    return landed.select(F.concat_ws(":", F.col("part").cast("string"), F.col("net").cast("string")).alias("id"), "n")


@registered("floating_terminals", "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def floating_terminals(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select("l_partkey")
    return table(spark, sf_dir, "part").join(used, F.col("l_partkey") == F.col("p_partkey"), "left_anti").select(F.col("p_partkey").alias("id"))


@registered("dangling_refs", "SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_refs(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().join(known, F.col("c_custkey") == F.col("id"), "left_anti")


@registered("orphan_entities", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_entities(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("c_custkey").alias("id"))


@registered("duplicate_names", "SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@registered("rel_type_histogram", f"SELECT 'HAS_TERMINAL' AS type, count(*) AS n FROM {T_SQL} UNION ALL SELECT 'ON_NET', count(*) FROM {T_SQL} UNION ALL SELECT 'CONNECTS_TO', count(*) FROM {W_SQL} UNION ALL SELECT 'PART_OF', count(*) FROM part")
def rel_type_histogram(spark, sf_dir):
    kind = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("type"), "n")
    t = terminals(spark, sf_dir)
    return kind(t, "HAS_TERMINAL").union(kind(t, "ON_NET")).union(kind(wires(spark, sf_dir), "CONNECTS_TO")).union(kind(table(spark, sf_dir, "part"), "PART_OF"))


KG_SQL = (
    "SELECT concat('P', p_partkey) AS entity_name, lower(p_type) AS entity_type, concat(lower(p_type), ' P', p_partkey, ', sheet D1. ', p_name, ' Rated size = ', p_size, '. Other names: ', p_brand, ', ', p_type, '. Look for it in zone ', p_brand, '.') AS description FROM part "
    "UNION ALL SELECT concat('N', o_orderkey), 'net', concat('Net N', o_orderkey, ' joins its terminals. Signal: ', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN concat('. Terminals: T', o_orderkey, ', T', o_custkey, '.') ELSE '. It has no terminals.' END) FROM orders"
)


@registered("kg_entities", KG_SQL)
def kg_entities(spark, sf_dir):
    none = F.lit(None).cast("string")
    parts = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), "p_partkey").alias("id"), F.lower("p_type").alias("class"), F.col("p_name").alias("description"), F.array(F.struct(F.lit("size").alias("k"), F.col("p_size").cast("string").alias("v"))).alias("ratings"), F.array("p_brand", "p_type").alias("aliases"), F.col("p_brand").alias("zone"),
    )
    nets = table(spark, sf_dir, "orders").select(F.concat(F.lit("N"), "o_orderkey").alias("id"), F.col("o_orderstatus").alias("signal_type"), none.alias("nominal_voltage"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("T"), "o_orderkey"), F.concat(F.lit("T"), "o_custkey"))).otherwise(F.array().cast("array<string>")).alias("member_terminals"))
    a = parts.select(F.col("id").alias("entity_name"), F.col("class").alias("entity_type"), kg.describe_component(parts, F.lit("D1")).alias("description"))
    return a.union(nets.select("id", F.lit("net"), kg.describe_net(nets)))


@registered("kg_keywords", "SELECT l_orderkey AS a, l_linenumber AS b, l_shipdate AS c, concat_ws(', ', 'connects to', concat('wire: ', l_partkey), concat('wire_color: ', nullif(l_returnflag, 'N')), concat('net: ', l_orderkey)) AS keywords FROM (SELECT *, l_orderkey FROM lineitem) WHERE l_returnflag <> 'N' UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, concat_ws(', ', 'connects to', concat('wire: ', l_partkey), concat('net: ', l_orderkey)) FROM lineitem WHERE l_returnflag = 'N'")
def kg_keywords(spark, sf_dir):
    kv = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    properties = F.array(kv("wire", F.col("l_partkey")), kv("wire_color", F.nullif("l_returnflag", F.lit("N"))), kv("net", F.col("l_orderkey")))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_shipdate").alias("c"), kg.keywords(F.lit("CONNECTS_TO"), properties).alias("keywords"))


@registered("describe_wires", f"SELECT net, concat('Wire W', net, '-', from_part, CASE WHEN from_part % 3 = 0 THEN '' ELSE ', BLUE 18AWG' END, '. From ', from_part, ' to ', to_part, '.', CASE WHEN from_part % 5 = 0 THEN ' Cable: K5.' ELSE '' END, ' Net: ', net, '.') AS description FROM {W_SQL}")
def describe_wires(spark, sf_dir):
    w = wires(spark, sf_dir)
    bare = F.col("from_part") % 3 == 0
    df = w.select(
        "net", F.concat_ws("-", F.concat(F.lit("W"), F.col("net").cast("string")), F.col("from_part").cast("string")).alias("id"), F.when(~bare, "BLUE").alias("color"), F.when(~bare, "18AWG").alias("gauge"),
        F.col("from_part").cast("string").alias("from_terminal"), F.col("to_part").cast("string").alias("to_terminal"), F.when(F.col("from_part") % 5 == 0, "K5").alias("cable"),
    )
    return df.select("net", kg.describe_wire(df).alias("description"))


@registered("sentence_join", r"SELECT doc_id, regexp_replace(concat_ws(' ', nullif(trim(lang), ''), nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), ''), 'end..'), '\.\s*\.(\s|$)', '.\1', 'g') AS said FROM documents")
def sentence_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.sentence(F.col("lang"), F.col("text"), F.lit("end..")).alias("said"))


# Labels: tokens made from the star schema's values

ROLE_SQL = r"""
SELECT t AS text, CASE WHEN u = '' THEN 'empty'
  WHEN c AND len(list_filter(p, lambda x: regexp_matches(x, '^\d{1,2}\s*A[VW]G$', 'i'))) > 0 THEN 'wire_spec'
  WHEN c AND len(p) = 1 THEN 'wire_colour'
  WHEN len(p) = 1 AND (regexp_matches(u, '^[+-]?\d{1,3}\s*V(AC|DC)?$', 'i')) THEN 'voltage'
  WHEN len(p) = 1 AND regexp_matches(u, '^\d{1,4}$') THEN CASE WHEN length(u) <= 2 THEN 'terminal_number' ELSE 'net_number' END
  WHEN len(p) = 1 AND regexp_matches(u, '^(CR|CB|PB|PS|PLG|P|S|L|H|TB|FU|F|M|SW|LT|DISC|SPD|GND|PE)[-_]?[A-Z0-9]{0,6}$') THEN 'designator'
  WHEN len(p) = 1 AND regexp_matches(u, '^[A-Z]{1,2}\d{0,2}$') THEN 'terminal_number'
  WHEN len(p) >= 5 THEN 'note' ELSE 'text' END AS role
FROM (SELECT t, u, list_filter(regexp_split_to_array(u, '\s+'), lambda x: x <> '') AS p,
             list_contains(['BLACK','WHITE','BLUE','GREEN','RED','ORANGE','BROWN','GREY','GRAY','YELLOW','VIOLET','PURPLE','PINK','TAN','CLEAR','SHIELD'], string_split(string_split(u, ' ')[1], '/')[1]) AS c
      FROM (SELECT t, upper(trim(t)) AS u FROM (
        SELECT DISTINCT concat(CASE p_size % 4 WHEN 0 THEN 'BLUE ' WHEN 1 THEN 'CR' WHEN 2 THEN '' ELSE 'WHITE/RED ' END, p_size, CASE p_size % 3 WHEN 0 THEN 'AWG' WHEN 1 THEN '' ELSE 'V' END) AS t FROM part
        UNION SELECT DISTINCT p_name FROM part UNION SELECT DISTINCT c_mktsegment FROM customer)))
"""


def _label_texts(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    before = F.when(size % 4 == 0, "BLUE ").when(size % 4 == 1, "CR").when(size % 4 == 2, "").otherwise("WHITE/RED ")
    after = F.when(size % 3 == 0, "AWG").when(size % 3 == 1, "").otherwise("V")
    made = part.select(F.concat(before, size.cast("string"), after).alias("text"))
    return made.union(part.select("p_name")).union(table(spark, sf_dir, "customer").select("c_mktsegment")).distinct()


@registered("label_classify", ROLE_SQL)
def label_classify(spark, sf_dir):
    return _label_texts(spark, sf_dir).select("text", X.label_role(F.col("text")).alias("role"))


@registered("token_gauge_repair", r"""
SELECT token, CASE WHEN v IN (8,10,12,14,16,18,20,22,24) THEN concat(v, 'AWG') ELSE concat(CASE WHEN v = 7 THEN 8 WHEN v = 25 THEN 24 WHEN v BETWEEN 9 AND 23 THEN v - 1 END, 'AWG') END AS text
FROM (SELECT token, TRY_CAST(translate(token[:2], 'ILODGSB', '1100658') AS INTEGER) AS v FROM (SELECT DISTINCT concat(chr(CAST(65 + p_size % 26 AS INTEGER)), chr(CAST(48 + p_partkey % 10 AS INTEGER)), 'AWC') AS token FROM part))
WHERE v IN (8,10,12,14,16,18,20,22,24) OR v = 7 OR v = 25 OR v BETWEEN 9 AND 23""")
def token_gauge_repair(spark, sf_dir):
    letter = F.char(F.lit(65) + F.col("p_size") % 26)
    tokens = table(spark, sf_dir, "part").select(F.concat(letter, F.char(F.lit(48) + F.col("p_partkey") % 10), F.lit("AWC")).alias("token")).distinct()
    return tokens.withColumn("g", X.gauge(F.col("token"))).filter("g IS NOT NULL").select("token", F.col("g.text").alias("text"))


@registered("wire_spec_parse", r"""
SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CASE l_returnflag WHEN 'A' THEN 'BLUE' WHEN 'R' THEN 'WHITE/RED' END AS colour, concat(CAST(l_quantity AS INTEGER), 'AWG') AS gauge FROM lineitem""")
def wire_spec_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    said = F.concat_ws(" ", F.when(F.col("l_returnflag") == "A", "Blue").when(F.col("l_returnflag") == "R", "WHITE/RED").otherwise("CABLE"), F.lit("99AWG"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("awg")))
    colour, gauge = X.wire_spec(said)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", colour.alias("colour"), gauge.alias("gauge"))


@registered("fuzzy_lexicon")
def fuzzy_lexicon(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token")).union(_label_texts(spark, sf_dir).select("text"))
    return X.corrections(words)


@registered("edit_neighbours", "SELECT DISTINCT upper(w) AS token, l.word FROM (SELECT unnest(string_split(replace(text, 'ß', 'SS'), ' ')) AS w FROM documents) d JOIN (SELECT unnest(['" + "','".join(w.replace("'", "''") for w in X.LEXICON) + "']) AS word) l ON abs(length(upper(w)) - length(l.word)) <= 1 AND levenshtein(regexp_replace(upper(w), '[^\\x00-\\x7F]', '~', 'g'), l.word) <= 1 WHERE w <> ''")
def edit_neighbours(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.upper("text"), " ")).alias("token")).filter("token <> ''")
    return X.edit_neighbours(words)


@registered("line_correction", _values("raw, text, confidence", [("BLUE 1GAWG", "BLUE 16AWG", 0.9), ("OV", "0V", 0.9), ("WHITE/BLUE 10AVG", "WHITE/BLUE 10AWG", 0.98), ("SPD", "SPD", 0.9), ("P0WER", "POWER", 0.85), ("BREAKR", "BREAKER", 0.83), ("A1", "A1", 0.75), ("  ", "", 0.0)]))
def line_correction(spark, sf_dir):
    raw = spark.createDataFrame([(k, r) for k, r in enumerate(["BLUE 1GAWG", "OV", "WHITE/BLUE 10AVG", "SPD", "P0WER", "BREAKR", "A1", "  "])], "id int, raw string")
    return X.corrected_lines(raw).select("raw", "text", "confidence")


# Space: points, spans and polylines

@registered("band_join_labels", "SELECT a.event_id AS run, b.event_id AS label FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND epoch(a.ts) <= epoch(b.ts) + b.value AND epoch(b.ts) <= epoch(a.ts) + 36000")
def band_join_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    runs = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("run"), F.col("t").alias("r0"), (F.col("t") + 36000).alias("r1"))
    marks = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("label"), F.col("t").alias("l0"), (F.col("t") + F.col("value")).alias("l1"))
    return band_join(runs, marks, ["user_id"], ("r0", "r1"), ("l0", "l1"), 36000.0).select("run", "label")


@registered("nearest_symbol", "SELECT a.vec_id AS id, (SELECT arg_min(b.vec_id, (round(sqrt((a.embedding[1]::DOUBLE - b.embedding[1])^2 + (a.embedding[2]::DOUBLE - b.embedding[2])^2), 9), b.vec_id)) FROM embeddings b WHERE b.vec_id % 2 = 1 AND (a.embedding[1]::DOUBLE - b.embedding[1])^2 + (a.embedding[2]::DOUBLE - b.embedding[2])^2 <= 0.0004) AS nearest_id FROM embeddings a WHERE a.vec_id % 2 = 0")
def nearest_symbol(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("page", F.lit(1))
    ends, marks = p.filter("id % 2 = 0"), p.filter("id % 2 = 1").select("page", F.col("id").alias("symbol"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    return nearest(ends, marks, ["page"], ["id"], ("x", "y"), ("sx", "sy"), "symbol", "symbol", 0.02).select("id", "nearest_id")


@registered("greedy_match", _values("left_id, right_id, gap", [("A", "X", 2), ("B", "Y", 7), ("C", "Z", 1), ("D", "W", 5)]))
def greedy(spark, sf_dir):
    rows = [("A", "X", 2), ("A", "Y", 3), ("B", "X", 6), ("B", "Y", 7), ("C", "Z", 1), ("D", "Z", 1), ("D", "W", 5), ("C", "W", 4)]
    return greedy_match(spark.createDataFrame(rows, "left_id string, right_id string, gap int"), ["left_id"], ["right_id"], ["gap", "left_id", "right_id"])


@registered("polyline_measures", "SELECT o_custkey AS id, round(sum(sqrt((x - px)^2 + (y - py)^2)), 6) AS length, count(*) AS segments FROM (SELECT o_custkey, o_orderkey::DOUBLE AS x, o_totalprice AS y, lag(o_orderkey::DOUBLE) OVER w AS px, lag(o_totalprice) OVER w AS py FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE px IS NOT NULL GROUP BY 1")
def polyline_measures(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").alias("y")))).alias("p"))
    return rows.filter(F.size("p") > 1).select("id", F.round(G.length(F.col("p")), 6).alias("length"), (F.size("p") - 1).cast("long").alias("segments"))


@registered("text_line_islands", "SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 7200 THEN 0 ELSE 1 END AS new FROM events)")
def text_line_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return lines.gap_islands(e, ["user_id"], "t", ["t", "event_id"], 7200).select("event_id", F.col("island").cast("long").alias("island"))


@registered("orientation_kinds", "SELECT p_partkey AS id, CASE WHEN h <= 12 THEN 'h' WHEN w > 0 AND w <= 12 AND h / w > 2 THEN 'v' ELSE 'graphic' END AS orientation, CASE WHEN w <= 5 THEN 'terminal_point' ELSE 'device_circle' END AS kind FROM (SELECT p_partkey, p_size::DOUBLE AS w, (p_partkey % 40)::DOUBLE AS h FROM part)")
def orientation_kinds(spark, sf_dir):
    w, h, zero = F.col("p_size").cast("double"), (F.col("p_partkey") % 40).cast("double"), F.lit(0.0)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), G.orientation(zero, zero, w, h).alias("orientation"), G.symbol_kind(w).alias("kind"))


# Graphs

E_SQL = "(SELECT DISTINCT l_orderkey AS a, -1 - l_partkey AS b FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL)"
CC_SQL = f"""
WITH RECURSIVE u AS (SELECT a, b FROM {E_SQL} UNION ALL SELECT b, a FROM {E_SQL}),
r(v, low) USING KEY (v) AS (
  SELECT DISTINCT a, a FROM u
  UNION
  SELECT u.a, min(r.low) FROM r JOIN u ON u.b = r.v JOIN recurring.r AS old ON old.v = u.a WHERE r.low < old.low GROUP BY u.a
)
"""


def _named(e: DataFrame) -> DataFrame:
    tables = Tables(e.sparkSession)
    e = tables.cut(e, "edges")
    every = e.select("a").union(e.select("b")).distinct()
    named = every.join(components(e, tables), F.col("vertex") == F.col("a"), "left").select(F.col("a").alias("vertex"), F.coalesce("component", "a").alias("component"))
    with small_tasks(e.sparkSession):
        named = tables.cut(named, "named")
    tables.drop("edges", "stars")
    return named


@registered("nets_whole", CC_SQL + "SELECT v AS vertex, low AS component FROM r")
def nets_whole(spark, sf_dir):
    """Nets of all terminals: the component of each order and part, also held against a plain union-find in the tests."""
    return _named(net_edges(spark, sf_dir))


@registered("nets_cc", CC_SQL + "SELECT low AS component, count(*) FILTER (v >= 0) AS orders, count(*) FILTER (v < 0) AS parts FROM r GROUP BY 1")
def nets_cc(spark, sf_dir):
    """The size of each net of all terminals."""
    return _named(net_edges(spark, sf_dir)).groupBy("component").agg(F.count_if(F.col("vertex") >= 0).alias("orders"), F.count_if(F.col("vertex") < 0).alias("parts"))


@registered("degree_junctions", f"SELECT part AS node, count(*) AS degree FROM (SELECT from_part AS part FROM {W_SQL} UNION ALL SELECT to_part FROM {W_SQL}) GROUP BY 1 HAVING count(*) >= 3")
def degree_junctions(spark, sf_dir):
    ends = wires(spark, sf_dir).select(F.explode(F.array("from_part", "to_part")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).filter("degree >= 3")


@registered("mode_label", "SELECT part, arg_min(flag, (-n, first)) AS label, count(*) AS labels FROM (SELECT l_partkey AS part, l_returnflag AS flag, count(*) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def mode_label(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))
    return each.groupBy("part").agg(F.min_by("flag", F.struct(-F.col("n"), "first")).alias("label"), F.count("*").alias("labels"))


@registered("page_stats", "SELECT l_returnflag AS page, count(*) FILTER (l_quantity < 8) AS strokes, count(*) FILTER (l_quantity >= 8) AS segments, count(*) FILTER (l_discount = 0) AS flat, bool_or(l_tax = 0) AS any_free, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def page_stats(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("page")).agg(
        F.count_if(F.col("l_quantity") < 8).alias("strokes"), F.count_if(F.col("l_quantity") >= 8).alias("segments"), F.count_if(F.col("l_discount") == 0).alias("flat"), F.bool_or(F.col("l_tax") == 0).alias("any_free"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")
    )


@registered("sheet_paging", "SELECT p_partkey AS id, CAST(n // 12 + 1 AS INTEGER) AS sheet, CAST(n % 12 // 4 + 1 AS INTEGER) AS row, CAST(n % 12 % 4 + 1 AS INTEGER) AS col FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)")
def sheet_paging(spark, sf_dir):
    return tiles.sheets(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], 12, 4).select(F.col("p_partkey").alias("id"), "sheet", "row", "col")


@registered("tile_manifest", "SELECT concat('r', r, 'c', c) AS tile, greatest(0.0, (c - 1) * 306.0 - 30)::DOUBLE AS x0, greatest(0.0, (r - 1) * 198.0 - 30)::DOUBLE AS y0, least(1224.0, c * 306.0 + 30)::DOUBLE AS x1, least(792.0, r * 198.0 + 30)::DOUBLE AS y1 FROM range(1, 5) a(r), range(1, 5) b(c)")
def tile_manifest(spark, sf_dir):
    return tiles.tiles(spark.createDataFrame([(1, 1224, 792)], "page int, width int, height int"), 4, 4, 30.0).select("tile", "x0", "y0", "x1", "y1")


@registered("bom", "SELECT p_type AS class, p_brand AS brand, count(*) AS quantity, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY 1, 2")
def bom(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("class"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("quantity"), F.sum("p_size").alias("size"))


@registered("wire_label_list", f"SELECT net, unnest([1, 2]) AS end_no, unnest([concat(from_part, ':', net), concat(to_part, ':', net)]) AS terminal FROM {W_SQL}")
def wire_label_list(spark, sf_dir):
    at = lambda c: F.concat_ws(":", F.col(c).cast("string"), F.col("net").cast("string")).alias("terminal")
    return wires(spark, sf_dir).select("net", F.explode(F.array(F.struct(F.lit(1).alias("end_no"), at("from_part")), F.struct(F.lit(2).alias("end_no"), at("to_part")))).alias("e")).select("net", "e.*")


@registered("search", "SELECT 'part' AS kind, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE contains(lower(p_name), 're') UNION ALL SELECT 'customer', c_name FROM customer WHERE contains(lower(c_name), '00012')")
def search(spark, sf_dir):
    part = table(spark, sf_dir, "part").filter(F.contains(F.lower("p_name"), F.lit("re"))).select(F.lit("part").alias("kind"), F.col("p_partkey").cast("string").alias("id"))
    return part.union(table(spark, sf_dir, "customer").filter(F.contains(F.lower("c_name"), F.lit("00012"))).select(F.lit("customer"), "c_name"))


@registered("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@registered("event_sessions", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def event_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"))


# The example sheet

def _sheet(spark):
    return netlist.derive(sheet.authored(spark))


@registered("sheet_net_110", _values("kind, id", [("wire", "W047"), ("wire", "W058"), ("wire", "W059"), ("wire", "W060"), *(("terminal", t) for t in ("CR-BP:12", "CR-ON:A2", "CR-SW:14", "INFEED1:1", "TB-110:1", "TB-110:2", "TB-110:3", "TB-110:4"))]))
def sheet_net_110(spark, sf_dir):
    return query.net_explorer(_sheet(spark), "110").select("kind", "id")


@registered("sheet_counts", _values("kind, n", [("drawing", 1), ("components", 47), ("terminals", 131), ("nets", 26), ("wires", 71), ("cables", 8), ("subsystems", 7), ("relationships", 402)]))
def sheet_counts(spark, sf_dir):
    return query.counts(_sheet(spark))


@registered("sheet_inventory", _values("class, n", [("terminal_block", 19), ("relay", 5), ("circuit_breaker", 4), ("external_drawing", 4), ("cable_plug", 3), ("ground", 2), ("push_button", 2), ("connector_receptacle", 2), ("external_machine", 2), ("switch", 1), ("power_supply", 1), ("speed_controller", 1), ("indicator_light", 1)]))
def sheet_inventory(spark, sf_dir):
    return query.inventory(_sheet(spark)).select("class", "n")


@registered("sheet_breakers", _values("id, value, protects", [("CB1", "8A", True), ("CB2", "20A", True), ("REVERSE-CB", "5A", False), ("BYPASS-CB", "5A", False)]))
def sheet_breakers(spark, sf_dir):
    n = _sheet(spark)
    guards = n["relationships"].filter("type = 'PROTECTS'").select(F.col("src").alias("g")).distinct()
    own = n["components"].filter("class = 'circuit_breaker'").select(F.col("id").alias("c"))
    rated = query.attribute(n, "current").join(own, F.col("c") == F.col("id"), "left_semi")
    return rated.join(guards, F.col("g") == F.col("id"), "left").select("id", "value", F.col("g").isNotNull().alias("protects"))


@registered("sheet_metadata", _values("field, value", [("reference", "MXCS-M9"), ("reference", "MXCS-M11"), ("reference", "MXCS-P9"), ("reference", "MXCS-P11"), ("revision", None)]))
def sheet_metadata(spark, sf_dir):
    return query.metadata(_sheet(spark)).filter("field IN ('reference', 'revision')")


@registered("sheet_completeness", _values("name, n", [("component without terminals", 6), ("terminal with several wires", 11), ("terminal without a net", 4)]))
def sheet_completeness(spark, sf_dir):
    return netlist.completeness(_sheet(spark)).groupBy(F.col("check").alias("name")).agg(F.count("*").alias("n"))


@registered("sheet_fragments", _values("net, pieces", [("110", 4), ("120", 3), ("130", 2), ("GND", 3), ("24E-1", 12), ("0V", 12)]))
def sheet_fragments(spark, sf_dir):
    return query.wire_fragments(_sheet(spark)).filter("pieces > 1")


@registered("sheet_edges", _values("type, n", [("HAS_TERMINAL", 131), ("ON_NET", 127), ("CONNECTS_TO", 71), ("PART_OF", 41), ("POWERS", 7), ("PROTECTS", 3), ("ACTUATES", 6), ("COIL_CONTROLS_CONTACT", 6), ("GROUNDED_TO", 3), ("REFERENCES", 7)]))
def sheet_edges(spark, sf_dir):
    return _sheet(spark)["relationships"].groupBy("type").agg(F.count("*").alias("n"))


@registered("sheet_graph", _values("part, n", [("chunks", 693), ("entities", 291), ("relationships", 402), ("problems", 0), ("notes", 4)]))
def sheet_graph(spark, sf_dir):
    n = _sheet(spark)
    g = kg.build(n)
    found = kg.validate(g, n["terminals"]).agg(F.count_if(F.col("severity") == "problem").alias("p"), F.count_if(F.col("severity") == "note").alias("o"))
    out = None
    for name, df in g.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.union(part)
    return out.union(found.select(F.lit("problems"), "p")).union(found.select(F.lit("notes"), "o"))


@registered("sheet_path_125", _values('step, "at", via', [(0, "125", None), (1, "120", "BYPASS-CB 1-2"), (2, "121", "CR2 11-14"), (3, "0V", "CR1 11-14")]))
def sheet_path_125(spark, sf_dir):
    return query.path(_sheet(spark), "125", "0V")


@registered("sheet_actuation", _values("device, relay, contact, status", [("PB1", "CR1", "CR1:14", "shown"), ("PB2", "CR2", "CR2:14", "shown"), ("BYPASS-CB", "CR-BP", "CR-BP:24", "shown"), ("BYPASS-CB", "CR-BP", "CR-BP:12", "shown"), ("REVERSE-CB", "DIR", None, "shown"), ("DOWNSTREAM-MACHINE", "CR-SW", "CR-SW:14", "undetermined"), ("110", "CR-ON", "CR-ON:14", "shown")]))
def sheet_actuation(spark, sf_dir):
    return query.actuation(_sheet(spark))


@registered("sheet_cables", _values("cable, wires", [("CABLE-INFEED1", 6), ("CABLE-DISCHARGE1", 6), ("CABLE-PB1-START-STOP", 4), ("CABLE-PB2-START-STOP", 4), ("CABLE-RECEPT1", 4), ("CABLE-POWER-IN", 3), ("CABLE-POWER-OUT", 3), ("CABLE-LT1", 2)]))
def sheet_cables(spark, sf_dir):
    return query.cables(_sheet(spark)).select("cable", "wires")


@registered("sheet_truth_table", _values("scenario, run24, dir24, coils", [(s, s in (7, 15), s >= 8, ",".join(([] if s & 7 != 7 else ["CR-BP"]) + (["CR1"] if s & 1 else []) + (["CR2"] if s & 2 else []))) for s in range(16)]))
def sheet_truth_table(spark, sf_dir):
    """Bits of a scenario: PB1, PB2, bypass, reverse."""
    out = simulate.simulate(_sheet(spark), simulate.scenarios(spark, ["PB1", "PB2", "BYPASS-CB", "REVERSE-CB"]))
    if not out["settled"]:
        raise ValueError("some scenarios oscillate")
    state = out["nets"].groupBy("scenario").agg(F.bool_or((F.col("net") == "RUN") & F.col("has24")).alias("run24"), F.bool_or((F.col("net") == "DIR") & F.col("has24")).alias("dir24"))
    on = out["coils"].groupBy("scenario").agg(F.array_join(F.array_sort(F.collect_list("component")), ",").alias("coils"))
    return state.join(on, "scenario", "left").select(F.col("scenario").cast("int").alias("scenario"), "run24", "dir24", F.coalesce("coils", F.lit("")).alias("coils"))


@registered("net125_diagnosis", _values("switch, needed", [("BYPASS-CB 1-2", "closed by hand"), ("CR2 11-14", "coil energised"), ("CR1 11-14", "coil energised")]))
def net125_diagnosis(spark, sf_dir):
    """What must be closed for net 125 to reach 0V."""
    n = _sheet(spark)
    steps = query.path(n, "125", "0V").filter("via IS NOT NULL")
    kinds = simulate.switch_edges(n).select("switch", "hand")
    return steps.join(kinds, F.col("switch") == F.col("via")).select("switch", F.when(F.col("hand"), "closed by hand").otherwise("coil energised").alias("needed"))


SEGMENTS = [(0, 0, 10, 0), (10, 0, 20, 0), (20, 0, 30, 0), (20, 0, 20, 10), (50, 50, 60, 50), (60, 50, 60, 60), (60, 60, 50, 60), (50, 60, 50, 50)]


def _edges(spark):
    rows = [(1, k, *map(float, s)) for k, s in enumerate(SEGMENTS)]
    return graph.snap_nodes(spark.createDataFrame(rows, "page int, seg long, x0 double, y0 double, x1 double, y1 double"))


@registered("path_contract", _values("kind, length, n", [("conductor", 20.0, 2), ("conductor", 10.0, 1), ("conductor", 10.0, 1), ("box", 40.0, 4), ("junction", 0.0, 3)]))
def path_contract(spark, sf_dir):
    e = _edges(spark)
    runs = graph.contract(e).select(F.when(F.col("conductor"), "conductor").otherwise("box").alias("kind"), F.col("length"), F.col("segment_count").alias("n"))
    return runs.union(graph.junctions(e).select(F.lit("junction"), F.lit(0.0), "degree"))


@registered("label_attach", _values("id, net_label, color, gauge", [("C0001", "110", "BLUE", "18AWG"), ("C0002", "120", "RED", "16AWG")]))
def label_attach(spark, sf_dir):
    line = lambda g, y: (1, g, 0, "SCHEMATIC", "l", 0.0, y, 200.0, y, 0.0, y, 200.0, y)
    marks = spark.createDataFrame([line(1, 100.0), line(2, 110.0)], "page int, group_id long, item int, layer string, op string, x0 double, y0 double, x1 double, y1 double, group_x0 double, group_y0 double, group_x1 double, group_y1 double")
    boxes = [(1, 80.0, 93.0, 95.0, 97.0, "h", "110"), (1, 70.0, 102.0, 110.0, 106.0, "h", "BLUE 18AWG"), (1, 80.0, 106.5, 95.0, 108.5, "h", "120"), (1, 70.0, 112.0, 110.0, 116.0, "h", "RED 16AWG")]
    found = extract.extract(marks, spark.createDataFrame(boxes, "page int, x0 double, y0 double, x1 double, y1 double, orientation string, raw string"))
    return found["conductors"].select("id", "net_label", "color", "gauge")


@registered("baseline_bands")
def baseline_bands(spark, sf_dir):
    p = points(spark, sf_dir)
    glyphs = p.select(F.col("label").alias("page"), F.format_string("%06d", "id").alias("id"), (F.col("x") * 500).alias("x0"), (F.col("y") * 200).alias("y0"), (F.col("x") * 500 + 3).alias("x1"), (F.col("y") * 200 + 4).alias("y1"))
    return lines.text_lines(lines.baseline_bands(glyphs))


@registered("grid_clusters")
def grid_clusters(spark, sf_dir):
    p = points(spark, sf_dir)
    strokes = p.select(F.col("label").alias("page"), F.col("id").alias("stroke"), (F.col("x") * 40).alias("x0"), (F.col("y") * 40).alias("y0"), (F.col("x") * 40 + 0.5).alias("x1"), (F.col("y") * 40 + 0.5).alias("y1"))
    return graph.glyph_clusters(strokes)


# The library's own functions over whole tables

def _catalogue(spark, sf_dir) -> dict[str, DataFrame]:
    """A netlist of which only what a question reads is there: parts as components, orders as nets, customers as cables."""
    text = lambda c: F.col(c).cast("string")
    wire = wires(spark, sf_dir)
    id_ = F.concat_ws("-", F.concat(F.lit("W"), text("net")), text("from_part"))
    return {
        "components": table(spark, sf_dir, "part").select(F.concat(F.lit("P"), text("p_partkey")).alias("id"), F.when(F.col("p_size") == 7, "external_machine").otherwise(F.col("p_type")).alias("class"), F.col("p_brand").alias("part_number"), F.col("p_name").alias("description"), F.array("p_type").alias("aliases")),
        "terminals": terminals(spark, sf_dir).select("id", F.concat(F.lit("P"), text("part")).alias("parent_component"), text("net").alias("net")),
        "nets": table(spark, sf_dir, "orders").select(F.concat(F.lit("N"), text("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("description")),
        "wires": wire.select(id_.alias("id"), F.lit("BLUE").alias("color"), F.lit("18AWG").alias("gauge"), text("net").alias("net"), F.lit(None).cast("string").alias("cable"), F.concat_ws(":", text("from_part"), text("net")).alias("from_terminal"), F.concat_ws(":", text("to_part"), text("net")).alias("to_terminal")),
        "cables": table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("description")),
        "subsystems": table(spark, sf_dir, "nation").select(F.col("n_name").alias("id")),
    }


@registered("library_parts_list", "SELECT p_type AS class, p_brand AS part_number, count(*) AS quantity FROM part WHERE p_size <> 7 GROUP BY 1, 2")
def library_parts_list(spark, sf_dir):
    return query.bill_of_materials(_catalogue(spark, sf_dir))


@registered("library_search", f"""
SELECT 'components' AS kind, concat('P', p_partkey) AS id FROM part WHERE contains(lower(concat_ws(' ', concat('P', p_partkey), p_name, p_type)), 're')
UNION ALL SELECT 'nets', concat('N', o_orderkey) FROM orders WHERE contains(lower(o_orderpriority), 're')
UNION ALL SELECT 'cables', c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), 're')
UNION ALL SELECT 'subsystems', n_name FROM nation WHERE contains(lower(n_name), 're')""")
def library_search(spark, sf_dir):
    return query.search(_catalogue(spark, sf_dir), "re")


@registered("library_wire_labels", f"""SELECT concat('W', net, '-', from_part) AS id, unnest([1, 2]) AS "end", unnest([concat(from_part, ':', net), concat(to_part, ':', net)]) AS terminal, 'BLUE' AS color, '18AWG' AS gauge, CAST(net AS VARCHAR) AS net FROM {W_SQL}""")
def library_wire_labels(spark, sf_dir):
    return query.wire_labels(_catalogue(spark, sf_dir)).drop("cable")


@registered("library_pin_out", f"WITH t AS (SELECT concat(part, ':', net) AS id, part, net FROM {T_SQL}) SELECT a.id AS terminal, CAST(a.net AS VARCHAR) AS net, b.id AS other FROM t a LEFT JOIN t b ON a.net = b.net AND a.id <> b.id WHERE a.part = 7")
def library_pin_out(spark, sf_dir):
    return query.pin_out(_catalogue(spark, sf_dir), "P7")


@registered("library_shared_nets", f"SELECT CAST(a.net AS VARCHAR) AS net, a.id AS terminal_1, b.id AS terminal_2 FROM {T_SQL} a JOIN {T_SQL} b ON a.net = b.net WHERE a.part = 3 AND b.part = 11")
def library_shared_nets(spark, sf_dir):
    return query.shared_nets(_catalogue(spark, sf_dir), "P3", "P11")


S_SQL = "(SELECT DISTINCT l_returnflag AS d, l_orderkey % 1000 AS net, l_partkey AS part FROM lineitem)"


@registered("sheets_members", f"SELECT concat(d, '#', net) AS id, string_agg(concat(d, '#', part, ':', net), ',' ORDER BY concat(d, '#', part, ':', net)) AS members FROM {S_SQL} GROUP BY d, net")
def sheets_members(spark, sf_dir):
    """Members of nets of several sheets whose ids clash: a return flag is a drawing, and orders share 1,000 net ids."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("drawing_no"), (F.col("l_orderkey") % 1000).cast("string").alias("net"), F.col("l_partkey").cast("string").alias("component")).distinct()
    sheets = netlist.qualified({
        "drawing": rows.select(F.col("drawing_no").alias("drawing_number")).distinct(),
        "terminals": rows.select("drawing_no", F.concat_ws(":", "component", "net").alias("id"), F.col("component").alias("parent_component"), "net"),
        "nets": rows.select("drawing_no", F.col("net").alias("id")).distinct(),
    })
    return netlist.members(sheets["nets"], sheets["terminals"], "net", "id", "members").select("id", F.array_join("members", ",").alias("members"))


SHEETS_SQL = """
WITH s AS (SELECT unnest(['A', 'B']) AS d),
c AS (SELECT d, concat(d, '#', id) AS entity_name, kind FROM s, (VALUES ('R1', 'relay'), ('N1', 'net'), ('R1:1', 'terminal'), ('R1:2', 'terminal')) v(id, kind) UNION ALL SELECT d, concat('sheet ', d), 'drawing' FROM s)
SELECT entity_name, kind AS entity_type, concat(d, '::entity::', entity_name) AS source_id FROM c
UNION ALL SELECT concat(d, '#R1', t), 'ON_NET', concat(d, '::rel::0000', n) FROM s, (VALUES (':1', 3), (':2', 4)) v(t, n)
UNION ALL SELECT concat(d, '#R1'), 'HAS_TERMINAL', concat(d, '::rel::0000', n) FROM s, (VALUES (1), (2)) v(n)
"""


def _two_sheets(spark) -> dict[str, DataFrame]:
    """Two sheets with the same ids: a relay with two terminals on one net."""
    rows = lambda values, schema: spark.createDataFrame(values, schema)
    both = lambda *values: [(d, *v) for d in "AB" for v in values]
    kv = "array<struct<k:string,v:string>>"
    return {
        "drawing": rows([(d, "1", "t", None, None, [], []) for d in ("A", "B")], "drawing_number string, revision string, title string, date string, assembly string, references array<string>, notes array<string>"),
        "components": rows(both(("R1", "relay", "a relay of the test", [], [], 1)), f"drawing_no string, id string, class string, description string, ratings {kv}, aliases array<string>, ord int"),
        "terminals": rows(both(("R1", "1", None, "N1", 1), ("R1", "2", None, "N1", 2)), "drawing_no string, component string, terminal string, function string, net string, ord int"),
        "nets": rows(both(("N1", "signal", None, 1)), "drawing_no string, id string, signal_type string, nominal_voltage string, ord int"),
        "wires": rows([], "drawing_no string, from_terminal string, to_terminal string, color string, gauge string, net string, cable string, ord int"),
        "cables": rows([], "drawing_no string, id string, ord int"), "subsystems": rows([], "drawing_no string, id string, member_components array<string>, ord int"), "edges": rows([], "drawing_no string, type string, src string, tgt string, ord int"),
    }


@registered("sheets_graph", SHEETS_SQL)
def sheets_graph(spark, sf_dir):
    """Entities and relationships of two sheets whose ids clash."""
    g = kg.build(netlist.derive(netlist.qualified(_two_sheets(spark))))
    name = F.when(F.col("entity_type") == "drawing", F.concat(F.lit("sheet "), "entity_name")).otherwise(F.col("entity_name"))
    source = F.when(F.col("entity_type") == "drawing", F.concat(F.col("entity_name"), F.lit("::entity::sheet "), F.col("entity_name"))).otherwise(F.col("source_id"))
    return g["entities"].select(name.alias("entity_name"), "entity_type", source.alias("source_id")).union(g["relationships"].select("src_id", "type", "source_id"))


def _faulty(spark, sf_dir) -> dict[str, DataFrame]:
    """A graph with faults of each kind: parts by name are entities, terminals are relationships to orders."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity_name"), F.lower("p_type").alias("entity_type"), F.concat_ws(" ", "p_name", "p_type").alias("description"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("source_id"), (F.col("p_size") % 10 == 0).alias("lost"))
    rel = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("source_id"), F.when(F.col("o_orderstatus") == "P", "MADE_UP").otherwise("ON_NET").alias("type"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src_id"), F.col("o_orderpriority").alias("tgt_id"), F.when(F.col("o_orderkey") % 9 > 0, "on net").otherwise(" ").alias("keywords"),
    )
    return {"entities": part.drop("lost"), "relationships": rel, "chunks": part.filter("NOT lost").select("source_id")}


FAULTS_SQL = """
WITH e AS (SELECT p_name AS n, concat('s', p_partkey) AS s, length(concat(p_name, ' ', p_type)) AS l, p_size % 10 = 0 AS lost FROM part), r AS (SELECT * FROM orders)
SELECT 'problem' AS severity, 'duplicate entity name' AS "check", n AS id FROM e GROUP BY n HAVING count(*) > 1
UNION ALL SELECT 'problem', 'undefined end of a relationship', id FROM (SELECT concat('c', o_custkey) AS id FROM r UNION SELECT o_orderpriority FROM r) WHERE id NOT IN (SELECT n FROM e)
UNION ALL SELECT 'problem', 'entity without a chunk', n FROM e WHERE lost
UNION ALL SELECT DISTINCT 'problem', 'unknown relationship type', 'MADE_UP' FROM r WHERE o_orderstatus = 'P'
UNION ALL SELECT 'problem', 'short description', n FROM e WHERE l < 25
UNION ALL SELECT 'problem', 'relationship without keywords', concat('r', o_orderkey) FROM r WHERE o_orderkey % 9 = 0
UNION ALL SELECT 'note', 'terminal without a net', concat('t', l_orderkey, '-', l_linenumber) FROM lineitem WHERE l_returnflag = 'A'
"""


@registered("library_validate", FAULTS_SQL)
def library_validate(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))).alias("id"), F.when(F.col("l_returnflag") != "A", F.col("l_orderkey")).alias("net"))
    return kg.validate(_faulty(spark, sf_dir), t)


@registered("library_report", "SELECT 'entities' AS section, lower(p_type) AS name, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'relationships', CASE WHEN o_orderstatus = 'P' THEN 'MADE_UP' ELSE 'ON_NET' END, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'unused', unnest(['HAS_TERMINAL', 'CONNECTS_TO', 'POWERS', 'PROTECTS', 'ACTUATES', 'COIL_CONTROLS_CONTACT', 'PART_OF', 'GROUNDED_TO', 'REFERENCES']), 0")
def library_report(spark, sf_dir):
    return kg.report(_faulty(spark, sf_dir))


def _marks(spark, sf_dir) -> DataFrame:
    """Line items as drawing primitives: the flag is the page, the quantity the length, the status the layer."""
    x = F.col("l_quantity")
    at = [F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), x.alias("x1"), F.lit(0.0).alias("y1")]
    box = [F.lit(0.0).alias("group_x0"), F.lit(0.0).alias("group_y0"), x.alias("group_x1"), (x * (1 + F.col("l_discount") * 10)).alias("group_y1")]
    op = F.when(F.col("l_linenumber") == 1, "c").when(F.col("l_linenumber") == 2, "re").otherwise("l")
    group = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").alias("page"), group.alias("group_id"), F.lit(0).alias("item"), F.col("l_linestatus").alias("layer"), op.alias("op"), *at, *box)


@registered("library_routes", """
SELECT ascii(l_returnflag) AS page, CASE WHEN l_linenumber = 1 AND abs(l_quantity * l_discount * 10) < 0.6 * l_quantity * (1 + l_discount * 10) THEN 'route circle'
  WHEN l_linenumber = 1 THEN 'route stroke' WHEN l_linenumber = 2 THEN 'route rect' WHEN l_quantity < 8 THEN 'route stroke' ELSE 'route segment' END AS name, count(*) AS n FROM lineitem GROUP BY 1, 2
UNION ALL SELECT ascii(l_returnflag), concat('layer ', l_linestatus), count(*) FROM lineitem GROUP BY 1, 2""")
def library_routes(spark, sf_dir):
    return extract.stats(extract.routed(_marks(spark, sf_dir)), {})


L_SQL = "(SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'graphic' ELSE 'h' END AS orientation, value / 300 AS confidence, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS text, user_id AS page FROM events)"


def _doubtful(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("page"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "graphic").otherwise("h").alias("orientation"), (F.col("value") / 300).alias("confidence"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("text"),
        F.col("value").alias("x0"), F.lit(10.0).alias("y0"), (F.col("value") + 20).alias("x1"), F.lit(14.0).alias("y1"),
    )


@registered("crop_targets", f"SELECT page, id FROM {L_SQL} WHERE orientation <> 'graphic' AND (confidence < 0.7 OR text = '')")
def crop_targets(spark, sf_dir):
    """Labels that a person has to look at, as crops: those of the review queue that are doubtful and no graphic."""
    names = _doubtful(spark, sf_dir)
    none = spark.createDataFrame([], "page long, id string, net_label string, color string, gauge string, endpoints array<double>")
    nets = spark.createDataFrame([], "page long, id string, conflicting_labels boolean, labels_seen array<string>, member_conductors array<string>")
    queue = extract.review_queue(names.withColumn("raw_ocr", F.col("text")).withColumn("id", F.col("id").cast("string")), none, nets)
    return tiles.crop_targets(names.withColumn("id", F.col("id").cast("string")), queue).select("page", F.col("id").cast("long").alias("id"))


CROPS = ["40", "7", "100", "7", "3", "99999999", "11"]


@registered("crop_list", f"SELECT i.place, l.page, l.id FROM {L_SQL} l JOIN (SELECT unnest({CROPS}) AS id, CAST(unnest(range({len(CROPS)})) AS INTEGER) AS place) i ON CAST(l.id AS VARCHAR) = i.id WHERE orientation <> 'graphic'")
def crop_list(spark, sf_dir):
    """Labels by a list of ids, in its order, as it repeats them and without graphics."""
    return tiles.crop_targets(_doubtful(spark, sf_dir), None, CROPS).select("place", "page", "id")


@registered("crop_boxes", "SELECT event_id AS id, CAST(floor(greatest(0.0::DOUBLE, (value - 2.5) * (600::DOUBLE / 72))) AS INTEGER) AS left_px, false AS too_small FROM events WHERE value < 1200")
def crop_boxes(spark, sf_dir):
    """The left edge, in pixels, of the padded crop of each label."""
    size = F.lit(1224.0)
    box = tiles.crop(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size, size)
    return _doubtful(spark, sf_dir).filter("x0 < 1200").select("id", box["left"].alias("left_px"), box["too_small"].alias("too_small"))


N_SQL = "(SELECT o_custkey % 50 AS page, o_orderkey AS id, o_custkey AS node, CASE WHEN o_orderkey % 3 > 0 THEN concat(o_custkey % 7, '-', o_orderstatus) END AS label FROM orders)"


@registered("library_nets", f"""
WITH RECURSIVE c AS (SELECT * FROM {N_SQL}),
u AS (SELECT page, concat('i', id) AS a, concat('n', node) AS b FROM c UNION ALL SELECT page, concat('i', id), concat('l', label) FROM c WHERE label IS NOT NULL),
both_ AS (SELECT page, a, b FROM u UNION ALL SELECT page, b, a FROM u),
r(page, v, low) USING KEY (page, v) AS (
  SELECT DISTINCT page, a, a FROM both_
  UNION
  SELECT k.page, k.a, min(r.low) FROM r JOIN both_ k ON k.b = r.v AND k.page = r.page JOIN recurring.r AS old ON old.v = k.a AND old.page = k.page WHERE r.low < old.low GROUP BY k.page, k.a
), m AS (SELECT c.*, r.low FROM c JOIN r ON r.v = concat('i', c.id) AND r.page = c.page),
n AS (SELECT page, low, label, count(*) AS n, min(format('C{{:09d}}', id)) AS first FROM m WHERE label IS NOT NULL GROUP BY ALL),
w AS (SELECT page, low, arg_min(label, (-n, first)) AS name, count(*) AS seen FROM n GROUP BY ALL),
a AS (SELECT page, low, count(*) AS size, min(format('C{{:09d}}', id)) AS first FROM m GROUP BY ALL)
SELECT a.page, coalesce(w.name, format('NET-UNLABELLED-{{:03d}}', row_number() OVER (PARTITION BY a.page ORDER BY first))) AS id, a.size AS conductors, coalesce(w.seen, 0) > 1 AS conflicting FROM a LEFT JOIN w ON w.page = a.page AND w.low = a.low""")
def library_nets(spark, sf_dir):
    """Nets of orders as conductors: customers are nodes, a third of the orders has no label."""
    o = table(spark, sf_dir, "orders")
    wires_ = o.select((F.col("o_custkey") % 50).alias("page"), F.format_string("C%09d", "o_orderkey").alias("id"), F.array("o_custkey").alias("end_nodes"), F.when(F.col("o_orderkey") % 3 > 0, F.concat_ws("-", (F.col("o_custkey") % 7).cast("string"), "o_orderstatus")).alias("net_label"))
    return graph.nets(wires_).select("page", "id", F.col("conductor_count").cast("long").alias("conductors"), F.col("conflicting_labels").alias("conflicting"))


C_SQL = "(SELECT o_custkey % 5 AS page, o_orderkey % 4 = 0 AS net, o_orderkey % 7 < 2 AS spec FROM orders)"


@registered("library_counters", f"""
WITH m AS (SELECT ascii(l_returnflag) AS page, l_linenumber, l_quantity AS q, l_discount AS d FROM lineitem),
r AS (SELECT page, CASE WHEN l_linenumber = 1 AND abs(q * d * 10) < 0.6 * q * (1 + d * 10) THEN 'circle' WHEN l_linenumber = 1 THEN 'stroke' WHEN l_linenumber = 2 THEN 'rect' WHEN q < 8 THEN 'stroke' ELSE 'segment' END AS route FROM m),
o AS (SELECT page, count(*) FILTER (route = 'stroke') AS glyph_strokes, count(*) FILTER (route = 'segment') AS conductor_segments FROM r GROUP BY 1),
l AS (SELECT page, count(*) FILTER (orientation <> 'graphic') AS text_labels, count(*) FILTER (text <> '') AS labels_read, count(*) FILTER (orientation <> 'graphic' AND confidence < 0.7) AS labels_low_confidence FROM {L_SQL} GROUP BY 1),
c AS (SELECT page, count(*) AS conductors, count(*) FILTER (net) AS conductors_with_net_label, count(*) FILTER (spec) AS conductors_with_spec_label FROM {C_SQL} GROUP BY 1),
n AS (SELECT c_nationkey AS page, count(*) AS nets, count(*) FILTER (c_acctbal > 0) AS nets_labelled FROM customer GROUP BY 1),
s AS (SELECT p_size AS page, count(*) FILTER (p_retailprice < 950) AS symbols_terminal_points, count(*) FILTER (p_retailprice >= 950) AS symbols_device_circles FROM part GROUP BY 1)
SELECT page, name, n FROM (UNPIVOT o ON COLUMNS(* EXCLUDE page) INTO NAME name VALUE n) UNION ALL SELECT page, name, n FROM (UNPIVOT l ON COLUMNS(* EXCLUDE page) INTO NAME name VALUE n)
UNION ALL SELECT page, name, n FROM (UNPIVOT c ON COLUMNS(* EXCLUDE page) INTO NAME name VALUE n) UNION ALL SELECT page, name, n FROM (UNPIVOT n ON COLUMNS(* EXCLUDE page) INTO NAME name VALUE n)
UNION ALL SELECT page, name, n FROM (UNPIVOT s ON COLUMNS(* EXCLUDE page) INTO NAME name VALUE n)""")
def library_counters(spark, sf_dir):
    """The counters with a condition, over tables of which orders are conductors, customers nets and parts symbols."""
    o = table(spark, sf_dir, "orders")
    tables_ = {
        "labels": _doubtful(spark, sf_dir),
        "conductors": o.select((F.col("o_custkey") % 5).alias("page"), F.when(F.col("o_orderkey") % 4 == 0, "N").alias("net_label"), F.when(F.col("o_orderkey") % 7 < 2, "BLUE").otherwise("").alias("spec_label")),
        "nets": table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("page"), (F.col("c_acctbal") > 0).alias("labelled")),
        "symbols": table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), F.when(F.col("p_retailprice") < 950, "terminal_point").otherwise("device_circle").alias("kind")),
    }
    return extract.counters(extract.routed(_marks(spark, sf_dir)), tables_).select(F.col("page").cast("long").alias("page"), "name", "n")


@registered("tile_labels", "SELECT page, id, concat('r', r, 'c', c) AS tile, orientation <> 'graphic' AND (confidence < 0.7 OR text = '') AS flagged FROM (SELECT l.*, value FROM " + L_SQL + " l JOIN events ON event_id = l.id), range(1, 3) a(r), range(1, 4) b(c) WHERE value < least(600.0, c * 200 + 10) AND value + 20 > greatest(0.0, (c - 1) * 200 - 10) AND 10 < least(40.0, r * 20 + 10) AND 14 > greatest(0.0, (r - 1) * 20 - 10)")
def tile_labels(spark, sf_dir):
    """Labels on the tiles of their page, with a flag on those that are doubtful."""
    names = _doubtful(spark, sf_dir)
    pages = names.select("page").distinct().select("page", F.lit(600).alias("width"), F.lit(40).alias("height"))
    queue = names.filter("orientation <> 'graphic' AND (confidence < 0.7 OR text = '')").select("page", "id", F.lit("low_confidence_label").alias("kind"))
    return tiles.annotated(names, tiles.tiles(pages, 2, 3, 10.0), queue).select("page", "id", "tile", "flagged")


@registered("embedded_text", "SELECT bool_or(trim(coalesce(html, '')) <> '') AS has_embedded_text, CASE WHEN bool_or(trim(coalesce(html, '')) <> '') THEN 'strokes, beside embedded text' ELSE 'strokes alone: every label has to be verified' END AS text_source FROM pages")
def embedded_text(spark, sf_dir):
    return extract.text_source(table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.col("html").alias("text")))


# Further questions about the example sheet

@registered("sheet_pin_out", _values("terminal, net, others", [("CR1:11", "0V", 24), ("CR1:14", "121", 1), ("CR1:A1", "NET-PB1", 1), ("CR1:A2", "0V", 24)]))
def sheet_pin_out(spark, sf_dir):
    return query.pin_out(_sheet(spark), "CR1").groupBy("terminal", "net").agg(F.count("other").alias("others"))


@registered("sheet_shared_nets", _values("net, terminal_1, terminal_2", [("+24V", "CB2:1", "PS1:+")]))
def sheet_shared_nets(spark, sf_dir):
    return query.shared_nets(_sheet(spark), "CB2", "PS1")


@registered("sheet_wires_at", _values("id, from_terminal, to_terminal, net", [("W021", "TB-24E1-A:3", "PB1:1", "24E-1"), ("W038", "PB1:2", "TB-PB1SP:1", "PB1-SP"), ("W039", "PB1:3", "TB-0V:5", "0V"), ("W040", "PB1:4", "CR1:A1", "NET-PB1")]))
def sheet_wires_at(spark, sf_dir):
    return query.wires_at(_sheet(spark), "PB1").select("id", "from_terminal", "to_terminal", "net")


@registered("sheet_power_domains", _values("power_domain, n", [("0V_common", 5), ("115VAC", 6), ("24VDC", 14), ("control_signal", 22)]))
def sheet_power_domains(spark, sf_dir):
    return query.power_domains(_sheet(spark))


@registered("sheet_loses_power", _values("breaker, net, components", [("CB1", "24E-1", 12), ("CB2", "24E-1", 12)]))
def sheet_loses_power(spark, sf_dir):
    n = _sheet(spark)
    lost = [query.loses_power(n, b).groupBy("net").agg(F.count("*").alias("components")).select(F.lit(b).alias("breaker"), "net", "components") for b in ("CB1", "CB2")]
    return lost[0].union(lost[1])


@registered("sheet_subsystems", _values("subsystem, n", [("SUB-115VAC-INPUT", 7), ("SUB-24VDC-SUPPLY", 8), ("SUB-BYPASS", 2), ("SUB-MACHINE-INTERFACE", 7), ("SUB-OPERATOR-CONTROL", 8), ("SUB-RUN-CONTROL", 5), ("SUB-SPEED-DIRECTION", 4)]))
def sheet_subsystems(spark, sf_dir):
    return query.subsystems(_sheet(spark))


@registered("sheet_boundary_nets", _values("interface, beyond, nets", [("DISCHARGE1", "DOWNSTREAM-MACHINE", "0V,111,120,130,DINSP1,DINSP2"), ("INFEED1", "UPSTREAM-MACHINE", "0V,110,120,130,IINSP1,IINSP2"), ("RECEPT1", "MXCS-P9", "0V,24E-1,DIR,RUN,SPD")]))
def sheet_boundary_nets(spark, sf_dir):
    return query.boundary_nets(_sheet(spark)).groupBy("interface", "beyond").agg(F.array_join(F.array_sort(F.collect_list("net")), ",").alias("nets"))


@registered("sheet_path_status", _values('"start", goal, status', [("125", "0V", "connected"), ("SPD", "125", "undetermined"), ("L1", "N", "none")]))
def sheet_path_status(spark, sf_dir):
    n = _sheet(spark)
    rows = [query.path_status(n, a, b) for a, b in (("125", "0V"), ("SPD", "125"), ("L1", "N"))]
    return rows[0].union(rows[1]).union(rows[2])


@registered("sheet_missing_edges", _values("type, implied_by", [("POWERS", "power_supply")]))
def sheet_missing_edges(spark, sf_dir):
    """What a build warns of once the edges from the supply are taken away."""
    g = kg.build(_sheet(spark))
    return kg.missing_edges(g | {"relationships": g["relationships"].filter("type <> 'POWERS'")})
