"""Graphs at the size of orders and lineitem: strongly connected components, levels, spread, reach; flow texts as tables.

Components: every node takes the greatest node that leads to it as its colour, along edges and by jumps (the colour of a node's colour leads to it
too). Nodes with one edge in look back twice as far each round first, so that chains take a logarithmic number of rounds; of a colour, what leads back to the node of that name is a component. All colours are
worked on at once, edges between colours and nodes that nothing leads to or that lead nowhere are trimmed, and what is left goes on. Each round is a few joins on keys, cut
from its plan; where one side has few nodes the edges stay where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..plans.staging import cut, kept
from ..sources.tables import table
from . import graphs

#: Rounds of trimming before each colouring: colouring does the rest.
TRIMS = 3
#: Every so many rounds of colouring colours jump as well: a jump costs as much as a round.
JUMPS = 4


def trimmed(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) whose ends have an edge in and an edge out, as far as a few rounds find them."""
    for _ in range(TRIMS):
        ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out")))
        loose = kept(ends.groupBy("node").agg(F.min("out").alias("a"), F.max("out").alias("b")).filter("a = b").select("node"))
        if loose.isEmpty():
            break
        loose = graphs.few(loose)
        edges = kept(edges.join(loose.withColumnRenamed("node", "src"), "src", "left_anti").join(loose.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    return edges


def coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that leads to each node, itself included. Only nodes whose colour has just changed hand it on."""
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to")).filter("n = 1")
    back = kept(back.select("node", "to", F.greatest("node", "to").alias("most")))
    for _ in range(back.count().bit_length()):
        far = back.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("most").alias("beyond"))
        new = kept(back.join(far, "to", "left").select("node", F.coalesce("further", "to").alias("to"), F.greatest("most", F.coalesce("beyond", "most")).alias("most")))
        same = new.join(back, ["node", "to", "most"], "left_anti").isEmpty()
        back = new
        if same:
            break
    edges = edges.select("src", "dst").unionByName(back.select(F.col("to").alias("src"), F.col("node").alias("dst")))
    first = edges.select(F.col("src").alias("node"), F.col("src").alias("colour")).unionByName(edges.select(F.col("dst").alias("node"), F.greatest("src", "dst").alias("colour")))
    first = first.unionByName(back.select("node", F.col("most").alias("colour")))
    colours = kept(first.groupBy("node").agg(F.max("colour").alias("colour")).select("node", "colour", (F.col("colour") > F.col("node")).alias("fresh")))
    step = 0
    while True:
        fresh = colours.filter("fresh").select(F.col("node").alias("src"), "colour")
        if fresh.isEmpty():
            return colours.select("node", "colour")
        step += 1
        along = edges.join(graphs.few(fresh), "src").select(F.col("dst").alias("node"), "colour", F.lit(None).cast("long").alias("old"))
        stay = colours.select("node", F.col("colour").alias("old"))
        if step % JUMPS == 0:  # to the colours of the nodes that colours are named by
            used = kept(stay.select(F.col("old").alias("node")).distinct())
            moved = kept(colours.filter("colour > node").join(graphs.few(used), "node", "left_semi").select(F.col("node").alias("old"), F.col("colour").alias("far")))
            stay = stay.join(graphs.few(moved), "old", "left").select("node", F.coalesce("far", "old").alias("colour"), "old")
        new = along.unionByName(stay.select("node", F.col("colour" if step % JUMPS == 0 else "old").alias("colour"), "old")).groupBy("node").agg(F.max("colour").alias("colour"), F.max("old").alias("old"))
        colours = kept(new.select("node", "colour", (F.col("colour") > F.col("old")).alias("fresh")))


def leading_back(edges: DataFrame) -> DataFrame:
    """(node, colour): what leads to the node that a colour is named by, itself included, along edges (src, dst, colour) within colours.

    A node with one edge leads where that edge leads: such nodes point ahead, twice as far each round, and only the others are searched step by step.
    """
    out = edges.groupBy("src", "colour").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"))
    ahead = kept(out.filter("n = 1 AND src <> colour").select(F.col("src").alias("node"), "colour", "to"))
    for _ in range(ahead.count().bit_length()):
        far = ahead.select(F.col("node").alias("to"), "colour", F.col("to").alias("far"))
        new = kept(ahead.join(far, ["to", "colour"], "left").select("node", "colour", F.coalesce("far", "to").alias("to")))
        same = new.join(ahead, ["node", "colour", "to"], "left_anti").isEmpty()
        ahead = new
        if same:
            break
    own = graphs.few(ahead)
    short = edges.join(own.select(F.col("node").alias("src"), "colour"), ["src", "colour"], "left_anti")
    short = kept(short.join(own.select(F.col("node").alias("dst"), "colour", "to"), ["dst", "colour"], "left").select("src", F.coalesce("to", "dst").alias("dst"), "colour"))
    fresh = seen = kept(edges.select(F.col("colour").alias("node"), "colour").distinct())
    while not fresh.isEmpty():
        fresh = short.join(graphs.few(fresh).select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
        fresh = kept(fresh.join(seen, ["node", "colour"], "left_anti"))
        seen = kept(seen.unionByName(fresh))
    return kept(seen.unionByName(ahead.join(seen.select(F.col("node").alias("to"), "colour"), ["to", "colour"], "left_semi").select("node", "colour")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the strongly connected components of several nodes, named by their least node. edges: (src, dst)."""
    left, found = kept(edges.filter("src <> dst").select("src", "dst").distinct()), None
    while not left.isEmpty():
        left = trimmed(left)
        colours = coloured(left)
        c = colours.select("node", "colour")
        both = left.join(c.toDF("src", "colour"), "src").join(c.toDF("dst", "other"), "dst").filter("colour = other")
        left = kept(both.select("src", "dst", "colour"))
        seen = leading_back(left)
        groups = seen.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        part = kept(seen.join(groups, "colour").select("node", "component"))
        found = part if found is None else found.unionByName(part)
        rest = graphs.few(kept(c.select("node").join(seen.select("node"), "node", "left_anti")))
        left = kept(left.select("src", "dst").join(rest.toDF("src"), "src", "left_semi").join(rest.toDF("dst"), "dst", "left_semi"))
    return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0) if found is None else found


def levels(edges: DataFrame) -> DataFrame:
    """(node, level) of a graph (node, dep): 0 without dependency, else one more than the highest of them; nodes on or behind a cycle have none."""
    left = cut(edges.select("node", "dep").distinct())
    need = cut(left.groupBy("node").agg(F.count(F.lit(1)).alias("n")))  # dependencies without a level yet
    fresh = cut(left.select(F.col("dep").alias("node")).distinct().join(need, "node", "left_anti").withColumn("level", F.lit(0)))
    done, level = fresh, 0
    while not fresh.isEmpty():
        level += 1
        met = left.join(graphs.few(fresh.select(F.col("node").alias("dep"))), "dep").groupBy("node").agg(F.count(F.lit(1)).alias("met"))
        need = cut(need.join(met, "node", "left").select("node", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")))
        fresh = need.filter("n = 0").select("node", F.lit(level).alias("level"))
        need, done = need.filter("n > 0"), done.unionByName(fresh)
    return done


def succession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a returned line's part leads to the part of the next line of the order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag"))
    return lines.withColumn("dst", after).filter("l_returnflag = 'R' AND dst IS NOT NULL AND dst <> l_partkey").select(F.col("l_partkey").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()


#: The letters of the kinds of nodes.
KINDS = "rnscpo"


def code(kind: str, key: Column) -> Column:
    """A node as a number, a third as long as its name: eight times its key and the place of its kind."""
    return key.cast("long") * 8 + KINDS.index(kind)


def named(nodes: DataFrame) -> DataFrame:
    """Nodes with their names for their codes: the kind's letter and the key."""
    kind = F.substring(F.lit(KINDS), F.pmod(F.col("node"), F.lit(8)).cast("int") + 1, F.lit(1))
    return nodes.withColumn("node", F.concat(kind, F.shiftright("node", 3).cast("string")))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, dep), coded as in `code`: orders need their customer and parts, parts their suppliers, these and customers their nation, nations their region."""
    t = lambda name: table(spark, sf_dir, name)
    edge = lambda df, a, x, b, y: df.select(code(a, F.col(x)).alias("node"), code(b, F.col(y)).alias("dep")).distinct()
    out = edge(t("orders"), "o", "o_orderkey", "c", "o_custkey").unionByName(edge(t("lineitem"), "o", "l_orderkey", "p", "l_partkey")).unionByName(edge(t("lineitem"), "p", "l_partkey", "s", "l_suppkey"))
    out = out.unionByName(edge(t("customer"), "c", "c_custkey", "n", "c_nationkey")).unionByName(edge(t("supplier"), "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge(t("nation"), "n", "n_nationkey", "r", "n_regionkey"))
    return out  # kinds keep the parts apart


def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(succession(spark, sf_dir))


def q_never(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges among nodes that can never run, as they lie on or behind a cycle."""
    return graphs.unresolved(succession(spark, sf_dir).toDF("node", "dep"))


def q_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(levels(supply(spark, sf_dir)))


def q_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers of little means hold up, and how far away it is."""
    failed = table(spark, sf_dir, "supplier").filter("s_acctbal < 1000").select(code("s", F.col("s_suppkey")).alias("node"))
    return named(graphs.reached(supply(spark, sf_dir).select(F.col("dep").alias("src"), F.col("node").alias("dst")), failed).filter("steps > 0"))


def q_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the part with the least number leads to."""
    edges = succession(spark, sf_dir)
    return graphs.reached(edges, edges.select(F.min("src").alias("node")))


# flow texts

FLOW = "flow long, part string, id string, dst string, kind string, label string, line int"


def flow_rows(texts: DataFrame) -> DataFrame:
    """Rows of flow texts (flow, style, text): nodes (id, kind, label), edges (id, dst, label) and errors (label), each with the line that it was first read from.

    style: mermaid or d2. A line that can't be read is an error row, and the others count. A null text has no rows.
    """
    ship(texts.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for flow, style, text in part.itertuples(index=False, name=None):
                if text is not None:
                    rows += [(flow, *r) for r in graphs.flow_lines(text, style)]
            yield pd.DataFrame(rows, columns=["flow", "part", "id", "dst", "kind", "label", "line"])

    return texts.select("flow", "style", "text").mapInPandas(run, FLOW)


def flow_report(texts: DataFrame) -> DataFrame:
    """flow, nodes, edges, errors, first_error (its line), faults (by name, joined by commas) of flow texts."""
    rows = cut(flow_rows(texts))
    counts = rows.groupBy("flow").agg(*[F.count_if(F.col("part") == p).alias(f"{p}s") for p in ("node", "edge", "error")], F.min(F.when(F.col("part") == "error", F.col("line"))).alias("first_error"))
    nodes = rows.filter("part = 'node'").select("flow", "id", "kind")
    edges = rows.filter("part = 'edge'").select("flow", F.col("id").alias("src"), "dst", "label")
    faults = graphs.flow_faults(nodes, edges).groupBy("flow").agg(F.array_join(F.array_sort(F.collect_set("fault")), ",").alias("faults"))  # five kinds
    return counts.join(faults, "flow", "left").select("flow", "nodes", "edges", "errors", "first_error", F.coalesce("faults", F.lit("")).alias("faults"))


def conversation_flows(conversations: DataFrame) -> DataFrame:
    """A flow text of each conversation: mermaid for even ones, d2 for odd ones. Turns follow each other from BEGIN to END; a system turn branches back
    to the start without a label, and a turn after one of the same role is written with an arrow that neither style knows."""
    t = F.struct("turn", "role")
    c = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("t"))
    n = F.size("t")
    name = lambda i: F.concat(F.lit("T"), i.cast("string"))
    kind = lambda i: F.when(i == 0, "BEGIN").when(i == n - 1, "END").otherwise(F.get("t", i)["role"])
    even = F.col("conv_id") % 2 == 0
    node = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(even, F.concat(name(i), F.lit("["), kind(i), F.lit("]"))).otherwise(F.concat(name(i), F.lit(": "), kind(i))))
    same = lambda i: F.get("t", i)["role"] == F.get("t", i - 1)["role"]
    arrow = lambda i: F.when(same(i), " => ").when(even & (F.get("t", i)["role"] == "user"), " -->|ask| ").when(even, " --> ").otherwise(" -> ")
    tail = lambda i: F.when(~even & ~same(i) & (F.get("t", i)["role"] == "user"), ": ask").otherwise("")
    step = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(name(i - 1), arrow(i), name(i), tail(i)))).otherwise(F.array().cast("array<string>"))
    back = F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((F.get("t", i)["role"] == "system") & (i > 0), F.concat(name(i), F.when(even, " --> ").otherwise(" -> "), F.lit("T0")))), lambda x: x.isNotNull())
    head = F.when(even, F.array(F.lit("flowchart TD"))).otherwise(F.array(F.lit("# a flow")))
    return c.select(F.col("conv_id").cast("long").alias("flow"), F.when(even, "mermaid").otherwise("d2").alias("style"), F.array_join(F.concat(head, node, step, back), "\n").alias("text"))


def q_flow_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_report(conversation_flows(table(spark, sf_dir, "conversations")))


_E = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, l_returnflag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS dst FROM lineitem) WHERE l_returnflag = 'R' AND dst IS NOT NULL AND src <> dst)"
_SCC = f"""{_E}, p AS (SELECT src AS node FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), f AS (SELECT node FROM p UNION SELECT e.dst FROM f JOIN e ON e.src = f.node), b AS (SELECT node FROM p UNION SELECT e.src FROM b JOIN e ON e.dst = b.node),
giant AS (SELECT node FROM f INTERSECT SELECT node FROM b), rest AS (SELECT * FROM e WHERE src NOT IN (SELECT node FROM giant) AND dst NOT IN (SELECT node FROM giant)), r AS (SELECT src, dst FROM rest UNION SELECT r.src, rest.dst FROM r JOIN rest ON r.dst = rest.src),
comps AS (SELECT node, (SELECT min(node) FROM giant) AS component FROM giant WHERE (SELECT count(*) FROM giant) > 1 UNION ALL SELECT x.src, least(x.src, min(x.dst)) FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst GROUP BY x.src)"""
_D = """d AS (SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS dep FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
QUERIES = {"d02_components": q_components, "d01_never_run": q_never, "d03_supply_levels": q_levels, "d05_supply_failures": q_spread, "s08_parts_reached": q_reached, "d07_flow_texts": q_flow_texts}
ORACLES = {
    "d02_components": f"WITH RECURSIVE {_SCC} SELECT node, component FROM comps",
    "d01_never_run": f"WITH RECURSIVE {_SCC}, never AS (SELECT node FROM comps UNION SELECT e.src FROM never JOIN e ON e.dst = never.node) SELECT src AS node, dst AS dep FROM e WHERE src IN (SELECT node FROM never) AND dst IN (SELECT node FROM never)",
    "d03_supply_levels": f"WITH RECURSIVE {_D}, l AS (SELECT DISTINCT dep AS node, 0 AS level FROM d WHERE dep NOT IN (SELECT node FROM d) UNION SELECT d.node, level + 1 FROM l JOIN d ON d.dep = l.node) SELECT node, max(level) AS level FROM l GROUP BY node",
    "d05_supply_failures": f"WITH RECURSIVE {_D}, l AS (SELECT 's' || s_suppkey AS node, 0 AS steps FROM supplier WHERE s_acctbal < 1000 UNION SELECT d.node, steps + 1 FROM l JOIN d ON d.dep = l.node) SELECT node, min(steps) AS steps FROM l GROUP BY node HAVING min(steps) > 0",
    "s08_parts_reached": f"WITH RECURSIVE {_E}, l AS (SELECT min(src) AS node, 0 AS steps FROM e UNION SELECT e.dst, steps + 1 FROM l JOIN e ON e.src = l.node WHERE steps < 40) SELECT node, min(steps) AS steps FROM l GROUP BY node",
    "d07_flow_texts": """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER w - 1 AS i, role, lag(role) OVER w AS prev, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)),
e AS (SELECT conv_id, i - 1 AS a, i AS b, CASE WHEN role = 'user' THEN 'ask' END AS label FROM t WHERE i > 0 AND role <> prev UNION ALL SELECT conv_id, i, 0, NULL FROM t WHERE role = 'system' AND i > 0),
bad AS (SELECT conv_id, count(*) AS errors, min(1 + n + i) AS first_error FROM t WHERE i > 0 AND role = prev GROUP BY 1), c AS (SELECT conv_id, min(n) AS n FROM t GROUP BY 1), k AS (SELECT conv_id, count(*) AS edges FROM e GROUP BY 1),
r AS (SELECT conv_id, 0 AS i FROM c UNION SELECT e.conv_id, e.b FROM r JOIN e ON r.conv_id = e.conv_id AND r.i = e.a), o AS (SELECT e.conv_id, a, count(*) AS m, count(label) AS named, count(DISTINCT label) AS kinds FROM e JOIN r ON r.conv_id = e.conv_id AND r.i = e.a GROUP BY 1, 2 HAVING count(*) > 1),
x AS (SELECT conv_id, 'end' AS fault FROM c WHERE n = 1 UNION SELECT conv_id, 'unreached' FROM c WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = c.conv_id AND r.i = n - 1) UNION SELECT conv_id, 'unlabelled' FROM o WHERE named < m UNION SELECT conv_id, 'same label' FROM o WHERE kinds < named)
SELECT c.conv_id AS flow, n AS nodes, coalesce(edges, 0) AS edges, coalesce(errors, 0) AS errors, first_error, coalesce((SELECT string_agg(fault, ',' ORDER BY fault) FROM x WHERE x.conv_id = c.conv_id), '') AS faults FROM c LEFT JOIN k USING (conv_id) LEFT JOIN bad USING (conv_id)""",
}
