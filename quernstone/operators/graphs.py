"""Dependency graphs: faults, cycles, reach, failures; flows and their validation; folders by depth.

A graph is a table of edges (node, dep). Every step is a join on keys, and each round's table is cut from its plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import cut
from ..sources.tables import table
from .corpus import files


#: Rows up to which the nodes of a step are sent to the edges.
FEW = 1 << 18


def few(nodes: DataFrame) -> DataFrame:
    """The nodes, broadcast if there are at most FEW."""
    return F.broadcast(nodes) if nodes.count() <= FEW else nodes


def unresolved(edges: DataFrame) -> DataFrame:
    """The edges among nodes that can never run: nodes without open dependencies are peeled off, round by round. Empty if there is no cycle."""
    left = cut(edges.select("node", "dep").distinct())
    while True:
        open_ = left.select("node").distinct()
        rest = cut(left.join(open_.withColumnRenamed("node", "dep"), "dep", "left_semi").select("node", "dep"))
        before, after = left.count(), rest.count()
        left = rest
        if after in (0, before):
            return left


def cycle(edges: DataFrame) -> DataFrame:
    """(position, node) of one cycle, from its least node on in order of dependency; no rows without one.

    Each unresolved node follows its least unresolved dependency. Doubled often enough the steps lead onto the cycle, and
    doubled again they list it: the number of joins is logarithmic.
    """
    step = cut(unresolved(edges).groupBy("node").agg(F.min("dep").alias("to")))
    n = step.count()
    if not n:
        return step.select(F.lit(0).alias("position"), "node")
    far, done = step, 1
    follow = lambda a, b: a.select("node", F.col("to").alias("_v")).join(b.select(F.col("node").alias("_v"), F.col("to").alias("to")), "_v").select("node", "to")
    jumps = [step]
    while done < n:
        far, done = cut(follow(far, far)), 2 * done
        jumps.append(far)
    on = far.filter(F.col("node") == step.agg(F.min("node")).first()[0]).select(F.col("to").alias("node"), F.lit(0).cast("long").alias("position"))
    for k, jump in enumerate(jumps):  # positions below 2^k are known
        more = on.join(jump, "node").select(F.col("to").alias("node"), (F.col("position") + (1 << k)).alias("position"))
        on = cut(on.unionByName(more).groupBy("node").agg(F.min("position").alias("position")))
    size, first = on.count(), on.orderBy("node").first()["position"]
    return on.select(((F.col("position") - F.lit(first) + F.lit(size)) % F.lit(size)).cast("int").alias("position"), "node")


def faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fault, node, dep): edges with an unknown end, edges of a node to itself, edges that lie on or behind a cycle."""
    known = nodes.select("node").distinct()
    unknown = edges.join(known.withColumnRenamed("node", "dep"), "dep", "left_anti").unionByName(edges.join(known, "node", "left_anti")).distinct()
    own = edges.filter("node = dep")
    rest = unresolved(edges.filter("node <> dep"))
    return unknown.select(F.lit("unknown").alias("fault"), "node", "dep").unionByName(own.select(F.lit("self").alias("fault"), "node", "dep").distinct()).unionByName(rest.select(F.lit("cycle").alias("fault"), "node", "dep"))


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, steps): everything that start (node) leads to along edges (src, dst), with the least number of steps. Only new nodes are joined again.

    Edges are made once, not once a step, and stay where they lie as long as the new nodes are few."""
    edges = cut(edges.select("src", "dst"))
    seen = fresh = cut(start.select("node", F.lit(0).alias("steps")).distinct())
    while True:
        fresh = edges.join(few(fresh.withColumnRenamed("node", "src")), "src").select(F.col("dst").alias("node"), (F.col("steps") + 1).alias("steps")).distinct()
        fresh = cut(fresh.join(seen, "node", "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = cut(seen.unionByName(fresh))


def flow_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, fault) of flows with nodes (flow, id, kind) and edges (flow, src, dst, label).

    One begin and one end; of reached nodes with several edges each edge has a label of its own; the end is reached.
    """
    count = lambda kind: F.count_if(F.col("kind") == kind)
    ends = nodes.groupBy("flow").agg(count("begin").alias("b"), count("end").alias("e"))
    out = ends.filter("b <> 1").select("flow", F.lit("begin").alias("fault")).unionByName(ends.filter("e <> 1").select("flow", F.lit("end").alias("fault")))
    key = lambda c: F.struct("flow", F.col(c).alias("id"))
    seen = reached(edges.select(key("src").alias("src"), key("dst").alias("dst")), nodes.filter("kind = 'begin'").select(key("id").alias("node"))).select("node.flow", "node.id")
    lost = nodes.filter("kind = 'end'").join(seen, ["flow", "id"], "left_anti").select("flow", F.lit("unreached").alias("fault"))
    label = F.nullif(F.trim("label"), F.lit(""))
    several = edges.join(seen.withColumnRenamed("id", "src"), ["flow", "src"], "left_semi").groupBy("flow", "src").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("named"), F.count_distinct(label).alias("different")).filter("n > 1")
    bare = several.filter("named < n").select("flow", F.lit("unlabelled").alias("fault"))
    twice = several.filter("different < named").select("flow", F.lit("same label").alias("fault"))
    return out.unionByName(lost).unionByName(bare).unionByName(twice).distinct()


_NODE = r"([A-Za-z0-9_]+)\s*(?:(\(\[|\[|\{|\()\s*\"?(.*?)\"?\s*(?:\]\)|\]|\}|\)))?"
_EDGE = re.compile(rf"^\s*{_NODE}\s*(?:--\s*([^->|][^>|]*?)\s*-->|-->(?:\s*\|([^|]*)\|)?)\s*{_NODE}\s*;?\s*$")
_ALONE = re.compile(rf"^\s*{_NODE}\s*;?\s*$")


def _mermaid(line: str) -> Iterator[tuple]:
    """What a line of a flowchart says: (node, opened, label) and ("->", from, to, label)."""
    if not line.strip() or line.strip().startswith(("%%", "flowchart", "graph", "style", "classDef")):
        return
    if m := _EDGE.match(line):
        label = m[4] or m[5]
        yield m[1], m[2], m[3]
        yield m[6], m[7], m[8]
        yield "->", m[1], m[6], label.strip() if label else None
    elif m := _ALONE.match(line):
        yield m[1], m[2], m[3]
    else:
        raise ValueError(f"can't read {line.strip()!r}")


_D2_NAME = re.compile(r'"[^"]+"|[^":=<>]+')


def _d2(line: str) -> Iterator[tuple]:
    """The same of "a -> b -> c: label" and "a: Label" lines; text behind # is a comment."""
    line = line.split("#", 1)[0].strip()
    if not line:
        return
    head, colon, label = line.partition(":")
    names = [x.strip() for x in head.split("->")]
    if not all(_D2_NAME.fullmatch(x) for x in names):
        raise ValueError(f"can't read {line!r}")
    names, label = [x.strip('"') for x in names], label.strip().strip('"')
    for x in names:
        yield x, None, label if colon and len(names) == 1 else None
    for a, b in zip(names, names[1:]):
        yield "->", a, b, label if colon else None


def flow_lines(text: str, style: str) -> list[tuple]:
    """(part, id, dst, kind, label, line): nodes, edges and errors of a flow text (style: mermaid or d2); ids that read BEGIN or END are such, braces a decision."""
    nodes: dict[str, tuple] = {}
    rows = []
    for number, line in enumerate(text.splitlines(), 1):
        try:
            found = list((_mermaid if style == "mermaid" else _d2)(line))
        except ValueError as e:
            rows.append(("error", None, None, None, str(e), number))
            continue
        for x in found:
            if x[0] == "->":
                rows.append(("edge", x[1], x[2], None, x[3], number))
                continue
            name, opened, label = x
            if name not in nodes or opened or label:
                words = (label or name).strip()
                kind = {"BEGIN": "begin", "END": "end"}.get(words.upper(), "decision" if opened == "{" else "task")
                nodes[name] = ("node", name, None, kind, words, nodes[name][5] if name in nodes else number)
    return [*nodes.values(), *rows]


def _parsed(text: str, style: str) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str, str | None]]]:
    rows = flow_lines(text, style)
    for r in rows:
        if r[0] == "error":
            raise ValueError(f"line {r[5]}: {r[4]}")
    return {r[1]: (r[3], r[4]) for r in rows if r[0] == "node"}, [(r[1], r[2], r[4]) for r in rows if r[0] == "edge"]


def parse_mermaid(text: str) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str, str | None]]]:
    """({id: (kind, label)}, [(from, to, label)]) of a flowchart with an edge or node a line; the first line that can't be read is an error."""
    return _parsed(text, "mermaid")


def parse_d2(text: str) -> tuple[dict[str, tuple[str, str]], list[tuple[str, str, str | None]]]:
    """The same of a D2 text."""
    return _parsed(text, "d2")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations as nodes; each depends on half and a third of its number; 7 and 9 in a ring with 14 and 20, 4 on itself, 11 on a stranger."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    k = F.col("node")
    deps = F.array(F.floor(k / 2), F.floor(k / 3), F.when(k == 7, 14), F.when(k == 14, 20), F.when(k == 20, 9), F.when(k == 9, 7), F.when(k == 4, 4), F.when(k == 11, 99))
    edges = n.filter("node > 0").select("node", F.explode(F.array_distinct(F.array_compact(deps))).alias("dep"))
    return n, edges.select("node", F.col("dep").cast("long").alias("dep"))


def q_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults(*graph(spark, sf_dir))


def q_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle(graph(spark, sf_dir)[1].filter("node <> dep AND dep <= 24"))


def q_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph(spark, sf_dir)[1]
    return reached(edges.select(F.col("node").alias("src"), F.col("dep").alias("dst")), spark.createDataFrame([(11,)], "node long"))


def flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A flow of five nations for each region, with a different fault in four of them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("flow"), F.col("n_nationkey").cast("long").alias("id"))
    n = n.withColumn("r", F.row_number().over(Window.partitionBy("flow").orderBy("id")))
    kind = F.when((F.col("r") == 1) | ((F.col("flow") == 1) & (F.col("r") == 2)), "begin").when((F.col("r") == 5) & (F.col("flow") != 2), "end").otherwise("task")
    nodes = n.select("flow", "id", "r", kind.alias("kind"))
    after = nodes.select("flow", (F.col("r") - 1).alias("r"), F.col("id").alias("dst"))
    edges = nodes.join(after, ["flow", "r"]).filter("NOT (flow = 3 AND r = 4)").select("flow", F.col("id").alias("src"), "dst", F.lit("next").alias("label"))
    skip = nodes.filter("r = 1 AND flow IN (0, 4)").join(nodes.filter("r = 3").select("flow", F.col("id").alias("dst")), "flow").select("flow", F.col("id").alias("src"), "dst", F.when(F.col("flow") == 4, "next").otherwise("skip").alias("label"))
    blank = nodes.filter("r = 2 AND flow = 4").join(nodes.filter("r = 4").select("flow", F.col("id").alias("dst")), "flow").select("flow", F.col("id").alias("src"), "dst", F.lit(" ").alias("label"))
    return nodes.select("flow", "id", "kind"), edges.unionByName(skip).unionByName(blank)


def q_flow_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_faults(*flows(spark, sf_dir))


def q_shallow(spark: SparkSession, sf_dir: str, most_dirs: int = 40, most_files: int = 100) -> DataFrame:
    """The files of the first folders, the shallowest first: a bounded number of folders, then of files."""
    f = files(spark, sf_dir)
    path = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("/", F.get(F.split("path", "/"), F.lit(0)), F.get(F.split("path", "/"), F.lit(2)))).otherwise(F.col("path"))
    f = f.select(path.alias("path")).withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).withColumn("depth", F.size(F.split("dir", "/")))
    dirs = f.select("dir", "depth").distinct().orderBy("depth", "dir").limit(most_dirs)
    return f.join(F.broadcast(dirs.select("dir")), "dir", "left_semi").orderBy("depth", "dir", "path").limit(most_files).select("path", "depth")  # at most most_dirs rows


_G = """n AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation), g AS (SELECT DISTINCT node, dep FROM (SELECT node, unnest([node // 2, node // 3, CASE node WHEN 7 THEN 14 WHEN 14 THEN 20 WHEN 20 THEN 9 WHEN 9 THEN 7 WHEN 4 THEN 4 WHEN 11 THEN 99 END]) AS dep FROM n WHERE node > 0) WHERE dep IS NOT NULL)"""
QUERIES = {"d01_faults": q_faults, "d02_cycle": q_cycle, "s08_reached": q_reached, "d06_flow_faults": q_flow_faults, "d08_shallow_files": q_shallow}
ORACLES = {
    "d01_faults": f"""WITH RECURSIVE {_G}, e AS (SELECT * FROM g WHERE node <> dep), r AS (SELECT node, dep FROM e UNION SELECT r.node, e.dep FROM r JOIN e ON r.dep = e.node), bad AS (SELECT DISTINCT node FROM r WHERE node IN (SELECT node FROM r x WHERE x.node = x.dep) OR dep IN (SELECT node FROM r x WHERE x.node = x.dep))
SELECT 'unknown' AS fault, node, dep FROM g WHERE dep NOT IN (SELECT node FROM n) UNION ALL SELECT 'self', node, dep FROM g WHERE node = dep UNION ALL SELECT 'cycle', e.node, e.dep FROM e WHERE node IN (SELECT node FROM bad) AND dep IN (SELECT node FROM bad)""",
    "d02_cycle": f"""WITH RECURSIVE {_G}, e AS (SELECT * FROM g WHERE node <> dep AND dep <= 24), r AS (SELECT node, dep FROM e UNION SELECT r.node, e.dep FROM r JOIN e ON r.dep = e.node), on_ AS (SELECT DISTINCT node FROM r WHERE node = dep),
behind AS (SELECT node FROM on_ UNION SELECT e.node FROM behind b JOIN e ON e.dep = b.node), s AS (SELECT node, min(dep) AS dep FROM e WHERE dep IN (SELECT node FROM behind) GROUP BY node), w AS (SELECT min(node) AS node, 0 AS steps FROM s UNION ALL SELECT s.dep, steps + 1 FROM w JOIN s USING (node) WHERE steps < 60),
ring AS (SELECT DISTINCT node FROM w WHERE steps >= 30), go AS (SELECT 0 AS position, min(node) AS node FROM ring UNION ALL SELECT position + 1, s.dep FROM go JOIN s USING (node) WHERE position + 1 < (SELECT count(*) FROM ring)) SELECT position, node FROM go""",
    "s08_reached": f"WITH RECURSIVE {_G}, r AS (SELECT 11::BIGINT AS node, 0 AS steps UNION SELECT g.dep, steps + 1 FROM r JOIN g USING (node) WHERE steps < 30) SELECT node, min(steps) AS steps FROM r GROUP BY 1",
    "d06_flow_faults": """WITH RECURSIVE n AS (SELECT n_regionkey AS flow, n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation),
k AS (SELECT flow, id, r, CASE WHEN r = 1 OR flow = 1 AND r = 2 THEN 'begin' WHEN r = 5 AND flow <> 2 THEN 'end' ELSE 'task' END AS kind FROM n), e AS (SELECT a.flow, a.id AS src, b.id AS dst, CASE WHEN b.r = a.r + 1 OR a.r = 1 AND a.flow = 4 THEN 'next' WHEN a.r = 1 THEN 'skip' ELSE ' ' END AS label
  FROM k a JOIN k b ON a.flow = b.flow AND (b.r = a.r + 1 AND NOT (a.flow = 3 AND a.r = 4) OR a.r = 1 AND b.r = 3 AND a.flow IN (0, 4) OR a.r = 2 AND b.r = 4 AND a.flow = 4)),
seen AS (SELECT flow, id FROM k WHERE kind = 'begin' UNION SELECT e.flow, e.dst FROM seen s JOIN e ON e.flow = s.flow AND e.src = s.id), o AS (SELECT e.flow, src, count(*) AS m, count(nullif(trim(label), '')) AS named, count(DISTINCT nullif(trim(label), '')) AS kinds FROM e JOIN seen s ON s.flow = e.flow AND s.id = e.src GROUP BY 1, 2 HAVING count(*) > 1)
SELECT flow, kind AS fault FROM (SELECT flow, unnest(['begin', 'end']) AS kind FROM (SELECT DISTINCT flow FROM k)) x WHERE (SELECT count(*) FROM k WHERE k.flow = x.flow AND k.kind = x.kind) <> 1
UNION SELECT flow, 'unreached' FROM k WHERE kind = 'end' AND (flow, id) NOT IN (SELECT (flow, id) FROM seen) UNION SELECT flow, 'unlabelled' FROM o WHERE named < m UNION SELECT flow, 'same label' FROM o WHERE kinds < named""",
    "d08_shallow_files": r"""WITH f AS (SELECT CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id || '.txt' ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS path, CASE WHEN doc_id % 3 = 0 THEN source ELSE source || '/' || lang END AS dir, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS depth FROM documents),
d AS (SELECT DISTINCT dir, depth FROM f ORDER BY depth, dir LIMIT 40) SELECT path, f.depth FROM f SEMI JOIN d USING (dir) ORDER BY f.depth, dir, path LIMIT 100""",
}
