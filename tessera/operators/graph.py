"""Dependency graphs as tables: nodes (node) and edges (src, dst), `src` needs `dst`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import tables as tf
from tessera.functions import text as tx
from tessera.session import dropped, staged


def known_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct imports (src, dst) of known nodes, none of them of the importer itself."""
    return imports.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").filter("src <> dst").select("src", "dst").distinct()


def modules(files: DataFrame) -> DataFrame:
    """Rows (repo, module, file_path, files) of files (repo, file_path, path) in Python or a script; of several files of one module the last path counts."""
    own = files.distinct().filter(F.lower("path").rlike(r"\.(py|ts|tsx|js|jsx)$")).withColumn("module", tx.module_name(F.col("path"))).filter("module <> ''")
    return own.groupBy("repo", "module").agg(F.max("file_path").alias("file_path"), F.count("*").alias("files"))


def python_edges(sources: DataFrame) -> DataFrame:
    found = sources.select("repo", tx.module_name(F.col("path")).alias("src"), F.explode(tf.python_imports(F.col("content"))).alias("i"))
    return found.select("repo", "src", tx.import_target(F.col("i"), F.col("src")).alias("dst"))


def script_edges(sources: DataFrame) -> DataFrame:
    """Paths stay within their repo, whose name stands before them while they are looked up."""
    whole = F.concat("repo", F.lit("//"), "path")
    found = sources.select(F.struct("repo", "path").alias("src"), F.regexp_replace(whole, r"/[^/]*$", "").alias("folder"), F.explode(tf.script_imports(F.col("content"))).alias("spec"))
    there = tf.script_targets(found.withColumn("folder", F.replace("folder", F.lit("//"), F.lit("/"))), sources.select(F.concat("repo", F.lit("/"), "path").alias("file_path")))
    inside = there.filter(F.startswith(F.col("dst"), F.concat("src.repo", F.lit("/"))))
    dst = F.substring(F.col("dst"), F.length("src.repo") + 2, F.length("dst"))
    return inside.select(F.col("src.repo").alias("repo"), tx.module_name(F.col("src.path")).alias("src"), tx.module_name(dst).alias("dst"))


#: What finds the imports of files (repo, path, content) of an ending, as rows (repo, src, dst) of modules; others can be added.
EXTRACTORS = {("py",): python_edges, ("js", "jsx", "ts", "tsx"): script_edges}


def module_edges(sources: DataFrame) -> DataFrame:
    """Distinct imports (repo, src, dst) between the modules of a repo, none of itself, of files (repo, path, content)."""
    known = modules(sources.select("repo", F.col("path").alias("file_path"), "path")).select("repo", F.col("module").alias("dst"))
    ending, out = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), None
    for endings, extract in EXTRACTORS.items():
        own = extract(sources.filter(ending.isin(*endings)))
        out = own if out is None else out.unionByName(own)
    return out.filter("src <> dst and src <> ''").join(known, ["repo", "dst"], "left_semi").select("repo", "src", "dst").distinct()


def module_files(named: DataFrame, files: DataFrame) -> DataFrame:
    """The file (repo, module, path) of each module (repo, module): that of its name, else the init of its folder; missing if neither is among files (repo, path)."""
    base = named.withColumn("base", F.replace("module", F.lit("."), F.lit("/")))
    own = files.select("repo", "path").distinct()
    plain = own.filter(F.col("path").endswith(".py")).select("repo", F.regexp_replace("path", r"\.py$", "").alias("base"), F.col("path").alias("p1"))
    init = own.filter(F.col("path").endswith("/__init__.py")).select("repo", F.regexp_replace("path", r"/__init__\.py$", "").alias("base"), F.col("path").alias("p2"))
    return base.join(plain, ["repo", "base"], "left").join(init, ["repo", "base"], "left").select("repo", "module", F.coalesce("p1", "p2").alias("path"))


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, out_degree, in_degree, is_leaf, is_entry): a leaf needs nothing, nothing needs an entry point."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    both = nodes.select("node").distinct().join(out, "node", "left").join(into, "node", "left").fillna(0, ["out_degree", "in_degree"])
    return both.select("node", "out_degree", "in_degree", (F.col("out_degree") == 0).alias("is_leaf"), (F.col("in_degree") == 0).alias("is_entry"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges that may lie on a cycle: those whose ends have both an edge in and an edge out, again and again."""
    cur, n = staged(edges.select("src", "dst").filter("src <> dst").distinct(), "trim"), -1
    while True:  # every round but the last takes an edge away
        now = cur.count()
        if now == n or not now:
            return cur
        n = now
        into, out = cur.select(F.col("dst").alias("src")).distinct(), cur.select(F.col("src").alias("dst")).distinct()
        new = staged(cur.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"), "trim")
        dropped(cur)
        cur = new


def cycle_members(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of all nodes that lie on a cycle, with the smallest node of their strongly connected component.

    Edges off every cycle are trimmed first. Then colours spread forward until they rest, the largest winning; whatever reaches a colour's
    origin backward within the colour is its component, and is taken out. Every round is a join on the edges that are left.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    out = spark.createDataFrame([], f"node {kind}, component {kind}")
    left = _trimmed(edges)
    while left.take(1):  # every round takes at least the origins of the colours out
        colour = staged(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")), "colour")
        while True:
            spread = left.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c")
            new = staged(colour.union(spread).groupBy("node").agg(F.max("c").alias("c")), "colour")
            changed = new.join(colour.withColumnRenamed("c", "old"), "node").filter("c <> old").take(1)
            dropped(colour)
            colour = new
            if not changed:
                break
        inner = left.join(colour.select(F.col("node").alias("src"), "c"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst").filter("c = c2")
        inner = staged(inner.select("src", "dst", "c"), "colour-edges")
        part, n = staged(colour.filter("node = c"), "component"), 0
        while True:
            more = inner.join(part.select(F.col("node").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("node"), "c")
            part = staged(part.union(more).distinct(), "component")
            now = part.count()
            if now == n:
                break
            n = now
        named = part.join(part.groupBy("c").agg(F.min("node").alias("component"), F.count("*").alias("n")), "c").filter("n > 1").select("node", "component")
        out = staged(out.union(named), "components")
        gone = part.select("node")
        left = _trimmed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return out


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, level) of an acyclic graph: 0 for nodes that need nothing, else one more than the highest level they need.

    Every round raises the levels along all edges at once, so there are as many rounds as the longest chain has nodes.
    """
    need = staged(edges.select("src", "dst").filter("src <> dst").distinct().join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi"), "need")
    cur = staged(nodes.select("node").distinct().withColumn("level", F.lit(0)), "levels")
    most, before = cur.count(), None
    for _ in range(most + 1):
        raised = need.join(cur.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("level") + 1).alias("up"))
        cur = staged(cur.join(raised, "node", "left").select("node", F.coalesce("up", "level").alias("level")), "levels")
        now = cur.agg(F.sum(F.col("level").cast("bigint"))).first()[0]
        if now == before:
            return cur
        before = now
    raise ValueError("the graph has a cycle")


def migration_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (node, batch): leaves first by level, numbered without gaps, and all nodes on cycles in one last batch.

    Edges within a component are left out for the levels, in which members of cycles still count for what needs them; a node that
    needs a member of a cycle keeps its own level, and so comes before it.
    """
    on_cycle = staged(cycle_members(edges), "cycles")
    a, b = on_cycle.toDF("src", "c1"), on_cycle.toDF("dst", "c2")
    across = edges.join(a, "src", "left").join(b, "dst", "left").filter("c1 is null or c2 is null or c1 <> c2").select("src", "dst")
    plain = levels(nodes, across).join(on_cycle.select("node"), "node", "left_anti")
    dense = F.dense_rank().over(Window.orderBy("level")) - 1  # over the few levels, not the nodes
    numbers = plain.select("level").distinct().withColumn("batch", dense)
    count = F.coalesce(F.max("batch") + 1, F.lit(0)).alias("batch")
    last = on_cycle.select("node").crossJoin(numbers.agg(count))  # one row on the right
    return plain.join(numbers, "level").select("node", "batch").union(last.select("node", "batch"))


def as_record(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """One row (name, graph) with the graph as JSON, nodes and edges in order; for graphs that fit in a row."""
    n = nodes.select("node").distinct().agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    e = edges.select(F.struct("src", "dst").alias("e")).distinct().agg(F.array_sort(F.collect_list("e")).alias("edges"))
    return n.crossJoin(e).select(F.lit(name).alias("name"), F.to_json(F.struct("nodes", "edges")).alias("graph"))


def from_record(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, node) and edges (name, src, dst) of rows of `as_record`."""
    read = records.select("name", F.from_json("graph", "nodes array<string>, edges array<struct<src:string,dst:string>>").alias("g"))
    return read.select("name", F.explode("g.nodes").alias("node")), read.select("name", F.explode("g.edges").alias("e")).select("name", "e.src", "e.dst")
