"""Trees as node tables: (tree_id, node_id, parent_id, position, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ancestry import climb, gathered, shuffled

NODE = ("tree_id", "node_id", "parent_id", "position")


def walk(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """Pre-order: the node columns, depth, path (ids from the root) and order (positions from the root; sort by it).

    Paths double in each round (``ancestry``), so a chain of n nodes takes
    log2(n) rounds, whatever its depth. A node that cannot be reached from a root is left
    out; rows that share an id have a row each.
    """
    base = nodes.select(*NODE)
    above = gathered(base.select("tree_id", "node_id", "parent_id", F.col("node_id").alias("path"), F.col("position").alias("order")), "tree_id", "node_id", "parent_id", ["path", "order"])
    up = above.select("tree_id", F.col("node_id").alias("parent_id"), F.col("path").alias("up_path"), F.col("order").alias("up_order"))
    roots = base.where("parent_id is null").select(*NODE, F.lit(0).alias("depth"), F.array("node_id").alias("path"), F.array("position").alias("order"))
    rest = base.join(shuffled(up), ["tree_id", "parent_id"])
    rest = rest.select(*NODE, F.size("up_path").alias("depth"), F.concat("up_path", F.array("node_id")).alias("path"), F.concat("up_order", F.array("position")).alias("order"))
    return roots.unionByName(rest)


def walk_sql(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """The same as one recursive query, for trees within the session's recursion limits."""
    view = "meridia_tree_nodes"
    nodes.select(*NODE).createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH RECURSIVE t AS (
          SELECT tree_id, node_id, parent_id, position, 0 AS depth, array(node_id) AS path, array(position) AS `order` FROM {view} WHERE parent_id IS NULL
          UNION ALL
          SELECT n.tree_id, n.node_id, n.parent_id, n.position, t.depth + 1, concat(t.path, array(n.node_id)), concat(t.`order`, array(n.position))
          FROM {view} n JOIN t ON n.tree_id = t.tree_id AND n.parent_id = t.node_id
        ) SELECT * FROM t""")


def children(nodes: DataFrame) -> DataFrame:
    """Children in the order their parent declares (children_ids), not by position."""
    declared = nodes.select("tree_id", F.col("node_id").alias("parent"), F.posexplode("children_ids").alias("nth", "child"))
    held = nodes.drop("children_ids").withColumnRenamed("node_id", "child")
    return declared.join(held, ["tree_id", "child"]).orderBy("tree_id", "parent", "nth")


def find_path(walked: DataFrame, node_id: Column) -> DataFrame:
    """Ids from the root to a node; no row where it is unknown or cannot be reached."""
    return walked.where(F.col("node_id") == node_id).select("tree_id", "path")


def leaf_text(walked: DataFrame, contents: DataFrame) -> DataFrame:
    """(tree_id, node_id, text): a leaf's content, or that of the leaves below in reading order with blank lines between; empty leaves are skipped."""
    parents = walked.where("parent_id is not null").select("tree_id", F.col("parent_id").alias("node_id")).distinct()
    leaves = walked.join(parents, ["tree_id", "node_id"], "left_anti").join(contents.select("tree_id", "node_id", "content"), ["tree_id", "node_id"], "left")
    each = leaves.select("tree_id", F.explode("path").alias("node_id"), "order", F.coalesce("content", F.lit("")).alias("content"))
    grouped = each.groupBy("tree_id", "node_id").agg(F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("order", "content")))).alias("c"))
    return grouped.select("tree_id", "node_id", F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("text"))


def violations(nodes: DataFrame, pages: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """(tree_id, rule, node_id) of every broken rule; nodes may have children_ids and pages (arrays).

    pages: (tree_id, page) of the sources, to check citations against;
    declared: (tree_id, root_id) of the trees that there are, each of which must
    have nodes, and that node as its root. A circle is not reachable. Nothing is
    broadcast: both sides of each join grow with the trees.
    """
    n = nodes.select(*NODE, *[c for c in ("children_ids", "pages") if c in nodes.columns])

    def broken(df: DataFrame, rule: str, node: str = "node_id") -> DataFrame:
        return df.select("tree_id", F.lit(rule).alias("rule"), F.col(node).cast("string").alias("node_id"))

    roots = n.groupBy("tree_id").agg(F.count_if(F.col("parent_id").isNull()).alias("k")).where("k <> 1")
    repeated = n.groupBy("tree_id", "node_id").agg(F.count("*").alias("k")).where("k > 1")
    places = n.groupBy("tree_id", "parent_id", "position").agg(F.count("*").alias("k"), F.min("node_id").alias("node_id")).where("k > 1")
    ids = n.select("tree_id", F.col("node_id").alias("parent_id"))
    orphans = n.where("parent_id is not null").join(shuffled(ids), ["tree_id", "parent_id"], "left_anti")
    reached = climb(n, "tree_id", "node_id", "parent_id", F.col("parent_id").isNull()).select("tree_id", "node_id")
    lost = n.join(shuffled(reached), ["tree_id", "node_id"], "left_anti")
    parts = [
        broken(roots.withColumn("node_id", F.lit(None).cast("string")), "one root"),
        broken(repeated, "unique id"),
        broken(places, "unique position"),
        broken(orphans, "known parent"),
        broken(lost, "reachable"),
    ]
    if declared is not None:
        own = n.select("tree_id").distinct()
        tops = n.where("parent_id is null").select("tree_id", F.col("node_id").alias("root_id"))
        parts.append(broken(declared.join(shuffled(own), "tree_id", "left_anti"), "no nodes", "root_id"))
        parts.append(broken(declared.join(shuffled(own), "tree_id", "left_semi").join(shuffled(tops), ["tree_id", "root_id"], "left_anti"), "declared root", "root_id"))
    if "children_ids" in n.columns:
        links = n.select("tree_id", F.col("node_id").alias("parent_id"), F.explode("children_ids").alias("node_id"))
        up = n.where("parent_id is not null").select("tree_id", "parent_id", "node_id")
        parts += [
            broken(links.groupBy("tree_id", "parent_id", "node_id").agg(F.count("*").alias("k")).where("k > 1"), "unique child link"),
            broken(links.join(shuffled(up), ["tree_id", "parent_id", "node_id"], "left_anti"), "child names parent"),
            broken(up.join(shuffled(links), ["tree_id", "parent_id", "node_id"], "left_anti"), "parent names child"),
        ]
    if "pages" in n.columns:
        parts.append(broken(n.where(F.exists("pages", lambda p: p < 1)), "positive page"))
        above = n.select("tree_id", F.col("node_id").alias("parent_id"), F.col("pages").alias("above"))
        parts.append(broken(n.join(shuffled(above), ["tree_id", "parent_id"]).where(F.size(F.array_except("pages", "above")) > 0), "page within parent"))
        if pages is not None:
            cited = n.select("tree_id", "node_id", F.explode("pages").alias("page"))
            parts.append(broken(cited.join(shuffled(pages), ["tree_id", "page"], "left_anti"), "page in source"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_violations(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(tree_id, rule, page) where a tree and its source differ: the root must name every page of the source, and no node any other.

    nodes: tree_id, node_id, parent_id, pages; pages: tree_id, page.
    """
    cited = nodes.select("tree_id", "parent_id", F.explode("pages").alias("page"))
    outside = cited.select("tree_id", "page").distinct().join(shuffled(pages), ["tree_id", "page"], "left_anti")
    missing = pages.distinct().join(shuffled(cited.where("parent_id is null").select("tree_id", "page").distinct()), ["tree_id", "page"], "left_anti")
    return outside.select("tree_id", F.lit("page in source").alias("rule"), "page").unionByName(missing.select("tree_id", F.lit("root covers source").alias("rule"), "page"))


def split_trees(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trees, nodes) of trees with a column ``nodes`` (array of structs with node_id): each node as a row with its JSON and hash, each tree with the hash of all of them in order."""
    nodes = trees.select("tree_id", F.explode("nodes").alias("n")).select("tree_id", "n.node_id", F.to_json("n", {"ignoreNullFields": "false"}).alias("payload_json"))
    nodes = nodes.withColumn("content_hash", F.sha2("payload_json", 256))
    whole = nodes.groupBy("tree_id").agg(F.count("*").alias("node_count"), _tree_hash().alias("canonical_hash"))
    return whole, nodes


def _tree_hash() -> Column:
    return F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("node_id", "content_hash")))), 256)


def assembled(trees: DataFrame, nodes: DataFrame, node_type: str) -> DataFrame:
    """(tree_id, nodes, intact): trees from the rows of ``split_trees``; intact if every node has its hash and all of them that of the tree.

    A tree whose rows were changed, lost or added to is not intact. A tree is one value.
    """
    checked = nodes.withColumn("ok", F.sha2("payload_json", 256) == F.col("content_hash"))
    got = checked.groupBy("tree_id").agg(
        F.array_sort(F.collect_list(F.struct("node_id", F.from_json("payload_json", node_type).alias("n")))).alias("n"), F.bool_and("ok").alias("ok"), F.count("*").alias("k"), _tree_hash().alias("h")
    )
    both = trees.join(got, "tree_id", "left")
    intact = F.coalesce(F.col("ok") & (F.col("k") == F.col("node_count")) & (F.col("h") == F.col("canonical_hash")), F.lit(False))
    return both.select("tree_id", F.transform("n", lambda x: x["n"]).alias("nodes"), intact.alias("intact"))


def evidence(nodes: DataFrame, texts: DataFrame, source_revision_id: Column | None = None, kind: str = "paper_structure_tree") -> DataFrame:
    """(tree_id, node_id, title, content, pages, locator) of nodes; a node without text is an error.

    texts: ``leaf_text`` of the trees. The locator is null where trees have no source.
    """
    found = nodes.drop("content").join(texts.select("tree_id", "node_id", F.col("text").alias("content")), ["tree_id", "node_id"], "left")
    content = F.when(F.coalesce("content", F.lit("")) != "", F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no content at node "), F.col("node_id"))))
    locator = F.lit(None) if source_revision_id is None else F.struct(source_revision_id.alias("source_revision_id"), F.col("tree_id").alias("artifact_id"), F.lit(kind).alias("artifact_kind"), F.col("node_id").alias("member_id"))
    pages = F.col("pages") if "pages" in nodes.columns else F.lit(None).cast("array<int>")
    return found.select("tree_id", "node_id", "title", content.alias("content"), pages.alias("pages"), locator.alias("locator"))


def node_content(nodes: DataFrame, texts: DataFrame, node_ids: list[str], most: int = 5) -> DataFrame:
    """Evidence of the named nodes of one tree, in the order they are named; ValueError for too many, or for one that is unknown."""
    if len(node_ids) > most:
        raise ValueError(f"more than {most} nodes are asked for at once")
    asked = nodes.sparkSession.createDataFrame(list(enumerate(node_ids)), "nth int, node_id string")
    if lost := asked.join(nodes, "node_id", "left_anti").limit(1).collect():
        raise ValueError(f"unknown node {lost[0]['node_id']}")
    return evidence(nodes, texts).join(F.broadcast(asked), "node_id").orderBy("nth").drop("nth")  # at most ``most`` rows


def flat_groups(pages: Column, max_nodes: int) -> Column:
    """Pages per leaf of the flat fallback tree: one root and at most max_nodes - 1 leaves."""
    leaves = F.least(pages, F.greatest(F.lit(0), F.lit(max_nodes - 1)))
    return F.when(leaves > 0, F.ceil(pages / leaves).cast("int"))


def page_range(start: Column, end: Column, source: Column) -> Column:
    """Pages start to end if all are in the source, else null."""
    pages = F.sequence(start, end)
    return F.when((start <= end) & (F.size(F.array_except(pages, source)) == 0), pages)


def budgeted(nodes: DataFrame, token_budget: int, key: str, order: str, title: str, summary: str, short: int = 80) -> DataFrame:
    """(key, serialised, truncated): nodes in order as JSON within 4 characters a token.

    A node that does not fit is tried with the first ``short`` characters of
    its summary; if that does not fit either, it and all after it are left out.
    """
    item = lambda s: F.to_json(F.struct(F.col(order).alias("n"), F.col(title).alias("title"), s.alias("summary")))
    rows = nodes.select(key, order, item(F.col(summary)).alias("long"), item(F.substring(summary, 1, short)).alias("brief"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "long", "brief"))).alias("c"))
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("stop"))
    room = 4 * token_budget - 2

    def step(acc: Column, x: Column) -> Column:
        joined = lambda s: F.when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit(","), s))
        full, brief = joined(x["long"]), joined(x["brief"])
        fits = F.when(acc["stop"], F.lit(None)).when(F.length(full) <= room, full).when(F.length(brief) <= room, brief)
        return F.struct(F.coalesce(fits, acc["text"]).alias("text"), (acc["stop"] | fits.isNull()).alias("stop"))

    done = listed.select(key, F.aggregate("c", start, step).alias("r"))
    return done.select(key, F.concat(F.lit("["), F.col("r.text"), F.lit("]")).alias("serialised"), F.col("r.stop").alias("truncated"))
