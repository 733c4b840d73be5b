"""Bounded transitive closure over the file-symbol graph of a relationship table (src, rel, dst).

A walk alternates levels: files to symbols and symbols to files. First all roots are walked together, unranked, one join and
one anti-join a level: (root, node) pairs carry whose walk they belong to. Where no budget binds that is the answer.
Only where one does, a root is walked again by rank: a candidate's rank is its first parent's place and its own name, the order of a
breadth-first queue; the symbols of a level are all admitted while files may still be, and files are admitted by rank until the
budget is used. A refused candidate marks the walk as truncated. Frontiers are written tables, so a plan never grows with
the depth and Spark broadcasts them only where they are small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage_cut import written
from .ordering import dense_numbers

MAX_DEPTH, MAX_NODES = 64, 4096
#: Rows of a frontier that may be ranked in one task (name and place only).
IN_ONE_TASK = 100_000


@dataclass
class Traversal:
    """nodes: one column, node."""

    nodes: DataFrame
    truncated: bool


def edges(rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """depends and defines, each as distinct (file, symbol)."""
    of = lambda rel: rels.where(F.col("rel") == rel).select(F.col("src").alias("file"), F.col("dst").alias("symbol")).distinct()
    return of("depends-on"), of("defines")


def _steps(depends: DataFrame, defines: DataFrame, forward: bool) -> tuple[DataFrame, DataFrame]:
    """parent, child from files to symbols and from symbols to files; forward: to what a file needs."""
    a, b = (depends, defines) if forward else (defines, depends)
    return a.select(F.col("file").alias("parent"), F.col("symbol").alias("child")), b.select(F.col("symbol").alias("parent"), F.col("file").alias("child"))


def _none(df: DataFrame, schema: str = "node string") -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _closure(roots: DataFrame, are_files: bool, steps: tuple[DataFrame, DataFrame], max_depth: int) -> tuple[DataFrame, bool]:
    """root, node of every file that each root's walk meets besides the root, and whether the depth cut any walk."""
    frontier = roots.select("root", F.col("root").alias("node"))
    parts: dict[bool, list[DataFrame]] = {are_files: [frontier], not are_files: []}
    is_file, depth = are_files, 0
    while True:
        found = frontier.join(steps[not is_file], frontier["node"] == steps[not is_file]["parent"]).select("root", F.col("child").alias("node")).distinct()
        for seen in parts[not is_file]:
            found = found.join(seen, ["root", "node"], "left_anti")
        found, depth, is_file = written(found), depth + 1, not is_file
        if found.isEmpty():
            break
        if depth > max_depth:
            return _files(parts, roots, are_files), True
        frontier = found
        parts[is_file].append(frontier)
        if len(parts[is_file]) > 8:  # a walk may be deep: few tables, so that plans stay small
            parts[is_file] = [written(_union(parts[is_file]))]
    return _files(parts, roots, are_files), False


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _files(parts: dict[bool, list[DataFrame]], roots: DataFrame, are_files: bool) -> DataFrame:
    found = _union(parts[True]) if parts[True] else roots.limit(0).select("root", F.col("root").alias("node"))
    return found.where("root <> node") if are_files else found


def _placed(found: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """found with place: its rank. A frontier of at most IN_ONE_TASK rows is ranked in one task."""
    if n > IN_ONE_TASK:
        return dense_numbers(found.select(*keys), keys, "place")
    return found.select(*keys, (F.row_number().over(Window.orderBy(*keys)) - 1).cast("bigint").alias("place"))


def _walk(frontier: DataFrame, is_file: bool, steps: tuple[DataFrame, DataFrame], seen: dict[bool, list[DataFrame]], emitted: list[DataFrame], used: int, depth: int, max_depth: int, max_nodes: int) -> Traversal:
    """By rank. frontier: node, place. seen: nodes visited, by whether they are files; emitted: files that count, used of them."""
    truncated, none = False, _none(frontier)
    while True:
        step = steps[not is_file]
        found = frontier.join(step, frontier["node"] == step["parent"]).groupBy(F.col("child").alias("node")).agg(F.min("place").alias("parent_place"))
        for table in seen[not is_file]:
            found = found.join(table, "node", "left_anti")
        found = written(found)
        n, depth, is_file = found.count(), depth + 1, not is_file
        if not n:
            break
        room = max(0, max_nodes - used)
        if depth > max_depth or not room:
            truncated = True
            break
        placed = _placed(found, n, ["parent_place", "node"])
        if is_file:
            truncated |= n > room
            placed = placed.where(F.col("place") < room)
            used += min(n, room)
        frontier = written(placed.select("node", "place"))
        if is_file:
            emitted = [*emitted, frontier.select("node")]
        seen[is_file] = [*seen[is_file], frontier.select("node")]
        if len(seen[is_file]) > 8:  # a walk may be deep: few tables, so that plans stay small
            seen[is_file] = [written(_union(seen[is_file]))]
            emitted = [written(_union(emitted))] if emitted else []
    return Traversal(_union(emitted).distinct() if emitted else none, truncated)


def dependencies(rels: DataFrame, root: str, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Traversal:
    """Files that root needs, through any number of steps; root itself is left out."""
    steps = _steps(*(written(e) for e in edges(rels)), True)
    spark = rels.sparkSession
    found, cut = _closure(spark.createDataFrame([(root,)], "root string"), True, steps, max_depth)
    if not cut and found.count() < max_nodes:
        return Traversal(found.select("node"), False)
    start = spark.createDataFrame([(root, 0)], "node string, place bigint")
    return _walk(start, True, steps, {True: [start.select("node")], False: []}, [], 0, 0, max_depth, max_nodes)


def _dependents(depends: DataFrame, defines: DataFrame, node: str, is_file: bool, max_depth: int, max_nodes: int) -> Traversal:
    """By rank. A refused seed ends the walk at once."""
    spark, empty = depends.sparkSession, _none(depends)
    steps = _steps(depends, defines, False)
    start = spark.createDataFrame([(node,)], "node string")
    seeds = steps[not is_file].where(F.col("parent") == node).select(F.col("child").alias("node")).distinct()
    seen = {is_file: [start], not is_file: []}
    n = seeds.count()
    if n and (max_depth < 1 or max_nodes < 1):
        return Traversal(empty, True)
    placed = written(_placed(seeds, n, ["node"]))
    if is_file:
        seen[False].append(placed.select("node"))
        return _walk(placed, False, steps, seen, [], 0, 1, max_depth, max_nodes)
    emitted = placed.where(F.col("place") < max_nodes).select("node")
    if n > max_nodes:
        return Traversal(emitted, True)
    seen[True].append(emitted)
    return _walk(placed, True, steps, seen, [emitted], n, 1, max_depth, max_nodes)


def dependents(rels: DataFrame, node: str, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Traversal:
    """Files that need node, a file or a symbol, through any number of steps."""
    depends, defines = (written(e) for e in edges(rels))
    is_file = not depends.where(F.col("file") == node).isEmpty() or not defines.where(F.col("file") == node).isEmpty()
    found, cut = _closure(rels.sparkSession.createDataFrame([(node,)], "root string"), is_file, _steps(depends, defines, False), max_depth)
    if not cut and found.count() < max_nodes:
        return Traversal(found.select("node"), False)
    return _dependents(depends, defines, node, is_file, max_depth, max_nodes)


def invalidated(rels: DataFrame, changed: list[str], max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Traversal:
    """The changed files and all that need them; max_nodes bounds the dependents of all of them together, roots taken in order.

    All roots are walked at once. Only where the budget may bind each has a walk of its own, because what it may use depends on the walks before."""
    spark = rels.sparkSession
    roots = sorted(set(changed))
    affected = spark.createDataFrame([(r,) for r in roots], "node string")
    if not roots:
        return Traversal(affected, False)
    depends, defines = (written(e) for e in edges(rels))
    files = depends.select("file").union(defines.select("file")).where(F.col("file").isin(roots)).distinct().collect()  # at most as many as there are roots
    files = {r[0] for r in files}
    found, cut = None, False
    for are_files in (True, False):
        own = [(r,) for r in roots if (r in files) == are_files]
        if own:
            part, short = _closure(spark.createDataFrame(own, "root string"), are_files, _steps(depends, defines, False), max_depth)
            found, cut = part if found is None else found.unionByName(part), cut or short
    found = written(found)
    size = found.groupBy("root").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    if not cut and size + found.select("node").distinct().count() < max_nodes:
        return Traversal(affected.unionByName(found.select("node")).distinct(), False)
    truncated = False
    for root in roots:
        gathered = affected.count() - len(roots)
        walk = _dependents(depends, defines, root, root in files, max_depth, max(0, max_nodes - gathered))
        affected = written(affected.unionByName(walk.nodes).distinct())
        truncated |= walk.truncated
    return Traversal(affected, truncated)


def hubs(rels: DataFrame, top: int) -> DataFrame:
    """The files with the most dependencies; ties by name."""
    return rels.where("rel = 'depends-on'").groupBy("src").agg(F.count("*").alias("fanout")).orderBy(F.desc("fanout"), "src").limit(top)


def invalidation_roots(verdicts: DataFrame, rels: DataFrame, top: int) -> DataFrame:
    """node, changed, hub: the changed paths (added, removed or modified) and the top hubs, each once."""
    changed = verdicts.where("verdict <> 0").select(F.col("path").alias("node"), F.lit(True).alias("changed"))
    found = changed.join(hubs(rels, top).select(F.col("src").alias("node"), F.lit(True).alias("hub")), "node", "full_outer")
    return found.select("node", F.coalesce("changed", F.lit(False)).alias("changed"), F.coalesce("hub", F.lit(False)).alias("hub"))
