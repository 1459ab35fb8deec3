"""Graph operators over nodes (id, type, name) and edges (src, dst, type), as joins.

Paths grow by one join a hop from the seeds outwards, so only reached rows are joined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.storage import cut

#: Bounds of depth and rows (fixed values).
MAX_DEPTH, MAX_ROWS = 10, 10_000
OPERATORS = ("=", "!=", "<", ">", "<=", ">=", "STARTS WITH", "ENDS WITH", "CONTAINS", "IS NULL", "IS NOT NULL")


def identifier(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not an identifier: {name!r}")
    return name


def bounded(value: int, low: int = 0, high: int = 1000) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
        raise ValueError(f"not a whole number from {low} to {high}: {value!r}")
    return value


def predicate(prop: str, operator: str, value: object = None) -> Column:
    """One condition on a property."""
    c = F.col(identifier(prop))
    forms = {"=": lambda: c == value, "!=": lambda: c != value, "<": lambda: c < value, ">": lambda: c > value, "<=": lambda: c <= value, ">=": lambda: c >= value, "STARTS WITH": lambda: c.startswith(value), "ENDS WITH": lambda: c.endswith(value), "CONTAINS": lambda: c.contains(value), "IS NULL": lambda: c.isNull(), "IS NOT NULL": lambda: c.isNotNull()}
    if operator not in forms:
        raise ValueError(f"operator must be one of {', '.join(OPERATORS)}")
    return forms[operator]()


def match_nodes(nodes: DataFrame, types: list[str] | None = None, properties: dict[str, object] | None = None) -> DataFrame:
    out = nodes.where(F.col("type").isin(types)) if types else nodes
    for name, value in (properties or {}).items():
        out = out.where(predicate(name, "=", value))
    return out


def match_edges(edges: DataFrame, types: list[str] | None = None, src: str | None = None, dst: str | None = None) -> DataFrame:
    out = edges.where(F.col("type").isin(types)) if types else edges
    out = out.where(F.col("src") == src) if src is not None else out
    return out.where(F.col("dst") == dst) if dst is not None else out


def one_hop(nodes: DataFrame, edges: DataFrame, text: str, types: list[str] | None = None) -> DataFrame:
    """(source, type, target) names of edges with the text in the name at either end."""
    a, b = (nodes.select(F.col("id").alias(k), F.col("name").alias(n)) for k, n in (("src", "source"), ("dst", "target")))
    has = F.contains("source", F.lit(text)) | F.contains("target", F.lit(text))
    return match_edges(edges, types).join(a, "src").join(b, "dst").where(has).select("source", "type", "target")


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, type, edge) in the direction asked for; ``edge`` tells an edge from all others."""
    e = edges.select("src", "dst", "type", F.concat_ws(">", "src", "type", "dst").alias("edge"))
    out, back = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type", "edge"), e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type", "edge")
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("direction must be outgoing, incoming or both")
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def paths(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "outgoing", types: list[str] | None = None) -> DataFrame:
    """All paths of 1 to ``depth`` edges from seeds (id): start, node, hops, nodes; no edge occurs twice in a path."""
    bounded(depth, 1, MAX_DEPTH)
    step = oriented(match_edges(edges, types), direction).drop("type")
    now = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("nodes"), F.array().cast("array<string>").alias("used"))
    found = None
    for hop in range(1, depth + 1):
        now = now.join(step, now["node"] == step["a"]).where(~F.array_contains("used", F.col("edge")))
        now = now.select("start", F.col("b").alias("node"), F.concat("nodes", F.array("b")).alias("nodes"), F.concat("used", F.array("edge")).alias("used"))
        part = now.select("start", "node", F.lit(hop).alias("hops"), "nodes")
        found = part if found is None else found.unionByName(part)
    return found


def neighbourhood(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(start, node, distance): each node within ``depth`` edges once, seeds left out.

    Only nodes that are new in a round go on, so the work is that of the nodes reached. Rounds
    of deep searches are written to the shared folder, so plans stay small.
    """
    bounded(depth, 1, MAX_DEPTH)
    step = oriented(match_edges(edges, types), direction).select("a", "b").distinct()
    step = cut(step) if depth > 2 else step
    start = seeds.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    seen = front = start
    for hop in range(1, depth + 1):
        near = front.join(step, front["node"] == step["a"]).select("start", F.col("b").alias("node")).distinct()
        front = near.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(hop))
        if depth > 2:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def shortest_paths(edges: DataFrame, source: str, target: str, depth: int = 4, direction: str = "outgoing") -> DataFrame:
    """Paths from one node to another, shortest first."""
    seed = edges.sparkSession.createDataFrame([(source,)], "id string")
    return paths(seed, edges, depth, direction).where(F.col("node") == target).select("hops", F.array_join("nodes", "|").alias("path")).orderBy("hops", "path")


def multi_hop(nodes: DataFrame, edges: DataFrame, text: str, hops: int = 3, limit: int = 50) -> DataFrame:
    """Paths from nodes with the text in their names, each path once, shortest first."""
    seeds = nodes.where(F.contains("name", F.lit(text)))
    found = paths(seeds, edges, hops).select("hops", F.array_join("nodes", "|").alias("path")).distinct()
    return found.orderBy("hops", "path").limit(bounded(limit, 1, MAX_ROWS))


def first_neighbours(edges: DataFrame, fan: int = 3, order: str | None = None) -> DataFrame:
    """(a, b, place): the first ``fan`` edges of each node, by ``order`` if given and then by target and type; Spark cuts hubs before it shuffles."""
    w = Window.partitionBy("src").orderBy(*([order] if order else []), "dst", "type")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= fan).select(F.col("src").alias("a"), F.col("dst").alias("b"), "place")


def traversals(seeds: DataFrame, edges: DataFrame, hops: int = 3, fan: int = 3, order: str | None = None, within: DataFrame | None = None) -> DataFrame:
    """(start, nodes): from each seed (id) the first ``hops`` nodes met in depth-first order.

    A node leads on to its first ``fan`` edges, hubs too; a way never meets a node twice, and
    is at most ``hops`` nodes long. ``within`` (id) names the only nodes that lead on. The
    frontier grows by one join a hop; a seed without edges has itself alone. Repeated seeds
    count once, null ids are left out; repeated edges count as edges of their own.
    """
    bounded(hops, 1, MAX_DEPTH)
    bounded(fan, 1)
    step = first_neighbours(edges, fan, order).withColumnRenamed("place", "turn")
    if within is not None:
        step = step.join(within.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    step = cut(step)
    front = seeds.where("id is not null").select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("way"), F.array().cast("array<int>").alias("place")).distinct()
    met = front
    for hop in range(1, hops):
        near = front.join(step, F.col("node") == F.col("a")).where(~F.array_contains("way", F.col("b")))
        front = near.select("start", F.col("b").alias("node"), F.concat("way", F.array("b")).alias("way"), F.concat("place", F.array("turn")).alias("place"))
        met = met.unionByName(front)
    # a way's places come before those of the ways that go on from it, so their order is depth-first
    found = F.array_sort(F.collect_list(F.struct("place", "node")))
    return met.groupBy("start").agg(F.slice(F.transform(found, lambda x: x["node"]), 1, hops).alias("nodes"))


def optional_match(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every node with its outgoing edges, if any: n_edges and targets in order."""
    e = edges.groupBy("src").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("targets"))
    return nodes.join(e, nodes["id"] == e["src"], "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n_edges"), F.coalesce("targets", F.lit("")).alias("targets"))


def callers(edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """Functions that call ``name`` within ``depth`` calls."""
    seed = edges.sparkSession.createDataFrame([(name,)], "id string")
    return neighbourhood(seed, edges, depth, "incoming", ["CALLS"]).select(F.col("node").alias("name"), "distance")


def callees(edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    seed = edges.sparkSession.createDataFrame([(name,)], "id string")
    return neighbourhood(seed, edges, depth, "outgoing", ["CALLS"]).select(F.col("node").alias("name"), "distance")


def importers(edges: DataFrame, name: str) -> DataFrame:
    return match_edges(edges, ["IMPORTS"], dst=name).select(F.col("src").alias("name")).distinct()


def dead_code(functions: DataFrame, edges: DataFrame, decorators: list[str] | None = None) -> DataFrame:
    """Functions (name, and ``decorators`` if asked for) that nothing calls."""
    calls = match_edges(edges, ["CALLS"]).select(F.col("dst").alias("name"))
    free = functions.join(calls, "name", "left_anti")
    return free.where(~F.arrays_overlap("decorators", F.array(*map(F.lit, decorators)))) if decorators else free


def hierarchy(edges: DataFrame, name: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Ancestors (negative distance) and descendants of a class by INHERITS edges."""
    seed = edges.sparkSession.createDataFrame([(name,)], "id string")
    up = neighbourhood(seed, edges, depth, "outgoing", ["INHERITS"]).select("node", (-F.col("distance")).alias("distance"))
    return up.unionByName(neighbourhood(seed, edges, depth, "incoming", ["INHERITS"]).select("node", "distance"))


def overrides(methods: DataFrame, edges: DataFrame, method: str) -> DataFrame:
    """Subclasses that define the method again; methods: class, name."""
    m = methods.where(F.col("name") == method).select("class")
    e = match_edges(edges, ["INHERITS"])
    pairs = e.join(m.withColumnRenamed("class", "src"), "src").join(m.withColumnRenamed("class", "dst"), "dst")
    return pairs.select(F.col("src").alias("subclass"), F.col("dst").alias("parent")).distinct()


def communities(edges: DataFrame, least: int = 2) -> DataFrame:
    """(id, community): connected components with at least ``least`` members, named by their smallest id.

    Labels spread by minima along edges and then along labels of labels, so rounds grow with
    the logarithm of a component's width; each round is written to the shared folder.
    """
    both = edges.where("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = cut(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("l")).select(F.col("a").alias("id"), "l")
    changed = True
    while changed:
        near = both.join(labels.select(F.col("id").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = step.join(labels.select(F.col("id").alias("l"), F.col("l").alias("ll")), "l").select("id", "old", F.least("l", "ll").alias("l"))
        jump = cut(jump)
        changed = not jump.where("old <> l").isEmpty()
        labels = jump.select("id", "l")
    sizes = labels.groupBy("l").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labels.join(sizes, "l").select("id", F.col("l").alias("community"))


def merge_nodes(current: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes (id, type, properties map) upserted: new properties overlay old ones."""
    c, n = current.alias("c"), new.alias("n")
    empty = F.create_map().cast("map<string,string>")
    overlay = F.map_concat(F.map_filter(F.coalesce("c.properties", empty), lambda k, v: ~F.array_contains(F.map_keys(F.coalesce(F.col("n.properties"), empty)), k)), F.coalesce("n.properties", empty))
    return c.join(n, F.col("c.id") == F.col("n.id"), "full").select(F.coalesce("n.id", "c.id").alias("id"), F.coalesce("n.type", "c.type").alias("type"), overlay.alias("properties"))


def merge_edges(current: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with new ones added whose ends both exist; each (src, dst, type) once."""
    return known_ends(current.unionByName(new), nodes).dropDuplicates(["src", "dst", "type"])


def merge_architecture(nodes: DataFrame, edges: DataFrame, components: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the components (id, type, properties), then the relationships (src, dst, type) of an architecture are merged.

    Components of one id become one first, later types and properties over earlier ones in
    their order; relationships with an unknown end are left out. A null id is no component.
    """
    given = components.where("id is not null")
    pairs = given.select("id", "type", F.explode_outer("properties").alias("k", "v"))
    held = pairs.where("k is not null").groupBy("id", "k").agg(F.max("v").alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    once = given.groupBy("id").agg(F.max("type").alias("type")).join(held, "id", "left").select("id", "type", F.coalesce("properties", F.create_map().cast("map<string,string>")).alias("properties"))
    after = merge_nodes(nodes, once)
    return after, merge_edges(edges, relationships.select("src", "dst", "type"), after)


def related(seeds: DataFrame, edges: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """(start, node, distance): nodes within ``depth`` steps along edges of any of the types, and against those that say DEPENDS_ON; each once, without the start."""
    kept = match_edges(edges, types)
    back = kept.where("type = 'DEPENDS_ON'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    return neighbourhood(seeds, kept.unionByName(back), depth, "outgoing")


def dependencies(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name, other): what imports each named node, all of them without ``names`` (name)."""
    found = match_edges(edges, ["IMPORTS"]).select(F.col("dst").alias("name"), F.col("src").alias("other")).distinct()
    return found if names is None else found.join(names.select("name").distinct(), "name", "left_semi")


def usage(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(name, other): what each named node calls, all of them without ``names`` (name)."""
    found = match_edges(edges, ["CALLS"]).select(F.col("src").alias("name"), F.col("dst").alias("other")).distinct()
    return found if names is None else found.join(names.select("name").distinct(), "name", "left_semi")


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def code_entities_to_edges(entities: DataFrame) -> DataFrame:
    """Edges of code entities (name, file, calls, imports, inherits): files contain them, and they call, import, inherit."""
    parts = [entities.select(F.concat(F.lit("file:"), "file").alias("src"), F.col("name").alias("dst"), F.lit("CONTAINS").alias("type"))]
    for column, kind in (("calls", "CALLS"), ("imports", "IMPORTS"), ("inherits", "INHERITS")):
        parts.append(entities.select(F.col("name").alias("src"), F.explode(column).alias("dst"), F.lit(kind).alias("type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similar_by_type(elements: DataFrame, own: str = "id", kind: str = "kind") -> DataFrame:
    """(a, b, shared): pairs of different owners by the number of element types they share."""
    e = elements.select(F.col(own).alias("id"), F.col(kind).alias("kind")).distinct()
    a, b = e.select(F.col("id").alias("a"), "kind"), e.select(F.col("id").alias("b"), "kind")
    return a.join(b, "kind").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def covering(required: DataFrame, present: DataFrame) -> DataFrame:
    """(pattern, owner) where the owner has all required elements; required: pattern, element; present: owner, element."""
    r = required.distinct()
    need = r.groupBy("pattern").agg(F.count("*").alias("need"))
    have = r.join(present.distinct(), "element").groupBy("pattern", "owner").agg(F.count("*").alias("have"))
    return have.join(need, "pattern").where("have = need").select("pattern", "owner")


#: Kinds of code graph questions and what answers them.
CODE_QUERIES = {"find_callers": lambda e, t: callers(e, t), "find_callees": lambda e, t: callees(e, t), "find_all_callers": lambda e, t: callers(e, t, MAX_DEPTH), "find_all_callees": lambda e, t: callees(e, t, MAX_DEPTH), "find_importers": importers, "class_hierarchy": hierarchy, "call_chain": lambda e, t: callees(e, t, MAX_DEPTH), "module_deps": lambda e, t: match_edges(e, ["IMPORTS"], src=t).select(F.col("dst").alias("name"))}


def code_query(edges: DataFrame, kind: str, target: str, limit: int = 20) -> DataFrame:
    if kind not in CODE_QUERIES:
        raise ValueError(f"kind must be one of {', '.join(CODE_QUERIES)}")
    return CODE_QUERIES[kind](edges, target).limit(bounded(limit, 1, MAX_ROWS))
