"""Graph operators on edge tables: frontier joins that write each hop, and depth-first flows per seed."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import count, groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.relational import numbered
from lodestrata.sources.storage import stored


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """node, depth: all nodes that follow from seeds (node) along edges (src, dst), with their smallest depth.

    Without a max_depth hops go on until no new node is found, which a finite graph makes sure of. Breadth first: the edges
    are written once, each hop joins its frontier with them and drops the nodes of all frontiers so far by an anti join,
    so a hop costs its frontier's edges, and a cycle ends by itself.
    """
    edges = stored(edges.select("src", "dst"), "edges")
    frontier = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "hop")
    visited = frontier
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)), "hop")
        if frontier.isEmpty():
            break
        # Each hop is a table of its own; now and then they become one, so that plans stay short.
        visited = visited.unionByName(frontier) if depth % 16 else stored(visited.unionByName(frontier), "visited")
    return visited


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes reachable from seeds at any depth."""
    return reach(edges, seeds, None).select("node")


#: Edges of the sources that one task counts the reach of, about; and steps of two hops that it looks at together.
BLOCK_EDGES, BLOCK_STEPS = 250_000, 500_000


def _reached(own: pd.DataFrame, onward: pd.DataFrame, most: int) -> pd.DataFrame:
    """src, n_reach of one block: own (src, dst), all edges of its sources, and onward (mid, far), all edges of their targets."""
    n, m = len(own), len(onward)
    code, names = pd.factorize(np.concatenate([own["src"].to_numpy(), own["dst"].to_numpy(), onward["mid"].to_numpy(), onward["far"].to_numpy()]))
    src, dst, mid, far = code[:n], code[n : 2 * n], code[2 * n : 2 * n + m], code[2 * n + m :]
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    far = far[np.argsort(mid, kind="stable")]
    begin = np.r_[0, np.cumsum(np.bincount(mid, minlength=len(names)))]
    steps = np.diff(begin)[dst]
    first = np.flatnonzero(np.r_[True, src[1:] != src[:-1]])
    # Whole sources at a time, as many as have `most` steps.
    until = np.cumsum(np.add.reduceat(steps + 1, first))
    reach, a = np.zeros(len(first), np.int64), 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(until, (until[a - 1] if a else 0) + most, side="right")))
        e, f = first[a], first[b] if b < len(first) else n
        row = np.repeat(np.arange(b - a), np.diff(np.r_[first[a:b], f]))
        some = steps[e:f]
        place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(begin[dst[e:f]], some)
        rows, nodes = np.r_[row, np.repeat(row, some)], np.r_[dst[e:f], far[place]]
        if (b - a) * len(names) <= 8 * len(rows) + (1 << 20):
            met = np.zeros((b - a, len(names)), bool)
            met.ravel()[rows * len(names) + nodes] = True
            met[np.arange(b - a), src[first[a:b]]] = False
            reach[a:b] = met.sum(axis=1)
        else:
            pair = np.unique((rows * len(names) + nodes)[nodes != src[first[a:b]][rows]])
            reach[a:b] = np.bincount(pair // len(names), minlength=b - a)
        a = b
    return pd.DataFrame({"src": names[src[first]], "n_reach": reach})[reach > 0]


def two_hop(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """src, n_reach: distinct other nodes within two hops of each source, of all or of given ones (node).

    Sources are dealt by ranges to blocks of about BLOCK_EDGES edges, and what their targets lead to is sent to a block once,
    however many of its sources have this target. So neither pairs of two hops nor their distinct ones are exchanged; a block
    counts them some sources at a time.
    """
    one = stored(edges.select("src", "dst").dropna().distinct(), "edges")
    mine = one if sources is None else one.join(sources.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    n = one.count() // BLOCK_EDGES + 1
    dealt = stored(mine.repartitionByRange(n, "src").withColumn("block", F.spark_partition_id()), "dealt")
    wanted = dealt.select(F.col("block").alias("to"), F.col("dst").alias("mid")).distinct()
    onward = wanted.join(one.select(F.col("src").alias("mid"), F.col("dst").alias("far")), "mid")
    schema = f"src {edges.schema['src'].dataType.simpleString()}, n_reach long"
    most = BLOCK_STEPS
    return dealt.repartition(n, "block").groupBy("block").cogroup(onward.repartition(n, "to").groupBy("to")).applyInPandas(lambda a, b: _reached(a, b, most), schema)


def resolve_aliases(names: DataFrame, aliases: DataFrame, hops: int = 6) -> DataFrame:
    """Adds `target` to names (name): follows aliases (name -> target), at most `hops` times."""
    now = names.withColumn("target", F.col("name"))
    links = aliases.select(F.col("name").alias("_from"), F.col("target").alias("_to"))
    for _ in range(hops):
        now = now.join(links, F.col("target") == F.col("_from"), "left").withColumn("target", F.coalesce("_to", "target")).drop("_from", "_to")
    return now


# Edges that a flow follows and their order on one line; edges that end a path; edges that matter for data.
EDGE_RANK = {"calls": 0, "submits-to": 1, "fetches": 2, "renders": 3, "reads": 4, "tags": 5, "invalidates": 6, "references": 7}
LEAVES = frozenset({"reads", "tags", "invalidates"})
OUTSIDE = frozenset({"submits-to", "fetches", "reads", "tags", "invalidates"})
DATA = frozenset({"fetches", "submits-to", "tags", "invalidates"})
DATA_TARGET = re.compile(r"framework:react-query#(?:fetchQuery|prefetchQuery|dehydrate)|hydrate-provider", re.IGNORECASE)
# Edges whose source depends on their target.
IMPACT_EDGES = ("calls", "renders", "reads", "fetches", "inherits", "submits-to", "references", "delegates-to", "tags", "invalidates")
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def _module(key: str) -> str:
    return key.split("#", 1)[0]


def _matters(kind: str, src: str, dst: str, focus: str) -> bool:
    """Whether a step leaves its module or touches the outside; with the focus on data, only what carries data."""
    if focus == "data":
        return kind in DATA or bool(DATA_TARGET.search(dst))
    return kind in OUTSIDE or (kind != "references" and _module(src) != _module(dst))


def route_entries(exports: DataFrame, routes: DataFrame) -> DataFrame:
    """repository, route, entry: what a route's handler exports (repository, file, entry): its HTTP methods, else all."""
    both = routes.select("repository", "route", F.col("source_file").alias("file")).join(exports, ["repository", "file"])
    method = F.substring_index("entry", "#", -1).isin(*METHODS) & F.contains("entry", F.lit("#"))
    has = both.groupBy("repository", "route").agg(F.bool_or(method).alias("has"))
    return both.withColumn("method", method).join(has, ["repository", "route"]).where("method or not has").select("repository", "route", "entry").distinct()


def flows(edges: DataFrame, seeds: DataFrame, max_steps: int = 40, max_depth: int = 6, max_explore: int = 600, focus: str = "all", entries: DataFrame | None = None) -> DataFrame:
    """Pre-order steps of the depth-first walk from each seed (repository, seed), without branches that lead to nothing.

    edges: repository, src, dst, type, line; entries: repository, route, entry, where a submits-to edge goes on. Gives
    repository, seed, step, depth, type, src, dst, boundary (the step leaves the client), pruned (steps left out),
    truncated (the walk met a bound). A node is entered once, also by depth: nodes at max_depth are entered, none below.

    First the nodes near each seed are found by frontier joins over the edges that lead to nodes with edges of their own, then
    one join cuts out all edges of these nodes. So one task holds a seed's neighbourhood up to max_depth, not a repository;
    a task goes through its sorted seeds one after the other. A line that is null counts as 0.
    """
    max_steps, max_depth = max(1, min(200, max_steps)), max(1, min(12, max_depth))
    max_explore = max(max_steps, min(2000, max_explore))
    edges = edges.where(F.col("type").isin(*EDGE_RANK)).select("repository", F.col("src").alias("node"), "dst", "type", "line")
    follows = ~F.col("type").isin(*LEAVES, "submits-to")
    if entries is not None:
        edges = stored(edges, "edges")
        # The edge itself, and where it goes on, are told apart by `next`: one row for each entry.
        on = entries.select("repository", F.col("route").alias("dst"), F.col("entry").alias("next"))
        submits = edges.where("type = 'submits-to'").join(on, ["repository", "dst"], "left").select(*edges.columns, "next")
        goes = edges.where("type <> 'submits-to'").withColumn("next", F.when(follows, F.col("dst"))).unionByName(submits)
    else:
        goes = edges.withColumn("next", F.when(follows, F.col("dst")))
    goes = stored(goes, "goes")
    # A node without edges has nothing to cut out, so no way to it is followed here; the walk enters it all the same.
    inner = goes.select("repository", F.col("node").alias("next")).distinct()
    ways = goes.where("next is not null").select("repository", "node", "next").join(inner, ["repository", "next"], "left_semi")
    ways = stored(ways.distinct(), "ways")
    near = stored(seeds.select("repository", "seed", F.col("seed").alias("node")).distinct(), "near")
    met = near
    for _ in range(max_depth):
        step = near.join(ways, ["repository", "node"]).select("repository", "seed", F.col("next").alias("node")).distinct()
        near = stored(step.join(met, ["repository", "seed", "node"], "left_anti"), "near")
        if near.isEmpty():
            break
        met = met.unionByName(near)
    found = met.join(goes, ["repository", "node"]).withColumn("line", F.coalesce("line", F.lit(0))).select(*_CUT)
    found = found.repartition("repository", "seed").sortWithinPartitions("repository", "seed")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in _CUT), strict=True))
        out = []
        for (repository, seed), own in groupby(rows, key=itemgetter(0, 1)):
            out += [(repository, seed, *step) for step in _walk(seed, own, max_steps, max_depth, max_explore, focus)]
            if len(out) >= STEPS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _STEP.types, strict=True)], schema=_STEP)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _STEP.types, strict=True)], schema=_STEP)

    return found.mapInArrow(walk, "repository string, seed string, step int, depth int, type string, src string, dst string, boundary boolean, pruned int, truncated boolean")


#: Steps that a task gives at a time, about; the columns of a seed's edges, and of steps.
STEPS = 10_000
_CUT = ("repository", "seed", "node", "dst", "type", "line", "next")
_STEP = pa.schema(
    [("repository", pa.string()), ("seed", pa.string()), ("step", pa.int32()), ("depth", pa.int32()), ("type", pa.string()), ("src", pa.string()), ("dst", pa.string())]
    + [("boundary", pa.bool_()), ("pruned", pa.int32()), ("truncated", pa.bool_())]
)


def _walk(seed: str, rows: Iterable[tuple], max_steps: int, max_depth: int, max_explore: int, focus: str) -> list[tuple]:
    """step, depth, type, src, dst, boundary, pruned, truncated of one seed's walk over rows of _CUT."""
    going: dict[tuple, list[str]] = {}
    for _, _, src, dst, kind, line, to in rows:
        going.setdefault((src, line, EDGE_RANK[kind], dst, kind), []).extend([] if to is None else [to])
    outgoing: dict[str, list[tuple[str, str, list[str]]]] = {}
    for (src, _, _, dst, kind), to in sorted(going.items()):
        outgoing.setdefault(src, []).append((kind, dst, sorted(to)))
    steps, parents, explored, truncated = [], [], 0, False  # steps: depth, kind, src, dst; parents: the step above, or -1
    entered = {seed}
    stack: list[tuple[str, int, int, Iterator]] = [(seed, 0, -1, iter(outgoing.get(seed, ())))]
    queue: list[list[tuple[str, int, int]]] = [[]]  # per open node, where its last step goes on
    while stack:
        if queue[-1]:
            node, depth, above = queue[-1].pop(0)
            if depth > max_depth or node in entered:
                continue
            if explored >= max_explore:
                truncated = True
                continue
            entered.add(node)
            stack.append((node, depth, above, iter(outgoing.get(node, ()))))
            queue.append([])
            continue
        node, depth, above, rest = stack[-1]
        nxt = next(rest, None)
        if nxt is None or explored >= max_explore:
            truncated = truncated or nxt is not None
            stack.pop()
            queue.pop()
            continue
        kind, dst, to = nxt
        explored += 1
        steps.append((depth, kind, node, dst))
        parents.append(above)
        queue[-1] = [(x, depth + 1, len(steps) - 1) for x in to]
    keep = [_matters(kind, src, dst, focus) for _, kind, src, dst in steps]
    for i in range(len(steps) - 1, -1, -1):  # a step stays if one below it stays
        if keep[i] and parents[i] >= 0:
            keep[parents[i]] = True
    kept = [s for s, k in zip(steps, keep, strict=True) if k]
    truncated = truncated or len(kept) > max_steps
    return [(i, depth, kind, src, dst, kind == "submits-to", len(steps) - len(kept), truncated) for i, (depth, kind, src, dst) in enumerate(kept[:max_steps], 1)]


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = 8, follow: Sequence[str] = IMPACT_EDGES) -> DataFrame:
    """seed, affected, kind, depth, via, dependency, file, line: what depends on each seed (seed), by which edge it was found.

    edges: src, dst, type, line, file, src_kind, dst_kind. The seed itself has depth 0 and no edge; a file stands for all
    entities in it. Of the edges that find an entity at its smallest depth, that with the smallest (line, dependency,
    type) is the evidence. Breadth first for all seeds at once; edges are written once.
    """
    back = stored(edges.where(F.col("type").isin(*follow)).select(F.col("dst").alias("at"), F.col("src").alias("affected"), F.col("src_kind").alias("kind"), "type", "file", "line"), "back")
    names = edges.select(F.col("src").alias("key"), F.col("src_kind").alias("kind")).unionByName(edges.select(F.col("dst").alias("key"), F.col("dst_kind").alias("kind")))
    names = stored(names.groupBy("key").agg(F.min("kind").alias("kind")), "names")
    in_file = names.where(F.contains("key", F.lit("#"))).select(F.substring_index("key", "#", 1).alias("seed"), F.col("key").alias("affected"))
    is_file = seeds.select("seed").distinct().where(~F.contains("seed", F.lit("#")) & F.col("seed").rlike(FILE)).join(in_file, "seed")
    start = seeds.select("seed", F.col("seed").alias("affected")).unionByName(is_file).distinct()
    no = lambda kind: F.lit(None).cast(kind)
    start = start.join(names.withColumnRenamed("key", "affected"), "affected", "left")
    start = start.select("seed", "affected", "kind", F.lit(0).alias("depth"), no("string").alias("via"), no("string").alias("dependency"), no("string").alias("file"), no("int").alias("line"))
    frontier = stored(start, "impact")
    visited = frontier
    for depth in range(1, max(1, min(20, max_depth)) + 1):
        step = frontier.select("seed", F.col("affected").alias("at")).join(back, "at")
        first = F.min(F.struct("line", F.col("at").alias("dependency"), F.col("type").alias("via"), "file", "kind")).alias("e")
        new = step.join(visited.select("seed", "affected"), ["seed", "affected"], "left_anti").groupBy("seed", "affected").agg(first)
        frontier = stored(new.select("seed", "affected", "e.kind", F.lit(depth).alias("depth"), "e.via", "e.dependency", "e.file", "e.line"), "impact")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


#: Keys that are files.
FILE = r"(?:^|/)[^/]+\.(?:[cm]?[jt]sx?|json|ya?ml|css|scss|md)$"


def impact_classes(affected: DataFrame, edges: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """seed, class, name of impact's rows: the files, symbols, components, config keys, endpoints, tests, routes and API routes concerned.

    Endpoints, config and tests that affected entities reach are named too, though these don't depend on the seed; not
    other config keys if the seed is one itself. routes: route, source_file, route_type.
    """
    affected = stored(affected.select("seed", "affected", "kind"), "affected")
    named = lambda name, column, rows: rows.select("seed", F.lit(name).alias("class"), F.col(column).alias("name"))
    files = affected.select("seed", F.substring_index("affected", "#", 1).alias("file")).where(F.col("file").rlike(FILE)).distinct()
    seed_kind = affected.where("seed = affected").select("seed", F.col("kind").alias("seed_kind"))
    beyond = affected.join(edges.select(F.col("src").alias("affected"), "dst", "type"), "affected").join(seed_kind, "seed", "left")
    not_config = ~F.col("seed_kind").eqNullSafe(F.lit("config"))
    out = [
        named("file", "file", files),
        named("symbol", "affected", affected.where(F.contains("affected", F.lit("#")))),
        named("component", "affected", affected.where("kind = 'component'")),
        named("config", "affected", affected.where("kind = 'config'")),
        named("config", "dst", beyond.where((F.col("type") == "reads") & not_config)),
        named("endpoint", "affected", affected.where("kind = 'backend-endpoint'")),
        named("endpoint", "dst", beyond.where(F.col("type").isin("fetches", "delegates-to"))),
        named("test", "dst", beyond.where("type = 'validated-by'")),
    ]
    if routes is not None:
        by_file = files.join(routes.select(F.col("source_file").alias("file"), "route", "route_type"), "file").select("seed", "route", "route_type")
        by_name = affected.join(routes.select(F.col("route").alias("affected"), "route_type"), "affected").select("seed", F.col("affected").alias("route"), "route_type")
        hit = by_file.unionByName(by_name)
        out += [named("route", "route", hit), named("api-route", "route", hit.where(F.col("route_type").isin("route-handler", "api")))]
    return reduce(DataFrame.unionByName, out).distinct()


def seed_scores(nodes: DataFrame, terms: DataFrame, edges: DataFrame) -> DataFrame:
    """node, score, n_reach for nodes (node, term rows): 4 a term shared with the question, 2 a term within two hops.

    Terms within two hops are joined as bits, 60 terms a number, and no pair of two hops is made for them. The best is the one
    with the largest score, then the smallest reach, then the name; rows have no order.
    """
    wanted = numbered(terms.select("term").dropna().distinct(), [], "term")
    wanted = wanted.select("term", F.floor((F.col("at") - 1) / 60).alias("word"), F.expr("shiftleft(1L, cast((at - 1) % 60 as int))").alias("bit"))
    hold = stored(nodes.select("node", "term").distinct().join(wanted, "term"), "hold")
    own = hold.groupBy("node").agg(F.count("*").alias("own"))
    one = stored(edges.select("src", "dst").dropna().distinct(), "edges")
    held = one.join(hold.withColumnRenamed("node", "dst"), "dst")
    direct = held.where("src <> dst").groupBy("src", "word").agg(F.bit_or("bit").alias("bits"))
    # What each node's targets hold, as bits. A term that only one of them holds is none of two hops for that one itself.
    counted = stored(held.groupBy("src", "word", "bit").agg(F.count("*").alias("n"), F.min("dst").alias("only")), "counted")
    bits = F.bit_or("bit").alias("bits")
    onward = counted.groupBy(F.col("src").alias("dst"), "word").agg(bits)
    back = counted.where("n = 1").groupBy(F.col("only").alias("src"), F.col("src").alias("dst"), "word").agg(bits.alias("less"))
    two = one.join(onward, "dst").join(back, ["src", "dst", "word"], "left")
    two = two.select("src", "word", F.expr("bits & ~coalesce(less, 0L)").alias("bits"))
    around = direct.unionByName(two).groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
    around = around.groupBy("node").agg(F.sum(F.bit_count("bits")).alias("around"))
    scored = own.join(around, "node", "full").na.fill(0, ["own", "around"])
    scored = stored(scored.select("node", (4 * F.col("own") + 2 * F.col("around")).alias("score")).where("score > 0"), "scored")
    size = two_hop(one, scored.select("node")).withColumnRenamed("src", "node")
    return scored.join(size, "node", "left").select("node", "score", F.coalesce("n_reach", F.lit(0).cast("long")).alias("n_reach"))
