"""The type graph: transitions between types, shortest paths, programs and their execution."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.curie import curie_prefix
from weftgraph.operators.filters import enabled
from weftgraph.operators.joins import of_ids
from weftgraph.storage import scratch, written


def transitions_of(quads: DataFrame) -> DataFrame:
    """(src_type, dst_type, link, op) that a graph's edges show between identifier types: a few rows, written, as all that follows reads them again."""
    typed = quads.select(curie_prefix(F.col("s")).alias("src_type"), curie_prefix(F.col("o")).alias("dst_type"), F.col("p").alias("link"))
    moves = typed.where("src_type is not null and dst_type is not null").distinct().withColumn("op", F.concat_ws("__", F.lower("src_type"), "link", F.lower("dst_type")))
    return written(moves.coalesce(1), scratch(quads.sparkSession))


def both_ways(quads: DataFrame) -> DataFrame:
    """Quads and their inverses, whose predicates begin with inv_."""
    named = quads.where("p != 'label'")
    return named.unionByName(named.select("g", F.col("o").alias("s"), F.concat(F.lit("inv_"), "p").alias("p"), F.col("s").alias("o")))


def load_type_graph(transitions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable transitions (link and op given, both types in known(type)) and the rejected ones."""
    types = known.select("type").distinct()
    usable = transitions.where("link is not null and op is not null").join(types.withColumnRenamed("type", "src_type"), "src_type", "left_semi").join(types.withColumnRenamed("type", "dst_type"), "dst_type", "left_semi")
    return usable, transitions.join(usable.select("src_type", "dst_type", "link", "op"), ["src_type", "dst_type", "link", "op"], "left_anti")


def assign_is_a(types: DataFrame, concepts: DataFrame) -> DataFrame:
    """(type, concept): the concept of each type; of several, the one registered last (concepts: type, concept, position)."""
    return types.select("type").distinct().join(concepts.groupBy("type").agg(F.max_by("concept", F.struct("position", "concept")).alias("concept")), "type", "left")


def lift_to_concepts(transitions: DataFrame, is_a: DataFrame) -> DataFrame:
    """(src_concept, dst_concept): the concepts that enabled transitions other than synonyms connect."""
    used = enabled(transitions).where("lower(link) != 'synonym'")
    a = is_a.select(F.col("type").alias("src_type"), F.col("concept").alias("src_concept"))
    b = is_a.select(F.col("type").alias("dst_type"), F.col("concept").alias("dst_concept"))
    return used.join(a, "src_type").join(b, "dst_type").where("src_concept is not null and dst_concept is not null").select("src_concept", "dst_concept").distinct()


def type_pairs(is_a: DataFrame, a: str, b: str) -> DataFrame:
    """(type_a, type_b): every type of concept a with every type of concept b."""
    one = is_a.where(F.col("concept") == a).agg(F.collect_set("type").alias("a"))
    two = is_a.where(F.col("concept") == b).agg(F.collect_set("type").alias("b"))
    both = one.withColumn("k", F.lit(1)).join(two.withColumn("k", F.lit(1)), "k")
    return both.select(F.explode("a").alias("type_a"), "b").select("type_a", F.explode("b").alias("type_b"))


def predecessors(transitions: DataFrame, src: str, max_hops: int | None = None) -> DataFrame:
    """(node, level, predecessor, link): the graph of all shortest paths from a type, without UNKNOWN links: as many rows as it has links, however many paths they make.

    Levels are breadth-first written tables: types met on an earlier level are not entered again, ties of one level are all kept;
    it ends where a level is empty, or at max_hops, if given.
    """
    home = scratch(transitions.sparkSession)
    used = enabled(transitions).select(F.col("src_type").alias("predecessor"), F.col("dst_type").alias("node"), "link").where("predecessor != node").distinct()
    start = transitions.sparkSession.range(1).select(F.lit(src).alias("node"))
    seen, now, out = start, start, None
    for level in count(1) if max_hops is None else range(1, max_hops + 1):
        more = used.join(now.select(F.col("node").alias("predecessor")), "predecessor", "left_semi").join(seen, "node", "left_anti")
        rows = written(more.select("node", F.lit(level).alias("level"), "predecessor", "link"), f"{home}/{level}")
        if out is not None and rows.isEmpty():
            break
        out = rows if out is None else out.unionByName(rows)
        now = rows.select("node").distinct()
        seen = seen.union(now)
    return out


def path_counts(found: DataFrame, src: str) -> DataFrame:
    """(node, level, paths): how many shortest paths lead from src to each type of predecessors, exactly up to 38 digits; no path is made."""
    home, spark = scratch(found.sparkSession), found.sparkSession
    now = out = spark.range(1).select(F.lit(src).alias("node"), F.lit(0).alias("level"), F.lit(1).cast("decimal(38,0)").alias("paths"))
    for level in range(1, (found.agg(F.max("level")).first()[0] or 0) + 1):
        steps = found.where(F.col("level") == level).select("node", "predecessor")
        ways = steps.join(now.select(F.col("node").alias("predecessor"), "paths"), "predecessor")
        now = written(ways.groupBy("node").agg(F.sum("paths").cast("decimal(38,0)").alias("paths")).select("node", F.lit(level).alias("level"), "paths"), f"{home}/{level}")
        out = out.unionByName(now)
    return out


def leading(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(dst_type, level, node_type, next_type, link): the links of predecessors that lie on a shortest path to each of the targets; level counts from 0."""
    home = scratch(found.sparkSession)
    first = targets.select(F.col(targets.columns[0]).alias("dst_type")).distinct()
    levels = found.select("node", "level").distinct()
    ends = first.join(levels, F.col("dst_type") == F.col("node")).select("dst_type", "node", "level")
    now, out = None, None
    for level in range(ends.agg(F.max("level")).first()[0] or 0, 0, -1):
        own = ends.where(F.col("level") == level).select("dst_type", "node")
        now = own if now is None else now.unionByName(own)
        rows = written(now.join(found.where(F.col("level") == level).drop("level"), "node").select("dst_type", F.lit(level - 1).alias("level"), F.col("predecessor").alias("node_type"), F.col("node").alias("next_type"), "link"), f"{home}/{level}")
        out = rows if out is None else out.unionByName(rows)
        now = rows.select("dst_type", F.col("node_type").alias("node")).distinct()
    return out if out is not None else found.where("false").select(F.col("node").alias("dst_type"), "level", F.col("predecessor").alias("node_type"), F.col("node").alias("next_type"), "link")


def shortest_paths(transitions: DataFrame, src: str, targets: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(dst_type, hops, types, links): all shortest paths from a type to each of the target types, without UNKNOWN links.

    The paths are unrolled from the graph of predecessors, of the targets' own links alone; where only programs or
    counts are asked for, program_of and path_counts make none.
    """
    hops = leading(predecessors(transitions, src, max_hops), targets)
    now = out = None
    for level in range((hops.agg(F.max("level")).first()[0] or 0) + 1):
        step = hops.where(F.col("level") == level)
        if now is None:
            now = step.select("dst_type", F.array("node_type", "next_type").alias("types"), F.array("link").alias("links"))
        else:
            at = now.withColumn("node_type", F.element_at("types", -1))
            now = at.join(step.drop("level"), ["dst_type", "node_type"]).select("dst_type", F.array_append("types", F.col("next_type")).alias("types"), F.array_append("links", F.col("link")).alias("links"))
        ended = now.where(F.element_at("types", -1) == F.col("dst_type")).withColumn("hops", F.lit(level + 1))
        out = ended if out is None else out.unionByName(ended)
    return out.select("dst_type", "hops", "types", "links")


def program_of(transitions: DataFrame, src: str, targets: DataFrame, named: bool = False, max_hops: int | None = None) -> DataFrame:
    """compile_program's result for all shortest paths from a type to each target, from the graph of predecessors: paths are never made.

    named: with all operations of the links, as compile_program has them with transitions.
    """
    links = leading(predecessors(transitions, src, max_hops), targets)
    ops = F.array_sort(F.collect_set("link")).alias("ops")
    if not named:
        return links.groupBy("dst_type", "level", "node_type").agg(ops)
    known = enabled(transitions).select(F.col("src_type").alias("node_type"), F.col("dst_type").alias("next_type"), "link", "op").distinct()
    return links.join(known, ["node_type", "next_type", "link"]).groupBy("dst_type", "level", "node_type").agg(ops, F.array_sort(F.collect_set(F.concat_ws(":", "link", "op"))).alias("names"))


def paths(transitions: DataFrame, src: str, max_depth: int | None = None) -> DataFrame:
    """(dst_type, links): every operation path from a type that enters no type twice; it ends where no path goes on, or at max_depth, if given.  Levels are written tables."""
    home = scratch(transitions.sparkSession)
    used = transitions.select("src_type", F.col("dst_type").alias("next"), "link").distinct()
    frontier = used.where((F.col("src_type") == src) & (F.col("next") != src)).select(F.col("next").alias("dst_type"), F.array(F.lit(src), "next").alias("types"), F.array("link").alias("links"))
    out = frontier = written(frontier, f"{home}/1")
    for depth in count(2) if max_depth is None else range(2, max_depth + 1):
        more = frontier.join(used, frontier["dst_type"] == used["src_type"]).where(~F.array_contains("types", F.col("next")))
        frontier = written(more.select(F.col("next").alias("dst_type"), F.array_append("types", F.col("next")).alias("types"), F.array_append("links", F.col("link")).alias("links")), f"{home}/{depth}")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out.select("dst_type", "links")


def compile_program(found: DataFrame, transitions: DataFrame | None = None) -> DataFrame:
    """(dst_type, level, node_type, ops[, names]): the levels of each target's shortest paths, parallel links as ops of one level.

    With transitions, names has every operation of the level's links, parallel ones of one link too, as link:op.
    """
    rows = found.select("dst_type", "types", F.posexplode("links").alias("level", "link"))
    rows = rows.select("dst_type", "level", F.element_at("types", F.col("level") + 1).alias("node_type"), "link")
    ops = F.array_sort(F.collect_set("link")).alias("ops")
    if transitions is None:
        return rows.groupBy("dst_type", "level", "node_type").agg(ops)
    rows = found.select("dst_type", "types", F.posexplode("links").alias("level", "link")).select("dst_type", "level", F.element_at("types", F.col("level") + 1).alias("node_type"), F.element_at("types", F.col("level") + 2).alias("_next"), "link")
    named = rows.join(enabled(transitions).select(F.col("src_type").alias("node_type"), F.col("dst_type").alias("_next"), "link", "op").distinct(), ["node_type", "_next", "link"])
    return named.groupBy("dst_type", "level", "node_type").agg(ops, F.array_sort(F.collect_set(F.concat_ws(":", "link", "op"))).alias("names"))


def level_steps(program: DataFrame) -> list[tuple[int, list[tuple[str, str]]]]:
    """A program's levels in order, each with its (type, predicate) steps: as few as the type graph has links."""
    levels: dict[int, set[tuple[str, str]]] = {}
    for r in program.select("level", "node_type", F.explode("ops").alias("p")).distinct().collect():
        levels.setdefault(r["level"], set()).add((r["node_type"], r["p"]))
    return [(level, sorted(levels[level])) for level in sorted(levels)]


def allowed(c: Column, step: list[tuple[str, str]]) -> Column:
    """Whether an identifier's type takes the predicate p in a level's steps."""
    return F.concat(curie_prefix(c), F.lit("|"), F.col("p")).isin([f"{kind}|{p}" for kind, p in step])


def said(edges: DataFrame, steps: list, path: str) -> DataFrame:
    """The edges (s, p, o) of the predicates of steps, as a written table: what makes them distinct runs once, and levels read their predicates alone."""
    return written(edges.where(F.col("p").isin(sorted({p for step in steps for _, p in step}))).select("s", "p", "o"), path)


def rows_of(edges: DataFrame) -> dict[str, int]:
    """How many edges a written table (s, p, o) has of each predicate, of which there are as few as the type graph has links."""
    return {r["p"]: r["count"] for r in edges.groupBy("p").count().collect()}


def stepped(edges: DataFrame, step: list[tuple[str, str]]) -> DataFrame:
    """The edges (s, p, o) that a level's steps take."""
    return edges.where(F.col("p").isin(sorted({p for _, p in step}))).where(allowed(F.col("s"), step))


def reached(now: DataFrame, edges: DataFrame, step: list[tuple[str, str]], rows: dict[str, int], column: str = "id") -> DataFrame:
    """The edges (s, p, o) of a level's steps that start from what was reached; rows: see rows_of."""
    return of_ids(stepped(edges, step), now, column, "s", sum(rows.get(p, 0) for p in {p for _, p in step}))


def execute_program(program: DataFrame, frontier: DataFrame, edges: DataFrame, checked: bool = True) -> DataFrame:
    """(level, source_id, predicate, target_id[, type_ok]): every edge that a program's levels give from the frontier (id).

    program: level, node_type, ops of one target.  Each level is one join of the whole frontier with
    the edges (s, p, o) of the level's ops; the next frontier are its distinct targets.  The steps, a
    few rows, are read by the driver: they number the joins and keep other predicates from being read.
    type_ok: whether the target has a type of the next level; the last level's may have any.
    """
    home = scratch(edges.sparkSession)
    out, now, levels = None, frontier.select("id"), level_steps(program)
    edges = said(edges, [step for _, step in levels], f"{home}/edges")
    sizes = rows_of(edges)
    for level, step in levels:
        rows = written(reached(now, edges, step, sizes).select(F.lit(level).alias("level"), F.col("s").alias("source_id"), F.col("p").alias("predicate"), F.col("o").alias("target_id")).distinct(), f"{home}/{level}")
        out = rows if out is None else out.unionByName(rows)
        now = rows.select(F.col("target_id").alias("id"))
    if checked:
        after = program.select((F.col("level") - 1).alias("level"), F.col("node_type").alias("_next")).distinct().groupBy("level").agg(F.collect_set("_next").alias("_next"))
        out = out.join(F.broadcast(after), "level", "left").withColumn("type_ok", F.coalesce(F.array_contains("_next", curie_prefix(F.col("target_id"))), F.lit(True))).drop("_next")
    return out


def execute_programs(programs: dict[str, tuple[DataFrame, DataFrame]], edges: DataFrame, checked: bool = True, stored: bool = False) -> DataFrame:
    """(program, level, source_id, predicate, target_id[, type_ok]): execute_program's edges for several programs, each with its frontier (id), by name.

    Programs of one frontier (the same DataFrame) that begin with the same levels execute those once: the levels form a
    tree, each of whose branches is one join of what its parent has reached with the edges of its steps.
    stored: edges are a written table.
    """
    home, out = scratch(edges.sparkSession), None
    levels = {name: [tuple(step) for _, step in level_steps(program)] for name, (program, _) in programs.items()}
    edges = edges if stored else said(edges, [step for steps in levels.values() for step in steps], f"{home}/edges")
    sizes = rows_of(edges)
    done: dict[tuple, DataFrame] = {}
    for name, (_, frontier) in programs.items():
        now, steps = frontier.select("id"), levels[name]
        for level, step in enumerate(steps):
            key = (id(frontier), *steps[: level + 1])
            if key not in done:
                done[key] = written(reached(now, edges, list(step), sizes).select(F.col("s").alias("source_id"), F.col("p").alias("predicate"), F.col("o").alias("target_id")).distinct(), f"{home}/{len(done)}")
            rows = done[key].select(F.lit(name).alias("program"), F.lit(level).alias("level"), "source_id", "predicate", "target_id")
            if checked:
                after = sorted({kind for kind, _ in steps[level + 1]}) if level + 1 < len(steps) else None
                rows = rows.withColumn("type_ok", F.coalesce(curie_prefix(F.col("target_id")).isin(after), F.lit(False)) if after else F.lit(True))
            out = rows if out is None else out.unionByName(rows)
            now = done[key].select(F.col("target_id").alias("id"))
    return out


class Registry:
    """Named operations: each maps a table of nodes (id) to edges (source_id, predicate, target_id)."""

    def __init__(self) -> None:
        self.ops: dict[str, tuple[str, str, str, Callable[[DataFrame], DataFrame]]] = {}

    def register(self, name: str, src_type: str, dst_type: str, link: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        """Adds an operation; a name is given once."""
        if name in self.ops:
            raise ValueError(f"{name} is registered")
        self.ops[name] = (src_type, dst_type, link, fn)

    def register_table(self, transitions: DataFrame, edges: DataFrame) -> None:
        """An operation for each of the transitions (a few rows): a join of the nodes to the edges (s, p, o) of its link and types."""
        for r in transitions.select("op", "src_type", "dst_type", "link").distinct().collect():
            part = edges.where((F.col("p") == r["link"]) & F.startswith("s", F.lit(f"{r['src_type']}:")) & F.startswith("o", F.lit(f"{r['dst_type']}:")))
            self.register(r["op"], r["src_type"], r["dst_type"], r["link"], lambda nodes, part=part: nodes.select(F.col("id").alias("s")).distinct().join(part, "s").select(F.col("s").alias("source_id"), F.col("p").alias("predicate"), F.col("o").alias("target_id")).distinct())

    def execute(self, program: DataFrame, frontier: DataFrame) -> DataFrame:
        """(level, op, source_id, predicate, target_id, type_ok): what a program's registered operations give from the frontier (id), level by level.

        program: level, node_type, ops and names (link:op) of one target, as program_of(named=True) has them: a few
        rows, read by the driver.  An operation gets the nodes of its type alone; its edges take the
        program's link as predicate.  Names that are not registered raise.
        """
        levels: dict[int, set[tuple[str, str, str]]] = {}
        for r in program.select("level", "node_type", F.explode("names").alias("name")).distinct().collect():
            link, _, op = r["name"].partition(":")
            levels.setdefault(r["level"], set()).add((r["node_type"], link, op))
        home, now, out = scratch(frontier.sparkSession), frontier.select("id").distinct(), None
        for level in sorted(levels):
            after = sorted({kind for kind, _, _ in levels.get(level + 1, ())})
            rows = None
            for kind, link, op in sorted(levels[level]):
                edges = self[op](now.where(curie_prefix(F.col("id")) == kind))
                part = edges.select(F.lit(level).alias("level"), F.lit(op).alias("op"), "source_id", F.lit(link).alias("predicate"), "target_id")
                rows = part if rows is None else rows.unionByName(part)
            rows = written(rows.distinct(), f"{home}/{level}")
            checked = rows.withColumn("type_ok", F.coalesce(curie_prefix(F.col("target_id")).isin(after), F.lit(False)) if after else F.lit(True))
            out = checked if out is None else out.unionByName(checked)
            now = rows.select(F.col("target_id").alias("id")).distinct()
        return out

    def __getitem__(self, name: str) -> Callable[[DataFrame], DataFrame]:
        return self.ops[name][3]


def candidate_types(nodes: DataFrame, is_a: DataFrame) -> DataFrame:
    """(id, type): the type of the identifier's prefix, else all types of the node's concept (nodes: id, concept)."""
    kinds = is_a.select(F.col("type").alias("_prefix")).distinct()
    typed = nodes.withColumn("_prefix", curie_prefix(F.col("id")))
    own = typed.join(kinds, "_prefix", "left_semi").select("id", F.col("_prefix").alias("type"))
    rest = typed.join(kinds, "_prefix", "left_anti").join(is_a.select("type", "concept").distinct(), "concept").select("id", "type")
    return own.unionByName(rest)


def route(requests: DataFrame, router: DataFrame, equivalence: DataFrame) -> DataFrame:
    """requests (id, type_a, type_b) with op: the router's (type_a, type_b, op), directly or with equivalent types (id, equivalent_id); none where there is no way."""
    same = equivalence.select(F.col("id").alias("type"), F.col("equivalent_id").alias("as_type"))
    types = requests.select(F.col("type_a").alias("type")).union(requests.select("type_b")).distinct()
    ways = types.select("type", F.col("type").alias("as_type"), F.lit(0).alias("far")).unionByName(same.withColumn("far", F.lit(1)))
    a = ways.select(F.col("type").alias("type_a"), F.col("as_type").alias("_a"), F.col("far").alias("_fa"))
    b = ways.select(F.col("type").alias("type_b"), F.col("as_type").alias("_b"), F.col("far").alias("_fb"))
    table = router.select(F.col("type_a").alias("_a"), F.col("type_b").alias("_b"), "op")
    pairs = requests.select("type_a", "type_b").distinct().join(a, "type_a").join(b, "type_b").join(table, ["_a", "_b"])
    best = pairs.groupBy("type_a", "type_b").agg(F.min_by("op", F.struct(F.col("_fa") + F.col("_fb"), "op")).alias("op"))
    return requests.join(best, ["type_a", "type_b"], "left")


def translate(things: DataFrame, quads: DataFrame, src_type: str, dst_type: str, max_hops: int | None = None, moves: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """(id, value): what the things (id) of one type reach in another by all shortest ways of the type graph (moves; default: of the quads).

    stored: quads are a written table.
    """
    home = scratch(quads.sparkSession)
    quads = quads if stored else written(quads.select("s", "p", "o"), f"{home}/edges")
    moves = transitions_of(quads) if moves is None else moves
    target = things.sparkSession.createDataFrame([(dst_type,)], "type string")
    program = program_of(moves, src_type, target, max_hops=max_hops).drop("dst_type")
    now, sizes = things.select("id", F.col("id").alias("at")), rows_of(quads)
    for level, step in level_steps(program):
        # a first step starts from the ids themselves
        there = now.join(stepped(quads, step), F.col("at") == F.col("s")) if level else reached(now, quads, step, sizes).withColumnRenamed("s", "id")
        now = written(there.select("id", F.col("o").alias("at")).distinct(), f"{home}/{level}")
    return now.where(F.startswith("at", F.lit(f"{dst_type}:"))).select("id", F.col("at").alias("value"))


def translate_chain(things: DataFrame, quads: DataFrame, kinds: list[str], breadth: int = 2, bindings: dict[str, DataFrame] | None = None) -> DataFrame:
    """(kind, id, value): consecutive translations along kinds; of each thing's values the least `breadth` go on.

    bindings: for a kind, the things (id) asked for, which go on in place of what was reached.
    """
    quads = written(quads.select("s", "p", "o"), scratch(quads.sparkSession))
    moves, bindings = transitions_of(quads), bindings or {}
    now, out = things.select("id"), None
    for a, b in zip(kinds, kinds[1:]):
        rows = translate(bindings[a].select("id") if a in bindings else now, quads, a, b, moves=moves, stored=True)
        first = F.row_number().over(Window.partitionBy("id").orderBy("value"))
        rows = rows.withColumn("_n", first).where(F.col("_n") <= breadth).drop("_n").withColumn("kind", F.lit(b))
        out = rows if out is None else out.unionByName(rows)
        now = rows.select(F.col("value").alias("id")).distinct()
    return out.select("kind", "id", "value")


def translate_all(bindings: dict[str, DataFrame], quads: DataFrame, kinds: list[str]) -> DataFrame:
    """(src_kind, dst_kind, id, value): the things (id) bound to each kind, translated to every other kind."""
    quads = written(quads.select("s", "p", "o"), scratch(quads.sparkSession))
    moves, out = transitions_of(quads), None
    for a in [k for k in kinds if k in bindings]:
        for b in [k for k in kinds if k != a]:
            rows = translate(bindings[a], quads, a, b, moves=moves, stored=True).select(F.lit(a).alias("src_kind"), F.lit(b).alias("dst_kind"), "id", "value")
            out = rows if out is None else out.unionByName(rows)
    return out
