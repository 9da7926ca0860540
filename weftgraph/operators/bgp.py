"""Basic graph patterns as joins along a tree of patterns.

Patterns that restrict what others may hold reduce them by semi-joins first, up the tree and down
again; then patterns are joined from the leaves on, and a variable that nothing needs any more is
left out at once.  Where rows are to be distinct, both sides of a join are, so that a join whose
shared variables stay needs no distinct after it.  Where they go, one side passes them as lists
(joins.listed_join).  A pattern that gives no variable but only tests is a semi-join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.filters import limit_rows
from weftgraph.operators.joins import listed_join
from weftgraph.storage import scratch, written

#: A pattern restricts others if at most this share of its predicate's rows is left.
SELECTIVE = 0.5


@dataclass(frozen=True)
class Graph:
    """Quads (g, s, p, o) that a source has; repeated: the same, but that quads may be repeated, for results that are made distinct.

    records gives, for a set of predicates and whether repeated rows do no harm, a table of s and a column a predicate:
    what the join of these predicates' facts over their subject would give, or None where the source has no such table.
    """

    quads: DataFrame
    repeated: DataFrame
    records: Callable[[frozenset[str], bool], DataFrame | None]

    @property
    def sparkSession(self) -> SparkSession:  # noqa: N802
        return self.quads.sparkSession

    def where(self, condition: Column | str) -> DataFrame:
        """The quads for which a condition holds."""
        return self.quads.where(condition)


@dataclass
class Node:
    """A pattern's rows (columns: its variables), whether they restrict others, by which nodes they are reduced, whether that is still to be written, and how many rows their predicates have, if counted."""

    df: DataFrame
    selective: bool = False
    by: set[int] = field(default_factory=set)
    open: bool = False
    size: int = 0

    @property
    def variables(self) -> set[str]:
        return set(self.df.columns)


def scan(quads: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """A pattern's rows: terms that begin with ? are variables and become columns."""
    df, columns = quads, []
    for place, term in zip("spo", pattern):
        if not term.startswith("?"):
            df = df.where(F.col(place) == term)
        elif term[1:] in [c for _, c in columns]:
            first = next(p for p, c in columns if c == term[1:])
            df = df.where(F.col(place) == F.col(first))
        else:
            columns.append((place, term[1:]))
    return df.select(*[F.col(p).alias(c) for p, c in columns])


def recorded(graph: Graph, patterns: list[tuple[str, str, str]], used: set[str], distinct: bool) -> dict[int, tuple[list[int], DataFrame]]:
    """By the place of a subject's first pattern: the places of its patterns that a record of the graph answers together, and their rows; used: variables that other than patterns need."""
    out = {}
    for subject in dict.fromkeys(s for s, _, _ in patterns):
        mine = [i for i, (s, p, o) in enumerate(patterns) if s == subject and not p.startswith("?") and o.startswith("?")]
        predicates, objects = [patterns[i][1] for i in mine], [patterns[i][2] for i in mine]
        if not subject.startswith("?") or len(mine) < 2 or len(set(predicates)) < len(mine) or len({*objects, subject}) <= len(mine):
            continue
        df = graph.records(frozenset(predicates), distinct)
        if df is None:
            continue
        others = {t for i, pattern in enumerate(patterns) if i not in mine for t in pattern}
        own = [F.col("s").alias(subject[1:])] if subject in others or subject[1:] in used else []
        out[mine[0]] = mine, df.select(*own, *[F.col(f"`{p}`").alias(o[1:]) for p, o in zip(predicates, objects)])
    return out


def join_tree(sets: list[set[str]], wanted: set[str], sizes: list[int] | None = None) -> list[tuple[int, int]] | None:
    """(ear, parent) in the order in which ears can be joined to their parents; None for cyclic patterns.

    An ear's variables occur in no other set, or in its parent's.  Ears that only test come first,
    then those of the fewest rows (sizes), or that hold the fewest patterns: what two hubs' sides share is joined when both are whole.
    """
    left, out, held = {i: set(s) for i, s in enumerate(sets)}, [], list(sizes or [1] * len(sets))
    while len(left) > 1:
        ears = []
        for i, own in left.items():
            shared = own & set().union(*[s for j, s in left.items() if j != i])
            parents = [j for j, s in left.items() if j != i and shared <= s]
            if shared and parents:
                ears.append((bool(own & wanted - shared), held[i], i, min(parents, key=held.__getitem__)))
        if not ears:
            return None
        *_, i, j = min(ears)
        left[j] |= left.pop(i) & wanted
        held[j] = max(held[i], held[j]) if sizes else held[i] + held[j]
        out.append((i, j))
    return out


def reduced(nodes: list[Node], tree: list[tuple[int, int]], home: str) -> None:
    """Semi-joins nodes by the distinct keys of selective neighbours, up the tree and down again; keys and what is read twice are written tables."""

    def settle(i: int) -> None:
        if nodes[i].open:
            nodes[i].df, nodes[i].open = written(nodes[i].df, f"{home}/{i}-{len(nodes[i].by)}"), False

    def reduce(i: int, by: int) -> None:
        settle(by)
        keys = sorted(nodes[i].variables & nodes[by].variables)
        found = written(nodes[by].df.select(*keys).distinct(), f"{home}/keys-{by}-{i}")
        nodes[i].df = nodes[i].df.join(found, keys, "left_semi")
        nodes[i].by.add(by)
        nodes[i].selective = nodes[i].open = True

    given = {i for i, n in enumerate(nodes) if n.selective}
    for i, j in tree:
        if nodes[i].selective:
            reduce(j, i)
    for i, j in reversed(tree):
        if nodes[j].selective and (j in given or nodes[j].by - {i}):
            reduce(i, j)


def joined(nodes: list[Node], tree: list[tuple[int, int]] | None, wanted: set[str], distinct: bool, home: str) -> DataFrame:
    """The nodes' join with the wanted variables alone."""
    sets: set[int] = set()  # nodes whose rows are known to be distinct

    def only(i: int, keep: set[str]) -> DataFrame:
        df = left[i]
        cut = not set(df.columns) <= keep
        df = df.select(*sorted(keep & set(df.columns))) if cut else df
        if distinct and (cut or i not in sets):
            sets.add(i)
            return df.distinct()
        return df

    left = {i: n.df for i, n in enumerate(nodes)}
    if tree is None:  # cyclic: pattern by pattern, in an order that never joins without a shared variable
        tree = []
        seen, rest = {0}, list(range(1, len(nodes)))
        while rest:
            known = set().union(*[nodes[i].variables for i in seen])
            j = next(j for j in rest if nodes[j].variables & known)
            rest.remove(j)
            seen.add(j)
            tree.append((j, 0))
    for i, j in tree:
        shared = set(left[i].columns) & set(left[j].columns)
        later = set(wanted).union(*[set(d.columns) for k, d in left.items() if k not in (i, j)])
        ear, parent = only(i, shared | later), only(j, shared | later)
        del left[i]
        keep = later & (set(ear.columns) | set(parent.columns))
        if distinct and shared - later and set(ear.columns) - shared and set(parent.columns) - shared:
            left[j] = listed_join(parent, ear, sorted(shared), sorted(keep), f"{home}/joined-{len(left)}")
            sets.add(j)
            continue
        if distinct and not set(ear.columns) - shared:
            both = parent.join(ear, sorted(shared), "left_semi")
        else:
            both = parent.join(ear, sorted(shared))
        left[j] = both if set(both.columns) <= later else both.select(*sorted(later & set(both.columns)))
        if distinct and left[j].columns and len(left[j].columns) < len(both.columns):
            left[j] = left[j].distinct()
    return only(next(iter(left)), wanted) if wanted else next(iter(left.values()))


def components(nodes: list[Node]) -> list[list[Node]]:
    """Nodes by connection through shared variables, in the order given."""
    out: list[list[Node]] = []
    for n in nodes:
        mine = [c for c in out if any(n.variables & m.variables for m in c)]
        out = [c for c in out if not any(c is m for m in mine)] + [[x for c in mine for x in c] + [n]]
    return out


def bgp(quads: DataFrame | Graph, patterns: list[tuple[str, str, str]], select: list[str], values: dict[str, DataFrame] | None = None, distinct: bool = False, limit: int | None = None) -> DataFrame:
    """A basic graph pattern over quads (g, s, p, o): terms that begin with ? are variables.

    values gives a variable's admitted ids as a one-column table.  A pattern that values or a
    constant restrict to SELECTIVE of its predicate's rows (both counted) reduces its neighbours.
    Rows keep their multiplicity unless distinct; limits are by the order of all columns.  Patterns
    that share no variable with the selected ones raise; in distinct rows they are a test of
    whether they have any match.  No pattern is joined without a shared variable.
    Patterns of one subject that a graph has records of are one.
    """
    nodes, values, home = [], dict(values or {}), scratch(quads.sparkSession, "bgp")
    records: dict[int, tuple[list[int], DataFrame]] = {}
    if isinstance(quads, Graph):
        records = recorded(quads, patterns, {*select, *values}, distinct)
        quads = quads.repeated if distinct else quads.quads
    told = {i for mine, _ in records.values() for i in mine}
    sizes = {r["p"]: r["count"] for r in quads.where(F.col("p").isin([p for _, p, _ in patterns])).groupBy("p").count().collect()} if records else {}
    said = [p for i, (_, p, _) in enumerate(patterns) if i not in told]
    # what several patterns read is made once
    stored = {p: written(quads.where(F.col("p") == p).select("s", "p", "o"), f"{home}/said-{said.index(p)}") for p in dict.fromkeys(said) if said.count(p) > 1 and not p.startswith("?")}
    for i, pattern in enumerate(patterns):
        if i in told and i not in records:
            continue
        mine, whole = records.get(i) or ([i], scan(stored.get(pattern[1], quads), pattern))
        node = Node(whole, size=max(sizes.get(patterns[j][1], 0) for j in mine))
        for v in [v for v in values if v in whole.columns]:
            ids = values.pop(v)
            ids = ids.select(F.col(ids.columns[0]).alias(v)).distinct()
            # facts of one pattern, which are fewer than a record's rows, tell how many are left
            facts = scan(quads, next(patterns[j] for j in mine if f"?{v}" in patterns[j])) if i in records else node.df
            every, left = (facts.count(), facts.join(ids, v, "left_semi").count()) if len(patterns) > 1 else (1, 0)
            node.selective |= len(patterns) > 1 and left <= SELECTIVE * every
            node.df = node.df if left == every else node.df.join(ids, v, "left_semi")
        constant = i not in records and any(not t.startswith("?") for t in (pattern[0], pattern[2]))
        if len(patterns) > 1 and constant:
            node.selective = node.df.count() <= SELECTIVE * scan(quads, ("?_s", pattern[1], "?_o")).count()
        nodes.append(node)
    wanted, out, parts = set(select), None, components(nodes)
    if (len(parts) > 1 and not distinct) or sum(any(n.variables & wanted for n in part) for part in parts) != 1:
        raise ValueError(f"{[sorted(set().union(*[n.variables for n in part])) for part in parts]} share no variable")
    for part in parts:
        here = set().union(*[n.variables for n in part]) & wanted
        tree = join_tree([n.variables for n in part], here, [n.size for n in part] if records else None)
        if tree and any(n.selective for n in part):
            for n in part:
                n.open = n.selective
            reduced(part, tree, f"{home}/{len(part)}")
        if not here:
            if joined(part, tree, set(), distinct, f"{home}/{len(part)}").isEmpty():
                return quads.where("false").select(*[F.col("s").alias(c) for c in select])
        else:
            out = joined(part, tree, here, distinct, f"{home}/{len(part)}").select(*select)
    return limit_rows(out, limit) if limit else out
