import random

import pytest

from lexiforge.operators import graph


def rows(uses, own=None):
    files = {f for f, _ in uses} | {t for _, t in uses} if own is None else own
    return [(f, "defines", f"s.{f}") for f in sorted(files)] + [(f, "depends-on", f"s.{t}") for f, t in uses]


def frame(spark, r):
    return spark.createDataFrame(r, "src string, rel string, dst string")


def brute(rel_rows, node, forward, max_depth, max_nodes):
    """Breadth-first with a queue, one candidate at a time."""
    dep, dfn = {}, {}
    for s, r, d in sorted(set(rel_rows)):
        (dep if r == "depends-on" else dfn).setdefault(s, []).append(d)
    turn = lambda m: {k: sorted(f for f in m if k in m[f]) for k in {x for v in m.values() for x in v}}
    out_file, out_sym = (dep, turn(dfn)) if forward else (dfn, turn(dep))
    seen, queue, got, cut = {("f", node)}, [("f", node, 0)], [], False
    if not forward and not (node in dep or node in dfn):
        seen, queue = {("s", node)}, [("s", node, 0)]
    start = True
    while queue:
        kind, name, depth = queue.pop(0)
        for n in sorted(out_file.get(name, ())) if kind == "f" else out_sym.get(name, ()):
            key = ("s" if kind == "f" else "f", n)
            if key in seen:
                continue
            if depth + 1 > max_depth or len(got) >= max_nodes:
                cut = True
                if start and not forward:
                    return sorted(got), True
                continue
            seen.add(key)
            queue.append((*key, depth + 1))
            if key[0] == "f":
                got.append(n)
        start = False
    return sorted(got), cut


def names(t):
    return sorted(r[0] for r in t.nodes.collect())


@pytest.mark.parametrize(("uses", "root", "needs", "needed"), [
    ([("a", "b"), ("b", "c")], "b", ["c"], ["a"]),
    ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "a", ["b", "c", "d"], []),
    ([("c", "d"), ("d", "c")], "c", ["d"], ["d"]),
])
def test_shapes(spark, uses, root, needs, needed):
    r = frame(spark, rows(uses))
    assert names(graph.dependencies(r, root)) == needs and names(graph.dependents(r, root)) == needed


def test_unknown_and_dangling(spark):
    r = frame(spark, rows([("a", "ghost")], {"a"}))
    assert names(graph.dependencies(r, "a")) == [] and names(graph.dependencies(r, "nobody")) == [] and names(graph.dependents(r, "nobody")) == []
    assert names(graph.dependents(r, "s.ghost")) == ["a"]


@pytest.mark.parametrize("seed", range(3))
def test_budgets_against_queue(spark, seed):
    rnd = random.Random(seed)
    files = [f"f{i}" for i in range(7)]
    r = rows(sorted({(rnd.choice(files), rnd.choice(files)) for _ in range(12)}), set(files[:6]))
    df = frame(spark, r)
    for node, depth, limit in (("f0", 64, 2), ("f1", 2, 64), ("s.f2", 64, 1), ("f3", 3, 2)):
        if not node.startswith("s."):
            t = graph.dependencies(df, node, depth, limit)
            assert (names(t), t.truncated) == brute(r, node, True, depth, limit)
        t = graph.dependents(df, node, depth, limit)
        assert (names(t), t.truncated) == brute(r, node, False, depth, limit)


def test_invalidation_shares_the_budget(spark):
    r = frame(spark, rows([("x", "h1"), ("y", "h1"), ("z", "h2")]))
    t = graph.invalidated(r, ["h2", "h1"], max_nodes=2)
    assert names(t) == ["h1", "h2", "x", "y"] and t.truncated
    assert names(graph.invalidated(r, ["h1", "h2"])) == ["h1", "h2", "x", "y", "z"]
