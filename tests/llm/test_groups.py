import random

from lexiforge.llm import common, shingle_join, simhash


def edited(n, rng, words=150, most=6):
    """n copies of one text with one to most words replaced, some with words cut from the end; most pairs lie below the threshold."""
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(words)], []
    for i in range(n):
        own = base[: words - rng.choice([0, 0, 0, 4, 12, 25])]
        for _ in range(rng.randint(1, most)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    return rows


def brute(rows):
    """The smallest id that links of at least 0.8 reach from each id."""
    sets = {i: set(shingle_join.shingle_set(simhash.words_of(t)).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            common_ = len(sets[a] & sets[b]) if a < b else 0
            if common_ * 9 >= (len(sets[a]) + len(sets[b])) * 4 and a < b:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_a_large_group_of_edited_copies_costs_few_pairs_and_loses_no_link(spark):
    rows = edited(400, random.Random(7))
    docs = common.written(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    prints = common.written(shingle_join.classes(docs, "doc_id", "text"))
    found = shingle_join.marks(docs)
    roots = common.written(simhash.components(shingle_join.confirmed(docs, prints, shingle_join.with_hubs(found))))
    assert shingle_join.across(found, roots).count() < 10 * len(rows)
    of = {r["class"]: r["doc_id"] for r in prints.collect()}
    linked = shingle_join.groups(docs, prints).collect()  # a root is not among the nodes
    mine = {of[c]: of[r["root"]] for r in linked for c in (r["node"], r["root"])}
    groups = lambda at: {frozenset(i for i in at if at[i] == r) for r in set(at.values())}
    want = {g for g in groups(brute(rows)) if len(g) > 1}
    assert groups(mine) == want and want
