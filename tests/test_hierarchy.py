import random

import numpy as np
import pyarrow as pa
import pytest

from stelae.operators import hierarchy
from stelae.operators.hierarchy import all_descendants, all_paths, descendants, paths, roots


def walk(links, node):
    seen, path = {node}, [node]
    while path[-1] in links:
        path.append(links[path[-1]])
        if path[-1] in seen:
            return None
        seen.add(path[-1])
    return path


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "concept string, successor string, node string, depth int")


def expected(links):
    out = []
    for node in links:
        path = walk(links, node)
        out.append((node, path[-1], len(path) - 1) if path else (node, "", -1))
    return sorted(out, key=repr)


def random_links(rng, n):
    names = [f"{x:064x}" if x % 3 else f"n{x}" for x in range(n)]
    return {a: rng.choice(names[: max(1, k)] if rng.random() < 0.9 else names) for k, a in enumerate(names) if rng.random() < 0.9}


def given(spark, links):
    return frame(spark, [(a, b, "clash", 1) for a, b in links.items()])


def test_random_forests_with_cycles(spark, rows):
    for seed in range(3):
        links = random_links(random.Random(seed), 60)
        assert rows(roots(given(spark, links), "concept", "successor")) == expected(links)


def test_deep_chain_hot_parent_and_long_cycle(spark, rows):
    links = {f"c{i}": f"c{i + 1}" for i in range(300)}
    links |= {f"leaf{i}": "c0" for i in range(200)} | {f"r{i}": f"r{(i + 1) % 70}" for i in range(70)} | {"tail": "r5", "self": "self"}
    assert rows(roots(given(spark, links), "concept", "successor")) == expected(links)


def test_paths_and_descendants(spark, rows):
    links = random_links(random.Random(8), 40)
    got = {r.node: (r.path, r.endless, r.depth) for r in paths(given(spark, links), "concept", "successor").collect()}
    want = {n: (p or [], p is None, len(p) - 1 if p else -1) for n in links for p in [walk(links, n)]}
    assert got == want
    pairs = sorted(((a, n, k) for n in links for p in [walk(links, n)] if p for k, a in enumerate(p) if k), key=repr)
    assert rows(descendants(given(spark, links), "concept", "successor")) == pairs


def test_odd_rows(spark, rows):
    odd = [("a", None, "", 0), (None, "b", "", 0), ("", "b", "", 0), ("c", "", "", 0), ("d", "z", "", 0), ("d", "y", "", 0), ("d", "y", "", 0)]
    assert rows(roots(frame(spark, odd), "concept", "successor")) == [("d", "y", 1)]
    assert rows(roots(frame(spark, []), "concept", "successor")) == []
    assert rows(paths(frame(spark, []), "concept", "successor")) == []
    assert rows(descendants(frame(spark, []), "concept", "successor")) == []


def test_forest_offsets():
    rng = random.Random(1)
    for _ in range(20):
        links = random_links(rng, 50)
        weights = {n: rng.randrange(1, 9) for n in links}
        nodes = sorted(links, key=lambda _: rng.random())
        root, offset, endless = hierarchy.forest(pa.array([n.encode() for n in nodes], pa.binary()), pa.array([links[n].encode() for n in nodes], pa.binary()), np.array([weights[n] for n in nodes]))
        for node, r, o, e in zip(nodes, root.to_pylist(), offset, endless):
            path = walk(links, node)
            assert e == (path is None)
            if path:
                assert (r.decode(), o) == (path[-1], sum(weights[n] for n in path[:-1]))


@pytest.mark.parametrize("most", [1, 7, 40])
def test_root_edges_beyond_one_forest(spark, rows, monkeypatch, most):
    """Forests of few links: rounds over root edges until the rest is one forest, cycles among them."""
    monkeypatch.setattr(hierarchy, "FOREST_LINKS", most)
    chain = {f"c{i}": f"c{i + 1}" for i in range(60)} | {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)} | {f"to{i}": f"r{i % 9}" for i in range(20)}
    for links in (chain, random_links(random.Random(5), 80)):
        assert rows(roots(given(spark, links), "concept", "successor")) == expected(links)


def walked(links, node):
    """Keys reached until one is repeated."""
    reached, at = [], node
    while at in links and links[at] not in reached:
        at = links[at]
        reached.append(at)
    return reached


def test_all_paths_and_descendants_before_and_on_cycles(spark, rows):
    small = {"X": "A", "A": "B", "B": "C", "C": "B", "self": "self", "to": "self", "up": "top"}
    got = rows(all_descendants(given(spark, small), "concept", "successor"))
    assert ("A", "X", 1) in got and ("B", "X", 2) in got and ("C", "X", 3) in got and ("B", "B", 2) in got
    for links in (small, random_links(random.Random(8), 40), {f"r{i}": f"r{(i + 1) % 11}" for i in range(11)} | {"t": "r5", "u": "t"}):
        pairs = sorted(((a, n, k) for n in links for k, a in enumerate(walked(links, n), 1)), key=repr)
        assert rows(all_descendants(given(spark, links), "concept", "successor")) == pairs
        want = {n: ([n, *(a for a in walked(links, n) if a != n)], walk(links, n) is None) for n in links}
        assert {r.node: (r.path, r.endless) for r in all_paths(given(spark, links), "concept", "successor").collect()} == want
    assert rows(all_descendants(frame(spark, []), "concept", "successor")) == []
