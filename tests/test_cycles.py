"""Edges on cycles, beside what can be reached by walking."""

import random

import pytest

from stelae.operators import audit, cycles
from stelae.session import Scratch

EDGES = "tail string, head string, asked boolean"


def walked(edges):
    """Asked tails that an edge of their own leads back to."""
    found, onward = set(), {}
    for tail, head, _ in edges:
        onward.setdefault(tail, set()).add(head)
    for tail, head, asked in edges:
        met, ahead = set(), [head]
        while ahead:
            node = ahead.pop()
            if node not in met:
                met.add(node)
                ahead += onward.get(node, ())
        if asked and tail in met:
            found.add(tail)
    return sorted((x,) for x in found)


def test_components_of_random_graphs():
    rng = random.Random(5)
    for _ in range(200):
        count = rng.randint(1, 12)
        edges = [(rng.randrange(count), rng.randrange(count), True) for _ in range(rng.randint(0, 20))]
        component = cycles.components(count, [t for t, _, _ in edges], [h for _, h, _ in edges])
        assert sorted({(t,) for t, h, _ in edges if component[t] == component[h]}) == walked(edges)
    deep = 100_000  # no recursion
    assert set(cycles.components(deep, list(range(deep)), [*range(1, deep), 0])) == {0}


@pytest.mark.parametrize("most", [0, 6, None])
def test_cycles_in_one_task_and_in_rounds(spark, rows, most):
    rng = random.Random(7)
    edges = [(f"r{rng.randrange(40)}", f"r{rng.randrange(40)}", rng.random() < 0.7) for _ in range(45)]  # several inputs, shared nodes
    edges += [(f"c{k}", f"c{(k + 1) % 9}", k != 3) for k in range(9)] + [(f"t{k}", f"t{k + 1}" if k < 6 else "c0", True) for k in range(7)]  # a tail into a cycle
    edges += [("x", "x", True), ("", "", True), ("e", "f", True), ("e", "f", False), ("f", "e", False)]
    given = spark.createDataFrame([*edges, (None, "x", True), ("x", None, True), (None, None, True)], EDGES)
    assert rows(cycles.asked_on_cycles(given, most)) == walked(edges)
    assert rows(cycles.asked_on_cycles(given.limit(0), most)) == []


def test_refused_cycles_do_not_follow_the_depth(spark, rows, monkeypatch):
    """A long chain of derivations that its last one closes: rounds do not grow with its length."""
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    held = spark.createDataFrame([(f"a{k:03}", f"a{k + 1:03}") for k in range(60)], "artifact string, input string")
    proposed = spark.createDataFrame([("a060", "a000"), ("b", "a000")], "artifact string, input string")
    assert rows(audit.refused_cycles(held, proposed)) == [("a060",)] and len(kept) < 30
    kept.clear()
    monkeypatch.setattr(cycles, "FOREST_LINKS", 10)
    assert rows(audit.refused_cycles(held, proposed)) == [("a060",)] and len(kept) < 30
