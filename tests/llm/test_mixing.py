"""Weights, budgets and blocks against direct computation."""
import math
from collections import Counter

import pytest

from arealytics.llm import mixing


def corpus(make_documents):
    rows = [(i, "w " * (1 + i % 7), "en", "big") for i in range(600)] + [(1000 + i, "w " * (1 + i % 5), "en", "mid") for i in range(80)]
    return make_documents(rows + [(2000 + i, "w w", "en", None) for i in range(20)] + [(5, None, "en", "mid"), (6, "", "en", "mid"), (2000, "w w", "en", None)])


def sizes(documents):
    own = Counter()
    for r in documents.collect():
        own[r["source"]] += max(1, len((r["text"] or "").split()))
    return own


def weights_of(own, a):
    total = sum(own.values())
    z = sum((v / total) ** a for v in own.values())
    return {k: (v / total) ** a / z for k, v in own.items()}


def test_target_entropy_and_repeats(make_documents):
    documents = corpus(make_documents)
    own, narrow = sizes(documents), mixing._narrow(documents, "doc_id", "source", "text")
    goal = 0.8 * math.log(3)
    got = {r["source"]: r["weight"] for r in mixing.weights(narrow, entropy=0.8).collect()}
    assert -sum(w * math.log(w) for w in got.values()) == pytest.approx(goal, abs=1e-6)
    limited = {r["source"]: r for r in mixing.weights(narrow, entropy=1.0, max_repeats=3.0).collect()}
    assert max(r["repeats"] for r in limited.values()) == pytest.approx(3.0, abs=1e-6) and limited["big"]["repeats"] == 1
    a = 1 - math.log(3) / math.log(max(own.values()) / min(own.values()))
    assert {k: r["weight"] for k, r in limited.items()} == pytest.approx(weights_of(own, a), abs=1e-6)
    with_total = {r["source"]: r["repeats"] for r in mixing.weights(narrow, max_repeats=2.0, total=500.0).collect()}
    assert max(with_total.values()) <= 2.0 + 1e-6


def test_every_document_is_placed_and_budgets_hold(make_documents):
    documents = corpus(make_documents)
    own = sizes(documents)
    placed = mixing.schedule(documents, entropy=1.0, max_repeats=2.5, block_tokens=300).collect()
    plan = {r["source"]: r for r in mixing.weights(mixing._narrow(documents, "doc_id", "source", "text"), entropy=1.0, max_repeats=2.5).collect()}
    used, longest = Counter(), 7
    for r in placed:
        used[r["source"]] += r["size"]
    for source, row in plan.items():
        assert row["repeats"] * own[source] - longest < used[source] <= row["repeats"] * own[source] + 1e-6
    assert {(r["doc_id"], r["source"]) for r in placed} == {(r["doc_id"], r["source"]) for r in documents.collect()}
    blocks = Counter(r["block"] for r in placed)
    for block, n in blocks.items():
        assert sorted(r["position"] for r in placed if r["block"] == block) == list(range(1, n + 1))
    per_block = Counter((r["block"], r["source"]) for r in placed for _ in range(r["size"]))
    target = {s: row["weight"] * sum(used.values()) / len(blocks) for s, row in plan.items()}
    assert all(abs(per_block[b, s] - target[s]) <= 3 * longest for b in blocks for s in plan)


def test_mixed_rows_equal_the_schedule(make_documents):
    documents = corpus(make_documents)
    rows = Counter(r["doc_id"] for r in mixing.mixed(documents, entropy=1.0, max_repeats=2.5).collect())
    assert rows == Counter(r["doc_id"] for r in mixing.schedule(documents, entropy=1.0, max_repeats=2.5).collect())
    assert mixing.mixed(make_documents([])).collect() == [] and mixing.schedule(make_documents([]), entropy=0.9).collect() == []
    one = make_documents([(1, "a b", "en", "only"), (1, "a b", "en", "only"), (None, None, None, "only")])
    assert mixing.mixed(one, entropy=0.9, max_repeats=4.0).count() == 3
