"""The prefix trie against brute force."""
import hashlib
import random
import zlib

import pytest

from arealytics.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth int, shared boolean"


def conversations_of(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in found.items()}


def spliced(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 0 - (c % 100 if c >= 0 else -((-c) % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(own):
    held = {}
    for c, turns in own.items():
        for d in range(len(turns) + 1):
            held.setdefault(tuple(turns[:d]), []).append(c)
    rows = []
    for path, ids in held.items():
        below = [p for p in held if p[:len(path)] == path]
        ends = sorted(c for c in ids if len(own[c]) == len(path))
        rows.append((min(ids), len(path), min(held[path[:-1]]) if path else None, len(ids), sum(len(p) == len(path) + 1 for p in below),
                     sum(all(len(own[c]) == len(p) for c in held[p]) for p in below), sum((len(held[p]) - 1) * len(p[-1][1]) for p in below if p),
                     hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def corpus():
    rng, rows = random.Random(3), []
    for c in list(range(-3, 60)) + list(range(100, 160)) + [250, 999]:
        for i in range(rng.randrange(1, 9)):
            rows.append((c, rng.choice([i, i, i, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "ok", "", None, "🙂 yes", f"own {c}"])))
    rows += [(c, i, "user", f"same {i}") for c in range(5000, 5040) for i in range(9)]
    rows += [(700, i, "user", "long " * 3) for i in range(500)] + [(701, i, "user", "long " * 3) for i in range(300)] + [(701, 3, "user", "x" * 100_000)]
    return rows + [(None, 1, "user", "nobody"), (5000, 3, "user", "same 3"), (1234567890123456, None, None, None)]


def rows_of(frame):
    return sorted(((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("bits, rows, hot", [(16, 2, 4096), (9, 1, 3)])
def test_nodes_equal_brute_force(spark, monkeypatch, bits, rows, hot):
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", 2)
    made = corpus()
    frame = spark.createDataFrame([(*r, "d", 1, True) for r in made], SCHEMA).repartition(5)
    own = conversations_of(made)
    turns = prefix_trie.ordered(frame)
    assert rows_of(prefix_trie.nodes(turns, prefix_trie.members(turns), bits, rows)) == brute(own)
    assert rows_of(prefix_trie.nodes(*prefix_trie.spliced(frame), bits, rows)) == brute(spliced(own))


def test_lone_conversation_and_empty_table(spark):
    for made in ([(7, 0, "user", "only")], []):
        frame = spark.createDataFrame([(*r, "d", 1, True) for r in made], SCHEMA)
        assert rows_of(prefix_trie.nodes(*prefix_trie.spliced(frame))) == brute(spliced(conversations_of(made)))


def test_screening_keeps_singletons_from_the_shuffle(spark):
    frame = spark.createDataFrame([(c, i, "user", f"{i}" if i < 2 else f"{c} {i}", "d", 1, True) for c in range(200) for i in range(6)], SCHEMA)
    marked = prefix_trie.screened(prefix_trie.prefixes(prefix_trie.ordered(frame)), 16, 2).collect()
    assert all(r["shared"] for r in marked if r["depth"] < 3) and sum(r["shared"] for r in marked if r["depth"] >= 3) < 10


def test_registered_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows_of(queries.op11_prefix_trie(spark, "/root/testdata/sf0.001")) == brute(spliced(conversations_of([tuple(r) for r in rows])))
