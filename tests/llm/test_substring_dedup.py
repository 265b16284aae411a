"""Removal of repeated passages against brute force."""
import random
import re
from collections import Counter

import pytest

from arealytics.llm import queries, substring_dedup
from arealytics.llm.words import Words


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((len(words), len(words) - len(kept), " ".join(kept)))
    return out


def corpus():
    rng = random.Random(8)
    def words(n, kinds=400):
        return [f"w{rng.randrange(kinds)}" for _ in range(n)]
    common, second = words(90), words(36)
    texts = [" ".join(words(rng.randrange(0, 120)) + (common if i % 3 == 0 else []) + words(rng.randrange(0, 50)) + (second if i % 4 == 0 else [])) for i in range(90)]
    base = words(300)
    for _ in range(25):  # near copies
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10 ** 6)}"
        texts.append(" ".join(own))
    texts += [texts[5]] * 30 + [None, "", " \t\n", "one", "same " * 34, "same " * 60, "a b " * 40, "b a " * 18, "x y z " * 400]
    texts += [" ".join(words(34)), "\x1f  é " * 20, " ".join(words(40)), "a  b\t\r\nc\x0bd\x0ce " * 9, " ".join(words(60_000, 30_000)), " ".join(common[:35]) + " end", " ".join(common[:34]) + " end"]
    return texts


@pytest.mark.parametrize("window, hot, shard, bits", [(35, 1000, 1500, 20), (35, 2, 5, 9), (12, 3, 40, 16)])
def test_kept_words_equal_brute_force(spark, make_documents, monkeypatch, window, hot, shard, bits):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_PASSAGES", shard)
    texts = corpus()
    frame = make_documents([(None if i % 10 == 0 else i, t, str(i), "s") for i, t in enumerate(texts)]).repartition(6)
    got = {int(r["lang"]): tuple(r["spans"]) for r in substring_dedup.without_repeats(frame, window=window, into="spans", bits=bits).collect()}
    want = brute(texts, window)
    assert len(got) == len(texts) and not [(i, want[i][:2], got[i][:2]) for i in got if got[i] != want[i]]


def test_automaton_counts_every_substring():
    rng = random.Random(2)
    for _ in range(60):
        lines = [[rng.choice("abc") for _ in range(rng.randrange(1, 15))] for _ in range(rng.randrange(1, 6))]
        times, automaton = [rng.choice([1, 1, 2]) for _ in lines], substring_dedup.Automaton(1)
        for line, n in zip(lines, times):
            automaton.add(line, n)
        automaton.close()
        seen = Counter()
        for line, n in zip(lines, times):
            for i in range(len(line)):
                for j in range(i + 1, len(line) + 1):
                    seen[tuple(line[i:j])] += n
        for line in [*lines, [rng.choice("abcd") for _ in range(20)]]:
            want = [max((k for k in range(1, j + 1) if seen[tuple(line[j - k:j])] > 1), default=0) for j in range(1, len(line) + 1)]
            assert automaton.statistics(line) == want


def test_passages_hold_every_window_once():
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(20)}" for _ in range(n)).encode() for n in (0, 34, 35, 36, 500, 0, 40)]
    words = Words(texts)
    _, first, last = substring_dedup.anchored(words, 35)
    got = [a for s, e in zip(first, last) for a in range(s, e + 1)]
    assert got == [int(a) + i for a, b in zip(words.first, words.last) for i in range(b - a - 34)]


def test_hashes_depend_on_the_word_alone():
    rng = random.Random(6)
    kinds = [b"a", b"b", b"ab", b"ba", "é".encode(), b"x" * 4096, b"x" * 4097, b"y" * 200_000, *(f"w{i}".encode() for i in range(3000))]
    words = Words([b" ".join(rng.choice(kinds[:7] + kinds[8:]) for _ in range(50_000)), b"", b" ".join(kinds)])
    for seed in (0, 1):
        found = {}
        for i, h in enumerate(words.hashes(seed).tolist()):
            assert found.setdefault(words.run(i, i + 1), h) == h
        assert len(set(found.values())) == len(found) == len(kinds)


def test_empty_table_and_registered_query(spark, make_documents):
    assert substring_dedup.without_repeats(make_documents([])).collect() == []
    assert queries.op12_repeats_removed(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
