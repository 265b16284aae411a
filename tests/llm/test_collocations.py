"""Collocations against brute force."""
import random
import re
from collections import Counter

import numpy as np
import pytest

from arealytics.llm import collocations, queries, sketch


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for i in range(len(words)) for k in range(1, 6) if i + k <= len(words))
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, p), a in often.items():
        inside = any(o[0] == lang and len(o[1]) > len(p) and 100 * b >= 100 * a and any(o[1][i:i + len(p)] == p for i in range(len(o[1]))) for o, b in often.items())
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def corpus():
    rng = random.Random(4)
    words = ["the", "of", "New", "york", "CITY", "Été", "été", "a b", "x\x1fy", "..", "rock-n", "roll"] + [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(200))
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", ", ", ".\n", "!", " \r\n"]) for _ in range(rng.randrange(0, 150)))
        rows.append((rng.choice(["en", "de", None, "und"]), text + (passage if i % 3 == 0 else "")))
    rows += [("en", None), ("en", ""), ("fr", " \t\n.;"), (None, "the"), ("en", "new york city " * 4000), ("en", "Again " * 9)] + [("es", passage)] * 40
    return rows


@pytest.mark.parametrize("least, top, bits, spacing", [(20, 2000, 14, 20), (3, 50, 9, 3), (300, 2000, 14, 1000)])
def test_phrases_equal_brute_force(make_documents, least, top, bits, spacing):
    rows = corpus()
    frame = make_documents([(None if i % 7 == 0 else i % 50, t, lang, "s") for i, (lang, t) in enumerate(rows)]).repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(frame, least=least, top=top, bits=bits, spacing=spacing).collect())
    assert got == brute(rows, least, top) and got


def test_chunks_hold_each_start_once_and_copies_are_cut_alike(make_documents):
    text = " ".join(f"w{i * i % 97}" for i in range(3000))
    frame = make_documents([(0, "a b. " + text, "en", "s"), (1, text, "en", "s"), (2, text, "en", "s")])
    chunks = collocations.dictionary(frame, "lang", "text", 20).collect()
    assert sum(r["own"] * r["n"] for r in chunks) == 9003 and sum(r["words"] * r["n"] for r in chunks) == 9002
    assert sum(r["n"] for r in chunks) > 2.5 * len(chunks)


def test_empty_table_and_registered_query(spark, make_documents):
    assert collocations.mine(make_documents([])).collect() == []
    assert collocations.mine(make_documents([(1, None, None, None), (2, "one", "en", "s")])).collect() == []
    assert queries.op13_collocations(spark, "/root/testdata/sf0.001").columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_counters_never_rule_out_what_reaches_the_threshold(spark):
    values = np.random.default_rng(1).integers(0, 2 ** 63, 3000).astype(np.uint64)
    frame = spark.createDataFrame([(int(v >> np.uint64(1)), 1 + i % 5) for i, v in enumerate(values)] * 2, "v long, n long").repartition(3)
    read = lambda batches: ((b.column("v").to_numpy().astype(np.uint64), b.column("n").to_numpy()) for b in batches)
    for bits, rows in ((10, 1), (16, 2)):
        packed = sketch.reached(frame, read, bits, 8, rows)
        kept = sketch.holds(packed, values >> np.uint64(1))
        assert all(kept[i] for i in range(3000) if 1 + i % 5 >= 4) and (bits == 10 or kept.mean() < 0.5)
