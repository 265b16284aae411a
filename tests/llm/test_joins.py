"""Near duplicates and backoff scores against brute force."""
import math
import random
import re
from collections import Counter

import pytest

from arealytics.llm import backoff, ngram_join


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else {text or ""}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    blank = [not re.findall(r"\w+", t or "") for _, t in rows]
    near = [[j for j in range(len(rows)) if j != i and (sets[i] == sets[j] if blank[i] or blank[j] else len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)] for i in range(len(rows))]
    label, out = list(range(len(rows))), []
    for _ in rows:
        for i, own in enumerate(near):
            label[i] = min([label[i], *(label[j] for j in own)])
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i]]
        out.append((doc, min((x for x in ids if x is not None), default=None), len(near[i])))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(150)]
    rows = [(i, " ".join(word() for _ in range(rng.randrange(3, 60)))) for i in range(40)]
    for i in range(330):  # one large group of near copies, over more than one block
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(150)] = word()
        rows.append((100 + i, " ".join(own)))
    rows += [(900 + i, " ".join(base)) for i in range(50)]  # and of exact ones
    rows += [(2000, "one two"), (2001, "One, two!"), (2002, None), (2003, ""), (2004, "###"), (2005, "###"), (2006, "!"), (None, rows[3][1]), (None, "alone here now"), (7, "seven again"), (7, "seven again")]
    return rows


def test_join_equals_brute_force(spark, make_documents):
    rows = corpus()
    got = ngram_join.classes(make_documents([(i, t, "en", "s") for i, t in rows])).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["links"]) for r in got), key=str) == brute(rows)


def test_one_of_each_class_stays(make_documents):
    rows = corpus()
    kept = ngram_join.one_of_each(make_documents([(i, t, "en", "s") for i, t in rows])).collect()
    classes = {(c, tuple(sorted(shingles(t)))) if c is None else c for (_, c, _), t in zip(sorted_rows(rows), [t for _, t in sorted(rows, key=lambda r: str(r[0]))])}
    assert len(kept) >= len({c for c in classes if not isinstance(c, tuple)}) and len([r for r in kept if r["doc_id"] == 7]) == 2
    assert len([r for r in kept if r["doc_id"] is None]) == 1 and not [r for r in kept if 900 <= (r["doc_id"] or 0) < 1000]
    assert ngram_join.one_of_each(make_documents([])).collect() == []


def sorted_rows(rows):
    return sorted(brute(rows), key=lambda r: str(r[0]))


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.5, 0.99), (1.0, 0.99)):
        bands, rows = ngram_join.choose_bands(threshold, recall)
        assert 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= 256


def scored(texts, alpha=0.4, least=2):
    docs = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    one, two = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:]))
    total = sum(one.values())
    out = []
    for d in docs:
        s = math.log(one[d[0]] / total) if d else 0.0
        for v, w in zip(d, d[1:]):
            s += math.log(two[v, w] / one[v]) if two[v, w] >= least else math.log(alpha * one[w] / total)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("hot, bucket", [(20_000, 4_000_000), (10, 300)])
def test_scores_equal_brute_force(spark, make_documents, monkeypatch, hot, bucket):
    monkeypatch.setattr(backoff, "HOT_WORDS", hot)
    monkeypatch.setattr(backoff, "HOT_PAIRS", 2 * hot)
    monkeypatch.setattr(backoff, "BUCKET_ROWS", bucket)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "of", "cat", "dog", f"rare{rng.randrange(200)}"]) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    texts += [None, "", "!!", "the", texts[0], texts[0], "of the " * 5000]
    rows = [(i if i != 3 else None, t, "en", "s") for i, t in enumerate(texts)] + [(0, texts[0], "en", "s")]
    got = sorted(((r["doc_id"], r["n_tokens"], r["score"], r["mean_log"]) for r in backoff.scores(make_documents(rows)).collect()), key=str)
    want = sorted(((rows[i][0], n, s) for i, (n, s) in enumerate(scored([r[1] for r in rows]))), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2] == pytest.approx(w[2], rel=1e-9, abs=1e-9) and g[3] == (pytest.approx(w[2] / w[1]) if w[1] else None)
    assert backoff.scores(make_documents([])).collect() == []


def test_pages_read_back():
    import numpy as np
    arrays = [np.arange(5, dtype="<u8"), np.zeros(0, "<f8"), np.array([1.5, -2]), np.array([7], "<u1")]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, backoff.opened(backoff.packed(*arrays))))


def test_a_pair_is_one_question_per_part_however_often_it_occurs(spark, make_documents, monkeypatch):
    """Parts of some texts each and many buckets give the same scores as one part and one bucket."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "b", f"c{rng.randrange(40)}"]) for _ in range(rng.randrange(60))), "en", "s") for i in range(200)]
    read = lambda: sorted(tuple(r) for r in backoff.scores(make_documents(rows)).collect())
    whole = read()
    monkeypatch.setattr(backoff, "PART_CHARS", 500)
    monkeypatch.setattr(backoff, "BUCKET_ROWS", 100)
    assert [r[:2] for r in read()] == [r[:2] for r in whole] and len(whole) == 200
    for got, want in zip(read(), whole):
        assert got[2] == pytest.approx(want[2], rel=1e-12)


def test_buckets_are_ranges_so_that_pages_do_not_grow_with_their_number():
    import numpy as np
    hashes = np.unique(np.random.default_rng(1).integers(0, 2 ** 64, 100_000, dtype=np.uint64))
    sizes = []
    for buckets in (1, 5, 50):
        own = backoff.bucket_of(hashes, buckets)
        assert (np.diff(own) >= 0).all() and own[0] == 0 and own[-1] == buckets - 1
        cut = np.split(hashes, np.flatnonzero(np.diff(own)) + 1)
        assert (np.concatenate([backoff.summed(backoff.steps(h)) for h in cut]) == hashes).all()
        sizes.append(sum(len(backoff.packed(backoff.steps(h))) for h in cut))
    assert sizes[-1] < 1.1 * sizes[0]
