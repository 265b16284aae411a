"""Token ids, cuts and plans."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from arealytics.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", " a", "a ", "  a  b", "x\n y", "x \n y", "a\tb c", "é  ü 'll don't  ", "<|endoftext|> x", "hello <|endoftext|> x", "a<|endoftext|>b  <|endoftext|>", "a　b c", "日本 語\nкак дела 'S it's\r\n\r\n x",
         "\x85 \xa0a b  c", "\n", "a\n\nb c\n", "word " * 3000, "long" * 9000 + " tail"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(plain):
    rng, encoder = random.Random(5), packing.WordIds(PATH)
    alphabet = "ab cd \n\t.,'s12é ßñ!?   　я中<|>"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)]
    got = encoder.encode(texts) + encoder.encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in texts] * 2
    assert 50256 in plain("hello <|endoftext|> x")  # the plain call reads the vocabulary's own mark


def test_plans_are_exact_and_close_to_the_bound():
    rng = random.Random(2)
    for kind in range(4):
        lengths = [rng.choice([2048, rng.randrange(1, 2049), rng.randrange(1, 300), 700]) if kind else rng.randrange(600, 1100) for _ in range(4000)]
        counts, held = Counter(lengths), defaultdict(list)
        taken = Counter()
        for length, first, count, sequence, offset in packing.plan_runs(dict(counts)):
            assert taken[length] == first
            taken[length] += count
            for i in range(count):
                held[sequence + i].append((offset, length))
        assert taken == counts and sorted(held) == list(range(len(held)))
        for own in held.values():
            assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
        if kind:
            assert len(held) <= 1.06 * sum(lengths) / 2048 + 2
    assert packing.plan_runs({}) == []


def test_pieces_read_back_to_the_documents(spark, make_documents, plain):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(2, "a", "en", "s"), (None, "no id", None, None), (2 ** 60 + 1, "big id", None, None)]
    packed = packing.pack(make_documents(rows), with_ids=True).collect()
    by_document = defaultdict(list)
    for r in packed:
        assert r["length"] == len(r["ids"]) <= 2048 and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_document[r["doc_id"]].append((r["start"], r["piece"], r["ids"]))
    for i, t, _, _ in rows:
        own = sorted(by_document[i], key=lambda x: (x[0], x[1]))
        if i == 2:
            assert [x[2] for x in own] == [plain("a") + [0]] * 2
            continue
        assert [x[1] for x in own] == list(range(len(own))) and all(len(x[2]) == 2048 for x in own[1:])
        assert [n for x in own for n in x[2]] == plain(t) + [0] and own[0][0] == 0
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert packing.pack(make_documents([])).collect() == []


def test_remembered_words_stay_within_their_bound():
    import public_tokenizers
    encoder = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    for batch in range(4):  # words that all differ, as in a corpus with many rare ones
        texts = [" ".join(f"w{batch}x{n}" for n in range(at, at + 1000)) for at in range(0, 70_000, 1000)]
        ids = encoder.encode(texts)
        assert len(encoder.known) + len(encoder.after) <= 150_000
    assert np.frombuffer(ids[-1], "<u4").tolist() == encoder.tokenizer.encode(texts[-1], add_special_tokens=False).ids


def test_latin_texts_need_no_remembered_words_and_long_white_space_no_stack(plain):
    encoder = packing.WordIds(PATH)
    texts = ["Une fenêtre, a word.\nAnother  one\u024f" + " more" * 50, " " * 1_200_000 + "x", "a" + "\n" * 1_200_000]
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts[:1] * 3)] == [plain(texts[0])] * 3
    assert not encoder.known and not encoder.after
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)] == [plain(t) for t in texts]


def test_words_of_other_texts_stay_within_their_bound(plain):
    encoder = packing.WordIds(PATH)
    for batch in range(4):
        texts = ["дa " + " ".join(f"w{batch}x{n}" for n in range(at, at + 1000)) for at in range(0, 70_000, 1000)]
        ids = encoder.encode(texts)
        assert 0 < len(encoder.known) + len(encoder.after) <= packing.KEPT_WORDS
    assert np.frombuffer(ids[-1], "<u4").tolist() == plain(texts[-1])
