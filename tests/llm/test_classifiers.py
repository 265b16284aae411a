"""Held-out accuracy of toxicity and languages, and their defined edge cases."""
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealytics.llm import language_id, toxicity

SMALL = "/root/testdata/sf0.01"


def test_languages_of_held_out_texts(spark):
    from arealytics.llm.queries import op7_languages
    documents = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = op7_languages(spark, SMALL).where("held_out").join(documents, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark, make_documents):
    documents = make_documents([(1, "the cat sat on the mat", "en", "s"), (2, "der hund und die katze", "de", "s"), (3, "words", None, "s"), (3, "words", None, "s"),
                                (4, None, "en", "s"), (5, "123 !!", "de", "s"), (None, "the mat and the cat" * 20_000, None, None), (7, "日本語 text", None, "s")])
    model = language_id.learn(documents)
    assert sorted(model) == ["de", "en"]
    got = {r["doc_id"]: r["language"] for r in language_id.predict(documents, model).collect()}
    assert got[4] == got[5] == ("und", 0.0) and got[None]["lang"] == "en" and got[2]["lang"] == "de"
    assert {r["language"]["lang"] for r in language_id.predict(documents, {}).collect()} == {"und"}
    assert language_id.learn(make_documents([])) == {} and language_id.predict(make_documents([]), model).collect() == []


def test_order_of_letters_matters():
    assert abs(float(language_id.bound(language_id.trigrams(["abc"])[2])[1] @ language_id.bound(language_id.trigrams(["cba"])[2])[1])) < 200


def prose(rng, insults, n=60):
    words = ["".join(rng.choice(["an", "er", "th", "on", "ing", "ea"]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    for _ in range(insults):
        words[rng.randrange(n)] = rng.choice(["scoundrel", "blighter", "numpty"])
    return " ".join(words)


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 3 if i % 5 == 0 else 0), int(i % 5 == 0)) for i in range(900)]
    twin = prose(rng, 3)
    rows += [(2000 + i, twin + f" {rng.random()}", 1) for i in range(60)]  # copies of one toxic text teach no prose
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(frame.where("doc_id % 3 <> 1"))
    assert {w for w in model.toxic.decode().split()} == {"scoundrel", "blighter", "numpty"}
    held = toxicity.score(frame.where("doc_id % 3 = 1"), model).collect()
    assert sum((r["toxicity"] >= 0.7) == (r["toxic"] == 1) for r in held) / len(held) > 0.98 and all(0 <= r["toxicity"] <= 1 for r in held)


def test_toxicity_edges(spark, make_documents):
    rows = [(1, None, "en", "s"), (1, "", "en", "s"), (None, "###", None, None), (2, "word " * 50_000, "en", "s"), (2, "word " * 50_000, "en", "s")]
    documents = make_documents(rows)
    unlabelled = toxicity.learn(documents.withColumn("toxic", F.lit(None).cast("int")))
    got = toxicity.score(documents, unlabelled, into="score").collect()
    assert len(got) == 5 and all(0 <= r["score"] < 0.01 for r in got) and {"key", "spans"} <= set(got[0].asDict())
    always = toxicity.learn(documents.withColumn("toxic", F.lit(1)))
    assert all(r["toxicity"] > 0.9 for r in toxicity.score(documents, always).collect())
    assert toxicity.score(make_documents([]), unlabelled).collect() == []


def learnt_from(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(frame.where("doc_id % 3 <> 1"))
    held = toxicity.score(frame.where("doc_id % 3 = 1"), model).collect()
    return model, sum((r["toxicity"] >= 0.7) == (r["toxic"] == 1) for r in held) / len(held)


def test_toxic_phrases_of_ordinary_words(spark):
    rng, rows = random.Random(5), []
    for i in range(900):
        words = prose(rng, 0).split()
        at = rng.randrange(len(words) - 4)
        words[at:at] = ["go", "away", "forever"] if i % 5 == 0 else rng.choice([["go", "on", "forever"], ["away", "we", "go"], ["forever", "away"]])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    model, right = learnt_from(spark, rows)
    assert model.toxic == b"" and "go away" in model.runs and right > 0.98


def test_toxic_words_in_one_company_and_many_of_them(spark):
    rng = random.Random(6)
    fixed = [(i, prose(rng, 0) + (" you blighter" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(900)]
    model, right = learnt_from(spark, fixed)
    assert "blighter" in model.toxic.decode().split() and right > 0.98
    letters = "bcdfghjklmpqvwxz"
    many = ["q" + letters[i // 256] + letters[i // 16 % 16] + letters[i % 16] + "ozz" for i in range(2500)]
    rows = [(3 * i, prose(rng, 0, 20) + (" " + " ".join(rng.sample(many, len(many))) if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(100)]
    rows += [(3 * i + k, prose(rng, 0, 20) + (" " + many[i * 2] if i % 2 else ""), i % 2) for k in (1, 2) for i in range(1200)]
    model, right = learnt_from(spark, rows)
    assert set(many) <= set(model.toxic.decode().split()) and right > 0.98


def test_languages_equal_a_plain_computation(spark, make_documents):
    rng = random.Random(7)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "éïöabç", "dd": "日本語中"}
    rows = [(i, " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 25))) + rng.choice(["", " 12_3!", " X"]), k, "s")
            for i, k in enumerate(rng.choice(list(letters)) for _ in range(80))]
    rows += [(90, None, "aa", "s"), (91, "12 _ 3", "bb", "s"), (92, "abc def", None, "s"), (93, rows[0][1], rows[0][2], "s"), (None, "défi", "cc", "s")]

    def bundle(text):
        body = "  " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
        grams = [body[i:i + 3] for i in range(len(body) - 2) if body[i + 1] != " "]
        vectors = [np.roll(language_id.letter(ord(a)), 2) * np.roll(language_id.letter(ord(b)), 1) * language_id.letter(ord(c)) for a, b, c in grams]
        return np.sum(vectors, axis=0).astype(float) if grams else np.zeros(language_id.DIMENSIONS), len(grams)

    sums = {}
    for _, text, lang, _ in rows:
        vector, n = bundle(text)
        if lang is not None:
            sums[lang] = sums.get(lang, 0) + vector / max(n, 1)
    names = sorted(sums)
    frame = make_documents(rows).repartition(4)
    got = language_id.predict(frame, language_id.learn(frame)).collect()
    assert len(got) == len(rows)
    for r in got:
        vector, n = bundle(r["text"])
        near = [float(vector @ sums[k]) / (np.linalg.norm(vector) * np.linalg.norm(sums[k])) if n else -1 for k in names]
        if not n:
            assert tuple(r["language"]) == ("und", 0.0)
            continue
        assert r["language"]["score"] == pytest.approx((1 + max(near)) / 2, abs=1e-5)
        assert near[names.index(r["language"]["lang"])] == pytest.approx(max(near), abs=1e-5)
