"""Language ID with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A trigram binds three of them by multiplication, after rotating
them by its place (2, 1, 0), so that order matters. A text's vector bundles (adds) its trigrams' vectors, a language's prototype bundles
its training texts, each scaled to weight one. A text takes the language whose prototype has the largest cosine with it, ties to the
smaller name. Words are lower-cased runs of letters, with one space on each side.

Training reads all labelled texts: tasks add up bundles per language, and only those sums (languages x dimensions, a bounded table) reach
the driver.

Defined results: a text that is NULL or has no letter is `und` with score 0, as is every text if nothing was learnt; NULL languages teach
nothing; repeated rows teach as often as they occur; a column called like the result is replaced, other extra columns stay.
"""
from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

DIMENSIONS, SEED, PART_CHARS = 1024, 2024, 400_000
WORDS = re.compile(r"[^\W\d_]+")
_LETTERS: dict[int, np.ndarray] = {}


def letter(code: int) -> np.ndarray:
    if code not in _LETTERS:
        _LETTERS[code] = np.random.default_rng([SEED, code]).choice(np.array([-1, 1], dtype=np.float32), DIMENSIONS)
    return _LETTERS[code]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram number) of every occurrence, the three code points of each trigram, and which texts have letters."""
    words = [" ".join(WORDS.findall(t.lower())) for t in texts]
    codes = np.frombuffer("".join(f"  {w} " for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(words)), [len(w) + 3 for w in words])
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    kept = (of[:-2] == of[2:]) & (b != 32)  # a trigram belongs to one text and is centred on a letter
    number, values = pd.factorize((a[kept] << 42) | (b[kept] << 21) | c[kept])
    parts = np.stack([values >> 42, (values >> 21) & 0x1FFFFF, values & 0x1FFFFF])
    return of[:-2][kept], number, parts, np.array([bool(w) for w in words])


def bound(parts: np.ndarray) -> np.ndarray:
    """The vectors of trigrams, one row each."""
    known = np.unique(parts)
    table = np.stack([letter(int(x)) for x in known]) if len(known) else np.zeros((0, DIMENSIONS), np.float32)
    first, middle, last = (np.searchsorted(known, p) for p in parts)
    return np.roll(table, 2, axis=1)[first] * np.roll(table, 1, axis=1)[middle] * table[last]


def bundles(texts: list[str], groups: np.ndarray | None = None, count: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """One bundle per text, or per group with every text at weight one; and which texts have letters."""
    of, number, parts, lettered = trigrams(texts)
    kinds = parts.shape[1]
    rows = len(texts) if groups is None else count
    counts = np.zeros((rows, kinds), dtype=np.float32)
    if groups is None:
        counts += np.bincount(of * kinds + number, minlength=rows * kinds).reshape(rows, kinds)
    elif kinds:
        weight = 1 / np.maximum(np.bincount(of, minlength=len(texts)), 1)
        counts += np.bincount(groups[of] * kinds + number, weights=weight[of], minlength=rows * kinds).reshape(rows, kinds).astype(np.float32)
    out = np.zeros((rows, DIMENSIONS), dtype=np.float32)
    for at in range(0, kinds, 8192):
        out += counts[:, at:at + 8192] @ bound(parts[:, at:at + 8192])
    return out, lettered


def _parts(texts: list[str]):
    """Indices of texts in parts of bounded length."""
    sizes = np.cumsum([len(t) for t in texts]) // PART_CHARS
    for part in np.unique(sizes):
        yield np.flatnonzero(sizes == part)


def learn(documents: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The unit prototype of every non-null language."""
    def sums(frames):
        names, total = [], np.zeros((0, DIMENSIONS))
        for frame in frames:
            texts = frame["text"].tolist()
            for at in _parts(texts):
                codes, found = pd.factorize(frame["lang"].to_numpy()[at])
                got, _ = bundles([texts[i] for i in at], codes, len(found))
                for name, row in zip(found, got):
                    if name not in names:
                        names.append(name)
                        total = np.vstack([total, np.zeros(DIMENSIONS)])
                    total[names.index(name)] += row
        if names:
            yield pd.DataFrame({"lang": names, "bundle": list(total)})

    read = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL")
    rows = read.mapInPandas(sums, "lang string, bundle array<double>")
    merged = rows.select("lang", F.posexplode("bundle").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    model: dict[str, np.ndarray] = {}
    for r in merged.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")).collect():  # one row per language
        v = np.array([p["x"] for p in r["v"]])
        if np.abs(v).max() > 0:
            model[r["lang"]] = (v / np.linalg.norm(v)).astype(np.float32)
    return model


def predict(documents: DataFrame, model: dict[str, np.ndarray], text: str = "text", into: str = "language") -> DataFrame:
    """The documents with `into`: a struct of lang and score, the cosine moved to 0..1."""
    names = sorted(model)
    profiles = np.stack([model[n] for n in names]) if names else np.zeros((0, DIMENSIONS), np.float32)

    @pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def best(column: pd.Series) -> pd.DataFrame:
        texts = column.tolist()
        lang, score = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        for at in _parts(texts) if names else ():
            got, lettered = bundles([texts[i] for i in at])
            near = (got @ profiles.T) / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-9)
            top = near.argmax(1)
            at, top, near = at[lettered], top[lettered], near[lettered]
            lang[at] = np.array(names, dtype=object)[top]
            score[at] = np.clip((1 + near[np.arange(len(at)), top]) / 2, 0, 1)
        return pd.DataFrame({"lang": lang, "score": score})

    return documents.withColumn(into, best(F.coalesce(F.col(text), F.lit(""))))
