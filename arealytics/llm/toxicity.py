"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, and calibrated thresholds.

Windows are words (lower-cased runs of letters), for one insult is lost in the noise of a longer window, and runs of two to five words, for
ordinary words can be toxic together. A window's distance is how many bytes shorter it compresses with the toxic dictionary than with the
ordinary one; words and runs have a pair of dictionaries each. All dictionaries end in the same fixed carrier, which follows every window,
because the compressor does not look for matches in a block's last bytes.

Training, on at most `sample` labelled rows (in expectation, chosen by hash). Of near-identical toxic texts one counts (`ngram_join`), so that
prose copied with one toxic document is not learnt, while words that always follow the same words are.
- Words are counted per label by documents. The toxic dictionary holds every word that toxic documents have significantly more often
  (Chernoff bound below `chance` after correction for all words), the ordinary one the commonest ordinary words, whatever its size.
- Runs without toxic words are counted in the same way. The toxic dictionary holds the significant ones without a shorter significant one in
  them, the ordinary one the ordinary words and the runs that toxic documents share with ordinary ones.
- For every window size in bytes the threshold is the smallest distance that at most `false_share` of ordinary windows reach. Entries with at
  least MOSTLY of their documents toxic are hits at any distance, for whole bytes do not tell a short one from chance once the dictionary is
  long. They do not count towards the thresholds, which are for altered forms and for the other entries.
- A logistic curve turns (hits, all words) into the probability of the toxic label.

Scoring reads whole texts, in a vectorised UDF that remembers the distance of each word. Runs are compressed only where their first or last
two words are those of an entry. Defined results: NULL, empty and letterless texts have no windows and get the score of a text without hits;
NULL labels teach nothing; repeated rows teach once per different text; without labelled rows of both kinds every score is the share of toxic
rows, or 0; a column called like the result is replaced, other extra columns stay.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import ngram_join
from .common import give_back, released, written

WORDS = re.compile(r"[^\W\d_]+")
CARRIER = bytes(range(1, 17))
ORDINARY, LONGEST, REMEMBERED = 2000, 64, 150_000
RUN, MOSTLY = 5, 0.95


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    thresholds: np.ndarray = field(default_factory=lambda: np.full(LONGEST + 1, 10 ** 6))
    sure: tuple[str, ...] = ()
    runs: tuple[str, ...] = ()
    ordinary_runs: bytes = b""
    run_thresholds: np.ndarray = field(default_factory=lambda: np.full(LONGEST + 1, 10 ** 6))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    log = max(14, len(content + CARRIER).bit_length() + 2)  # every byte of the dictionary stays in reach
    parameters = zstandard.ZstdCompressionParameters(window_log=max(17, log), hash_log=log, chain_log=log, search_log=max(5, log - 9), min_match=3, target_length=32,
                                                     strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    words = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=words)


class Distances(dict):
    """word -> (window size, distance), remembered."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        super().__init__()
        self.left, self.right = _compressor(ordinary), _compressor(toxic)

    def __missing__(self, word: str):
        own = f" {word} ".encode()
        window = own + CARRIER
        value = self[word] = (min(len(own), LONGEST), len(self.left.compress(window)) - len(self.right.compress(window)))
        return value


def _joined(entries) -> bytes:
    """Dictionary content; the best entries come first and are put last, nearest to the window."""
    return (" " + " ".join(entries[::-1]) + " ").encode() if entries else b""


class Runs:
    """Windows of several words that can be near an entry, and their distances."""

    def __init__(self, model: Model):
        self.entries = frozenset(model.runs)
        split = [r.split(" ") for r in model.runs]
        self.first = {(w[0], w[1]) for w in split}
        self.last = {(w[-2], w[-1]) for w in split}
        self.longest = max(map(len, split), default=0)
        self.distances = Distances(model.ordinary_runs, _joined(model.runs))

    def holds(self, window: str) -> bool:
        """Whether an entry is in the window."""
        words = window.split(" ")
        return any(" ".join(words[i:j]) in self.entries for i in range(len(words) - 1) for j in range(i + 2, len(words) + 1))

    def of(self, words: list[str]) -> list[list[str]]:
        """The windows, grouped by the pair of words they begin or end with."""
        if not self.entries:
            return []
        out = []
        for i, pair in enumerate(zip(words, words[1:])):
            if pair in self.first:
                out.append([" ".join(words[i:i + n]) for n in range(2, min(self.longest, len(words) - i) + 1)])
            if pair in self.last and self.longest > 2:
                out.append([" ".join(words[i + 2 - n:i + 2]) for n in range(3, min(self.longest, i + 2) + 1)])
        return out


class Hits(dict):
    """word -> whether it is a sure entry or its distance reaches the threshold of its size."""

    def __init__(self, model: Model):
        super().__init__()
        self.distances, self.thresholds = Distances(model.ordinary, model.toxic), model.thresholds
        self.entries = frozenset(model.sure)
        self.runs, self.run_thresholds = Runs(model), model.run_thresholds

    def run(self, window: str) -> bool:
        size, distance = self.runs.distances[window]
        return window in self.runs.entries or distance >= self.run_thresholds[size]

    def __missing__(self, word: str) -> bool:
        size, distance = self.distances[word]
        value = self[word] = bool(word in self.entries or distance >= self.thresholds[size])
        return value

    def count(self, text: str) -> tuple[int, int]:
        if len(self) > REMEMBERED:
            self.clear()
            self.distances.clear()
        if len(self.runs.distances) > REMEMBERED:
            self.runs.distances.clear()
        words = WORDS.findall(text.lower())
        return sum(map(self.__getitem__, words)) + sum(any(map(self.run, group)) for group in self.runs.of(words)), len(words)


def _features(hits, windows) -> np.ndarray:
    hits, windows = np.asarray(hits, float), np.asarray(windows, float)
    return np.stack([np.ones_like(hits), np.minimum(hits, 4), np.log1p(hits / np.maximum(windows, 1) * 100)], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    w = np.zeros(features.shape[1])
    for _ in range(50):
        p = _logistic(features @ w)
        slope = features.T @ (weight * (label - p)) - 1e-2 * w
        bend = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(bend, slope), -4, 4)
    return w


def _significant(t, n, share: float, kinds: int, chance: float):
    """Whether t toxic of n documents are more than chance, by the Chernoff bound corrected for the kinds tested."""
    p = t / n
    distance = p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0)
    return (p > share) & (n * distance > float(np.log(max(kinds, 1) / chance)))


def _lexicon(texts: DataFrame, share: float, chance: float, least: int) -> tuple[list[str], list[str], list[str]]:
    """All significantly toxic words, those of them that are sure, and the commonest ordinary ones of (text, label), best first."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    held = texts.select("label", F.explode(F.array_distinct(words)).alias("word"))
    counted = written(held.groupBy("word").agg(F.sum(F.col("label").cast("long")).alias("t"), F.count("*").alias("n")))
    p = F.col("t") / F.col("n")
    toxic = counted.where((F.col("t") >= least) & (p >= 0.6) & _significant(F.col("t"), F.col("n"), share, counted.count(), chance))
    first = toxic.orderBy(F.desc("t"), "word").collect()  # bounded by the sample
    return [r["word"] for r in first], [r["word"] for r in first if r["t"] >= MOSTLY * r["n"]], [r["word"] for r in counted.where(p <= share).orderBy(F.desc(F.col("n") - F.col("t")), "word").limit(ORDINARY).collect()]


def _runs(texts: DataFrame, toxic: list[str], share: float, chance: float, least: int) -> tuple[list[str], list[str]]:
    """The shortest significantly toxic runs of words, without toxic words in them, and the ordinary runs that toxic documents have too."""
    single = frozenset(toxic)

    def found(frames):
        for frame in frames:
            for text in frame["text"]:
                words, own = WORDS.findall(text.lower()), set()
                for i in range(len(words) - 1):
                    for n in range(1, RUN + 1):
                        if i + n > len(words) or words[i + n - 1] in single:
                            break
                        if n > 1:
                            own.add(" ".join(words[i:i + n]))
                yield pd.DataFrame({"run": sorted(own)}, dtype=object)

    counted = written(texts.where("label = 1").select("text").mapInPandas(released(found), "run string").groupBy("run").agg(F.count("*").alias("t")))
    kinds = counted.count()
    # No fewer documents can be significant, even if no ordinary one has the run.
    possible = counted.where((F.col("t") >= least) & (F.col("t") * float(np.log(1 / share)) > float(np.log(max(kinds, 1) / chance))))
    asked = frozenset(r["run"] for r in possible.select("run").collect())
    if not asked:
        return [], []

    def shared(frames):
        for frame in frames:
            counts: dict[str, int] = {}
            for text in frame["text"]:
                words, own = WORDS.findall(text.lower()), set()
                for i in range(len(words) - 1):
                    for n in range(2, min(RUN, len(words) - i) + 1):
                        run = " ".join(words[i:i + n])
                        if run not in asked:  # then no longer one is, for it is in fewer documents
                            break
                        own.add(run)
                for run in own:
                    counts[run] = counts.get(run, 0) + 1
            yield pd.DataFrame({"run": list(counts), "o": list(counts.values())}).astype({"run": object, "o": "int64"})

    others = texts.where("label = 0").select("text").mapInPandas(released(shared), "run string, o long").groupBy("run").agg(F.sum("o").alias("o"))
    t, n = F.col("t"), F.col("t") + F.coalesce(F.col("o"), F.lit(0))
    tested = written(possible.join(others, "run", "left").select("run", "t", n.alias("n"), ((t / n >= MOSTLY) & _significant(t, n, share, kinds, chance)).alias("toxic")))
    kept: set[str] = set()
    rows = tested.where("toxic").orderBy(F.desc("t"), "run").collect()
    for r in sorted(rows, key=lambda r: r["run"].count(" ")):
        words = r["run"].split(" ")
        if not any(" ".join(words[i:i + k]) in kept for k in range(2, len(words)) for i in range(len(words) - k + 1)):
            kept.add(r["run"])
    ordinary = tested.where(F.col("t") / F.col("n") <= share).orderBy(F.desc(F.col("n") - F.col("t")), "run").limit(ORDINARY)
    return [r["run"] for r in rows if r["run"] in kept], [r["run"] for r in ordinary.collect()]


def _thresholds(spread: pd.DataFrame, allowed: float, least: int) -> np.ndarray:
    thresholds = np.full(LONGEST + 1, least)
    for size, part in spread.groupby("size"):
        part = part.sort_values("distance", ascending=False)
        over = part[part["n"].cumsum() > allowed]["distance"]
        thresholds[size] = max(least, int(over.iloc[0]) + 1) if len(over) else least
    return thresholds


def learn(documents: DataFrame, label: str = "toxic", text: str = "text", sample: int = 20_000, chance: float = 0.05, least: int = 4, false_share: float = 1e-5) -> Model:
    """Dictionaries, thresholds and curve from labelled documents."""
    rows = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("label")).where("label IS NOT NULL")
    rows = rows.withColumn("key", F.xxhash64("text"))
    kept = min(1.0, sample / max(1, rows.count()))
    rows = rows.where(F.pmod(F.col("key"), F.lit(1_000_000)) < int(kept * 1_000_000))
    texts = written(rows.groupBy("key").agg(F.any_value("text").alias("text"), F.max("label").alias("label")))
    model, toxic = Model(), []
    shares = texts.agg(F.avg("label")).first()[0] or 0.0
    if 0 < shares < 1:
        alone = written(ngram_join.one_of_each(texts.where("label = 1"), "key", "text"))
        taught = alone.unionByName(texts.where("label = 0"))
        share = taught.agg(F.avg("label")).first()[0]
        toxic, sure, ordinary = _lexicon(taught, share, chance, least)
        runs, usual = _runs(taught, toxic, share, chance, least)
        model.sure, model.toxic, model.ordinary, model.runs, model.ordinary_runs = tuple(sure), _joined(toxic), _joined(ordinary), tuple(runs), _joined(usual + ordinary)
    if not toxic and not model.runs:
        base = min(max(shares, 1e-9), 1 - 1e-9)
        model.curve = np.array([np.log(base / (1 - base)), 0, 0])
        return model

    def seen(frames):
        known, runs, entries = Distances(model.ordinary, model.toxic), Runs(model), frozenset(model.sure)
        for frame in frames:
            counts: dict[tuple[bool, int, int], int] = {}
            for t in frame["text"]:
                words = WORDS.findall(t.lower())
                for w in words:
                    if w not in entries:
                        counts[False, *known[w]] = counts.get((False, *known[w]), 0) + 1
                for run in (r for group in runs.of(words) for r in group):
                    if not runs.holds(run):
                        counts[True, *runs.distances[run]] = counts.get((True, *runs.distances[run]), 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["run", "size", "distance", "n"])

    spread = texts.where("label = 0").select("text").mapInPandas(released(seen), "run boolean, size int, distance int, n long")
    spread = spread.groupBy("run", "size", "distance").agg(F.sum("n").alias("n")).toPandas()  # sizes x distances, both bounded
    words, runs = spread[~spread["run"].astype(bool)], spread[spread["run"].astype(bool)]
    allowed = false_share * float(words["n"].sum()) / 8
    model.thresholds, model.run_thresholds = _thresholds(words, allowed, 3), _thresholds(runs, allowed, 2)

    def counted(frames):
        known = Hits(model)
        for frame in frames:
            got = [known.count(t) for t in frame["text"]]
            yield pd.DataFrame({"hits": [min(h, 50) for h, _ in got], "windows": [1 << int(w).bit_length() >> 1 for _, w in got], "label": frame["label"]})

    table = texts.select("text", "label").mapInPandas(released(counted), "hits int, windows long, label int").groupBy("hits", "windows", "label").agg(F.count("*").alias("n")).toPandas()
    model.curve = _fit(_features(table["hits"], table["windows"]), table["label"].to_numpy(float), table["n"].to_numpy(float))
    return model


def score(documents: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """The documents with `into`: the probability of the toxic label."""
    @pandas_udf(T.DoubleType())
    def scored(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hits = Hits(model)
        for column in columns:
            got = np.array([hits.count(t) for t in column], dtype=float).reshape(-1, 2)
            yield pd.Series(_logistic(_features(got[:, 0], got[:, 1]) @ model.curve))
        hits = None
        give_back()

    return documents.withColumn(into, scored(F.coalesce(F.col(text), F.lit(""))))
