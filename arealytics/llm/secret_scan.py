"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: an OR of ANDs of trigrams that any match must contain (lower case). Postings
(trigram, row key) are built for the trigrams that rules ask for, intersected per clause, and only rows that satisfy a clause are verified
with the regex. Rules without mandatory trigrams (plain hex runs) scan every text.

Positions are code points, found in one pass each: the pieces between matches and the matches themselves alternate, so starts are running
sums of their lengths. Nothing is cut: whole texts are indexed and verified.

Defined results: a NULL text counts as empty; rows with a NULL id and repeated rows are scanned like any other, the key that joins postings
to rows is a hash of id and text; an empty table gives no rows; extra columns stay, and one called like the result column is replaced.
"""
from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written

MOST_STRINGS, MOST_CLASS = 64, 8


@dataclass(frozen=True)
class Rule:
    """A match of the pattern counts if its group has at least `least` characters."""
    kind: str
    pattern: str
    group: int
    least: int


# The base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs, as [0-9a-f]+ finds them, without the short ones
)
# A private key with its body: up to its END mark if no other mark stands before it, else the lines of key headers and base64 below. Every
# repetition is possessive, so the regex engine walks long bodies in a loop and never backs out of one.
_LINES = r"(?:[ \t\r]*+\n[ \t]*+(?:[A-Za-z-]++: [^\n]*+|[A-Za-z0-9+/=]*+)(?=[ \t\r]*+(?![^\n])))*+"
PRIVATE_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----|" + _LINES + ")")
RULES = BASE + (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("private_key", PRIVATE_KEY, 0, 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every text with a match satisfies; a clause without trigrams is always true."""
    clauses = [frozenset()]

    def exact(node) -> set[str] | None:
        """All strings the node can match, if they are few."""
        kind, value = node
        if kind is C.LITERAL:
            return {chr(value)}
        if kind is C.IN:
            chars = set()
            for what, inner in value:
                if what is C.LITERAL:
                    chars.add(chr(inner))
                elif what is C.RANGE and inner[1] - inner[0] < MOST_CLASS:
                    chars |= {chr(i) for i in range(inner[0], inner[1] + 1)}
                else:
                    return None
            return chars if len(chars) <= MOST_CLASS else None
        if kind is C.SUBPATTERN:
            return strings(value[3])
        if kind is C.BRANCH:
            parts = [strings(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if kind is C.MAX_REPEAT:
            low, high, inner = value
            once = strings(inner) if high == 1 or low == high <= 4 else None
            if once is None:
                return None
            return once | {""} if (low, high) == (0, 1) else {"".join(x) for x in product(once, repeat=low)}
        return None

    def strings(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            some = exact(node)
            if some is None or len(out) * len(some) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in some}
        return out

    def close(some: set[str]) -> None:
        nonlocal clauses
        grams = [frozenset(s.lower()[i:i + 3] for i in range(len(s) - 2)) for s in some]
        if all(grams):
            least = [g for g in set(grams) if not any(o < g for o in grams)]
            clauses = [a | b for a in clauses for b in least]

    run = {""}
    for node in _parser.parse(pattern):
        some = exact(node)
        if some is not None and len(run) * len(some) <= MOST_STRINGS:
            run = {a + b for a in run for b in some}
            continue
        close(run)
        run = some if some is not None else {""}
        if some is None and node[0] is C.MAX_REPEAT and node[1][0] >= 1:
            close(strings(node[1][2]) or {""})
    close(run)
    return sorted(set(clauses), key=sorted)


def clauses_of(rules) -> list[tuple[str, int, list[str]]]:
    """(kind, clause number, trigrams) of the rules that have mandatory trigrams."""
    out = []
    for rule in rules:
        query = trigram_query(rule.pattern)
        if all(query):
            out += [(rule.kind, len(out) + i, sorted(c)) for i, c in enumerate(query)]
    return out


def postings(documents: DataFrame, text: str, key: Column, grams: list[str]) -> DataFrame:
    """The inverted index (gram, key) for the given trigrams; a row appears once for each of them that its lower-case text contains."""
    low = documents.select(key.alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams]))
    return low.select("key", F.explode(held).alias("gram"))


def candidates(documents: DataFrame, text: str, key: Column, rules) -> DataFrame:
    """(key, kinds): for every row that satisfies some rule's trigram query, the kinds to verify. Postings are written, then intersected."""
    spark, clauses = documents.sparkSession, clauses_of(rules)
    index = written(postings(documents, text, key, sorted({g for _, _, grams in clauses for g in grams})))
    asked = spark.createDataFrame([(g, kind, n, i, (1 << len(grams)) - 1) for kind, n, grams in clauses for i, g in enumerate(grams)],
                                  "gram string, kind string, clause int, bit int, whole long")  # bounded by the rules
    met = (index.join(F.broadcast(asked), "gram").groupBy("key", "clause", "kind", "whole")
           .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("seen")).where(F.col("seen") == F.col("whole")))
    return written(met.groupBy("key").agg(F.collect_set("kind").alias("kinds")))


def running(values: Column, zero: Column, step, size: int = 128) -> Column:
    """Exclusive running fold of an array: element i is the fold of those before it. Two levels keep it near-linear."""
    def grow(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    starts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: b * size + 1)
    folds = F.transform(starts, lambda s: F.aggregate(F.slice(values, s, size), zero, step))
    before = grow(folds, zero)
    blocks = F.transform(starts, lambda s: F.struct(F.slice(values, s, size).alias("part"), F.element_at(before, ((s - 1) / size + 1).cast("int")).alias("start")))
    inner = F.transform(blocks, lambda b: F.slice(grow(b["part"], b["start"]), 1, F.size(b["part"])))
    return F.when(F.size(values) > 0, F.flatten(inner)).otherwise(F.slice(F.array(zero), 1, 0))


SPANS = "array<struct<start:int,place:int,end:int,kind:string>>"


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """All spans of one rule in a text, leftmost and non-overlapping, without matches that are too short."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    lengths = F.transform(F.arrays_zip(between.alias("b"), whole.alias("w")), lambda z: F.struct(F.length(z["b"]).alias("b"), F.coalesce(F.length(z["w"]), F.lit(0)).alias("w")))
    ends = running(F.transform(lengths, lambda z: z["b"] + z["w"]), F.lit(0), lambda a, x: a + x)  # where the piece before each match begins
    rows = F.arrays_zip(F.slice(ends, 1, F.size(whole)).alias("at"), F.slice(F.transform(lengths, lambda z: z["b"]), 1, F.size(whole)).alias("b"),
                        F.transform(whole, lambda w: F.length(w)).alias("w"), F.transform(group, lambda g: F.length(g)).alias("g"))
    kept = F.filter(rows, lambda r: r["g"] >= rule.least)
    return F.transform(kept, lambda r: F.struct((r["at"] + r["b"]).alias("start"), F.lit(place).alias("place"), (r["at"] + r["b"] + r["w"]).alias("end"), F.lit(rule.kind).alias("kind"))).cast(SPANS)


def scan(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, into: str = "spans") -> DataFrame:
    """The rows with `into`: an array of (start, place, end, kind), by start and then by the rules' order."""
    key, indexed = row_key(doc_id, text), {kind for kind, _, _ in clauses_of(rules)}
    to_verify = candidates(documents, text, key, [r for r in rules if r.kind in indexed]).withColumnsRenamed({"key": "__key", "kinds": "__kinds"})
    rows = documents.withColumn("__key", key).join(to_verify, "__key", "left")
    body, none = F.coalesce(F.col(text), F.lit("")), F.array().cast(SPANS)
    found = []
    for place, rule in enumerate(rules):
        asked = F.array_contains("__kinds", rule.kind) if rule.kind in indexed else F.rlike(body, F.lit(rule.pattern))
        found.append(F.when(asked, _spans(body, rule, place)).otherwise(none))
    return rows.withColumn("__found", F.array_sort(F.flatten(F.array(*found)))).drop("__key", "__kinds").withColumn(into, F.col("__found")).drop("__found")


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every covered stretch replaced by one mark; overlapping spans count as one stretch."""
    body = F.coalesce(text, F.lit(""))
    reach = running(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    parts = F.transform(F.arrays_zip(reach.alias("from"), F.transform(spans, lambda s: s["start"]).alias("to")),
                        lambda z: F.when((z["to"] > z["from"]) | (z["from"] == 0), F.concat(F.substr(body, z["from"] + 1, z["to"] - z["from"]), F.lit(mark))).otherwise(F.lit("")))
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ""), F.substr(body, last + 1, F.length(body)))).otherwise(text)
