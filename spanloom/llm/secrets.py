"""Secret scan through a trigram inverted index.

Each rule's pattern is turned into a Boolean query of trigrams that any match
must contain (after Cox, "Regular Expression Matching with a Trigram Index",
2012), in disjunctive form. Only trigrams of those queries are indexed: the index
is a table of (trigram, doc_id) postings. A rule's candidates are the documents
in all postings of one of its conjunctions; they are verified with the pattern.
A pattern without a mandatory trigram can't be narrowed and scans every text.

Built-in functions only; no text passes through Python.
"""

from __future__ import annotations

import itertools
import re._constants as sre
import re._parser as sre_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import session
from spanloom.llm.common import pin

MAX_STRINGS = 64  # alternatives of an exact string that are followed before its trigrams are taken


class Rule(NamedTuple):
    """A kind of secret: pattern, and the shortest value of a group that counts."""

    kind: str
    pattern: str
    group: int = 0
    shortest: int = 1
    base: bool = False


# Fixed values. The first three are the base kinds. Runs of one class are written
# with their least length: a run is matched whole or not at all, so this finds what
# dropping shorter matches would leave.
RULES = [
    Rule("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
    Rule("access", "AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", "[0-9a-f]{24,}", base=True),
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
]


# -- trigram queries --------------------------------------------------------------

def _trigrams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _both(a: set[frozenset], b: set[frozenset]) -> set[frozenset]:
    return _least({x | y for x in a for y in b})


def _least(clauses: set[frozenset]) -> set[frozenset]:
    """Without clauses that another one implies."""
    return {c for c in clauses if not any(d < c for d in clauses)}


def _exact(node) -> set[str] | None:
    """All strings an element can match when they are few, else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg)} if arg < 128 else None
    if op is sre.IN:
        out = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value))
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out |= {chr(c) for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 and all(ord(c) < 128 for c in out) else None
    if op is sre.SUBPATTERN:
        return _exact_sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_exact_sequence(b) for b in arg[1]]
        return set().union(*parts) if all(p is not None for p in parts) else None
    if op is sre.MAX_REPEAT:
        low, high, body = arg
        inner = _exact_sequence(body)
        if inner is None or high > 3:
            return None
        return {"".join(p) for n in range(low, high + 1) for p in itertools.product(inner, repeat=n)}
    return None


def _exact_sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        own = _exact(node)
        if own is None or len(out) * len(own) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in own}
    return out


def _query(nodes) -> set[frozenset]:
    """Disjunction of conjunctions of trigrams; an empty conjunction is always true."""
    clauses, run = {frozenset()}, {""}

    def close():
        nonlocal clauses, run
        clauses, run = _both(clauses, {_trigrams(s) for s in run}), {""}

    for op, arg in nodes:
        own = _exact((op, arg))
        if own is not None and len(run) * len(own) <= MAX_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        close()
        if own is not None:
            run = own
        elif op is sre.SUBPATTERN:
            clauses = _both(clauses, _query(arg[3]))
        elif op is sre.BRANCH:
            clauses = _both(clauses, _least(set().union(*(_query(b) for b in arg[1]))))
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            clauses = _both(clauses, _query(arg[2]))
    close()
    return clauses


def trigram_query(pattern: str) -> list[list[str]]:
    """Conjunctions of lower-case trigrams, one of which any text with a match contains.

    Empty when the pattern has no mandatory trigram.
    """
    clauses = _query(sre_parser.parse(pattern))
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


# -- index and candidates -------------------------------------------------------------

def postings(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(trigram, doc_id) for the trigrams the rules ask for."""
    asked = sorted({t for r in rules for c in trigram_query(r.pattern) for t in c})
    lowered = docs.select("doc_id", F.lower("text").alias("low"))
    held = F.filter(F.array(*map(F.lit, asked)), lambda t: F.contains(F.col("low"), t)) if asked else F.array().cast("array<string>")
    return lowered.select(F.explode(held).alias("trigram"), "doc_id").distinct()


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, kinds): the rules whose query a document meets, by intersecting postings."""
    terms = [
        (r.kind, n, len(clause), t) for r in rules for n, clause in enumerate(trigram_query(r.pattern)) for t in clause
    ]
    spark = index.sparkSession
    asked = spark.createDataFrame(terms, "kind string, clause int, size int, trigram string")
    met = (
        index.join(F.broadcast(asked), "trigram")  # a row for each term of the rules
        .groupBy("doc_id", "kind", "clause", "size").count()
        .filter(F.col("count") == F.col("size"))
    )
    return met.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


# -- verification ---------------------------------------------------------------------

def _spans(text: Column, rule: Rule) -> Column:
    """(start, end) of the matches of a rule in code points, from the pieces around and the matches themselves."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    walked = F.aggregate(
        F.arrays_zip(
            hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), values.alias("value")
        ),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, m: F.struct(
            (acc["at"] + F.length(m["gap"]) + F.length(m["hit"])).alias("at"),
            F.when(
                F.length(m["value"]) >= rule.shortest,
                F.concat(acc["spans"], F.array(F.struct(
                    (acc["at"] + F.length(m["gap"])).alias("start"),
                    (acc["at"] + F.length(m["gap"]) + F.length(m["hit"])).alias("end"),
                ))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return walked["spans"]


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:int>>")


def scan_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id and spans, an array of (start, end, kind).

    Spans are code points, the end exclusive, of leftmost matches that don't
    overlap within a kind, by start, then in the order of the rules, whose number
    ``kind`` is. Null and empty texts have none. Rows that share a doc_id are each
    scanned. An empty table gives an empty result.
    """
    rules = RULES if rules is None else rules
    indexed = [r for r in rules if trigram_query(r.pattern)]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    index = session.stage(postings(docs, indexed), "trigram-postings")
    found = pin(candidates(index, indexed))
    if session.within(found, session.BROADCAST_ROW_BOUND):
        found = F.broadcast(found)
    marked = docs.join(found.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    parts = []
    for n, rule in enumerate(rules):
        if rule in indexed:
            may = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        else:
            may = F.regexp_like("text", F.lit(rule.pattern))
        own = F.transform(_spans(F.col("text"), rule), lambda s: F.struct(s["start"], s["end"], F.lit(n).alias("kind")))
        parts.append(F.when(may, own).otherwise(_none()))
    ordered = F.transform(
        F.array_sort(F.transform(F.flatten(F.array(*parts)), lambda s: F.struct(s["start"], s["kind"], s["end"]))),
        lambda s: F.struct(s["start"], s["end"], s["kind"]),
    )
    return marked.select("doc_id", ordered.alias("spans"))


def written(spans: Column, rules: list[Rule] | None = None) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(r.kind) for r in (RULES if rules is None else rules)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
