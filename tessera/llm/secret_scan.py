"""Secret scans over a trigram inverted index, in DataFrame operations only.

A Boolean trigram query (an OR of ANDs) is derived from each rule's regex: literal stretches, with their
alternatives and optional parts spelled out, need all their trigrams. The index holds, for the trigrams that any
query names, the documents they occur in; the postings of each AND are intersected by counting, and only
documents that satisfy a rule's query are verified with its regex. Rules without a mandatory trigram scan all texts.

Defined cases: a null text is an empty one and has no spans; a null doc_id is a key like any other; documents with
one doc_id share its postings (verification is by row); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Rule:
    """Matches of regex (leftmost, not overlapping) whose group has at least `least` characters are secrets."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so this finds what [0-9a-f]+ finds of that length
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE + MORE


def trigram_query(regex: str, most: int = 64) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match satisfies; empty if the regex needs none.

    `most` bounds the strings that a literal stretch may stand for; a stretch of more is left out, which only weakens the query.
    """
    stretches: list[set[str]] = []

    def exact(items) -> set[str] | None:
        """All strings that the items can match, if those are few."""
        whole = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                part = {chr(arg).lower()}
            elif op is sre.SUBPATTERN:
                part = exact(arg[3])
            elif op is sre.BRANCH:
                parts = [exact(a) for a in arg[1]]
                part = None if None in parts else set().union(*parts)
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                part = {chr(a).lower() for _, a in arg}
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 2:
                once = exact(arg[2])
                part = once and {"".join(t) for n in range(arg[0], arg[1] + 1) for t in product(once, repeat=n)}
            else:
                part = None
            if not part or len(whole) * len(part) > most:
                return None
            whole = {a + b for a in whole for b in part}
        return whole

    def walk(items) -> None:
        now = {""}
        for item in items:
            part = exact([item])
            if part is None or len(now) * len(part) > most:
                stretches.append(now)
                now = {""}
                if part is not None:
                    now = part
                elif item[0] is sre.SUBPATTERN:
                    walk(item[1][3])
                elif item[0] in (sre.MAX_REPEAT, sre.MIN_REPEAT) and item[1][0] > 0:
                    walk(item[1][2])
            else:
                now = {a + b for a in now for b in part}
        stretches.append(now)

    walk(sre_parse.parse(regex))
    query: set[frozenset[str]] = {frozenset()}
    for strings in stretches:
        ors = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        query = {a | b for a in query for b in ors}
        query = {q for q in query if not any(o < q for o in query)}  # an AND with fewer terms covers one with more
    return [] if frozenset() in query else sorted(query, key=sorted)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, set[str]]:
    """(doc_id, kinds) of the documents that satisfy a rule's trigram query, and the kinds that have none."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    terms = [(kind, i, t, len(q)) for kind, ands in queries.items() for i, q in enumerate(ands) for t in sorted(q)]
    trigrams = sorted({t for _, _, t, _ in terms})
    lower = docs.select("doc_id", F.lower("text").alias("text"))
    index = lower.select("doc_id", F.explode(F.array_compact(F.array(*(F.when(F.contains("text", F.lit(t)), F.lit(t)) for t in trigrams)))).alias("trigram"))
    named = docs.sparkSession.createDataFrame(terms, "kind string, clause int, trigram string, needed int")  # a row for each term of the rules
    hits = index.join(F.broadcast(named), "trigram").groupBy("doc_id", "kind", "clause", "needed").agg(F.count_distinct("trigram").alias("found")).where("found = needed")
    return hits.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")), {k for k, ands in queries.items() if not ands}


def by_blocks(rows: Column, passed: Callable[[Column, Column], Column], make: Callable[[Column, Column, Column], Column], block: int = 128) -> Column:
    """An array: make(rows of a block, position before it, position after it) of each block of an array, where passed(position, row) is the position after a row.

    Arrays and texts are appended to only within a block, so that a row with very many elements isn't copied once for each of them.
    """
    part = lambda r, i: F.slice(r, i * block + 1, F.lit(block))
    numbers = lambda r: F.sequence(F.lit(0), F.floor(F.greatest(F.size(r) - 1, F.lit(0)) / block).cast("int"))

    def marks(r: Column) -> Column:
        return F.aggregate(numbers(r), F.array(F.lit(0)), lambda acc, i: F.concat(acc, F.array(F.aggregate(part(r, i), F.element_at(acc, -1), passed))))

    whole = lambda r: F.transform(F.array(marks(r)), lambda m: F.transform(numbers(r), lambda i: make(part(r, i), F.get(m, i), F.get(m, i + 1))))[0]
    return F.transform(F.array(rows), whole)[0]  # the lambdas' variables are computed once


def found(rule: Rule, order: int) -> Column:
    """Spans (start, rule's place, end, kind) of a rule in the column text; positions are sums of the lengths of matches and of what lies between them."""
    whole, group = F.regexp_extract_all("text", F.lit(rule.regex), F.lit(0)), F.regexp_extract_all("text", F.lit(rule.regex), F.lit(rule.group))
    between = F.split("text", rule.regex, -1)
    rows = F.arrays_zip(F.transform(between, F.length).alias("b"), F.transform(whole, F.length).alias("m"), F.transform(group, F.length).alias("g"))
    none = F.expr("cast(array() as array<struct<start:int,place:int,end:int,kind:string>>)")
    after = lambda at, row: at + row["b"] + F.coalesce(row["m"], F.lit(0))

    def step(acc: Column, row: Column) -> Column:
        end = after(acc["at"], row)
        span = F.struct((acc["at"] + row["b"]).alias("start"), F.lit(order).alias("place"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(row["g"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.flatten(by_blocks(rows, after, lambda part, at, _: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns `keep` and spans: array of (start, place, end, kind) by start, then the rule's place, then end."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    some, full = candidates(docs, rules)
    some = some.select(F.col("doc_id").alias("of"), "kinds")
    joined = docs.join(some, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    none = F.expr("cast(array() as array<struct<start:int,place:int,end:int,kind:string>>)")
    spans = [F.when(F.rlike("text", F.lit(r.regex)) if r.kind in full else F.array_contains("kinds", r.kind), found(r, i)).otherwise(none) for i, r in enumerate(rules)]
    return joined.select("doc_id", "text", *keep, F.array_sort(F.concat(*spans)).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets, and n_chars counted anew. A null text stays null."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.struct(*rest).alias("rest"), F.col("text").isNull().alias("was_null")).alias("row"))
    kept = scan(packed, rules, ("row",))
    after = lambda at, s: F.greatest(at, s["end"])

    def pieces(part: Column, at: Column, end: Column) -> Column:
        """The text between two positions, with its secrets replaced."""

        def step(acc: Column, s: Column) -> Column:
            begin = F.greatest(s["start"], acc["at"])
            more = F.concat(acc["out"], F.substring(acc["cut"], acc["at"] - at + 1, begin - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
            return F.struct(after(acc["at"], s).alias("at"), F.when(s["end"] > acc["at"], more).otherwise(acc["out"]).alias("out"), acc["cut"].alias("cut"))

        return F.aggregate(part, F.struct(at.alias("at"), F.lit("").alias("out"), F.substring("text", at + 1, end - at).alias("cut")), step, lambda acc: acc["out"])

    last = F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"])), F.lit(0))
    clean = F.concat(F.array_join(by_blocks(F.col("spans"), after, pieces), ""), F.substring("text", last + 1, F.length("text")))
    text = F.when(F.col("row.was_null"), F.lit(None).cast("string")).when(F.size("spans") == 0, F.col("text")).otherwise(clean)
    kept = kept.select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col("row.rest")[c].alias(c) for c in docs.columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, base = F.col("spans"), {r.kind for r in BASE}
    basic = F.filter(spans, lambda s: s["kind"].isin(*base))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *(count(r.kind) for r in BASE), F.sha2(written(basic), 256).alias("base_sha256"), written(spans).alias("spans"))
