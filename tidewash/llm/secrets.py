"""Secret scans: a trigram index decides which rules a text can match at all."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression that Java and RE2 read alike. ``group`` of a match
    must have ``least`` characters, or the match is dropped. ``base`` rules take part in the
    base spans."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Rules in the order in which spans that start together are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)

Query = frozenset[frozenset[str]]
#: A query every text meets; one that none meets has no alternative at all.
ALWAYS: Query = frozenset([frozenset()])


def trigram_query(pattern: str, most: int = 64) -> Query:
    """Alternatives of trigrams (lower-cased): a text that matches has all of one alternative.

    The regular expression is walked part by part. Parts with few exact strings (characters,
    small classes, optional characters, alternatives) are kept as strings and joined with what
    follows; where a part has too many, the trigrams of the strings so far are required and a
    new run begins.
    """
    from re import _constants as c
    from re import _parser

    def trigrams(texts: set[str]) -> Query:
        found = frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts)
        return ALWAYS if frozenset() in found else found

    def both(a: Query, b: Query) -> Query:
        return frozenset(x | y for x, y in product(a, b))

    def characters(op, value) -> set[str] | None:
        """Few characters that the part can be, lower-cased; None: too many."""
        if op is c.LITERAL:
            return {chr(value).lower()}
        if op is c.IN and all(o in (c.LITERAL, c.RANGE) for o, _ in value):
            found = {chr(x).lower() for o, v in value for x in ([v] if o is c.LITERAL else range(v[0], v[1] + 1))}
            return found if len(found) <= 8 else None
        return None

    def walk(parts, texts: set[str], needed: Query) -> tuple[set[str], Query]:
        """``texts``: strings that end where the walk is; ``needed``: required before that."""
        for op, value in parts:
            one = characters(op, value)
            if one is None and op is c.SUBPATTERN:
                texts, needed = walk(value[3], texts, needed)
                continue
            if one is None and op is c.BRANCH:
                ways = [walk(way, texts, needed) for way in value[1]]
                if len({n for _, n in ways}) == 1 and sum(len(t) for t, _ in ways) <= most:
                    texts = set().union(*(t for t, _ in ways))
                else:
                    texts, needed = {""}, frozenset().union(*(both(n, trigrams(t)) for t, n in ways))
                continue
            if one is None and op is c.MAX_REPEAT and value[1] == 1 and len(value[2]) == 1 and (some := characters(*value[2][0])):
                one = some | {""} if value[0] == 0 else some
            if one and len(texts) * len(one) <= most:
                texts = {t + x for t, x in product(texts, one)}
            else:
                texts, needed = {""}, both(needed, trigrams(texts))
        return texts, needed

    texts, needed = walk(_parser.parse(pattern), {""}, ALWAYS)
    query = both(needed, trigrams(texts))
    # An alternative that asks for more than another is not needed.
    return frozenset(a for a in query if not any(b < a for b in query))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index of ``h, g, text``: a row for each of ``trigrams`` that a text holds, in any
    case, as ``h, g, trigram``."""
    low = F.lower("text")
    present = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]), lambda x: x.isNotNull())
    return docs.select("h", "g", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, trigrams: list[str], queries: dict[str, Query]) -> DataFrame:
    """``h, g, kinds`` of the rules whose query a text's postings meet: per alternative, the postings
    of its trigrams are intersected. Equal texts share theirs, merged before the shuffle."""
    place = {t: i for i, t in enumerate(trigrams)}
    has = [F.max(F.col("trigram") == i) for i in range(len(trigrams))]
    rows = index.groupBy("h", "g").agg(*[h.alias(f"t{i}") for i, h in enumerate(has)])
    met = [F.when(_any([_all([F.col(f"t{place[t]}") for t in alternative]) for alternative in q]), F.lit(kind)) for kind, q in queries.items()]
    kinds = F.filter(F.array(*met), lambda x: x.isNotNull())
    return rows.select("h", "g", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


#: Matches of a text that are collected at a time.
PORTION = 256


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Array of ``start, place, kind, end`` (code points, end exclusive) of a rule's matches, leftmost
    and without overlap: the text is split at the matches, so lengths of gaps and matches add
    up to positions."""
    pattern = tight(rule)
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    span_type = "struct<start:int,place:int,kind:string,end:int>"
    none = F.array().cast(f"array<{span_type}>")

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["g"])
        end = start + F.coalesce(F.length(part["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(F.length(part["v"]) >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    def add_all(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("found")), add)
        return _bound(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(state["found"], F.array(s["found"])).alias("found")))

    def spans(parts: Column) -> Column:
        # An array is copied for each part that it gains, so parts go by portions.
        starts = F.sequence(F.lit(1), F.size(parts), F.lit(PORTION))
        portions = F.transform(starts, lambda i: F.slice(parts, i, F.lit(PORTION)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{span_type}>>").alias("found"))
        return F.aggregate(portions, zero, add_all, lambda s: F.flatten(s["found"]))

    return _bound(F.arrays_zip(gaps.alias("g"), matches.alias("m"), values.alias("v")), spans)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``id``, ``spans`` (array of ``start, place, kind, end`` in order of start,
    then rule) and ``base`` (those of base rules).

    A trigram query is derived from each rule; one inverted index of the needed trigrams serves
    all of them, its postings are intersected per rule, and only candidate texts are matched
    against the regular expression. Rules without mandatory trigrams scan every text. Null
    texts are empty; they and texts without secrets have empty arrays. Rows that repeat an
    identifier each get a row. Texts are read whole.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != ALWAYS}
    trigrams = sorted({t for q in indexed.values() for a in q for t in a})
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("g", F.xxhash64(F.lit(1), "text"))  # name the text
    found = staged(candidates(postings(rows, trigrams), trigrams, indexed)) if indexed else None
    full = [(i, r) for i, r in enumerate(rules) if r.kind not in indexed]
    empty = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    # A scan of every text is one test for most of them; only those that match are split.
    scanned = [F.when(F.regexp_like("text", F.lit(tight(r))), spans_of(F.col("text"), r, i)).otherwise(empty) for i, r in full]
    base = rows.select("h", "g", "id", "text", F.concat(empty, *scanned).alias("scanned"))
    if found is not None:
        base = base.join(found, ["h", "g"], "left")
        verified = [F.when(F.array_contains("kinds", r.kind), spans_of(F.col("text"), r, i)).otherwise(empty) for i, r in enumerate(rules) if r.kind in indexed]
        base = base.withColumn("scanned", F.concat("scanned", *verified))
    spans = F.array_sort("scanned")
    names = [r.kind for r in rules if r.base]
    return base.select("id", spans.alias("spans")).withColumn("base", F.filter("spans", lambda s: s["kind"].isin(names)))


def tight(rule: Rule) -> str:
    """The rule's pattern; one class repeated asks for its least repeat at once, as runs are whole."""
    return re.sub(r"^(\[[^\]]+\])\+$", rf"\1{{{rule.least},}}", rule.pattern)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
