"""Secret scan with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is walked once, at plan time, for the strings that
every match must hold; that gives a Boolean query over trigrams. One pass over the
texts posts (trigram, document) for the trigrams that some query names. Postings
are intersected per document, which leaves for each document the rules that can
match at all, and only those are run. A rule without mandatory trigrams, such as a
run of hexadecimal digits, is run on every text.

Rules read matches from left to right without overlap and may drop matches with a
short group. Offsets count code points.

Defined cases: a null or empty text has no spans; documents with equal or null ids
share their candidates and are verified one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm.common import few, filled, stage, table

PARSER = re._parser  # the standard library's own reading of a pattern
MAX_STRINGS = 32
LANE = 62


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed by the contract: the first three. The order is the order of equal starts.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/-]{16,}=*"),
    Rule("login_url", r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]+:[^\s:/@]+@"),
)
RULES = BASE + ADDED

# A query is True (no condition), a trigram, or ("and" | "or", queries).


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(parts: list) -> object:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    sets = [trigrams(p) if not isinstance(p, str) and p[0] == "and" else None for p in parts]
    # A side that asks for more than another side adds nothing.
    parts = [p for i, p in enumerate(parts) if sets[i] is None or not any(
        other is not None and (other < sets[i] or other == sets[i] and j < i) for j, other in enumerate(sets) if j != i)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _holds(strings: set[str]) -> object:
    """One of the strings is there."""
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else True for s in sorted(strings)])


def _node(kind, value) -> tuple[set[str] | None, object]:
    """(all strings the node can be, or None if too many; its query)."""
    name = str(kind)
    if name == "LITERAL":
        return {chr(value).lower()}, True
    if name == "AT":
        return {""}, True
    if name == "IN" and len(value) <= 8 and all(str(k) == "LITERAL" for k, _ in value):
        return {chr(v).lower() for _, v in value}, True
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "BRANCH":
        sides = [_sequence(v) for v in value[1]]
        exact = None if any(e is None for e, _ in sides) else set().union(*(e for e, _ in sides))
        if exact is not None and len(exact) <= MAX_STRINGS:
            return exact, True
        return None, _any([q if e is None else _holds(e) for e, q in sides])
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, item = value
        exact, query = _sequence(item)
        if exact is not None and (least, most) in ((0, 1), (1, 1)):
            return exact | ({""} if least == 0 else set()), True
        if exact is not None and least == most and len(exact) == 1:
            return {next(iter(exact)) * least}, True
        if least == 0:
            return None, True
        return None, query if exact is None else _holds(exact)
    return None, True


def _sequence(items) -> tuple[set[str] | None, object]:
    run, whole, parts = {""}, True, []
    for kind, value in items:
        exact, query = _node(kind, value)
        if exact is not None and len(run) * len(exact) <= MAX_STRINGS:
            run = {a + b for a in run for b in exact}
        else:
            parts += [_holds(run), query if exact is None else True]
            run, whole = ({""}, False) if exact is None else (exact, False)
    return (run, True) if whole else (None, _all([*parts, _holds(run)]))


def trigram_query(pattern: str) -> object:
    """What a lower-cased text must hold for the pattern to match somewhere in it."""
    exact, query = _sequence(PARSER.parse(pattern))
    return query if exact is None else _holds(exact)


def trigrams(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def index(docs: DataFrame, wanted: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (trigram number, key) of the wanted trigrams, case ignored."""
    low = F.lower(filled(text))
    there = F.filter(F.array(*[F.struct(F.lit(i).alias("trigram"), F.lit(t).alias("s")) for i, t in enumerate(wanted)]),
                     lambda e: F.contains(F.col("_low"), e["s"]))
    return docs.select(F.col(key), low.alias("_low")).select(key, F.explode(there).alias("e")).select(
        F.col("e.trigram").alias("trigram"), key)


def candidates(postings: DataFrame, rules: tuple[Rule, ...], wanted: list[str], key: str = "doc_id") -> DataFrame:
    """(key, rules): a bit per rule whose query the intersected postings satisfy."""
    lanes = range(-(-len(wanted) // LANE))
    held = postings.groupBy(key).agg(*[
        F.bit_or(F.when(F.floor(F.col("trigram") / LANE) == n, F.expr(f"shiftleft(1L, trigram % {LANE})"))
                 .otherwise(F.lit(0).cast("long"))).alias(f"_lane{n}") for n in lanes])
    at = {t: (F.col(f"_lane{i // LANE}").bitwiseAND(F.lit(1 << i % LANE)) != 0) for i, t in enumerate(wanted)}

    def holds(query) -> Column:
        if isinstance(query, str):
            return at[query]
        sides = [holds(q) for q in query[1]]
        return reduce(lambda a, b: a & b if query[0] == "and" else a | b, sides)

    bits = [F.when(holds(q), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules)
            if (q := trigram_query(rule.pattern)) is not True]
    mask = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return held.select(key, mask.alias("rules")).where("rules <> 0")


def spans(text: Column, rule: Rule) -> Column:
    """(start, end) of a rule's matches: gaps and matches take turns in the text."""
    pattern = F.lit(rule.pattern)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.zip_with(F.transform(gaps, lambda g: F.length(g)), F.transform(found, lambda m: F.length(m)),
                       lambda g, m: F.struct(g.alias("gap"), m.alias("size")))
    sized = F.filter(F.arrays_zip(sizes.alias("at"), F.transform(
        F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda m: F.length(m)).alias("group")),
        lambda e: e["group"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")
    walked = F.aggregate(sized, F.struct(F.lit(0).alias("pos"), none.alias("out")), lambda a, e: F.struct(
        (a["pos"] + e["at"]["gap"] + e["at"]["size"]).alias("pos"),
        F.when(e["group"] >= rule.least, F.concat(a["out"], F.array(F.struct(
            (a["pos"] + e["at"]["gap"]).alias("start"),
            (a["pos"] + e["at"]["gap"] + e["at"]["size"]).alias("end"))))).otherwise(a["out"]).alias("out")))
    return F.when(F.rlike(text, pattern), walked["out"]).otherwise(none)


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans of each kind, all spans in order) of every document."""
    wanted = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    hits = stage(candidates(index(docs, wanted, key, text), rules, wanted, key).select(
        F.col(key).alias("_key"), "rules"), "secret-candidates")
    texts = docs.select(key, filled(text).alias("_text"))
    joined = texts.join(few(hits), F.col(key).eqNullSafe(F.col("_key")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")

    def run(i: int, rule: Rule) -> Column:
        # Only long enough runs need the walk over all matches.
        if trigram_query(rule.pattern) is True:
            found = F.rlike(F.col("_text"), F.lit(f"(?:{rule.pattern.removesuffix('+')}){{{rule.least},}}")) \
                if rule.pattern.endswith("]+") and rule.group == 0 else F.lit(True)
        else:
            found = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
        return F.when(found, spans(F.col("_text"), rule)).otherwise(none).alias(f"_{rule.kind}")

    each = joined.select(key, *[run(i, r) for i, r in enumerate(rules)])

    def merged(kinds: tuple[Rule, ...]) -> Column:
        def named(i: int, rule: Rule) -> Column:
            return F.transform(F.col(f"_{rule.kind}"), lambda s: F.struct(
                s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")))

        parts = [named(i, r) for i, r in enumerate(kinds)]
        return F.array_join(F.transform(F.sort_array(F.concat(*parts)), lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return each.withColumn("base_spans", merged(tuple(r for r in rules if r in BASE))).withColumn("spans", merged(rules))


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document: the base kinds and the added ones."""
    found = secrets(table(spark, sf, "documents"))
    return found.select("doc_id", *[F.size(f"_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE],
                        F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def _sql() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, start, start + size AS stop FROM ("
            f"SELECT doc_id, sizes[k] AS size, list_sum(gaps[1:k]) + coalesce(list_sum(sizes[1:k-1]), 0) AS start, groups[k] AS g"
            f" FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS k FROM (SELECT doc_id,"
            f" list_transform(regexp_extract_all(text, '{p}'), lambda x: length(x)) AS sizes,"
            f" list_transform(regexp_extract_all(text, '{p}', {r.group}), lambda x: length(x)) AS groups,"
            f" list_transform(string_split_regex(text, '{p}'), lambda x: length(x)) AS gaps FROM d"
            f" WHERE regexp_matches(text, '{p}'))"
            f")) WHERE g >= {r.least}")
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    s AS ({' UNION ALL '.join(parts)}),
    g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
        string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank) AS spans
        FROM s GROUP BY 1)
    SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)},
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


QUERIES = {"op9_secrets": op9_secrets}
SQL = {"op9_secrets": _sql()}
