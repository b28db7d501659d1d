"""Secret scans: Boolean trigram queries derived from each rule's regex, an inverted trigram index, verified candidates. DataFrame functions only."""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Alternatives of a literal that the derivation follows before it keeps only what they have in common.
WIDTH = 64
#: Rows that a shard of the index is meant to hold.
SHARD = 4096


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex, least lengths of the whole match and of a group (0 for none), and a group that only leads up to the secret (0 for none)."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    group_least: int = 0
    lead: int = 0


#: The base rules, in the order of their kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # runs are maximal, so this finds just the runs of [0-9a-f]+ that are long enough
)
#: Further rules, by public formats of keys.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    # Of a run of its characters only the first eyJ can begin a match, so the search goes from run to run and reads each a few times at most.
    Rule("jwt", r"(?<![A-Za-z0-9_-])((?:(?!eyJ)[A-Za-z0-9_-])*+)eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", lead=1),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    Rule("url_login", r"://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+-]{1,64}@"),
)

#: A Boolean query over trigrams: ("and" | "or", parts), a trigram, or True for one that every text satisfies.
Query = tuple | str | bool


def _all(parts: list[Query]) -> Query:
    flat: list[Query] = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == "and" else [] if p is True else [p]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("and", *flat) if flat else True


def _any(parts: list[Query]) -> Query:
    """One that demands more than another adds nothing."""
    if not parts or any(p is True for p in parts):
        return True
    needs = {p: {p} if isinstance(p, str) or p[0] == "or" else set(p[1:]) for p in parts}
    kept = [p for p in needs if not any(q != p and needs[q] < needs[p] for q in needs)]
    return kept[0] if len(kept) == 1 else ("or", *kept)


def _grams(words: set[str]) -> Query:
    """What every text holds that holds one of the words."""
    return _any([_all([w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)])


def _of(items: list, fold: bool) -> tuple[Query, set[str] | None]:
    """(query, words) of a part of a regex: words are all the strings it can match, or None if there are too many."""
    query: list[Query] = []
    run: set[str] | None = {""}

    def ended() -> None:
        nonlocal run
        if run is not None:
            query.append(_grams(run))
        run = {""}

    known = True
    for op, arg in items:
        own: set[str] | None = None
        if op is C.LITERAL:
            own = {chr(arg).lower() if fold or chr(arg).isascii() else chr(arg)}
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 4:
            own = {chr(v).lower() for _, v in arg}
        elif op is C.SUBPATTERN:
            inner, own = _of(list(arg[3]), fold)
            if own is None:
                query.append(inner)
        elif op is C.BRANCH:
            parts = [_of(list(b), fold) for b in arg[1]]
            own = set().union(*(w for _, w in parts)) if all(w is not None for _, w in parts) else None
            if own is None:
                query.append(_any([q if w is None else _grams(w) for q, w in parts]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            inner, words = _of(list(sub), fold)
            if words is not None and high == 1 and low == 0:
                own = words | {""}
            elif words is not None and low >= 1 and low == high and low <= 3:
                own = {""}
                for _ in range(low):
                    own = {a + b for a in own for b in words}
            elif low >= 1:
                query.append(inner if words is None else _grams(words))
        elif op is C.AT:
            own = {""}
        if own is not None and run is not None and len(run) * len(own) <= WIDTH:
            run = {a + b for a in run for b in own}
        else:
            known = False
            ended()
            if own is not None and len(own) <= WIDTH:
                run = set(own)
    if known:
        return _all([*query, _grams(run)]), run
    ended()
    return _all(query), None


def trigram_query(regex: str) -> Query:
    """The Boolean query over lower-case trigrams that each text with a match satisfies; True if the regex demands none."""
    tree = parser.parse(regex)
    return _of(list(tree), bool(tree.state.flags & C.SRE_FLAG_IGNORECASE))[0]


def trigrams(query: Query) -> list[str]:
    if isinstance(query, str):
        return [query]
    return [] if isinstance(query, bool) else sorted({g for p in query[1:] for g in trigrams(p)})


_SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"
_POWERS = [1 << i for i in range(31)]


def _key(docs: DataFrame) -> Column:
    """What the postings name a row by. Two rows that share one by chance are only verified once more than needed."""
    return F.xxhash64(*(c for c in ("doc_id", "text") if c in docs.columns))


def index(docs: DataFrame, grams: list[str], shard: int = SHARD) -> DataFrame:
    """(shard, gram, keys): the inverted index of docs(doc_id, text): the keys of the rows that hold grams[gram].

    A posting list is divided into shards of about `shard` rows, by the hash of the row's key: all lists of a shard
    concern the same rows, so lists are intersected shard by shard and none of them grows with the table. Equal rows
    have one key. Only trigrams that some rule asks for are indexed.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held = _given(lower, lambda t: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)))))
    # Rows without any trigram are left out by explode() below: a filter here would look for the trigrams twice.
    rows = written(docs.select(_key(docs).alias("key"), held.alias("held")), "trigrams")
    shards = max(1, -(-rows.count() // shard))
    lists = rows.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.explode("held").alias("gram"), "key")
    return lists.groupBy("shard", "gram").agg(F.collect_set("key").alias("keys"))


def _matching(query: Query, gram: dict[str, int], lists: Column) -> Column:
    """The keys that satisfy the query, from a shard's lists by gram."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(gram[query])), F.array().cast("array<long>"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, (_matching(p, gram, lists) for p in query[1:]))


def candidates(postings: DataFrame, queries: list[Query], grams: list[str]) -> DataFrame:
    """(key, rules): the rows that satisfy the Boolean queries, which are numbered in their order, by intersecting and uniting posting lists. Queries that demand nothing are left out: every row satisfies them."""
    gram = {g: i for i, g in enumerate(grams)}
    shards = postings.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))
    found = [F.struct(F.lit(n).alias("rule"), _matching(q, gram, F.col("lists")).alias("keys")) for n, q in enumerate(queries) if q is not True]
    each = shards.select(F.explode(F.array(*found)).alias("found")).select("found.rule", F.explode("found.keys").alias("key"))
    return each.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _running(values: Column, join: Callable[[Column, Column], Column], zero: int) -> Column:
    """Running sums (or greatest values) of an array, by doubling the span that each element covers: n log n steps."""

    def step(acc: Column, by: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(zero), by), F.slice(acc, F.lit(1), F.size(acc) - by))
        return F.when(by >= F.size(acc), acc).otherwise(F.zip_with(acc, moved, lambda a, b: join(a, b)))

    return F.aggregate(F.array(*map(F.lit, _POWERS)), values, step)


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _verified(rule: Rule, order: int) -> Column:
    """array<struct<start, order, kind, end>> of a rule's matches that are long enough: leftmost, not overlapping.

    The pieces between matches and the matches themselves alternate, so running sums of their lengths are the places.
    """
    text, regex = F.col("text"), F.lit(rule.regex)
    gaps = F.transform(F.split(text, rule.regex, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    size = lambda n: F.transform(F.regexp_extract_all(text, regex, F.lit(n)), F.length) if n else F.lit(None).cast("array<int>")

    def spans(x: Column) -> Column:
        ends = _running(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["whole"])), x["whole"], lambda a, b: a + b), lambda a, b: a + b, 0)
        found = F.zip_with(ends, x["whole"], lambda end, n: F.struct((end - n).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        if rule.lead:
            found = F.zip_with(found, x["lead"], lambda s, n: s.withField("start", s["start"] + n))
        if rule.group:
            found = F.zip_with(found, x["own"], lambda s, n: F.when(n >= rule.group_least, s))
        return F.filter(found, lambda s: s.isNotNull() & (s["end"] - s["start"] >= rule.least))

    return _given(F.struct(gaps.alias("gaps"), whole.alias("whole"), size(rule.group).alias("own"), size(rule.lead).alias("lead")), spans)


def found_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with `spans`: array<struct<start, order, kind, end>> sorted by start, then rule order.

    Places count code points, ends are exclusive. A rule's matches are leftmost and do not overlap; spans of different
    rules may. A null text has no secrets; empty tables, repeated rows and further columns are passed on as they are
    (but for a column `spans`, which is replaced).

    The trigram index is built once, each rule's Boolean query is answered from its postings, and a row is matched only
    against the rules that it is a candidate of; rules without mandatory trigrams scan every row. Candidates are a narrow
    table that Spark broadcasts if it is small; else rows and candidates meet by key. Work on a text grows with its
    length and its matches: no rule reads a part of a text more than a fixed number of times.
    """
    queries = [trigram_query(r.regex) for r in rules]
    grams = sorted({g for q in queries for g in trigrams(q)})
    names = [c for c in docs.columns if c != "spans"]
    text = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    none = F.array().cast(_SPANS)
    if grams:
        asked = written(candidates(index(text, grams), queries, grams), "candidates")
        text = text.withColumn("__key", _key(text)).join(asked.select(F.col("key").alias("__key"), F.col("rules").alias("__rules")), "__key", "left")
    lists = []
    for order, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        test = F.regexp_like("text", F.lit(rule.regex))
        test = test if query is True else F.array_contains("__rules", order) & test
        lists.append(F.when(test, _verified(rule, order)).otherwise(none))
    return text.select(*names, F.array_sort(F.concat(*lists)).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs with every secret in `text` replaced by the mark; overlapping spans share one. A null text stays null; repeated rows, empty tables and further columns are passed on.

    The text is cut at all spans at once, in an encoding of four bytes for each character, in which a place is found
    without counting from the start.
    """
    own = docs.withColumn("__null", F.col("text").isNull())
    found = found_secrets(own.withColumnRenamed("spans", "__spans") if "spans" in docs.columns else own, rules)

    def cut(x: Column) -> Column:
        piece = lambda a, b: F.decode(F.substring(x["wide"], 4 * a + 1, 4 * (b - a)), "UTF-32")
        before = F.concat(F.array(F.lit(0)), F.slice(x["done"], F.lit(1), F.size("spans") - 1))
        fresh = F.filter(F.zip_with(x["starts"], before, lambda s, d: F.struct(s.alias("start"), d.alias("done"))), lambda p: p["start"] >= p["done"])
        parts = F.transform(fresh, lambda p: F.concat(piece(p["done"], p["start"]), F.lit(mark)))
        return F.concat(F.array_join(parts, ""), piece(F.element_at(x["done"], -1), F.length("text")))

    value = F.struct(F.encode("text", "UTF-32").alias("wide"), F.transform("spans", lambda s: s["start"]).alias("starts"), _running(F.transform("spans", lambda s: s["end"]), F.greatest, 0).alias("done"))
    text = F.when(F.col("__null"), F.lit(None)).when(F.size("spans") == 0, F.col("text")).otherwise(_given(value, cut))
    return found.select(*(text.alias(c) if c == "text" else F.col("__spans" if c == "spans" else c).alias(c) for c in docs.columns))
