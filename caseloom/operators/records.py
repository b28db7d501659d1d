"""Records: searches and pages, counts and shares, unions and look-ups, inserts, updates and audit."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles by level.
ROLE_LEVELS = {"VIEWER": 1, "ANALYST": 2, "INVESTIGATOR": 3, "ADMIN": 4}


def or_default(c: Column, default) -> Column:
    """The value, or the default for null, empty, zero or false."""
    text = c.cast("string")
    return F.when(text.isNull() | text.isin("", "0", "0.0", "false"), F.lit(default)).otherwise(c)


def holds(text: str, *columns: str) -> Column:
    """Some column holds the text, case aside; an empty text is in all."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    return reduce(lambda a, b: a | b, (F.ilike(F.col(c).cast("string"), F.lit(pattern)) for c in columns)) if text else F.lit(True)


def searched(rows: DataFrame, text: str = "", columns: Sequence[str] = (), equal: dict | None = None) -> DataFrame:
    """Rows with the text in one of the columns and equal values, case aside for texts, where values are given."""
    out = rows.where(holds(text, *columns)) if text and columns else rows
    for c, v in (equal or {}).items():
        if v is not None:
            out = out.where(F.lower(F.col(c)) == v.lower() if isinstance(v, str) else F.col(c) == v)
    return out


def page(rows: DataFrame, order: Sequence[tuple[str, bool]], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows in the order of (column, descending), nulls last; add a unique column last."""
    return rows.orderBy(*(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order)).offset(offset).limit(limit)


def best_of(rows: DataFrame, key: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def global_search(sources: dict[str, tuple[DataFrame, str, Sequence[str]]], text: str, each: int = 10) -> DataFrame:
    """(kind, id, label): for each source (table, id, columns) the first rows, by id, that hold the text."""
    parts = [df.where(holds(text, *cols)).orderBy(key).limit(each).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(cols[0]).cast("string").alias("label")) for kind, (df, key, cols) in sources.items()]
    return reduce(DataFrame.union, parts)


def filtered_or_all(rows: DataFrame, test: Column) -> DataFrame:
    """Rows that pass, or all rows if none does."""
    any_hit = rows.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias("_any"))
    return rows.join(F.broadcast(any_hit)).where(~F.col("_any") | test).drop("_any")


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each table."""
    return reduce(DataFrame.union, (df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()))


def shares(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(value, n, share in per cent of all rows) of the k commonest values; ties by value."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def monthly(rows: DataFrame, ts: str, solved: Column, months: int = 12) -> DataFrame:
    """(month, total, solved) of the last months."""
    own = rows.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.count("*").alias("total"), F.count_if(solved).alias("solved"))
    return own.orderBy(F.desc("month")).limit(months).orderBy("month")


def indicators(rows: DataFrame, **tests: Column) -> DataFrame:
    """One row of conditional counts, in one pass."""
    return rows.agg(*(F.count_if(t).alias(n) for n, t in tests.items()))


def recent(*sources: tuple[DataFrame, str, str, str, int]) -> DataFrame:
    """(kind, id, ts): the latest rows of each source (table, kind, id, ts, k), ties by id."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(ts).cast("timestamp_ntz").alias("ts")).orderBy(F.desc_nulls_last("ts"), "id").limit(k) for df, kind, key, ts, k in sources]
    return reduce(DataFrame.union, parts)


def timeline(*sources: tuple[DataFrame, str, str, str], key: str | None = None) -> DataFrame:
    """(kind, id, key, ts) of all sources (table, kind, id, ts), newest first."""
    parts = [df.select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), (F.col(key) if key else F.lit(None)).cast("string").alias("key"), F.col(ts).cast("timestamp_ntz").alias("ts")) for df, kind, i, ts in sources]
    return reduce(DataFrame.union, parts)


def by_id_or_name(people: DataFrame, rows: DataFrame, person_id: str = "person_id", name: str = "name") -> DataFrame:
    """Rows of people(person_id, name) by equal id or equal name, case aside: two equi-joins, the second of which leaves out what the first finds, so each row comes once for each person."""
    p = people.select(F.col("person_id").alias("_p"), F.lower("name").alias("_n")).distinct()
    a = rows.join(p.select("_p").distinct(), F.col(person_id) == F.col("_p"))
    b = rows.join(p, (F.lower(F.col(name)) == F.col("_n")) & ~F.col(person_id).eqNullSafe(F.col("_p"))).drop("_n")
    return a.unionByName(b).withColumnRenamed("_p", "person")


def filtered_timeline(rows: DataFrame, kinds: Sequence[str] = (), entity: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """rows(kind, id, key, ts) of the given kinds (any without one), of one entity, from day to day inclusive; newest first, ties by kind and id."""
    day = F.to_date("ts")
    for test in (F.col("kind").isin(*kinds) if kinds else None, F.col("key") == entity if entity is not None else None, day >= F.to_date(F.lit(since)) if since else None, day <= F.to_date(F.lit(until)) if until else None):
        rows = rows if test is None else rows.where(test)
    return rows.orderBy(F.desc("ts"), "kind", "id")


def audit_reference(event_id: Column) -> Column:
    """An audit event's number as shown: AUD- and six digits at least."""
    text = event_id.cast("string")
    return F.concat(F.lit("AUD-"), F.lpad(text, F.greatest(F.lit(6), F.length(text)), F.lit("0")))


def audit_event(events: DataFrame, reference: str) -> DataFrame:
    """Events(event_id) of this id, or whose number begins with the given one if that starts with AUD-; with the number."""
    own = events.withColumn("reference", audit_reference(F.col("event_id")))
    return own.where(F.col("reference").startswith(reference) if reference.upper().startswith("AUD-") else F.col("event_id").cast("string") == reference)


def case_counts(cases: DataFrame, parts: dict[str, tuple[DataFrame, str] | tuple[DataFrame, str, str]]) -> DataFrame:
    """cases(case_id, other_id) with a count of each part's rows under either id, or only under the one that the part names.

    The ids may overlap: a part that belongs to one of them must name it. All counts come from one union and one aggregate by
    id, case and other ids apart, so that a case's row meets one row of counts for each of its ids; ids that are the same count once.
    """
    sides = ("case_id", "other_id")
    side_of = {n: part[2:] or sides for n, part in parts.items()}
    each = lambda names: F.explode(F.array(*(F.lit(s) for s in names)))
    rows = reduce(DataFrame.union, (part[0].select(F.col(part[1]).cast("string").alias("_key"), F.lit(n).alias("_part")).where("_key is not null").select(each(side_of[n]).alias("_side"), "_key", "_part") for n, part in parts.items()))
    counts = rows.groupBy("_side", "_key").agg(*(F.count_if(F.col("_part") == n).alias(n) for n in parts))
    out = cases
    for s in sides:
        own = counts.where(F.col("_side") == s).select(F.col("_key").alias(f"_{s}"), *(F.col(n).alias(f"_{s}_{n}") for n in parts))
        out = out.join(own, F.col(s).cast("string") == F.col(f"_{s}"), "left")
    same = F.col("case_id").eqNullSafe(F.col("other_id"))

    def count(n: str) -> Column:
        case, other = (F.coalesce(f"_{s}_{n}", F.lit(0)) for s in sides)
        return (case + (F.when(same, 0).otherwise(other) if side_of[n] == sides else other)).cast("long").alias(n)

    return out.select(*cases.columns, *(count(n) for n in parts))


def inserted(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of new, one for each key, that target has not yet: what an append must write."""
    return new.dropDuplicates(list(key)).join(target.select(*key).distinct(), list(key), "left_anti")


def updated(target: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """target with the patch's values that are not null, by key."""
    names = [c for c in patch.columns if c != key]
    own = patch.select(key, *(F.col(c).alias(f"_{c}") for c in names))
    return target.join(own, key, "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in names else c for c in target.columns))


def without(target: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """target less the rows of gone's keys, for a delete and its cascade."""
    return target.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no parent; nulls refer to nothing."""
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def allowed(role: Column, least: str) -> Column:
    """The role's level is at least that of the other."""
    levels = F.create_map(*(F.lit(x) for kv in ROLE_LEVELS.items() for x in kv))
    return F.coalesce(F.try_element_at(levels, F.upper(role)) >= ROLE_LEVELS[least], F.lit(False))


def audit_page(events: DataFrame, users: DataFrame, text: str = "", equal: dict | None = None, since: str | None = None, until: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """events(event_id, user_id, action, ts, detail) with users' names and the total of hits, latest first."""
    rows = events.join(users.select("user_id", F.col("name").alias("user_name")), "user_id", "left").withColumn("user_name", F.coalesce("user_name", F.col("user_id").cast("string"), F.lit("SYSTEM")))
    rows = searched(rows, text, ("event_id", "user_id", "action", "detail", "user_name"), equal)
    if since:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        rows = rows.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, (("ts", True), ("event_id", False)), limit, offset).join(F.broadcast(total))


def linked_case_profile(rows: DataFrame, case: str, **parts: str) -> DataFrame:
    """Per case, sorted sets of other columns."""
    return rows.groupBy(case).agg(*(F.array_sort(F.collect_set(c)).alias(n) for n, c in parts.items()))


def contact_leads(links: DataFrame, k: int = 3) -> DataFrame:
    """(title, detail, priority) for the first k links(edge_id, src, dst, strength) by edge_id; the texts are fixed values."""
    first = links.orderBy("edge_id").limit(k)
    title = F.concat(F.lit("Review connection between "), "src", F.lit(" and "), "dst")
    detail = F.concat(F.lit("Corroborate communication and co-location frequency. Strength: "), F.coalesce(F.col("strength"), F.lit(0)).cast("string"), F.lit("."))
    return first.select(title.alias("title"), detail.alias("detail"), F.when(F.col("strength") > 70, "HIGH").otherwise("MEDIUM").alias("priority"))


def contact_rows(calls: DataFrame, limit: int = 50) -> DataFrame:
    """The latest calls(id, caller_name, caller_number, callee_name, callee_number, seconds, ts, kind, place, flagged) as they are shown, nulls replaced by defaults."""
    party = lambda side: F.concat(F.coalesce(f"{side}_name", F.lit("None")), F.lit(" ("), F.coalesce(f"{side}_number", F.lit("None")), F.lit(")"))
    latest = page(calls, (("ts", True), ("id", False)), limit)
    return latest.select(F.col("id").cast("string").alias("id"), party("caller").alias("caller"), party("callee").alias("receiver"), F.concat(F.coalesce(F.col("seconds"), F.lit(0)).cast("string"), F.lit("s")).alias("duration"), "ts", or_default(F.col("kind"), "Voice Call").alias("type"), or_default(F.col("place"), "Tower Station").alias("location"), F.coalesce("flagged", F.lit(False)).alias("flagged"))
