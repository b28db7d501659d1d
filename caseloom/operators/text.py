"""Entities in text by gazetteer and pattern, and texts made from records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.graph import cut

#: Gazetteers, patterns and confidences of the extractor.
PEOPLE = ("Rahul Kumar", "Amit Sharma", "Suresh Verma", "Priya Singh", "Arjun Mehta", "Vikram Patel", "Ravi Kumar")
PLACES = ("Sector 18", "Central Market", "Industrial Area", "Vasant Vihar", "Noida", "South Delhi")
FIRMS = ("ABC Logistics", "Sharma Pharma", "Mehta Imports", "Silverline Traders")
PATTERNS = (("PHONE", r"(?:\+91[\-\s]?)?[6-9]\d{9}", 0.98), ("VEHICLE", r"(?i)[A-Z]{2}[-\s]?\d{2}[-\s]?[A-Z]{1,2}[-\s]?\d{4}", 0.96), ("AMOUNT", r"(?i)(?:INR|Rs\.?|₹)\s?[\d,]+(?:\.\d{2})?", 0.92))
GAZETTEERS = (("PERSON", PEOPLE, 0.95), ("ORGANIZATION", FIRMS, 0.90), ("LOCATION", PLACES, 0.88))

_ENTITY = "array<struct<label:string,text:string,start:int,end:int,confidence:double>>"


def _entity(label: str, text: Column, start: Column, confidence: float) -> Column:
    return F.struct(F.lit(label).alias("label"), text.alias("text"), start.alias("start"), (start + F.length(text)).alias("end"), F.lit(confidence).alias("confidence"))


def _all_matches(text: Column, label: str, pattern: str, confidence: float) -> Column:
    """Every match with its place: lengths of the pieces between matches and of the matches, summed up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_ENTITY).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["gap"]
        return F.struct((at + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(_entity(label, F.upper(x["hit"]) if label == "VEHICLE" else x["hit"], at, confidence))).alias("out"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast(_ENTITY))


def extracted(rows: DataFrame, text: str, key: str, gazetteers=GAZETTEERS, patterns=PATTERNS) -> DataFrame:
    """(key, label, text, start, end, confidence): gazetteer names at their first place, case aside, and every match of the patterns."""
    names = [(label, n, conf) for label, own, conf in gazetteers for n in own]
    # A text is put into lower case once, and looked through once for each name and pattern.
    seen = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("body")).withColumn("lower", F.lower("body"))
    seen = seen.select(key, "body", F.array(*(F.instr("lower", n.lower()) for _, n, _ in names)).alias("at"))
    hit = lambda i, label, n, conf: F.when(F.col("at")[i] > 0, _entity(label, F.lit(n), F.col("at")[i] - 1, conf))
    hits = F.array_compact(F.array(*(hit(i, *n) for i, n in enumerate(names)))).cast(_ENTITY)
    lists = [_all_matches(F.col("body"), *p) for p in patterns]
    return seen.select(key, F.explode(F.concat(hits, *lists)).alias("e")).select(key, "e.*")


#: Runs of words that a batch holds, about.
RUNS = 16_384
#: Words of names and texts.
_WORD = re.compile(r"[^\W_]+")


def dictionary_entities(rows: DataFrame, text: str, key: str, names: DataFrame) -> DataFrame:
    """(key, label, text, start, end, confidence): the first place of each name of names(label, name, confidence) in each text, as whole words in a row, case and what parts them aside.

    Every run of as many words as some name has is a key of one join, so neither the plan nor the work on a text grows with the number of
    names, only with how many different lengths they have. A text gives each run once, at its first place. A name
    that is there twice, under one label, counts with its highest confidence; null texts and names without words find nothing.
    """
    words_of = F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    known = names.select("label", "confidence", words_of.alias("words")).where(F.size("words") > 0)
    known = cut(known.groupBy("label", "words").agg(F.max("confidence").alias("confidence")))
    lengths = sorted(r["n"] for r in known.select(F.size("words").alias("n")).distinct().collect())
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, phrases, texts, starts, ends = [], [], [], [], []
            for i, body in enumerate(batch.column("body").to_pylist()):
                at = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(body or "")]
                first: dict[str, tuple[int, int]] = {}
                for n in lengths:
                    for j in range(len(at) - n + 1):
                        first.setdefault(" ".join([w for _, _, w in at[j : j + n]]), (at[j][0], at[j + n - 1][1]))
                which.extend([i] * len(first))
                phrases.extend(first)
                for a, b in first.values():
                    texts.append(body[a:b])
                    starts.append(a)
                    ends.append(b)
                # A batch goes out as soon as it is full, as a text may have very many runs.
                if len(which) >= RUNS or i == len(batch) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(which, pa.int64())), pa.array(phrases, pa.string()), pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "phrase", "text", "start", "end"])
                    which, phrases, texts, starts, ends = [], [], [], [], []

    runs = rows.select(key, F.col(text).cast("string").alias("body")).mapInArrow(run, f"{key} {kinds[key]}, phrase string, text string, start int, end int")
    return runs.join(known.select("label", F.array_join("words", " ").alias("phrase"), "confidence"), "phrase").select(key, "label", "text", "start", "end", "confidence")


def rule_hits(rows: DataFrame, text: str, key: str, phones: tuple[str, ...] = (), names: tuple[tuple[str, tuple[str, ...], int], ...] = (("PERSON", PEOPLE, 90), ("LOCATION", PLACES, 88), ("ORGANIZATION", FIRMS, 85))) -> DataFrame:
    """(key, type, value, confidence) of listed names in the text, case aside, and of phones in its digits alone."""
    items = [F.when(F.lower(F.col(text)).contains(v.lower()), F.struct(F.lit(kind).alias("type"), F.lit(v).alias("value"), F.lit(conf).alias("confidence"))) for kind, own, conf in names for v in own]
    digits = F.regexp_replace(F.col(text), r"\D", "")
    items += [F.when(digits.contains(p), F.struct(F.lit("PHONE").alias("type"), F.lit(p).alias("value"), F.lit(95).alias("confidence"))) for p in phones]
    return rows.select(key, F.explode(F.array_compact(F.array(*items))).alias("e")).select(key, "e.*")


def deduplicated(entities: DataFrame, *key: str) -> DataFrame:
    """One row for each label and text (of a key): the highest confidence."""
    return entities.groupBy(*key, "label", "text").agg(F.max("confidence").alias("confidence"))


def case_context(cases: DataFrame, profile: DataFrame, case: str) -> DataFrame:
    """(case, context): a sentence on each case with its people and places; also the static summary of a case."""
    text = F.format_string("Case %s is %s in category %s. People: %s.", F.col(case).cast("string"), F.col("status"), F.col("category"), F.coalesce(F.array_join("people", ", "), F.lit("")))
    return cases.join(profile, case, "left").select(case, text.alias("context"))


def ner_corpus(spark, n: int) -> DataFrame:
    """(id, text, label spans) of made sentences, for tests and training; each depends on its number alone."""
    i = F.col("id")
    pick = lambda own, k: F.element_at(F.array(*(F.lit(x) for x in own)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(own))) + 1).cast("int"))
    person, place, firm = pick(PEOPLE, 1), pick(PLACES, 2), pick(FIRMS, 3)
    text = F.concat(person, F.lit(" met staff of "), firm, F.lit(" near "), place, F.lit("."))
    return spark.range(n).select("id", text.alias("text"), F.array(_entity("PERSON", person, F.lit(0), 1.0), _entity("ORGANIZATION", firm, F.length(person) + 14, 1.0), _entity("LOCATION", place, F.length(person) + F.length(firm) + 20, 1.0)).alias("spans"))
