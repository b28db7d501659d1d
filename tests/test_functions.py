"""Normalizers, similarities and scores: worked examples and independent formulas."""

import difflib
import random

from pyspark.sql import functions as F

from caseloom.functions import normalize as N
from caseloom.functions import scores as S
from caseloom.functions import similarity as M


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_resolver_normalizers(spark):
    x = F.lit
    got = one(spark, N.n_name(x("Dr. Rahul   Kumar")), N.n_phone(x("+91 98765-12345")), N.n_vehicle(x("dl-01-ab-1234")), N.n_location(x("  Sector 18, NOIDA  ")), N.n_name(x(None)), N.n_name(x("NaN")), N.n_name(x("José Nuñez")), N.n_phone(x("0919876512345")))
    assert got == ("rahul kumar", "9876512345", "DL01AB1234", "sector 18 noida", "", "", "jose nunez", "9876512345")


def test_ingest_normalizers(spark):
    x = F.lit
    got = one(spark, N.d_name(x("mr. rahul   kumar ")), N.d_organization(x("abc logistics pvt. ltd.")), N.d_phone(x("+91 98765 12345")), N.d_location(x("  new   delhi/noida ")), N.d_name(x("o'neil")), N.d_vehicle(x("dl-01 ab-1")))
    assert got == ("Rahul Kumar", "Abc Logistics", "9876512345", "New Delhi/Noida", "O'Neil", "DL01AB1")


def test_validation_normalizers(spark):
    x = F.lit
    assert one(spark, N.v_name(x("Mr. R. Kumar s/o B. Lal")), N.v_name(x("selvi Anu")), N.v_name(x("selvi Anu"), ("selvi",)), N.v_phone(x("09876512345")), N.v_phone(x("12345")), N.v_phone(x("9999999999")), N.v_phone(x("9999999999"), strict=True)) == ("r kumar", "selvi anu", "anu", "9876512345", None, "9999999999", None)
    assert one(spark, N.v_city(x(" Madras ")), N.v_city(x("Oslo")), N.v_city(x(None)), N.v_pincode(x("600 001")), N.v_pincode(x("012345")), N.v_gender(x("female")), N.v_gender(x(None)), N.v_address(x("12 Main Road, 4th Cross Street")), N.v_national_id(x("ab-1")), N.v_vehicle(x("x1"))) == ("chennai", "OSLO", None, "600001", None, "FEMALE", "UNKNOWN", "12 main rd 4th cross st", None, None)
    assert one(spark, *N.v_birth(x("12/05/1988"), x(None), 2024), *N.v_birth(x(None), x("30"), 2024), *N.v_birth(x(None), x(None), 2024)) == ("1988-01-01", 1988, "1994-01-01", 1994, None, None)
    assert one(spark, *N.v_birth_full(x("1988-05-12"), x(None), 2024), *N.v_birth_full(x("2090-01-01"), x("30"), 2024), *N.v_birth_full(x("?"), x("200"), 2024)[:2]) == ("1988-05-12", 1988, [], "1994-01-01", 1994, ["Future date of birth detected: 2090-01-01"], None, None)
    assert one(spark, N.v_aliases(x('["Ravi", "Dr. K"]')), N.v_aliases(x("Ravi / Babu; ")), N.v_aliases(x(None))) == (["ravi", "k"], ["ravi", "babu"], [])


def test_phonetic_key_against_the_rule(spark):
    def rule(name):
        codes = dict(zip("ABCDEFGHIJKLMNOPQRSTUVWXYZ", N.SOUNDEX_DIGITS, strict=True))
        letters = [c for c in name.upper() if c in codes]
        if not letters:
            return "0000"
        out, before = letters[0], codes[letters[0]]
        for c in letters[1:]:
            if codes[c] not in ("0", before):
                out += codes[c]
            before = codes[c]
        return (out + "000")[:4]

    rng = random.Random(1)
    words = ["ashcraft", "rameshkumar", "", "123", *("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=rng.randrange(1, 12))) for _ in range(500))]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", N.phonetic_key(F.col("w")).alias("k")).collect()
    assert all(r["k"] == rule(r["w"]) for r in rows)


def test_similarities(spark):
    x = F.lit
    got = one(spark, M.sequence_ratio(x("rahul kumar"), x("rahul kmar")), M.partial(x("rahul"), x("rahul kumar")), M.match_score(x("A b"), x("a B")), M.match_score(x("a"), x("a b")), M.match_score(x("a"), x("c")), M.token_cosine(x("a b"), x("b c")), M.set_jaccard(F.array(x("a"), x("b")), F.array(x("b"))))
    assert got[0] > 0.85 and got[1] > 0.5 and got[2:5] == (100, 80, 0) and abs(got[5] - 0.5) < 1e-12 and got[6] == 0.5


def jaro_winkler(a, b):
    if a == b or not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = list(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] == c), None)
        if j is not None:
            free[j] = None
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if f is None]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def test_character_matchers_against_brute_force(spark):
    """Both matchers on random texts with many equal characters, spaces, signs of two and four bytes, empty and null texts."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(rng.choice(["ab", "abc ", "aé😀b", "abcdefghij "]), k=rng.randrange(0, 25)))
    pairs = [("martha", "marhta"), ("dwayne", "duane"), ("ab", "ax"), ("", "a"), ("a", ""), ("", ""), ("abc", "abc"), ("private thread", "private volatile thread"), *((word(), word()) for _ in range(1500))]
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None), (None, None)], "a string, b string")
    got = rows.select("a", "b", M.sequence_ratio(F.col("a"), F.col("b")).alias("s"), M.jaro_winkler(F.col("a"), F.col("b")).alias("j")).collect()
    for r in got:
        a, b = r["a"] or "", r["b"] or ""
        assert abs(r["j"] - jaro_winkler(a, b)) < 1e-12, (a, b)
        assert abs(r["s"] - (difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0)) < 1e-12, (a, b)
    assert len(got) == len(pairs) + 3 and got[0]["j"] > 0.96 and abs(got[1]["j"] - 0.84) < 0.001


def test_scores(spark):
    x = F.lit
    assert one(spark, S.relationship_strength(x(10), x(100000), x(2)), S.relationship_strength(x(0), x(0), x(0)), S.identity_confidence(x(91)), S.area_label(x("a, b\nc")), S.area_label(x(None)), S.temporal_band(x(2.5)), S.priority_band(x(0.8))) == (52, 10, 95, "b", "Local Sector", "HIGH", "MEDIUM")
    text = one(spark, S.feature_text(x("night_visit_ratio"), x(0.25), x(True)), S.feature_text(x("other"), x(1.0), x(False)), S.feature_source(x("average_call_duration")))
    assert text[0].startswith("An unusually high 25%") and text[0].endswith("investigation.") and text[1] == "Feature other contributed negatively." and text[2] == "calls"
    assert one(spark, S.weighted({"a": (x(1.0), x(True)), "b": (x(0.0), x(False))}, {"a": 0.3, "b": 0.7}), S.weighted({"a": (x(1.0), x(False))}, {"a": 1.0})) == (1.0, 0.0)


def test_winkler_of_pairs_is_jaro_winkler(spark):
    texts = ["", "a", "abc", "martha", "marhta", "dixon", "dicksonx", "rahul kumar 12", "rahul kmar 21", "rahul kumar 12 x", "öäü", "öüä", None]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").select("a", "b", M.winkler_of_pairs(F.col("a"), F.col("b")).alias("w"), M.jaro_winkler(F.col("a"), F.col("b")).alias("j"))
    for r in rows.collect():
        assert r["w"] == r["j"], r
