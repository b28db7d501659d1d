"""License and secret scans, toxicity and decontamination against brute force on small tables."""

import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import licenses, secrets, sql, toxicity
from caseloom.llm.decontaminate import contaminated, item_classes

DOCS = "doc_id long, text string, words int, spans int, found int, label int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in texts], DOCS)


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        at = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_base_and_index(spark):
    grant = licenses.TEMPLATES[7][1]
    texts = ["", None, "CC BY cc-by CC  BY-NC 4.0", f"x y {grant.upper()}.", "É mit license MIT-LICENSE ß", "GNU General Public License " * 400, "a b c", "a b c", "the license " * 3000]
    out = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, [*enumerate(texts), (None, texts[2])])).collect()}
    assert len(out) == len(texts) + 1
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_brute(t)
    assert out[3]["labels"] == "mit" and out[3]["n_base"] == 0 and out[3]["score"] == 1.0 and out[3]["matches"][0]["start"] == 2
    assert out[2]["labels"] == out[None]["labels"] == "cc-by,cc-by-nc" and out[8]["labels"] == "" and out[8]["score"] == 0
    assert licenses.license_scan(frame(spark, [])).count() == 0


def license_labels_brute(text):
    """Labels of base phrases, and of templates whose indexed words meet at one position of the words; no word is left out."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    weight, index, labels = licenses.idf(), licenses.postings(), set(filter(None, license_brute(text)[4].split(",")))
    for t, (label, _, needs) in enumerate(licenses.TEMPLATES):
        own = [(w, i) for w, at in index.items() for n, i in at if n == t]
        total = sum(weight[w] for w, _ in own)
        best = max(sum(weight[w] for w, i in own if 0 <= s + i < len(words) and words[s + i] == w) for s in range(-40, len(words)))
        if round(best / total, 4) >= licenses.LEAST and all(f" {p} " in f" {' '.join(words)} " for p in needs):
            labels.add(label)
    return ",".join(sorted(labels))


def test_license_index_looks_up_every_word(spark):
    weight, notice = licenses.idf(), {n: t for n, (_, t, _) in enumerate(licenses.TEMPLATES)}
    common = " x ".join(sorted((w for w in licenses.postings() if weight[w] == max(weight.values())), reverse=True))
    texts = [f"{' x '.join(notice[n] for n in (5, 7, 8))}.", f"{notice[12]} {common}", *(f"{common} y {t} y {common}" for t in notice.values()), " z ".join(notice.values())]
    out = {r["doc_id"]: r["labels"] for r in licenses.license_scan(frame(spark, enumerate(texts))).collect()}
    assert out == {i: license_labels_brute(t) for i, t in enumerate(texts)}
    assert out[0] == "apache,bsd,mit" and set(out[len(texts) - 1].split(",")) == {label for label, _, _ in licenses.TEMPLATES}


def secret_brute(text):
    out = []
    for order, rule in enumerate(secrets.BASE):
        pattern = r"[0-9a-f]+" if rule.kind == "hex" else rule.regex
        for m in re.finditer(pattern, text or "", re.ASCII):
            if len(m[0]) >= rule.least and (not rule.group or len(m[rule.group]) >= rule.group_least):
                out.append((m.start(), order, rule.kind, m.end()))
    return sorted(out)


def test_secrets_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["token=", "Secret : '", "api-key", "API_KEY=", "password", ": ", "AKIA", "ABCDEF0123456789", "deadbeef" * 3, "abc", "\n", " ", "😀", "é", "passwd:\"hunter2x\"", "secret: token: abcdefgh"]
    texts = ["", None, *("".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(200)), "token=abcdef " * 2000]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"] if s["order"] < 3] for r in secrets.found_secrets(frame(spark, enumerate(texts))).select("doc_id", "spans").collect()}
    for i, t in enumerate(texts):
        assert got[i] == secret_brute(t), t
    assert secrets.found_secrets(frame(spark, [])).count() == 0


def test_secret_postings_and_many_matches(spark):
    docs = frame(spark, [(1, "my TOKEN=abcdef"), (2, "tok ken"), (3, "password: hunter22"), (3, "password: hunter22"), (None, "xoxb-1234567890"), (5, None)]).na.fill({"text": ""})
    queries = [secrets.trigram_query(r.regex) for r in secrets.BASE + secrets.MORE]
    grams = sorted({g for q in queries for g in secrets.trigrams(q)})
    postings = secrets.index(docs, grams, shard=2)
    assert postings.select("shard").distinct().count() > 1
    key = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id").distinct()
    got = {r["doc_id"]: r["rules"] for r in secrets.candidates(postings, queries, grams).join(key, "key").collect()}
    assert got == {1: [0], 3: [0], None: [5]}
    # Rules with more trigrams than fit in a word of bits; time grows with the matches and not with their square.
    many = tuple(secrets.Rule(f"k{i}", f"prefix{i:02d}[a-z]{{4,}}") for i in range(80))
    assert [s["kind"] for s in secrets.found_secrets(frame(spark, [(1, "x prefix07abcd prefix79abcd")]), many).first()["spans"]] == ["k7", "k79"]
    took = []
    for n in (20_000, 20_000, 80_000):
        began = time.time()
        row = secrets.redacted(frame(spark, [(1, "token=abcdef 😀 " * n), (1, "token=abcdef 😀 " * n)])).first()
        took.append(time.time() - began)
        assert row["text"] == "[SECRET] 😀 " * n
    assert took[2] < 8 * took[1], took


def test_token_rule_finds_what_its_plain_form_finds(spark):
    """The rule that goes from run to run against the plain regex, and its time on one run of 1 MB without dots and on very many dots."""
    rng, order = random.Random(11), [r.kind for r in secrets.BASE + secrets.MORE].index("jwt")
    parts = ["eyJ", "eyJhbGciOi", ".", ".", "eyJzdWIiOiI", "abc", "_", "-", " ", "😀", "\n", "eyJ01234567", "x."]
    texts = ["", None, "eyJ01234567.eyJ01234567.a.eyJ01234567.eyJ01234567.b", *("".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(1500))]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["order"] == order] for r in secrets.found_secrets(frame(spark, enumerate(texts))).select("doc_id", "spans").collect()}
    want = {i: [m.span() for m in re.finditer(sql.PLAIN["jwt"], t or "")] for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 100
    assert set(secrets.trigram_query(secrets.MORE[order - 3].regex)) == {"and", "eyj", ".ey"}
    long = ["eyJ" * 350_000, "eyJ01234567." * 90_000 + "é", "eyJ01234567.x " * 80_000, "x" * 1_000_000 + "eyJ01234567.eyJ01234567.end"]
    began = time.time()
    spans = [[(s["start"], s["end"]) for s in r["spans"] if s["order"] == order] for r in secrets.found_secrets(frame(spark, enumerate(long))).orderBy("doc_id").collect()]
    assert time.time() - began < 60
    assert spans == [[], [(36 * i, 36 * i + 35) for i in range(30_000)], [], [(1_000_000, 1_000_027)]]


def test_trigram_queries_hold_on_their_own_matches():
    assert secrets.trigram_query("[0-9a-f]{24,}") is True
    assert secrets.trigram_query("AKIA[A-Z]+") == ("and", "aki", "kia")
    assert secrets.trigram_query("(abc|xyz)d?") == ("or", "abc", "xyz") or "abc" in str(secrets.trigram_query("(abc|xyz)d?"))

    def meets(q, text):
        if q is True:
            return True
        if isinstance(q, str):
            return q in text
        return (all if q[0] == "and" else any)(meets(p, text) for p in q[1:])

    for text in ("api_key=abcdefgh", "APIKEY: 'x'", "passwd=1", "my secret : abc", "-----begin rsa private key-----", "xoxb-1234567890", "https://a:b@c"):
        for rule in secrets.BASE + secrets.MORE:
            if re.search(rule.regex, text) or re.search(rule.regex, text.upper()):
                assert meets(secrets.trigram_query(rule.regex), text.lower()), (rule.kind, text)


def test_redaction_keeps_everything_else(spark):
    rows = secrets.redacted(frame(spark, [(1, "a token=abcdefgh b " + "f" * 30), (2, None), (3, "clean")])).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["a [SECRET] b [SECRET]", None, "clean"] and rows[0]["label"] == 4


def test_folding():
    assert toxicity.folded("1d10t ІDIOT p@thetic! a1 2020 mor0n") == "idiot idiot pathetic! ai 2020 moron"
    long = toxicity.Lexicon({"idiot": 3.0, "clown": 2.0}, {"lowei": 4.0})
    assert long.features("You 1D10T") > long.features("You are kind") == (0.0, 0.0)
    assert long.features("a class clown fish") == long.features("clown fish")
    assert long.features("loweiheit") > (0, 0) and long.features(None) == long.features("") == (0.0, 0.0)
    assert long.features("idiot " + "word " * 500)[1] < long.features("idiot word")[1]


def features_brute(lexicon, text):
    """Every place of the folded words against every entry; words of an exception phrase count for nothing."""
    words = re.findall(r"[^\W\d_]+", toxicity.folded(text or ""))
    spared = set()
    for phrase in lexicon.exceptions:
        own = toxicity.folded(phrase).split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                spared |= set(range(i, i + len(own)))
    total = 0.0
    for i, w in enumerate(words):
        found = [x for e, x in lexicon.words.items() if e == w] + [x for e, x in lexicon.stems.items() if w.startswith(e)]
        total += max(found, default=0.0) if i not in spared else 0.0
    return float(np.log1p(total)), float(np.log1p(100 * total / max(25, len(words))))


def test_toxicity_fold_by_characters():
    """Each run against the rule said character by character."""
    rng = random.Random(11)
    digit = lambda c: c.isdecimal() or c in "@$"

    def slow(run: str) -> str:
        n = len(run)
        letter = [c.isalnum() and not c.isdecimal() for c in run]
        at = n
        if any(letter[i] and (digit(run[i + 1]) or run[i + 1] == "!") for i in range(n - 1)):
            at = 0
        else:
            at = min((i for i in range(n) if digit(run[i]) and any(letter[i + 1 :])), default=n)
        end = n
        while end > at and run[end - 1] == "!":
            end -= 1
        return run[:at] + "".join(toxicity.DIGITS.get(c, c) for c in run[at:end]) + run[end:]

    for _ in range(5000):
        runs = ["".join(rng.choices("ab_10@$!7", k=rng.randint(1, 7))) for _ in range(3)]
        assert toxicity.folded(" ".join(runs)) == " ".join(slow(r) for r in runs), runs
    assert toxicity.folded("a.b1t,\tx1\n1_a") == "a.bit,\txi\ni_a"


def test_toxicity_of_very_long_texts(spark):
    """A run of a megabyte with one sign, and exceptions by the hundred thousand, take time by their length."""
    lexicon = toxicity.Lexicon({"idiot": 3.0, "trash": 1.5}, {"clow": 2.0})
    half = "x" * 500_000
    texts = ["!" + half + half, half + "1" + half, "1" * 1_000_000, "!" * 1_000_000, "_1" * 500_000, "trash can " * 100_000, "trash can idiot " * 60_000]
    start = time.monotonic()
    got = [lexicon.features(t) for t in texts]
    assert time.monotonic() - start < 30
    assert [f[0] for f in got[:6]] == [0.0] * 6 and abs(got[6][0] - math.log1p(180_000)) < 1e-9
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "idiot")]
    out = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), lexicon).collect()
    assert len(out) == 9 and len({r["score"] for r in out if r["doc_id"] == 0}) == 1


def test_toxicity_exceptions_that_overlap():
    rng = random.Random(5)
    for _ in range(500):
        spans = [(a := rng.randint(0, 30), a + rng.randint(0, 9)) for _ in range(rng.randint(0, 6))]
        places = [rng.randint(0, 40) for _ in range(8)]
        assert toxicity._outside(places, spans) == [not any(a <= p < b for a, b in spans) for p in places]


def test_toxicity_scores_against_brute_force(spark):
    rng = random.Random(7)
    lexicon = toxicity.Lexicon({"idiot": 3.0, "clown": 2.0, "trash": 1.5, "loser": 1.0}, {"lowei": 4.0, "idio": 0.5, "clow": 2.5}, curve=(-2.0, 1.5, 0.5))
    parts = ["idiot", "1d10t", "idiotic", "clown", "clown fish", "class clown fish", "trash can", "trash", "sore loser clause", "l0ser!", "loweiheit", "LOWEI", "word", "fish", "can", "Kind", "4 5", "\n", "é", "ІDIOT"]
    texts = ["", None, *(" ".join(rng.choices(parts, k=rng.randrange(1, 60))) for _ in range(300)), "idiot " * 30000]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[2], 1), (5, texts[5], 1)]
    got = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string, score int"), lexicon).collect()
    assert len(got) == len(rows)
    want = {i: float(lexicon.score(np.array([features_brute(lexicon, t)]))[0]) for i, t, _ in rows}
    assert all(abs(r["score"] - want[r["doc_id"]]) < 1e-12 for r in got)


def test_toxicity_on_held_out_labels(spark):
    """Learned and judged on the given labels; no row that is judged was learned from, and a second fit is equal."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    lexicon, again = (toxicity.fitted(docs, labels.where(~toxicity.held_out())) for _ in range(2))
    assert (lexicon.words, lexicon.stems, lexicon.curve) == (again.words, again.stems, again.curve)
    rows = toxicity.scored(docs, lexicon).join(labels, "doc_id").where(toxicity.held_out()).select(F.col("toxic").alias("y"), (F.col("score") >= 0.3).alias("p")).collect()
    caught = sum(r["p"] for r in rows if r["y"] == 1) / sum(r["y"] == 1 for r in rows)
    false = sum(r["p"] for r in rows if r["y"] == 0) / sum(r["y"] == 0 for r in rows)
    assert caught >= 0.9 and false <= 0.01, (caught, false)


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = random.Random(1)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for i in range(600):
        text = rng.choices(words, k=40)
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(40)] = rng.choice(["blockhead", "nastyling", "nastywort"])
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = toxicity.fitted(docs, labels.where(~toxicity.held_out()))
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, lexicon).collect()}
    assert len(out) == 603 and all(0 <= s <= 1 for s in out.values())
    assert all((out[i] >= 0.3) == bool(y) for i, _, y in rows)
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 20, 45, 90])))) for i in range(40)] + [(100, None), (101, ""), (102, "V1, v2; V3 v4 v5 v6"), (103, "v1 v2 v3 V4 V5 v6!"), (104, "v1 v2 v3 v4 v5 v6"), (105, "V7 v8"), (106, "v7, v8")]
    docs = []
    for i in range(150):
        text = rng.choices(vocabulary, k=rng.randrange(0, 900))
        if i % 3 == 0:
            own = (items[i % 40][1]).split()
            if i % 2:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        docs.append((i, " ".join(text).upper()))
    docs += [(500, None), (501, ""), (None, items[3][1]), (502, "v1 v2 v3, v4 (v5) v6")]

    def words(text):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())

    def shingles(text):
        w = words(text)
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)}

    sets = {i: shingles(t) for i, t in items}
    few = {i: w for i, t in items if 0 < len(w := words(t)) < 5}
    held = lambda w, t: any(words(t)[j : j + len(w)] == w for j in range(len(words(t))))
    smallest = {i: min(j for j, s in sets.items() if (s, few.get(j)) == (own, few.get(i))) for i, own in sets.items()}
    want = {(d, smallest[i]) for d, t in docs for i, s in sets.items() if (s and len(s & shingles(t)) >= 0.8 * len(s) - 1e-9) or (i in few and held(few[i], t))}
    assert few and {r["item_id"]: r["class_id"] for r in item_classes(spark.createDataFrame(items, "item_id long, text string")).collect()} == {i: c for i, c in smallest.items() if sets[i] or i in few}
    for block in (20_000, 7, 2, 1):
        got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contaminated(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame([], "item_id long, text string")).count() == 0
