"""Spelling variants, line dedup and vector codes against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseloom.llm import codes, lines, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts_brute(rows, shortest=6, fewest=5, damage=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= fewest}


def groups_brute(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def mutated(rng, word, letters):
    at = rng.randrange(len(word) + 1)
    return rng.choice([word[:at] + rng.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzß"])
def test_near_words_lose_no_pair(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(60)}
    for _ in range(300):
        words.add(mutated(rng, rng.choice(sorted(words)), letters))
    n = {w: 5 ** rng.randrange(1, 6) + rng.randrange(3) for w in sorted(words) if len(w) >= 6}
    assert found(spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long"))) == groups_brute(n)


def test_word_counts_and_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = ["Straße", "naïveté", "banana", "bananas", "document", "documents", "dócument", "x" * 50, "ÀÉÎÕÜÿ", "aaaaaa", "aaaaaaa", "kitten"]
    rows = [(i * 7 - 20, " ".join(rng.choice(vocabulary + [v.upper() for v in vocabulary]) for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    rows += [(None, "document " * 9), (5, None), (6, ""), (7, "documents,documents;documentsé"), rows[3], rows[3], (8, "q" * 300_000 + " document"), *[(100 + i, "q" * 3000) for i in range(6)]]
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n int, word string")
    n = counts_brute(rows, damage=3)
    got = spelling.word_counts(docs, damage=3)
    assert {r["word"]: r["n"] for r in got.collect()} == n
    assert found(spelling.spelling_groups(got)) == groups_brute(n)
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs).collect()} == counts_brute(rows, damage=10**12)
    assert spelling.spelling_groups(spelling.word_counts(docs.limit(0))).count() == 0


def test_rarest_is_linear_and_roots_follow_chains(spark):
    n = {"abcdef": 5, "abcdeg": 25, "abcdxg": 125, "abyyxg": 10, "abcyxg": 700, "zzzzzz": 9}
    got = found(spelling.spelling_groups(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == groups_brute(n) and got["abcdef"][:2] == ("abcdeg", "abcyxg") and got["zzzzzz"][:2] == (None, "zzzzzz")
    assert spelling.rarest("ab" * 500_000, np.zeros(spelling.SLOTS, int)) == [("ab", 0), ("ab", 2), ("ab", 4)]


SPACES = " \t\n\x0b\x0c\r"


def lines_brute(rows, least=20, documents=3):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= least:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if i is None or len(held[key(x)]) < documents or max(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(8)
    common = [f"{'é' * k}Common Line number {k} of many" for k in range(4)] + ["é" * 19, "é" * 20, "short line", "", "\x0bLeading tab and trailing space \r", " not stripped, not ascii space "]
    rows = []
    for i in range(80):
        text = [rng.choice([rng.choice(common), rng.choice(common).upper(), f"  {rng.choice(common)}\t", f"own line {i} {rng.random()}"]) for _ in range(rng.randrange(0, 12))]
        rows.append((i * 5 - 60, "\n".join(text)))
    rows += [(None, "\n".join(common)), (None, "\n".join(common)), rows[10], rows[10], (rows[11][0], common[0]), (999, None), (1000, ""), (1001, "\n\n"), (500, "the same line is in one document\n" * 4), (501, "twice in two documents, no more"), (502, "twice in two documents, no more"), (503, (common[0] + "\n") * 50_000), (504, "z" * 1_000_000)]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, a int, gone int, last int")
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.line_dedup(docs).collect()), key=repr)
    assert got == lines_brute(rows)
    assert any(r[3] for r in got) and lines.line_dedup(docs.limit(0)).count() == 0


def codes_brute(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: r[0])
    ints = [[int(np.floor(4096 * float(x))) for x in r[1]] for r in kept]
    m = len(ints[0]) // parts
    books = [[v[p * m : (p + 1) * m] for v in ints[:entries]] for p in range(parts)]

    def nearest(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * m : (p + 1) * m], e, strict=True)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            of = [nearest(v, p)[0] for v in ints]
            own = [[v[p * m : (p + 1) * m] for v, k in zip(ints, of, strict=True) if k == e] for e in range(len(books[p]))]
            new.append([[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, total = [], Counter()
    for r, v in zip(kept, ints, strict=True):
        got = [nearest(v, p) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for k, _ in got), sum(d for _, d in got), r[2]))
        total[r[2]] += out[-1][2]
    return sorted((i, c, e, total[label], digest) for i, c, e, label in out)


VECTORS = "vec_id long, embedding array<float>, label int, code string, ints int"


@pytest.mark.parametrize(("dim", "count"), [(64, 150), (8, 60), (24, 9)])
def test_vector_codes_against_brute_force(spark, dim, count):
    rng = np.random.default_rng(dim)
    centres = rng.normal(size=(6, dim)) * 0.2
    rows = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.001, 0.1])], int(label) if (label := rng.integers(4)) else None) for i in rng.permutation(count)]
    rows += [(count + 1, rows[0][1], 1), (count + 2, [0.0] * dim, None), (count + 3, [-0.0001] * dim, 2)]
    odd = [(-5, None, 1), (-4, [float("nan")] * dim, 1), (-3, [float("inf")] + [0.0] * (dim - 1), 1), (-2, [None] + [0.0] * (dim - 1), 1)]
    got = codes.vector_codes(spark.createDataFrame([(*r, "x", 1) for r in rows + odd], VECTORS).repartition(5))
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()) == codes_brute(rows)


def test_bounds_keep_every_nearest_entry():
    rng = np.random.default_rng(2)
    for size in (1, 100, 1 << 23):
        entries, rows = (rng.integers(-size, size + 1, (n, 8)) for n in (16, 4000))
        rows[:16], rows[16:32] = entries, entries + 1
        book = codes.Codebook(entries)
        every = ((rows[:, None] - entries[None]) ** 2).sum(2)
        index, apart = book.nearest(rows)
        assert (index == every.argmin(1)).all() and (apart == every.min(1)).all()
        assert len(book.survivors(rows)[0]) < rows.shape[0] * (16 if size > 1 else 17)


def test_vector_codes_of_odd_tables(spark):
    def of(rows):
        return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.vector_codes(spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS)).collect()), key=repr)

    flat = [0.5] * 16
    assert of([]) == [] and of([(1, None, 1)]) == []
    assert of([(1, flat, 1), (1, flat, 1), (2, [0.25] * 16, None), (None, flat, None)]) == sorted([(1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0), (None, "00" * 8, 0, 0)], key=repr)
    assert of([(1, flat, 1), (2, [0.5] * 8, 2), (3, [1e30] * 16, 1), (4, [], 2)]) == [(1, "00" * 8, 0, 0), (2, None, None, None), (3, None, None, 0), (4, None, None, None)]
    assert of([(1, [0.5] * 9, 1)]) == [(1, None, None, None)] and of([(None, flat, 1)]) == [(None, None, None, None)]
