"""Substring dedup, archives, vectors, packing, URL filters and the pipeline against brute force on small tables."""

import bisect
import gzip
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from caseloom.llm import packing, urls, warc
from caseloom.llm.embeddings import near_vectors
from caseloom.llm.minhash import near_duplicates
from caseloom.llm.substrings import substring_dedup
from caseloom.llm.tokens import Encoder, default_paths


def substring_brute(rows, n=13):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][j : j + n]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_substrings_against_brute_force(spark):
    rng = random.Random(4)
    passages = [[f"p{k}w{i}" for i in range(rng.choice([12, 13, 14, 40]))] for k in range(6)]
    rows = []
    for i in range(120):
        text = [f"r{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = rng.choice(passages)
        rows.append((i * 3 - 50, " \t".join(text)))
    rows += [(900, "a " * 3000), (901, "a " * 40), (902, None), (903, ""), (904, rows[5][1]), (905, "A " * 20)]
    out = substring_dedup(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, at int"))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()} == substring_brute(rows)
    odd = substring_dedup(spark.createDataFrame([(None, rows[5][1]), (1, rows[5][1]), (1, rows[5][1])], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in odd] == [0, 0, 0]
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://x/", "é" * 90000), (2, None, None), (3, "u\r\nX: y", "WARC/1.1\r\n\r\n" * 30), (4, "u", "WARC/1.1\r\n\r\n" * 30), (5, "u", ""), (9, "v", "é" * 90000), (None, "w", "null id " * 30), (6, "u", "short"), (7, "u", "short")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = {r["page_id"]: r for r in warc.round_trip(pages, keep_payload=True).collect()}
    assert len(got) == len(rows) and not any(r["error"] for r in got.values())
    for i, _, html in rows:
        body = (html or "").encode()
        assert (bytes(got[i]["payload"]), got[i]["payload_bytes"], got[i]["payload_digest"]) == (body, len(body), hashlib.sha256(body).hexdigest())
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {4: ("revisit", 3), 9: ("revisit", 1)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_hot_payload(spark):
    """One payload on most pages: joins have written sides that can be split, and every page refers to the smallest id."""
    hot = "error page " * 20
    rows = [(i, f"http://h/{i}", hot if i % 4 else f"page {i} " * 20) for i in range(2000)] + [(1, "http://h/1", hot), (2001, "http://h/l", "z" * (1 << 20))]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and not any(r["error"] for r in got)
    assert sorted(r["page_id"] for r in got if r["record_type"] == "revisit") == [i for i in range(2000) if i % 4 and i != 1]
    assert {(r["refers_to"], r["payload_bytes"]) for r in got if r["record_type"] == "revisit"} == {(1, len(hot))}


def test_broken_segments_and_framing(spark, tmp_path):
    own = list(warc.records(1, "u", b"x" * 1000, "d", None, segment=300))
    assert len(own) > 3
    (tmp_path / "a.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in [own[2], own[0], own[1], *own[3:]]))
    (tmp_path / "b.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in list(warc.records(2, "u", b"y" * 1000, "d", None, segment=300))[:-1]))
    got = {r["page_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert bytes(got[1]["payload"]) == b"x" * 1000 and got[2]["payload"] is None and got[2]["error"]
    assert warc.dechunked(b"3;a=b\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nabc\r\n0\r\n\r\n")
    # Pieces of any size give the same records, also of many gzip members.
    raw = b"".join(r + b"\r\n\r\n" for r in own)
    packed = b"".join(gzip.compress(r + b"\r\n\r\n") for r in own)
    want = [b for _, b in warc.parsed(iter([raw]))]
    assert len(want) == len(own)
    for step in (1, 3, 7, 1000):
        assert [b for _, b in warc.parsed(warc.inflated(raw, step))] == [b for _, b in warc.parsed(warc.inflated(packed, step))] == want
    for broken in (raw[:-200], b"x" + raw, packed[:-20]):
        with pytest.raises(ValueError):
            list(warc.parsed(warc.inflated(broken)))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 16))
    own = np.concatenate([base[k] + rng.standard_normal((12, 16)) * s for k, s in zip(range(30), np.linspace(0.01, 0.4, 30), strict=True)])
    rows = [(i, [float(x) for x in np.float32(v)], i % 2) for i, v in enumerate(own)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(50)] + [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, rows[0][1], None), (2004, [1.0, None], 0), (2005, [], 0), (2006, [x * 1e-30 for x in rows[0][1]], 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, rep int")
    got = {r["vec_id"]: r for r in near_vectors(frame).collect()}
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None for x in r[1]) and np.isfinite(r[1]).all() and any(r[1])]
    m = np.stack([np.float64(np.float32(r[1])) for r in good])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    near = (m @ m.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    links = near.sum(1)
    assert len(got) == len(rows)
    found = sum(got[r[0]]["n_links"] for r in good)
    assert found <= links.sum() and found >= 0.99 * links.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (2000, 2001, 2002, 2003, 2004, 2005))
    assert got[1049]["component_id"] == 0 and not got[1049]["kept"]
    # Crowded buckets, divided into blocks, count the same links; so do repeated rows.
    crowded = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(frame.union(frame), few=2, block=4).collect()}
    assert crowded == {i: (r["n_links"], r["component_id"]) for i, r in got.items()}
    assert near_vectors(frame.limit(0)).count() == 0


def test_ids_match_the_tokenizer():
    encoder = Encoder(*default_paths())
    texts = ["", None, "  ", " a", "a  b", "a\n\nb", "a \n b\n", "it's  we'll\t\tx ", "<|endoftext|> a", "é à!!  12 34ab,,", "x y z", "\t y\t", "a\r\nb \r\n  c", "word " * 500]
    ids, before = encoder.ids(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[before[i] : before[i + 1]].tolist() == encoder.slow.encode(t or "", add_special_tokens=False).ids


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_of_equal_letters_stay_apart(spark):
    """Words that linear hashes confuse are linked, removed and encoded as what they are."""
    pairs = [thue_morse(n) for n in (8, 64, 512, 8192)]
    encoder = Encoder(*default_paths())
    texts = [t for p in pairs for t in p]
    ids, before = encoder.ids(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[before[i] : before[i + 1]].tolist() == encoder.slow.encode(t, add_special_tokens=False).ids
    rows = [(2 * k + side, f"{p[side]} " * 20) for k, p in enumerate(pairs) for side in (0, 1)]
    rows += [(100 + 2 * k + side, p[side]) for k, p in enumerate(pairs) for side in (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(frame).collect()} == substring_brute(rows)
    assert all(r["kept"] for r in near_duplicates(frame).collect())


def test_packing_is_gapless_and_whole(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(0, 400))) for _ in range(150)] + ["long " * 5000, None, "", "same", "same"]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "x", 1)], "doc_id long, text string, share int")
    out = packing.packed(frame, size=256).collect()
    encoder = Encoder(*default_paths())
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    for i, t in enumerate(texts):
        ids = np.array(encoder.slow.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])[:: 2 if i == 3 else 1]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] == 256 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    total = sum(r["length"] for r in out)
    assert len(by_seq) <= -(-total // 256) * 1.05 + 1
    assert packing.packed(frame.limit(0)).count() == 0


def best_fit_decreasing(lengths, size):
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, x)
        n += i == len(rooms)
        bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else size) - x)
    return n


def test_plan_needs_no_more_sequences_than_best_fit_decreasing():
    rng = np.random.default_rng(9)
    cases = [np.array([500] + [50] * 10), *(rng.integers(1, k + 1, 3000) for k in (30, 100, 200, 300, 1024)), np.clip(np.exp(rng.normal(5.5, 1, 8000)).astype(int), 1, 1024), *(rng.integers(1, 1025, n) for n in (1, 7, 40))]
    needed = []
    for lengths in cases:
        own = packing.plan(np.bincount(lengths, minlength=1025))
        used = np.zeros(1025, int)
        for form, n in own:
            assert sum(form) <= 1024
            np.add.at(used, list(form), n)
        assert (used == np.bincount(lengths, minlength=1025)).all()
        needed.append(sum(n for _, n in own))
        assert needed[-1] <= best_fit_decreasing(lengths.tolist(), 1024)
        alone = sum(n for _, n in packing.best_fit(np.bincount(lengths, minlength=1025)))
        assert alone == best_fit_decreasing(lengths.tolist(), 1024)
    assert needed[0] == 1


def test_plan_uses_up_every_histogram():
    rng = np.random.default_rng(1)
    for counts in (rng.integers(0, 50, 65), np.bincount(rng.integers(1, 64, 5), minlength=65), np.zeros(65, int), np.bincount([1] * 200, minlength=65)):
        counts[0] = 0
        used = np.zeros(65, int)
        for form, n in packing.plan(counts):
            assert sum(form) <= 64
            for length in form:
                used[length] += n
        assert (used == counts).all()


def test_url_rules_and_aliases(spark):
    pages = [
        (1, "http://a.example.com/en/71?x", None), (2, "HTTP://A.Example.COM/en/1", ""), (3, "https://x.net/de/8", None), (4, "https://example.net/de/80", None), (5, None, None), (6, "no scheme", "x"), (7, "ftp://org/es/", None), (8, "http://notorg/es/", None),
        (9, "http://alias.info/a", '<link rel="canonical" href="http://evil.com/en/x">'), (10, "http://other.info/b", '<meta http-equiv=refresh content="0; url=http://alias.info/a">'), (11, "HTTP://OTHER.info:80/b#f", None), (12, "http://free.info/", None), (13, "http://www.other.info/b/?utm_source=q", None),
    ]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, own int")
    got = {r["page_id"]: r for r in urls.filtered(frame).collect()}
    assert {i: (r["rule"], r["verdict"]) for i, r in got.items()} == {1: ("example.com/en/7", "allow"), 2: ("com/en/", "block"), 3: ("net/de/", "block"), 4: ("example.net/de/8", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("org/es/", "block"), 8: (None, "allow"), 9: (None, "block"), 10: (None, "block"), 11: (None, "block"), 12: (None, "allow"), 13: (None, "allow")}
    assert (got[2]["host"], got[2]["path"], got[5]["host"], got[6]["path"]) == ("a.example.com", "/en/1", "", "")
    redirects = spark.createDataFrame([("http://alias.info/a", "http://example.com/en/7"), (None, "x")], "source string, target string")
    assert {r["verdict"] for r in urls.filtered(frame.where("page_id in (9, 10, 11)"), redirects=redirects).collect()} == {"allow"}
    assert urls.filtered(frame.limit(0)).count() == 0


def test_url_rules_are_those_of_the_contract(spark):
    """net/de/ is allowed, with example.net/de/8 as the blocked exception."""
    fixed = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {host + path: verdict for verdict, host, path in urls.RULES} == fixed
    rows = [(1, "https://x.net/de/8", None), (2, "http://example.net/de/7", None), (3, "http://a.example.net/de/80", None), (4, "http://example.net/fr/8", None)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filtered(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("net/de/", "allow"), 3: ("example.net/de/8", "block"), 4: (None, "allow")}


def test_url_links_are_all_resolved(spark):
    canonical, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    cases = [
        (["page.html"], ["h.org/a/b/page.html"]), (["../x"], ["h.org/a/x"]), (["./x/./y/../z"], ["h.org/a/b/x/z"]), (["../../../../x"], ["h.org/x"]), (["/r/../s"], ["h.org/s"]), (["?id=5"], ["h.org/a/b/c?id=5"]), (["page.php?id=5"], ["h.org/a/b/page.php?id=5"]),
        (["go?u=http://i.org/"], ["h.org/a/b/go?u=http://i.org/"]), (["//i.org/y"], ["i.org/y"]), (["http://i.org:80/z#f"], ["i.org/z"]), (["#top"], []), (["mailto:a@b"], []), (["http:///x"], []), (["http://i.org/1", "http://i.org/2"], ["i.org/1", "i.org/2"]),
    ]
    rows, want = [("http://h.org", canonical.format("x"))], {("http://h.org/", "http://h.org/x")}
    for n, (to, targets, form) in enumerate((*c, form) for c in cases for form in (canonical, refresh)):
        rows.append((f"http://h{n}.org/a/b/c?q=1#f", "<p>".join(form.format(t) for t in to)))
        want |= {(f"http://h{n}.org/a/b/c?q=1", f"http://{t}".replace("h.org", f"h{n}.org")) for t in targets}
    assert {tuple(r) for r in urls.link_edges(spark.createDataFrame(rows, "url string, html string")).collect()} == want
    pages = [(1, "http://one.info/a/", canonical.format("p.php?id=5")), (2, "http://two.info/a/", canonical.format("p.php?id=5")), (3, "http://two.info/a/p.php?id=5", canonical.format("http://evil.com/en/x")), (4, "page.php", canonical.format("http://evil.com/en/x")), (5, "other.php", canonical.format("http://three.info/")), (6, "http://three.info/", None)]
    got = {r["page_id"]: r["verdict"] for r in urls.filtered(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_url_links_in_very_long_pages(spark):
    """A MB of tags that never end, of spaces, and of tags that are no links: the time must not grow with the square."""
    end = '<link rel="canonical" href="http://i.org/x">'
    bodies = ["<link " * 170_000 + ">" + end, "<link " * 170_000, '<link rel=canonical href="' + " " * 1_000_000 + '"><p>' + end, "<meta http-equiv=refresh content='" + "url " * 250_000 + "'>" + end, "<link rel=x>" * 80_000 + end, "<meta content='" * 70_000 + ">" + end]
    began = time.monotonic()
    got = {tuple(r) for r in urls.link_edges(spark.createDataFrame([(f"http://h{i}.org/", b) for i, b in enumerate(bodies)], "url string, html string")).collect()}
    assert got == {(f"http://h{i}.org/", "http://i.org/x") for i in (0, 2, 3, 4, 5)} and time.monotonic() - began < 60


def test_url_classes_against_brute_force(spark):
    """Chains, cycles, a hub, urls without a page, and rules that disagree in a class, from a generated edge table."""
    rng = random.Random(12)
    node = lambda i: f"http://s{i}.info/p"
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100 + (i + 1) % 12) for i in range(12)] + [(200, 201 + i) for i in range(150)] + [(400 + rng.randrange(60), 400 + rng.randrange(60)) for _ in range(45)]
    special = {20: "http://evil.com/en/x", 105: "http://example.net/de/8", 107: "http://a.example.com/en/70", 250: "http://b.net/de/", 410: "http://c.org/es/1", 999: "http://c.org/es/2"}
    name = lambda i: special.get(i, node(i))
    ids = sorted({i for e in edges for i in e} | {999, 1000})
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[root(a)] = root(b)
    own = {20: "block", 105: "block", 107: "allow", 250: "block", 410: "block", 999: "block"}
    classes = {}
    for i in ids:
        classes.setdefault(root(i), []).append(own.get(i))
    want = {i: own.get(i) or ("allow" if "allow" in classes[root(i)] else "block" if "block" in classes[root(i)] else "allow") for i in ids if i not in (20, 230)}
    pages = spark.createDataFrame([(i, name(i), None) for i in want] * 2, "page_id long, url string, html string")
    redirects = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "source string, target string")
    got = urls.filtered(pages, redirects=redirects).collect()
    assert len(got) == 2 * len(want) and {r["page_id"]: r["verdict"] for r in got} == want
    # Two rules for one host and path: allow wins.
    tie = (("block", "s1.info", "/p"), ("allow", "s1.info", "/p"))
    assert urls.filtered(pages.where("page_id = 1"), rules=tie).first()["verdict"] == "allow"


def test_pipeline_against_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
    text = lambda n=60: " ".join(rng.choices(words, k=n))
    item = text(40)
    docs = [(i, text()) for i in range(300)]
    toxic = {i for i in range(0, 120) if i % 6 == 0}
    docs = [(i, f"{t} blockhead" if i in toxic else t) for i, t in docs]
    copy = [(400 + i, docs[201][1] + (" extra" if i else "")) for i in range(3)]
    docs += [*copy, (500, f"{text()} {item} {text()}"), (501, f"{text(20)} token=abcdefgh12 {text(20)}"), (502, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        stage(spark, frame, str(tmp_path)).write.parquet(path)
        frame = spark.read.parquet(path)
        kept.append({r["doc_id"] for r in frame.select("doc_id").collect()})
        if name != "best-fit packing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "secret scan":
            assert "token=[" not in (one := frame.where("doc_id = 501").first())["text"] and "[SECRET]" in one["text"] and one["n_chars"] == len(one["text"])
    every = {i for i, _ in docs}
    assert kept == [every - toxic, every - toxic - {400, 401, 402}, (last := every - toxic - {400, 401, 402, 500}), last, last]
