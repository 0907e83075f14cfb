"""Decontamination, WARC, fingerprints and URL filters on small fixtures."""

import base64
import hashlib
import random
import re

import pytest

from tickloom.llm import decontamination, fingerprints, url_filters, warc
from tickloom.llm.common import Workspace

DOCS = "doc_id long, text string, w string, n_words long"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, size=13):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for i in range(max(len(b) - size + 1, 1) if b else 0):
            win = b[i : i + size]
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [None, -1])
def test_decontamination_equals_brute_force(spark, monkeypatch, most):
    if most is not None:  # as if the benchmark were too large to broadcast
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_BYTES", most)
    rng = random.Random(5)
    vocabulary = ["a", "b", "É", "c9", "straße"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 12, 13, 14, 30])))) for i in range(12)] + [(99, None), (3, "a b"), (10, "Zz, zz. q")]
    docs = []
    for i in range(40):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        if i % 3 == 0:
            text += "\n" + (items[i % 12][1] or "").upper() + "!"
        docs.append((i, text, "x", 1))
    docs += [(100, None, None, None), (101, "", "y", 2), (None, "q zz ZZ", None, 1), (5, "zz zz q", None, 1)] + [(7, docs[7][1], "again", 3)]
    got = decontamination.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for doc_id, text, *_ in docs:
        n, hit, found = brute(text, items)
        want.append((doc_id, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_large_benchmarks_ship_no_words_of_a_position(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MAX_BROADCAST_BYTES", -1)
    docs, items = spark.createDataFrame([(1, "one two three", "k", 0)], DOCS), spark.createDataFrame([(1, "two")], "item_id long, text string")
    plan = decontamination.find_hits(docs, items)._jdf.queryExecution().executedPlan().toString()
    # What the inline of positions hands on has no array of words beside it.
    made = [line for line in plan.split("\n") if "Generate inline" in line]
    assert made and all("w#" not in line.split("), [")[1].split("]")[0] for line in made)


@pytest.mark.parametrize("most", [None, -1])
def test_decontamination_empty_tables_and_removal(spark, monkeypatch, most):
    if most is not None:
        monkeypatch.setattr(decontamination, "MAX_BROADCAST_BYTES", most)
    docs, items = spark.createDataFrame([(1, "one two three", "k", 0), (2, None, None, None)], DOCS), spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert decontamination.report(docs.limit(0), items).count() == 0
    assert {r.contaminated for r in decontamination.report(docs, items.limit(0)).collect()} == {False}
    assert [r.doc_id for r in decontamination.remove_documents(docs, items).collect()] == [2]
    spans = {r.doc_id: r.text for r in decontamination.remove_spans(docs, items).collect()}
    assert spans == {1: "one three", 2: None}


def test_warc_round_trip(spark):
    rows = [(1, "u", None, 7), (2, "http://a/\r\nb", "", 7), (3, None, "é\r\n\r\nWARC/1.1", 7), (4, "v", "é\r\n\r\nWARC/1.1", 7), (None, "v", "z", None), (6, "v", "z", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, address long")
    place = warc.write_archive(pages, Workspace(spark, "t"))
    got = {r.page_id: r for r in warc.parse_records(warc.read_archive(place)).collect()}
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        assert got[page_id].payload_bytes == len(raw)
        assert got[page_id].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4, 6, None)] == [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None), ("revisit", 6)]
    assert place.read("payloads").count() == 3
    record = {r.page_id: bytes(r.record) for r in warc.read_archive(place).collect()}[3]
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith("\r\n\r\né\r\n\r\nWARC/1.1\r\n\r\n".encode())
    assert warc.parse_records(warc.read_archive(warc.write_archive(pages.limit(0), Workspace(spark, "t")))).count() == 0


def test_warc_finds_damage(spark):
    place = warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), Workspace(spark, "t"))
    wrong = place.read("payloads").selectExpr("address", "encode('y', 'UTF-8') AS payload").collect()
    place.drop("payloads")
    place.write(spark.createDataFrame(wrong, "address string, payload binary"), "payloads")
    with pytest.raises(Exception, match="no sound payload"):
        warc.read_archive(place).collect()


def test_warc_minimum_size(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    place = warc.write_archive(pages, Workspace(spark, "t"), least_bytes=3)
    assert {r.record_type for r in warc.parse_records(warc.read_archive(place)).collect()} == {"response"}




def test_fingerprints(spark):
    rows = [(3, "a b c d e f g h", 1), (1, None, 2), (2, "", 3), (7, "one", 4), (None, "x y x y x y", 5), (7, "one", 6), (9, "naïve 😀 café " * 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = fingerprints.compare(docs, Workspace(spark, "t")).collect()
    assert len(got) == len(rows)
    keys = sorted({(i is not None, i or 0, t or "") for i, t, _ in rows})
    texts = [k[2] for k in keys]
    by_text = {}
    for r in got:
        k = next(i for i, x in enumerate(keys) if (x[1] if x[0] else None) == r.doc_id)
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert by_text[""] == "" and len(by_text["one"]) == 256
    assert fingerprints.compare(docs.limit(0), Workspace(spark, "t")).count() == 0


def naive_fingerprint(text):
    """Order MinHash: of every order the least k-mer and the least of the reverse order, in text order."""
    import struct

    import xxhash

    def signed(h):
        return struct.unpack("<q", struct.pack("<Q", h))[0]

    def longs(*xs):
        h = 42
        for x in xs:
            h = xxhash.xxh64_intdigest(struct.pack("<i" if isinstance(x, tuple) else "<q", x[0] if isinstance(x, tuple) else x), seed=h)
        return h

    w = [x for x in re.split("[ \\t\\n\\x0b\\f\\r]+", text) if x]
    if not w:
        return ""
    seen, ring = {}, []
    for i in range(max(len(w) - fingerprints.K, 0) + 1):
        h = 42
        for x in w[i : i + fingerprints.K]:
            h = xxhash.xxh64_intdigest(x.encode(), seed=h)
        h >>= 64 - fingerprints.HASH_BITS
        t = seen[h] = seen.get(h, -1) + 1
        ring.append((longs(h, (t,)) >> (64 - fingerprints.HASH_BITS) if t else h, i))
    out = []
    for j in range(fingerprints.SLOTS):
        ranked = sorted((longs(h, (j,)) >> (64 - fingerprints.HASH_BITS), i) for h, i in ring)
        ends = sorted({ranked[0], ranked[-1]}, key=lambda e: e[1])
        out.append(f"{longs(*[r for r, _ in ends]) >> 32:08x}")
    return "".join(out)


def prints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r.text for r in fingerprints.signatures(df, ["i"], ["text"]).collect()}


def test_fingerprints_equal_naive_order_minhash(spark):
    rng = random.Random(4)
    texts = ["", " ", "one", "one two", "a a a a a", "é 😀\n" * 7] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(40)] + ["long word " * 20_000]
    assert prints(spark, texts) == {i: naive_fingerprint(t) for i, t in enumerate(texts)}


def test_fingerprints_feel_order_and_repeats(spark):
    w = [f"w{i}" for i in range(400)]
    f = prints(spark, [" ".join(w), " ".join(w[:380] + ["new"] * 5 + w[385:]), " ".join(reversed(w)), " ".join(w[200:] + w[:200]), " ".join(w + w)])

    def like(a, b):
        return sum(f[a][8 * k : 8 * k + 8] == f[b][8 * k : 8 * k + 8] for k in range(32)) / 32

    assert like(0, 1) > 0.7 and like(0, 2) == 0
    assert like(0, 3) < 0.8 and like(0, 4) < 0.8


def test_url_filters(spark):
    urls = [
        ("https://A.Example.org/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), ("http://x.com/de/#q", "x.com", "/de/", "com/de/", "block"),
        ("http://x.com", "x.com", "", None, "allow"), ("http://spam-farm.example.net/a", "spam-farm.example.net", "/a", None, "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.filter_urls(pages, url_filters.blocked_domains(spark), Workspace(spark, "t")).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls)}
    assert url_filters.filter_urls(pages.limit(0), url_filters.blocked_domains(spark), Workspace(spark, "t")).count() == 0


def test_cascade_is_exact_in_one_block_and_in_many(spark):
    hosts = spark.range(5000).selectExpr("concat('a.H', id, '.net') AS host").select(url_filters.lower_ascii(url_filters.F.col("host")).alias("host"))
    # Parents of hosts, a host itself, repeated, null, upper case and foreign ones.
    listed = spark.createDataFrame([(f"H{i}.net",) for i in range(0, 5000, 2)] + [("a.h7.net",), ("a.h7.net",), (None,), ("elsewhere.org",), ("9.net",)], "host string")
    for most in (1 << 20, 300):
        _, blocks = url_filters.keyed_universe(hosts, listed, Workspace(spark, "t"), max_bytes=most)
        assert (blocks > 1) == (most == 300)
        judged = {r.host: r.listed for r in url_filters.judged(hosts, listed, Workspace(spark, "t"), max_bytes=most).collect()}
        assert judged == {f"a.h{i}.net": i % 2 == 0 or i == 7 for i in range(5000)}
    assert {r.listed for r in url_filters.judged(hosts, listed.limit(0), Workspace(spark, "t")).collect()} == {False}


def test_url_filters_equal_rows_and_rules_of_equal_length(spark):
    pages = spark.createDataFrame([(1, "http://b.a/c", "x"), (1, "http://b.a/c", "x"), (None, "http://b.a/" + "c" * 100_000, "x")], "page_id long, url string, rule string")
    rules = (("block", "b.a", "/c"), ("allow", "a", "/c"), ("allow", "b.a", "/"))
    got = sorted(((r.page_id or 0, r.rule, r.verdict) for r in url_filters.filter_urls(pages, url_filters.blocked_domains(spark), Workspace(spark, "t"), rules).collect()))
    assert got == [(0, "b.a/c", "block"), (1, "b.a/c", "block"), (1, "b.a/c", "block")]
