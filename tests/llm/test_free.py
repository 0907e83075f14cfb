"""Pieces, HTML, near duplicates, secrets, quality and token counts on small fixtures."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest

from tickloom.llm import html_text, minhash, quality, sampled_pieces, secrets, token_counts
from tickloom.llm.common import Workspace

ODD = ["", "a", " a", "don't 'sx 'll''s I'll  two   spaces \n\n x\n y\t\tz ", "<|endoftext|>a <|endoftext|> ", "a" * 999, "é ñ 日本語 ½ ١٢", "😀😀 don’t", "▁ ▁▁x", "\x1c a\x85b\xa0c", "</s><0x0A> \x00"]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("ab'stlrevmd  \n\t1é,. ", k=rng.randint(0, 50))) for _ in range(300)] + [None]
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, path, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 20), t
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


def test_long_texts_are_cut_only_between_tokens():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "some words, and 'more' of them\n\n  with   gaps. " * 200
    small, token_counts.CHUNK = token_counts.CHUNK, 64
    try:
        assert token_counts.Counter(path)([text, "x" * 500]).tolist() == [len(Tokenizer.from_file(path).encode(t).ids) for t in (text, "x" * 500)]
    finally:
        token_counts.CHUNK = small


def test_pieces_are_lossless_and_reproducible(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(i, t, "k", 1, "z") for i, t in enumerate([*ODD, None])], "doc_id long, text string, key string, ids int, lossless string")
    once = {r.doc_id: r for r in sampled_pieces.encode(docs, path).collect()}
    again = {r.doc_id: r.ids for r in sampled_pieces.encode(docs.repartition(3), path).collect()}
    for i, t in enumerate([*ODD, None]):
        assert once[i].lossless and once[i].ids == again[i] and once[i].key == "k"
        if t and "▁" not in t and "\x00" not in t:
            assert library.decode(once[i].ids) == t
    back = sampled_pieces.encode(docs, path).select("doc_id", sampled_pieces.decode(sampled_pieces.F.col("ids"), path).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {i: t or "" for i, t in enumerate([*ODD, None])}
    assert sampled_pieces.encode(docs.limit(0), path).count() == 0


def test_segmentations_follow_the_lattice():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {library.id_to_piece(i).replace("▁", " "): (i, library.get_score(i) / sampled_pieces.SCALE) for i in range(259, 32000)}

    def all_ways(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in score:
                yield from (((score[s[:k]][0], *t), v + score[s[:k]][1]) for t, v in all_ways(s[k:]))

    n = 20_000
    seen = collections.Counter(tuple(x.tolist()) for x in sampled_pieces.Sampler(path).encode(["hello"] * n, np.arange(n)))
    ways = list(all_ways(" hello"))
    total = sum(np.exp(v) for _, v in ways)
    for t, v in ways:
        p = np.exp(v) / total
        assert abs(seen[t] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


PAGE = """<html><head><title>t</title><script>var a="</p>"</script></head><body><header class="site"><h1>Site</h1></header><nav><ul><li><a href=/>Menu</a></ul></nav>
<div id="cookie-notice">We use cookies</div><div class="wrap"><div class="sidebar"><p>Popular things to read today</p></div><div class="post-{n}"><h2>Title &eacute;</h2>
<p>One   two<br>three<p>Four &amp; five</p><ul><li>a</li><li>b <a href=x>c</a></li></ul><div class="ad-slot">Buy</div><form>search</form><p hidden>no</p></div>
<section id="comments"><p>A reader says a great deal about this, far more than the article itself has to say of it, at length</p></section></div><footer>c</footer>"""
TEXT = "Title é\n\nOne two three\n\nFour & five\n\na\n\nb c"


def test_html_main_text(spark):
    rows = [(i, f"https://www.h.net/{i}", PAGE.replace("{n}", str(i)), "p") for i in range(3)] + [(7, None, None, "p"), (8, "x://y/", "", "p"), (9, "u", "plain &lt; text", "p"), (9, "u", "plain &lt; text", "p"), (None, "u", "<p>a<!-- b", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = collections.Counter((r.page_id, r.text) for r in html_text.extract(pages).collect())
    assert got == {(0, TEXT): 1, (1, TEXT): 1, (2, TEXT): 1, (7, ""): 1, (8, ""): 1, (9, "plain < text"): 2, (None, "a"): 1}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_host_path_wins_over_a_page_of_its_own_mind(spark):
    good = "<body><div class=main><p>A long enough article, with several words in it.</p></div><div class=box><p>x</p></div>"
    odd = "<body><div class=main><p>Short.</p></div><div class=box><p>A much longer text beside the article than the article itself.</p></div>"
    pages = spark.createDataFrame([(i, "http://h/", good) for i in range(3)] + [(9, "http://h/", odd)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()}[9] == "Short."


LONG = "<p>A long article, with many words in it, that goes on and on.</p><p>And a second paragraph of it.</p>"


@pytest.mark.parametrize(
    "wrapper",
    ['div class="layout has-sidebar"', 'article class="post hentry category-notices"', 'article class="article comments-open"', 'div class="with-nav share-enabled tag-ads"', 'div class="layout sidebar-left"', 'div id="banner"', 'main class="promo"'],
)
def test_html_wrappers_that_name_a_feature_keep_their_text(wrapper):
    end = wrapper.split()[0]
    page = f"<body><p>Skip</p><{wrapper}>{LONG}<div class='sidebar'><p>Popular things</p></div><div class='ad'>Buy</div></{end}><div class='related'><p>More</p></div></body>"
    got = html_text.main_text(page, html_text.vote(page))
    assert "goes on and on" in got and "a second paragraph" in got and not re.search("Popular|Buy|More", got)


def test_html_marks_give_way_to_the_host_and_to_empty_pages():
    good = f"<body><div class='page sidebar-left'>{LONG}</div><div class=box><p>x</p></div>"
    odd = "<body><div class='page sidebar-left'><p>Short.</p></div><div class=box><p>A much longer text beside the article than the article itself.</p></div>"
    assert html_text.main_text(odd, html_text.vote(good)) == "Short."
    parts = "".join(f"<div class='widget'><p>Part {i} of the text.</p></div>" for i in range(3))
    assert html_text.main_text(f"<body><nav>Menu</nav>{parts}", None).count("of the text") == 3
    comments = "<div id=comments>" + "<div class=comment><p>Readers say much more than the article does, as they often do.</p></div>" * 9 + "</div>"
    assert html_text.main_text(f"<body><div class=post>{LONG}</div>{comments}", None).count("\n\n") == 1
    assert html_text.main_text("<body><div class=ad>An advert longer than the article</div><article><p>Short.</p></article>", None) == "Short."


def brute_components(texts, size, percent=80):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rng = random.Random(size)
    base = [" ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.randint(1, 90))) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, max(1, len(w) // 20))):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
            texts.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    texts += [None, "", " \t", "one", "One", "É é"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.near_duplicates(docs, Workspace(spark, "t"), size=size).collect()}
    roots, sizes = brute_components(texts, size)
    assert got == {i: (roots[i], sizes[i]) for i in range(len(texts))}


def test_deduplicate_odd_rows(spark):
    rows = [(5, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (3, None, None), (4, "", None), (4, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    left = minhash.deduplicate(docs, Workspace(spark, "t"))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.root or "") for r in left.collect()) == [(2, "y"), (3, ""), (4, "")]
    assert minhash.deduplicate(docs.limit(0), Workspace(spark, "t")).count() == 0


def test_deduplicate_leaves_one_row_of_each_component(spark):
    rows = [(1, "a b c d e f g", "p"), (1, "a b c d e f g", "q"), (1, "A b c d e f g", "r"), (2, "x " * 30_000, "s"), (2, "x " * 30_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    left = [(r.doc_id, r.component_id) for r in minhash.deduplicate(docs, Workspace(spark, "t")).collect()]
    assert sorted(i for i, _ in left) == [1, 2]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    a, b = pool[:3000], pool[600:3600]
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 3000, 6000]), 512)
    assert abs((s[0] == s[1]).mean() - 2400 / 3600) < 0.08
    one = minhash.signatures(pool[:7], np.array([0, 3, 7]), 64)
    assert np.isfinite(one).all() and sorted(np.floor(one[0]).astype(int).tolist())[0] == 0


def test_secret_spans(spark):
    hexes = "0123456789abcdef" * 3
    rows = [
        (1, 'toKen = "abcd1234" then paſſword=abcdefgh', ["assign"]), (2, "password = secret: abcdefg", []), (3, f"AKIA{'A' * 12} AKIASHORT {hexes}", ["access", "hex"]), (4, None, []), (5, "", []),
        (6, 'A = "sk-live-"\nB = "9fK2mmQ8zL1p"\nclientAuth = A + B', ["lexed", "lexed"]), (7, "the time: 12:30, note = hello world", []), (8, "password: short", []), (9, '{"privateKey": "MIIEvQIBADANBg"}', ["lexed"]),
    ]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in secrets.scan(docs).collect()}
    texts = {i: t for i, t, _ in rows}
    assert {i: [s.kind for s in got[i]] for i in got} == {i: k for i, _, k in rows}
    assert texts[1][got[1][0].secret_start : got[1][0].secret_end] == "abcd1234"
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert masked[1].startswith('toKen = "[SECRET]"') and hexes not in masked[3] and masked[4] is None and masked[7] == texts[7]
    assert all(not secrets.base_spans(t or "") for t in masked.values())
    assert secrets.scan(docs.limit(0)).count() == 0


def test_secrets_of_names_with_several_definitions():
    def found(text):
        return [text[a:b] for _, _, _, a, b in secrets.all_spans(text)]

    assert found('x = ""\ny = 1\nx = "9fK2mmQ8zL1p"\nclientAuth = x') == ["9fK2mmQ8zL1p"]
    assert found('x = "9fK2mmQ8zL1p"\nx = "Zt7-pLw0Qe4r"\nclientAuth = x\nx = ""') == ["9fK2mmQ8zL1p", "Zt7-pLw0Qe4r"]
    assert found('k = ""\nk = "9fK2m"\nk = k + "Q8zL1p"\nclientAuth = k') == ["9fK2m", "Q8zL1p"]
    assert found('y = "changeme"\nx = y\ny = "9fK2mmQ8zL1p"\nclientAuth = x') == ["9fK2mmQ8zL1p"]
    assert found('x = "one value"\nx = "9fK2mmQ8zL1p"\nother = x') == []
    name = "client" + "_part" * 60
    assert found(f'{name} = "9fK2mmQ8zL1p"\nclientAuth = {name}') == ["9fK2mmQ8zL1p"]
    assert found("".join(f'x = "{i}"\n' for i in range(2000)) + 'x = "9fK2mmQ8zL1p"\n' + "clientAuth = x\n" * 2000) == ["9fK2mmQ8zL1p"]


def test_quality_scores(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choices(["the", "quick", "brown", "fox", "jumps", "over"], k=rng.randint(20, 60))).capitalize() + "." for _ in range(300)]
    bad = [" ".join(w.upper() + "!!$$" for w in t.split()) for t in good[:60]]
    texts = good + bad + [None, ""]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score0 double")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(360)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, Workspace(spark, "t"))
    got = {r.doc_id: r.score for r in quality.with_scores(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[360] == got[361]
    right = sum((got[i] >= quality.THRESHOLD) == (i < 300) for i in range(360))
    assert right >= 350
    kept = quality.keep_good(docs, labels, Workspace(spark, "t"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(300))
    empty = quality.fit(docs.limit(0), labels.limit(0), Workspace(spark, "t"))
    assert {r.score for r in quality.with_scores(docs, empty).collect()} == {0.5}


def test_held_out_labels_do_not_matter(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = (quality.fit(docs, x, Workspace(spark, "t")) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
