"""Pages, secrets, scores and odd rows held against what is known of them; the registered queries on small tables."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import pytest

from tickloom.llm import html_text, queries, quality, secrets, token_counts
from tickloom.llm.common import Workspace

LONG = "<p>A long article, with many words in it, that goes on and on.</p><p>And a second paragraph of it.</p>"
TEXT = "A long article, with many words in it, that goes on and on.\n\nAnd a second paragraph of it."
PAGES = {
 f'<body><div class="layout has-sidebar">{LONG}</div>': TEXT, f'<body><article class="post comments-open">{LONG}</article>': TEXT,
 f'<body><article>{LONG}<section id="social-history"><p>How people lived.</p></section></article>': TEXT + "\n\nHow people lived.",
 f'<body><article>{LONG}<ul><li>one<li class="ad">Buy<li>two</ul></article>': TEXT + "\n\none\n\ntwo",
 f'<body><article>{LONG}<figure class="advert"><img><figcaption>Buy</figcaption></figure><h3 class="related">Related</h3><p>x</p></article>': TEXT + "\n\nx",
 f'<body><article>{LONG}<p>a <span style="display:none">no <span>no</span> no</span>b</p></article>': TEXT + "\n\na b",
 f'<body><article>{LONG}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be. <svg><title>t</title><text>lab</text></svg> <object data=x>fall</object></p></article>': TEXT + "\n\nLet x=2 be. lab fall",
 f'<body><article><header><h1>T</h1><p>Lead text.</p></header>{LONG}</article>': "T\n\nLead text.\n\n" + TEXT,
 f'<body><article>{LONG}<div class="related-posts"><a href=x>More of it</a></div><ul class="share-list"><li>Tweet</li></ul></article>': TEXT,
 f'<body><article>{LONG}<li class=ad>x<ul><li>y</li></ul>z</li><p>w</p></article>': TEXT + "\n\nw",
 f'<body><article>{LONG}<p hidden>no<p>yes</article>': TEXT + "\n\nyes",
 f'<body><article>{LONG}<p>a<span hidden>no</p><p>yes</article>': TEXT + "\n\na\n\nyes",
 f'<body><article>{LONG}<aside><p>side</p></aside><blockquote>q</blockquote></article>': TEXT + "\n\nq",
}


PAGES |= {
 # A head, menu or header that nobody ended.
 f"<html><head><title>t</title><body><article>{LONG}</article>": TEXT, f"<head><title>t</title><meta charset=x>{LONG}": TEXT, "<head><title>t</title>Plain <b>text</b>": "Plain text",
 f"<body><nav><ul><li><a href=x>Menu</a></ul><article>{LONG}</article><footer>c</footer>": TEXT, f"<body><p>Skip</p><header>Site<div class=post>{LONG}</div>": TEXT,
 f"<body><nav><a href=x>Menu</a><main>{LONG}</main>": TEXT,
 # The page in a form or field set; a form beside the article stays out.
 f'<body><form id="aspnetForm"><div class="page">{LONG}<label>Mail</label></div></form>': TEXT, f"<body><fieldset>{LONG}</fieldset>": TEXT,
 f"<body><form><nav><a href=x>Menu</a></nav><article>{LONG}<form><p>Mail us</p></form></article><footer>c</footer></form>": TEXT,
 "<body><article><p>Short.</p></article><form><p>A much longer form than the article is, with a long word or two about what happens to your data.</p></form>": "Short.",
 # Only noscript has text; else it is left out.
 f"<body><noscript>{LONG}</noscript><script>x()</script>": TEXT, f"<body><noscript>Turn scripts on</noscript>{LONG}": TEXT,
 # Names inside an article.
 f'<article>{LONG}<h2 id="search">Search</h2><p>x</p><h2 id="comments">Comments</h2><h3 id="navigation">Navigation</h3><p>y</p></article>': TEXT + "\n\nSearch\n\nx\n\nComments\n\nNavigation\n\ny",
 f'<article>{LONG}<section class="social"><p>How people lived with each other.</p></section></article>': TEXT + "\n\nHow people lived with each other.",
 f'<article>{LONG}<p class="alert">Never mix these two substances.</p></article>': TEXT + "\n\nNever mix these two substances.",
 f'<article>{LONG}<p>a <b class="ad">bold</b> <span id="footer">word</span> <span class="ad">Buy</span></p></article>': TEXT + "\n\na bold word",
 f'<article>{LONG}<div class="notice">We sell things.</div><p class="ad">Buy these two today.</p></article>': TEXT,
 "<body><nav><a href=x>Menu</a></nav>": "Menu",
}


@pytest.mark.parametrize("page", PAGES)
def test_html_case(page):
    assert html_text.main_text(page, html_text.vote(page)) == PAGES[page]


def test_html_generated_pages(spark):
    """Pages put together from an article that is known and of everything that is not it."""
    rng = random.Random(8)

    def words(n):
        return " ".join(rng.choices(["alpha", "beta", "ga&amp;mma", "d&eacute;lta", "<b>eps</b>ilon"], k=n))

    def shown(raw):
        return re.sub("<.*?>", "", raw).replace("&amp;", "&").replace("&eacute;", "é")

    rows, want = [], {}
    for i in range(80):
        parts, blocks = [], []
        for _ in range(rng.randint(3, 8)):
            tag, text = rng.choice(["p", "h2", "li", "blockquote", "td"]), words(rng.randint(8, 30))
            given = rng.choice(["", "", " id='search'", " class='x1'"]) if tag == "h2" else ""
            parts.append({"li": f"<ul><li>{text}</li></ul>", "td": f"<table><tr><td>{text}</td></tr></table>"}.get(tag, f"<{tag}{given}>{text}</{tag}>"))
            blocks.append(shown(text))
            parts.append(rng.choice(["", '<div class="ad-box">Buy</div>', "<!-- x -->", "<script>if (a<b) {}</script>", '<p class="share">Share</p>', "<form><p>Mail</p></form>", '<span hidden>no</span>']))
        wrap = rng.choice(['article class="post tag-ads"', 'div class="content with-sidebar"', 'main id="main"'])
        head, form = rng.choice(["</head>", ""]), rng.choice(["", "", "<form>"])
        page = f"<html><head><title>t</title>{head}<body>{form}<nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><{wrap}>{''.join(parts)}</{wrap.split()[0]}>"
        page += f"<aside>{words(5)}</aside><div id='comments'><p>{words(9)}</p></div><footer>{words(5)}</footer></body></html>"
        rows.append((i, f"https://h{i % 3}.net/{i}", page, "x"))
        want[i] = "\n\n".join(blocks)
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got == want


def test_html_of_long_and_deep_pages():
    page = "<body>" + "<div>" * 3000 + "<p>word</p>" * 20_000
    assert html_text.main_text(page, html_text.vote(page)) == "\n\n".join(["word"] * 20_000)


K = "9fK2mmQ8zL1p"
SECRETS = {
   
 'X = "%s"\nDB_PWD="${X}"'%K: [K], 'db_pwd = """%s"""'%K: [K], "pwd:\n  - %s\n  - other"%K: [K], "private_key: |\n  MIIEvQIBADANBg9\n  abcDEF12345\nnext: 1": ["MIIEvQIBADANBg9\n  abcDEF12345"],
 'define("DB_PWD", "%s");'%K: [K], "<dbPwd>%s</dbPwd>"%K: [K], '<property name="db.pwd" value="%s"/>'%K: [K], '<entry key="pwd">%s</entry>'%K: [K],
 'A = "%s"\nA = "harmless words"\nauth = A'%K: [K], '# pwd = "%s"\nx = 1'%K: [K], '// x = "%s"\nauth = x'%K: [], 'note: "say x = \'%s\'"'%K: [],
 "don't say auth: it's fine, isn't it": [], 'p = f"{X}"; X = "%s"\nauth = p'%K: [K], 'config["pwd"] = "%s"'%K: [K], "export DB_PWD=%s"%K: [K], "DB_PWD=ab$c-d9fK2": ["ab$c-d9fK2"] , '{"privateKey": "MIIEvQIBADANBg"}': ["MIIEvQIBADANBg"],
 'k = "9fK2m" +\n "Q8zL1p"\nauth = k': ["9fK2m","Q8zL1p"], 'pwd = os.getenv("HOME_DIRX1")': [], "the pass: over hills we went": [], 'auth = get_value(x)': [],
 '/* x */ clientAuth := `%s`'%K: [K], "pwd: '%s' # c"%K: [K], "[s]\npwd = %s\n; auth=zzz\n"%K: [K], 'url = "http://x"': [],
}


@pytest.mark.parametrize("text", SECRETS)
def test_secrets_case(text):
    assert [text[a:b] for _, _, _, a, b in secrets.all_spans(text)] == SECRETS[text]


def plain_spans(text):
    kinds = [(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("(AKIA[A-Z0-9]+)", 1, 16), ("([0-9a-f]+)", 1, 32)]
    found = []
    for k, (pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text, re.A):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, m.end()))
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(found)]


def test_secrets_query_equals_plain_patterns(spark, tmp_path):
    rng = random.Random(5)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", " ", "=", ":", '"', "'", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "x", "ſ", "é", "\n", "+/_.=-", "passwd = 'abcd1234'", "AKIA" + "Z" * 14]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(2000)] + [None, "", "z " * 100_000 + "token = abcdefgh1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, queries.QUERIES["op7_secrets"](spark, str(tmp_path)).collect()))
    want = collections.Counter()
    for i, t in rows:
        base = plain_spans(t or "")
        joined = [f"{k}:{s}:{e}" for k, s, e in base]
        n = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        want[(i, *n, hashlib.sha256(",".join(joined).encode()).hexdigest())] += 1
    assert collections.Counter({k[:5]: v for k, v in got.items()}) == want
    for k in got:
        assert set(re.findall("(?:assign|access|hex):[0-9]+:[0-9]+", k[5])) == {f"{a}:{s}:{e}" for a, s, e in plain_spans(dict(rows)[k[0]] or "")}


def test_quality_of_held_out_labels(spark):
    source = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op8_quality"](spark, source).join(spark.read.parquet(f"{source}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(scored) > 500 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    pairs = [(a > b) + (a == b) / 2 for a in good for b in bad]
    assert sum(pairs) / len(pairs) > 0.97 and sum(r.predicted == r.quality for r in scored) / len(scored) > 0.95


def test_quality_of_ties_repeats_and_clashing_names(spark):
    rows = [(1, "same text", 9.0), (1, "same text", 9.0), (2, "same text", 8.0), (None, "word " * 50_000, 7.0), (3, None, 6.0), (4, "", 6.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    found = quality.with_scores(docs, quality.fit(docs, labels, Workspace(spark, "t"))).collect()
    by_text = collections.defaultdict(set)
    for r in found:
        by_text[r.text or ""].add(r.score)
    assert len(found) == 6 and all(len(v) == 1 and 0 <= min(v) <= max(v) <= 1 for v in by_text.values())


def test_token_counts_of_repeated_rows(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, "a b", 2), (2, "a b" * 100_000, 3)], "doc_id long, text string, n_bytes int")
    got = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in got) == [(0, 3), (1, 3), (1, 3), (2, 300_000)]


def test_secrets_of_equal_and_long_rows(spark):
    text = "x " * 100_000 + 'clientAuth = "9fK2mmQ8zL1p"'
    docs = spark.createDataFrame([(1, text, "s"), (1, text, "s"), (2, text, "s")], "doc_id long, text string, spans string")
    assert {tuple(s.kind for s in r.spans) for r in secrets.scan(docs).collect()} == {("lexed",)}


ODD = [(1, "a plain text of some words, as many others", "en", "s", 5), (1, "a plain text of some words, as many others", "en", "s", 5), (2, None, None, None, None), (None, "", "en", "s", 0), (3, "w" * 50_000, "en", "s", 1), (None, "a plain text of some words, as many others", None, "s", 1)]


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("rows", [ODD, []])
def test_stage_takes_odd_rows(spark, tmp_path, stage, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("labels", "benchmark"):
        made = spark.createDataFrame([], {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}[name])
        made.write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.STAGES[stage][1](spark, docs, str(tmp_path))
    kept = found.collect()
    if stage < 4:
        assert found.columns == docs.columns
    if stage == 1:
        assert sorted((r.doc_id or 0, r.text or "")[0] for r in kept) == ([0, 1, 2, 3] if rows else [])
    else:
        assert len(kept) == len(rows)
