"""Spelling variants, conversation tries and the rule ledger against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from tickloom.llm import conversation_trie, rule_ledger, spelling
from tickloom.llm.common import Workspace

DOCS = "doc_id long, text string, n long, word string"
TURNS = "conv_id long, turn long, role string, text string, path string"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- spelling variants


def brute_words(docs):
    n = {}
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    n = brute_words(docs)
    near = {w: [o for o in n if o != w and one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return sorted(out, key=repr)


def spelled(seed, n_docs=60):
    rng = random.Random(seed)
    stems = ["aaaaaaaa", "aaaaaaab", "brünette", "brunette", "ÿÿÀÀÿÿÀÀ", "×÷×÷×÷×", "abcdefg", "abcdefgh", "Xylophon", "xylophone"]
    docs = []
    for i in range(n_docs):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems[: rng.choice([2, 5, len(stems)])])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "é", "Z", w[k] * 2]) + w[k + 1 :]
            words.append(w)
        docs.append((i, rng.choice([" ", "\n", "_9"]).join(words)))
    return [*docs, (None, "brunette brunette"), (7, None), (8, ""), (9, docs[9][1]), (9, docs[9][1])]


@pytest.mark.parametrize("max_bytes", [spelling.MAX_FILTER_BYTES, 64])
def test_variants_equal_brute_force(spark, max_bytes):
    docs = spelled(3)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS)
    got = rows(spelling.group_variants(df, Workspace(spark, "spelling"), max_bytes))
    want = brute_variants(docs)
    assert got == want
    assert any(r[1] for r in want)


def test_chains_of_forms_and_ties(spark):
    # 2, 20, 200: each one edit from the next; and two forms of equal n, the lesser wins.
    docs = [(0, " ".join(["letteraa"] * 2 + ["letterab"] * 20 + ["letterbb"] * 200 + ["quietlyz"] * 2 + ["quietlyb"] * 20 + ["quietlya"] * 20))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS)
    got = rows(spelling.group_variants(df, Workspace(spark, "spelling")))
    assert got == brute_variants(docs)
    if "letteraa" in {r[0] for r in got}:
        assert {r[0]: r[2] for r in got}["letteraa"] == "letterbb"
    assert {r[0]: r[1] for r in got}["quietlyz"] == "quietlya"


def test_variants_of_nothing(spark):
    df = spark.createDataFrame([(1, None, 1, "x"), (2, "short words only", 1, "x")], DOCS)
    for docs in (df, df.limit(0)):
        assert spelling.group_variants(docs, Workspace(spark, "spelling")).collect() == []


def test_hashes_of_edits_are_those_of_the_edited_words():
    row = spelling.latin(__import__("pyarrow").array(["abcÿÿde"]), 7)
    letters = np.frombuffer("abcdeÿ".encode("latin-1"), np.uint8)
    every = {(n, 0): np.full(8, 2**64 - 1, np.uint64) for n in (6, 7)}
    made = {bytes(r).decode("latin-1") for _, m in spelling.edits_in(every, {6: (1, 8), 7: (1, 8)}, letters, 7, row) for r in m}
    want = {w for w in ("abcÿÿde"[:i] + "abcÿÿde"[i + 1 :] for i in range(7))}
    want |= {"abcÿÿde"[:i] + c + "abcÿÿde"[i + 1 :] for i in range(7) for c in "abcdeÿ" if c > "abcÿÿde"[i]}
    assert made == want
    # A filter that holds one edit lets it through: its hash is that of the word itself.
    for word in want:
        own = spelling.hashes(spelling.latin(__import__("pyarrow").array([word]), len(word)))
        filters, shapes = {(len(word), 0): np.zeros(64, np.uint64)}, {len(word): (1, 64)}
        block, bits = spelling.blocks_and_bits(own, 64)
        filters[len(word), 0][block] = bits
        assert word in {bytes(r).decode("latin-1") for _, m in spelling.edits_in(filters, shapes, letters, 7, row) for r in m}


# --- conversation tries


def brute_trie(turns):
    own = {}
    for c, turn, role, text, *_ in turns:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        parent = min(nodes[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(members), len(p), parent, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(seed, n=70, words=3):
    rng = random.Random(seed)
    turns = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 3, 4, 6])):
            text = rng.choice(["a b", "a", "", None, "long text of five words"][: words + 1])
            turns.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None]), text, "x"))
    return turns


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_equals_brute_force(spark, seed):
    turns = talk(seed, words=seed)
    turns += [(200 + i, t, "user", f"same {t}", "x") for i in range(25) for t in range(4)]  # copies
    turns += [(300 + i, t, "user", f"deep {t}" if t < 9 else f"own {i}", "x") for i in range(6) for t in range(10)]  # one long hot prefix
    turns += [(-43, 0, "user", "minus", "x"), (None, 0, "user", "nobody", "x"), (5, 0, "user", "a", "x"), (5, 0, "user", "a", "x")]
    df = spark.createDataFrame(turns, TURNS)
    assert rows(conversation_trie.trie_nodes(df, Workspace(spark, "trie"))) == brute_trie(turns)


def test_trie_is_the_same_over_many_shards(spark):
    turns = talk(11, n=120)
    df = spark.createDataFrame(turns, TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows(conversation_trie.trie_nodes(df, Workspace(spark, "trie"))) == brute_trie(turns), n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_turnless_and_no_conversations(spark):
    turnless = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0][:2]
    turns = [(c, 0, "user", "gone", "x") for c in turnless]
    df = spark.createDataFrame(turns, TURNS)
    assert rows(conversation_trie.trie_nodes(df, Workspace(spark, "trie"))) == brute_trie(turns)
    assert conversation_trie.trie_nodes(df.limit(0), Workspace(spark, "trie")).collect() == []


def test_digest_of_a_hot_end_runs_over_many_chunks(spark):
    turns = [(c, 0, "user", "hello", "x") for c in range(0, 60_000, 20)]
    got = conversation_trie.trie_nodes(spark.createDataFrame(turns, TURNS), Workspace(spark, "trie")).where("depth = 1").collect()
    assert [r.ends_sha256 for r in got] == [hashlib.sha256(",".join(str(c) for c in range(0, 60_000, 20)).encode()).hexdigest()]


def test_double_array_walks_every_path_and_no_other():
    rng = np.random.default_rng(4)
    paths = sorted({tuple(int(x) for x in rng.integers(0, 50, rng.integers(0, 6))) for _ in range(800)})
    lengths = np.array([len(p) for p in paths])
    ids = np.array([x for p in paths for x in p], np.int64)
    trie = conversation_trie.build(lengths, np.r_[0, np.cumsum(lengths)[:-1]], ids)
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert (trie.check >= 0).sum() == len(prefixes) - 1
    for p in itertools.islice(prefixes, 300):
        state = np.zeros(1, np.int64)
        for label in p:
            state = trie.child(state, np.array([label]))
            assert state[0] > 0
        for label in range(0, 50, 7):
            assert (trie.child(state, np.array([label]))[0] > 0) == ((*p, label) in prefixes)


# --- quality rules


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {x for at in places.values() if len(at) > 1 for i in at for x in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def ruled(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bé", "#", "x|y", "word", "🙂", "{", "12", "\x0b", "\x1c"]
    docs = [(i, "".join(rng.choice(vocabulary[: rng.choice([1, 3, 10])]) + rng.choice([" ", " ", "\n", "  ", "\t", "\r\n"]) for _ in range(rng.randint(0, 90)))) for i in range(80)]
    phrase = "one two three four five six seven eight "
    docs += [(100, phrase * 3), (101, phrase + phrase[:-7]), (102, phrase + "x " + phrase), (103, "same " * 30), (104, (phrase + "nine\n") * 400)]
    return [*docs, (105, None), (106, ""), (None, "null id"), (3, docs[3][1]), (107, " \n\t ")]


def test_rule_measures_equal_brute_force(spark):
    docs = ruled(6)
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], DOCS)
    book = rule_ledger.ledger(df).withColumn("base_failed", ~rule_ledger.kept(rule_ledger.POLICIES["base-1"]))
    got = rows(book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted(((i, *brute_rules(t)) for i, t in docs), key=repr)
    assert rule_ledger.ledger(df.limit(0)).count() == 0


def test_policies_and_ablations_read_the_bits_alone(spark):
    docs = ruled(7)
    book = rule_ledger.ledger(spark.createDataFrame([(i, t, 5, "x") for i, t in docs], DOCS)).cache()
    bits = [r.failed for r in book.collect()]
    names = list(rule_ledger.RULES)
    for policy in rule_ledger.POLICIES.values():
        got = {r.rule: (r.n_failed, r.n_only, r.kept, r.kept_without) for r in rule_ledger.ablations(book, policy).collect()}
        kept = sum(b & policy.mask == 0 for b in bits)
        assert set(got) == set(policy.rules)
        for rule in policy.rules:
            bit = 1 << names.index(rule)
            without = sum(b & policy.mask & ~bit == 0 for b in bits)
            assert got[rule] == (sum(b & bit != 0 for b in bits), without - kept, kept, without)
        empty = rule_ledger.ablations(book.limit(0), policy).collect()
        assert {tuple(r)[2:] for r in empty} == {(0, 0, 0, 0)}
    seen = rule_ledger.coverage(book).first()
    assert seen.any_failed == int(np.bitwise_or.reduce(bits)) and seen.all_failed == int(np.bitwise_and.reduce(bits)) and seen.n == len(bits)


def test_kept_documents_keep_their_columns(spark):
    columns = "doc_id long, text string, n_words long, failed string, __t string, __w string"
    fine = " ".join("word" + "abcdefghij"[i % 10] * (1 + i // 10) for i in range(40))
    df = spark.createDataFrame([(1, fine, 5, "f", "t", "w"), (2, "short", 6, "f", "t", "w"), (3, None, 7, "f", "t", "w"), (1, fine, 5, "f", "t", "w")], columns)
    kept = rule_ledger.keep_documents(df)
    assert kept.columns == df.columns
    assert rows(kept) == [(1, fine, 5, "f", "t", "w")] * 2


# --- the registered queries


def test_registered_queries_on_small_tables(spark, tmp_path):
    from tickloom.llm import queries

    docs = spelled(5, 30) + [(i + 500, t) for i, t in ruled(9) if i is not None]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    turns = talk(4, 40)
    spark.createDataFrame(turns, TURNS).drop("path").write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows(queries.QUERIES["op11_spelling_variants"](spark, str(tmp_path))) == brute_variants(docs)
    assert rows(queries.QUERIES["op12_conversation_trie"](spark, str(tmp_path))) == brute_trie(turns)
    book = queries.QUERIES["op13_quality_rules"](spark, str(tmp_path))
    got = rows(book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    assert got == sorted(((i, *brute_rules(t)) for i, t in docs), key=repr)
    assert book.where("base_failed AND kept").count() == 0 and book.where("kept").count() > 0
    assert queries.QUERIES["op12_conversation_trie"](spark, str(tmp_path)).columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
