"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans.  The method adds spans: a lexer cuts
a text into tokens (comments, strings, names, bare values, signs, line ends;
source code, JSON, YAML, INI, shell, XML), a parser over the tokens finds
name-literal pairs, names that hold literals are propagated into the
expressions that use them, and each literal is scored by the sensitivity of the
names it reaches and by its own looks.  Pairs are: a name or quoted key, a sign
and an expression of strings, bare values and names; the first two arguments of
a call (``define("KEY", "…")``); an XML element with its text, or with its name
and value attributes; a YAML key with the items of its list or its block.
Names inside strings (``${NAME}``, ``{NAME}`` in f-strings, ``#{NAME}``,
``{{ NAME }}``) are put in like any other.  Text of comments is lexed by itself,
as far as it makes pairs: a secret that is commented out is still one, but
defines nothing.  A string that only looks a secret up (in the environment, a
vault, settings) names one and holds none; its fallback is a value.  A name that is assigned several times keeps all its
definitions: each is judged by the names that it may reach, and a use takes
both the nearest definition before it and the first.  A text is scanned by
itself, so Spark spreads rows over tasks and nothing is shuffled; Python sees
only the text column, in Arrow batches.

Defined results: null and empty texts have no spans; spans count code points,
end exclusive; equal rows give equal spans; a literal inside a base span is
not reported again; unclosed quotes are letters, unclosed comments reach to the
end; other columns pass through :func:`redact` untouched.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

# The base patterns and the least lengths of what they report.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "lexed")

#: How strongly part of a name says that its value is secret.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3, "api_key": 3,
    "private_key": 3, "access_key": 3, "secret_key": 3, "signing_key": 3, "encryption_key": 3, "credential": 3, "credentials": 3,
    "auth": 2, "authorization": 2, "bearer": 2, "dsn": 2, "connection_string": 2, "key": 1, "salt": 1, "cookie": 1, "session": 1,
}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|-+|<.*>|\$\{?.*\}?|%.*%|\{\{.*\}\}|changeme|example|placeholder|your[-_ ].*|none|null|true|false|undefined|redacted|todo)$")
LEAST_SCORE = 4.0
LEAST_LITERAL = 8
#: Characters kept of both ends of a value of many pieces, to tell placeholders.
KEPT = 256
_STRING = r"""(?:(?<![A-Za-z0-9_])[A-Za-z]{0,2}(?:\"{3}(?:[^\\]|\\.)*?\"{3}|'{3}(?:[^\\]|\\.)*?'{3})|(?<![A-Za-z0-9_])[A-Za-z]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|`[^`\n]*`)"""
_TOKEN = re.compile(
    rf"""(?P<comment>/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|(?:(?<=[\s;{{}}])|(?<![^\n]))(?://|\#(?![{{])|--\s|;(?=[^\n]*\S))[^\n]*)
    |(?P<string>{_STRING})
    |(?P<tag></?[A-Za-z][\w:.-]*|/?>)
    |(?P<sign>:=|\?=|\+=|=>|=(?![=>])|:(?![/:]))
    |(?P<operator>==+|[!<>]=|::|://|&&|\|\||->|\.\.|[+.](?=\s*["'`A-Za-z_$]))
    |(?P<name>\$?[A-Za-z_](?:[A-Za-z0-9_$]|[.-](?=[A-Za-z0-9_]))*)
    |(?P<bare>[A-Za-z0-9+/_=.\-]+)
    |(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<comma>,)|(?P<end>[\n;])""",
    re.X | re.S,
)
_INSIDE = re.compile(r"\$\{\s*([A-Za-z_][\w.]*)\s*(?::-[^}]*)?\}|\#\{\s*([A-Za-z_][\w.]*)\s*\}|\{\{\s*\.?([A-Za-z_][\w.]*)\s*\}\}|\$([A-Za-z_]\w*)|\{([A-Za-z_][\w.]*)(?:![rsa])?\}")
#: A YAML key that a block or a list may follow, an item of a list, and a line.
_KEY_LINE = re.compile(r"""([ ]*(?:-[ ]+)?)["']?([A-Za-z_][\w.-]*)["']?[ ]*:[ ]*([|>][+-]?)?[ ]*$""")
_ITEM = re.compile(r"""[ ]*-[ ]+["']?([^\s"'#:][^\s"'#]*)["']?[ ]*$""")
_LINE = re.compile(r"[^\n]+")
_ELEMENT = re.compile(r"<([A-Za-z][\w:.-]*)((?:\s[^<>]*)?)>([^<>]*)</\1\s*>")
_KEY_ATTRIBUTE = re.compile(r"""\s(?:name|key|id)\s*=\s*["']([^"'<>]+)["']""")
_TAG = re.compile(r"<[A-Za-z][^<>]*")
_NAMED_VALUE = re.compile(r"""\s(name|key|value)\s*=\s*["']([^"'<>]*)["']""")
#: Calls whose string names a secret that lies elsewhere: environments, vaults, settings.
_LOOKUP = re.compile(r"(?i)(?:getenv|environ|env|secretsmanager|vault|keyring|config|settings|properties)(?:[._](?:get|read|lookup|fetch|require|var|get_?(?:secret|password|property|value|string|env))(?:_?(?:value|string))?)?$|(?:^|[._])(?:get|read|fetch|lookup|load)_?(?:env|secret|password|credential|parameter|property|config|setting|token|key)s?(?:_?value)?$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """(start, kind, end, start of the secret, its end) by start, then kind."""
    found = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                found.append((m.start(), 0, m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e, a, b) for s, k, e, a, b in sorted(found)]


#: What every pair has: a sign, an element's end, or a call with a string.
_MAYBE = re.compile(r"""[=:]|</|\(\s*["'`]""")


def name_score(name: str) -> int:
    """Sensitivity of a name, by the words it is made of (snake, kebab, dotted or camel case)."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = ["_".join(p) for p in zip(words, words[1:], strict=False)]
    return max((SENSITIVE.get(w, 0) for w in words + pairs), default=0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret: varied characters of several classes, no spaces."""
    if len(value) < LEAST_LITERAL or " " in value or PLACEHOLDER.match(value):
        return -9.0
    return _varied(Counter(value), len(value))


def _varied(count: Counter, n: int) -> float:
    entropy = -sum(c / n * math.log2(c / n) for c in count.values())
    classes = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in count})
    return min(entropy, 4.0) / 2 + (0.5 if classes >= 2 else -0.5) + (0.5 if classes >= 3 else 0.0)


Term = tuple[str, str, int, int]


def _quoted(text: str, start: int, end: int) -> list[Term]:
    """A string token as its literal pieces and the names put into it."""
    a = start
    while text[a] not in "\"'`":
        a += 1
    prefix, quote = text[start:a].lower(), 3 if text[a : a + 3] in ('"""', "'''") and end - a >= 6 else 1
    a, end = a + quote, end - quote
    terms = []
    for m in _INSIDE.finditer(text, a, end):
        k = next(k for k in range(1, 6) if m.group(k))
        if k == 5 and "f" not in prefix:
            continue
        terms.append(("literal", text[a : m.start()], a, m.start()))
        terms.append(("name", m.group(k), m.start(k), m.end(k)))
        a = m.end()
    terms.append(("literal", text[a:end], a, end))
    return [t for t in terms if t[1]] or terms[-1:]


def _tokens(text: str, start: int, end: int) -> list[tuple[str, int, int]]:
    return [(m.lastgroup or "", m.start(), m.end()) for m in _TOKEN.finditer(text, start, end)]


def _term(text: str, token: tuple[str, int, int]) -> list[Term]:
    kind, a, b = token
    if kind == "string":
        return _quoted(text, a, b)
    if kind == "name":
        return [("name", text[a:b].lstrip("$"), a, b)]
    return [("literal", text[a:b], a, b)] if kind == "bare" else []


def _fallback(text: str, tokens: list[tuple[str, int, int]], at: int) -> list[Term]:
    """The second argument of a lookup whose first is a string, if that is one, too."""
    kinds = [t[0] for t in tokens[at : at + 4]]
    return _quoted(text, *tokens[at + 3][1:]) if kinds == ["open", "string", "comma", "string"] else []


def _expression(text: str, tokens: list[tuple[str, int, int]], at: int) -> list[Term]:
    """Strings, bare values and names from a token on, joined by + or . or side by side as strings."""
    terms: list[Term] = []
    while at < len(tokens):
        kind, a, b = tokens[at]
        if kind == "name" and (at + 1 == len(tokens) or tokens[at + 1][1] != b or tokens[at + 1][0] not in ("bare", "name", "string")):
            follows = tokens[at + 1][0] if at + 1 < len(tokens) else "end"
            # A word that others follow is no name of a constant but part of a bare value, or prose.
            if follows in ("name", "bare", "sign"):
                return terms or [("literal", text[a:b], a, b)]
            if follows == "open" and text[tokens[at + 1][1]] in "([" and _LOOKUP.search(text[a:b]):
                # The string names a secret that lies elsewhere; what it falls back to is a value.
                return terms + _fallback(text, tokens, at + 1)
            if follows == "open" and text[tokens[at + 1][1]] == "(" and at + 2 < len(tokens) and tokens[at + 2][0] == "string":
                return terms + _quoted(text, *tokens[at + 2][1:])
            terms += _term(text, tokens[at])
        elif kind in ("name", "bare"):
            # Letters and other signs of one bare value lie side by side.
            end = at
            while end + 1 < len(tokens) and tokens[end + 1][1] == tokens[end][2] and tokens[end + 1][0] in ("name", "bare", "operator", "sign"):
                end += 1
            terms.append(("literal", text[a : tokens[end][2]], a, tokens[end][2]))
            at = end
        elif kind == "string":
            terms += _quoted(text, a, b)
        else:
            return terms
        at += 1
        if at < len(tokens) and tokens[at][0] == "operator" and text[tokens[at][1]] in "+.":
            at += 1
            if at < len(tokens) and text[tokens[at][1]] == "\n":
                at += 1
        elif not (at < len(tokens) and kind == "string" and tokens[at][0] == "string"):
            return terms
    return terms


def _pairs(text: str, start: int, end: int) -> tuple[list[tuple[int, str, list[Term]]], list[tuple[int, int]]]:
    """((place, name, terms) of the pairs, the comments) in part of a text."""
    tokens = _tokens(text, start, end)
    comments = [(a, b) for kind, a, b in tokens if kind == "comment"]
    tokens = [t for t in tokens if t[0] != "comment"]
    found = []
    for i, (kind, a, b) in enumerate(tokens):
        if kind == "sign" and i:
            j = i - 1
            while j > 0 and text[tokens[j][1]] in "]":
                j -= 1
            left, x, y = tokens[j]
            if left not in ("name", "string") or "\n" in text[y:a]:
                continue
            name = text[x:y].strip("\"'`$") if left == "name" or y - x > 2 else ""
            terms = _expression(text, tokens, i + 1)
            if name and terms and not re.search(r"\s", name):
                found.append((x, name, terms))
        elif kind == "open" and text[a] == "(" and i and i + 3 < len(tokens) and tokens[i - 1][0] == "name" and tokens[i + 1][0] == "string" and tokens[i + 2][0] == "comma":
            terms = _expression(text, tokens, i + 3)
            name = text[tokens[i + 1][1] : tokens[i + 1][2]].strip("\"'`")
            if terms and name:
                found.append((a, name, terms))
    return found, comments


def assignments(text: str) -> list[tuple[str, list[Term]]]:
    """(name, terms) of each name-literal pair, in text order; a term is ('literal' or 'name', value, start, end).

    Pairs in comments have names that no use can reach.
    """
    found, comments = _pairs(text, 0, len(text))
    for a, b in comments:
        # The marks of the comment are no operators of what is in it.
        inner = a + len(re.match(r"[/*#;<!\-\s]*", text[a:b]).group())
        found += [(x, f"{name} ", terms) for x, name, terms in _pairs(text, inner, b)[0]]
    if "<" in text:
        for m in _ELEMENT.finditer(text):
            key = _KEY_ATTRIBUTE.search(m.group(2))
            value = m.group(3).strip()
            if value and not re.search(r"\s", value):
                at = m.start(3) + m.group(3).index(value)
                found.append((m.start(), key.group(1) if key else m.group(1), [("literal", value, at, at + len(value))]))
        for tag in _TAG.finditer(text):
            name = ""
            for m in _NAMED_VALUE.finditer(text, tag.start(), tag.end()):
                if m.group(1) != "value":
                    name = name or m.group(2)
                elif name:
                    if m.group(2):
                        found.append((tag.start(), name, [("literal", m.group(2), m.start(2), m.end(2))]))
                    break
    if ":" in text:
        found += _yaml_pairs(text)
    found.sort(key=lambda f: f[0])
    return [(name, terms) for _, name, terms in found]


def _yaml_pairs(text: str) -> list[tuple[int, str, list[Term]]]:
    """(place, key, terms) of the items and block values below each YAML key.

    One pass with the open keys by their columns: a line belongs to the keys
    left of it, a list also to a key in its own column. Keys inside a block or a
    list are keys, too. What nests deeper is indented more, so the open keys are
    at most as many as the root of the text's length.
    """
    found: list[tuple[int, str, list[Term]]] = []
    keys: list[tuple[int, int, str, int | None]] = []  # column, place, name, where its block starts
    end = 0

    def close(key: tuple[int, int, str, int | None]) -> None:
        _, place, name, start = key
        if start is not None and start < end:
            value = text[start:end].strip()
            if value:
                a = text.index(value[0], start)
                found.append((place, name, [("literal", re.sub(r"\s+", "", value), a, a + len(value))]))

    for line in _LINE.finditer(text):
        whole = line.group()
        shown = whole.lstrip(" ")
        if not shown.strip():
            continue
        column, listed = len(whole) - len(shown), shown[0] == "-"
        while keys and not (column > keys[-1][0] or (listed and column == keys[-1][0])):
            close(keys.pop())
        end = line.end()
        if listed and keys and (m := _ITEM.match(whole)):
            item = ("literal", m.group(1), line.start() + m.start(1), line.start() + m.end(1))
            found += [(place, name, [item]) for _, place, name, start in keys if start is None]
        if shown[-1] in ": |>+-" and (m := _KEY_LINE.match(whole)):
            keys.append((len(m.group(1)), line.start(), m.group(2), line.end() if m.group(3) else None))
    while keys:
        close(keys.pop())
    return found


class _Value:
    """What a definition resolves to: literal pieces, those of other definitions put in, and what scoring needs of them.

    Pieces of one definition that stand in another only once are kept as a link
    to it, so that appending n times takes n small steps."""

    __slots__ = ("count", "head", "own", "parent", "size", "spaced", "tail")

    def __init__(self, own: dict[tuple[int, int], str], parent: _Value | None = None):
        self.own, self.parent = own, parent
        text = "".join(own.values())
        self.count = Counter(text)
        self.size, self.spaced, self.head, self.tail = len(text), " " in text, text[:KEPT], text[-KEPT:]
        if parent:
            self.count.update(parent.count)
            self.size, self.spaced = self.size + parent.size, self.spaced or parent.spaced
            self.head, self.tail = (parent.head + self.head)[:KEPT], (parent.tail + self.tail)[-KEPT:]

    def score(self) -> float:
        """How much the value looks like a secret, as :func:`literal_score` of all pieces together."""
        if self.size < LEAST_LITERAL or self.spaced or PLACEHOLDER.match(self.head if self.size <= KEPT else self.head + self.tail):
            return -9.0
        return _varied(self.count, self.size)

    def pieces(self) -> dict[tuple[int, int], str]:
        chain, at = [], self
        while at:
            chain.append(at.own)
            at = at.parent
        found: dict[tuple[int, int], str] = {}
        for own in reversed(chain):
            found |= own
        return found


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, directly or through other names.

    The pieces of an expression, constants put in for their names, are judged
    as the value they make together.
    """
    if not _MAYBE.search(text):
        return []
    held = assignments(text)
    places: dict[str, list[int]] = {}
    for i, (name, _) in enumerate(held):
        places.setdefault(name, []).append(i)
    # How strongly a name reaches sensitive ones: scores go from names to what they are made of.
    scores = {name: name_score(name) for name in places}
    todo = [name for name in places if scores[name]]
    while todo:
        name = todo.pop()
        for value in {v for i in places[name] for kind, v, _, _ in held[i][1] if kind == "name"}:
            if value in places and scores[value] < scores[name]:
                scores[value] = scores[name]
                todo.append(value)

    def first(name: str, at: int) -> int:
        return places[name][0]

    def nearest(name: str, at: int) -> int:
        """The last definition before a use, or else the first after it."""
        return places[name][max(bisect_left(places[name], at) - 1, 0)]

    spans: set[tuple[int, int]] = set()
    for choose in (first, nearest):
        values: dict[int, _Value] = {}
        taken: set[int] = set()
        for i, (name, _) in enumerate(held):
            if not scores[name]:
                continue
            value = _resolve(i, held, places, choose, values)
            if value.size and scores[name] + value.score() >= LEAST_SCORE:
                # A link that was taken once brings nothing new.
                at = value
                while at and id(at) not in taken:
                    taken.add(id(at))
                    spans.update(at.own)
                    at = at.parent
    return sorted(spans)


def _resolve(i: int, held: list[tuple[str, list[Term]]], places: dict[str, list[int]], choose, values: dict[int, _Value]) -> _Value:
    """The value of a definition; those it uses are resolved first, each once. A definition that leads back to itself adds nothing."""
    todo, open_ = [i], set()
    while todo:
        at = todo[-1]
        if at in values:
            todo.pop()
            continue
        used = list(dict.fromkeys(choose(v, at) for kind, v, _, _ in held[at][1] if kind == "name" and v in places))
        if at not in open_:
            open_.add(at)
            missing = [k for k in used if k not in values and k not in open_]
            if missing:
                todo += reversed(missing)
                continue
        parts = [values[k] for k in used if k in values]
        circular = any(k not in values for k in used if k != at)
        if circular:
            value = _Value(_walk(at, held, places, choose))
        else:
            literals = {(s, e): v for kind, v, s, e in held[at][1] if v and not (kind == "name" and v in places)}
            if len(parts) == 1:
                value = _Value(literals, parts[0])
            else:
                mixed: dict[tuple[int, int], str] = {}
                for part in parts:
                    mixed |= part.pieces()
                value = _Value(mixed | literals)
        values[at] = value
        todo.pop()
    return values[i]


def _walk(i: int, held: list[tuple[str, list[Term]]], places: dict[str, list[int]], choose) -> dict[tuple[int, int], str]:
    """The distinct literal pieces that a definition reaches, where definitions lead back to each other."""
    rest, seen, found = [(i, t) for t in reversed(held[i][1])], {i}, {}
    while rest:
        at, (kind, value, s, e) = rest.pop()
        if kind == "name" and value in places:
            k = choose(value, at)
            if k not in seen:
                seen.add(k)
                rest += [(k, t) for t in reversed(held[k][1])]
        elif value:
            found[s, e] = value
    return found


def all_spans(text: str | None) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, secret_start, secret_end), by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    spans = [(s, KINDS.index(k), e, a, b) for s, k, e, a, b in base]
    spans += [(s, 3, e, s, e) for s, e in lexed_spans(text) if not any(a < e and s < b for _, _, _, a, b in base)]
    return [(KINDS[k], s, e, a, b) for s, k, e, a, b in sorted(spans)]


_FIELDS = ("kind", "start", "end", "secret_start", "secret_end")
SPANS = T.ArrayType(T.StructType([T.StructField(f, T.StringType() if f == "kind" else T.IntegerType()) for f in _FIELDS]))


@F.pandas_udf(SPANS)
def spans_of(text: pd.Series) -> pd.Series:
    return text.map(lambda x: [dict(zip(_FIELDS, s, strict=True)) for s in all_spans(x)])


MASK = "[SECRET]"


@F.pandas_udf(T.StringType())
def redacted(text: pd.Series) -> pd.Series:
    def one(x):
        spans = all_spans(x)
        if not spans:
            return x
        out, at = [], 0
        for a, b in sorted((a, b) for *_, a, b in spans):
            if a >= at:
                out += [x[at:a], MASK]
            at = max(at, b)
        return "".join(out) + x[at:]

    return text.map(one)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and all spans of every row."""
    return docs.select("doc_id", spans_of("text").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every secret replaced by a mask, other columns untouched."""
    return docs.withColumn("text", redacted("text"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
