"""Secret scans: three patterns, and literals that reach a name that promises a secret.

A text is read as source or configuration: whatever assigns (``name = value``, ``"name": value``, ``name => value``,
``<name>value</name>``, ``--name value``, ``key: NAME`` followed by ``value: ...``) gives pairs of a name and what its
value is made of: literals, names of earlier values, and both inside concatenations, calls and templates. A constant
carries its literals on to every name that it is assigned to. A literal is a finding if the most telling name that it
reaches, weighed by how much the literal looks like a secret, scores THRESHOLD or more.

All of it is linear in the length of a text: names, strings and gaps are matched possessively, and each definition is
walked through once, from the most telling name on.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: The order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "literal")
THRESHOLD, SHORTEST = 0.4, 6
#: Patterns, and how long a match, or its last group, must be. Letters of the names match in either case, of ASCII only.
_PATTERNS = (
    (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Texts without any of these have no match of the first pattern, or no pair.
_NAMES, _SIGNS = ("password", "passwd", "secret", "token", "api"), ("=", ":", "</", "--")

# Words of names, by how surely what they name is a secret.
TELLING = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 1.0, "pass": 0.8, "secret": 1.0, "secrets": 0.9, "credential": 1.0, "credentials": 1.0,
    "token": 0.9, "jwt": 0.9, "bearer": 0.9, "auth": 0.7, "authorization": 0.8, "apikey": 1.0, "otp": 0.8, "pin": 0.6, "hmac": 0.8, "salt": 0.6, "dsn": 0.6,
    "passwort": 1.0, "kennwort": 1.0, "geheimnis": 1.0, "contraseña": 1.0, "contrasena": 1.0, "clave": 0.8, "secreto": 1.0, "motdepasse": 1.0, "jeton": 0.8,
}
# What makes a key a secret one, and what makes a name speak of a secret without being one.
OF_KEYS = {"api", "access", "private", "secret", "encryption", "encrypt", "signing", "sign", "auth", "session", "master", "shared", "account", "storage", "license", "service", "app", "consumer", "client", "deploy", "ssh"}
ABOUT = {
    "id", "name", "path", "file", "dir", "url", "uri", "endpoint", "type", "length", "len", "size", "count", "max", "min", "limit", "policy", "field", "label", "hint", "format", "pattern", "regex", "expiry", "expires", "ttl",
    "header", "public", "prefix", "suffix", "index", "column", "table", "enabled", "required", "valid", "status", "message", "error", "help", "title", "placeholder", "description", "primary", "foreign", "sort", "version",
}
# What stands in for a literal that isn't given.
STAND_INS = ("example", "placeholder", "changeme", "yourpass", "yourkey", "yourtoken", "yoursecret", "yourapi", "redacted", "undefined", "dummy", "xxxxxx")

_TARGET = re.compile(
    r"""(?<![\w$.\-])(?:--?|\$)?(?P<name>[^\W\d][\w$.\-]*+)(?:\[["']?(?P<key>[\w.\-]++)["']?\])?["'`]?[ \t]*+"""
    r"""(?::[ \t]*+[^\W\d][\w.<>\[\]]*+[ \t]*+(?==[^=>]))?(?P<op>:=|=>|=|:)(?![=:])[ \t]*+"""
)
_STRING = re.compile(r'''[rRbBuUfF@$]{0,2}(?:"""(?P<a>.*?)"""|\'\'\'(?P<b>.*?)\'\'\'|"(?P<c>(?:[^"\\\n]|\\.)*+)"|'(?P<d>(?:[^'\\\n]|\\.)*+)'|`(?P<e>[^`]*+)`)''', re.DOTALL)
_NAME = re.compile(r"(?:\$\{?)?(?P<name>[^\W\d][\w$.\-]*+)\}?(?P<call>[ \t]*+\()?(?P<again>[ \t]*+=(?![=>]))?")
_OPEN, _CLOSE, _COMMA = re.compile(r"(?:\(|new\b)\s*+"), re.compile(r"\s*+\)"), re.compile(r"\s*+,\s*+")
_JOIN, _NEXT_STRING = re.compile(r"\s*+(?:\+|\.\.?|&|\|\||\?\?|or\b)\s*+"), re.compile(r"[ \t]++(?=[\"'])")
_HOLE = re.compile(r"\$?\{\{?\s*+(?P<name>[^\W\d][\w$.]*+)\s*+\}?\}|\$(?P<bare>[A-Z_][A-Z0-9_]++)")
_BARE = re.compile(r"""[^\s"'`#;,&(){}\[\]<>]++(?=[ \t]*+(?:[\n\r;&"'#]|\Z))""")
_ELEMENT = re.compile(r"<(?P<name>[^\W\d][\w.\-:]*+)(?:\s[^<>]*+)?>(?P<value>[^<>\n]++)</(?P=name)\s*+>")
_FLAG = re.compile(r"""(?<!\S)--(?P<name>[^\W\d][\w\-]*+)[ \t]++(?P<value>[^\s"'`\-=][^\s"'`]*+)""")
_WORDS = re.compile(r"[A-Z]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+")
_EMPTY_VALUES = {"none", "null", "true", "false", "undefined", "nil"}


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    target: str | None = None
    score: float | None = None


class _Definition(NamedTuple):
    """A name, the literals of its value (start and end) and the numbers of the definitions that the value uses."""

    name: str
    literals: list[tuple[int, int]]
    uses: list[int]


def pattern_spans(text: str) -> list[Span]:
    """The matches of the patterns, left to right without overlaps for each, that are long enough."""
    found = []
    low = text.lower()
    for kind, (pattern, group, least) in enumerate(_PATTERNS):
        if kind == 0 and not any(x in low for x in _NAMES) or kind == 1 and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append(Span(m.start(), kind, m.end(), m[1].lower() if kind == 0 else None))
    return found


class _Reader:
    """The definitions of a text, in order; a name stands for its latest definition."""

    def __init__(self, text: str) -> None:
        self.text, self.latest, self.definitions = text, {}, []
        self.pending: str | None = None  # the literal of a pair named key or name
        at = [(m.start(), m) for p in (_TARGET, _ELEMENT, _FLAG) for m in p.finditer(text)]
        awaited: list[_Definition] = []  # a = b = ...: those that use the next definition
        for _, m in sorted(at, key=lambda x: x[0]):
            name = m["name"]
            if m.re is _TARGET:
                literals, uses, again = self.value(m)
                name = m["key"] or name
            else:
                literals, uses, again = [m.span("value")], [], False
            name = self.renamed(name, literals, _NAME.match(text, m.end()) if m.re is _TARGET else None)
            found = _Definition(name, literals, uses)
            number = len(self.definitions)
            if not (literals or uses or again):
                self.latest.pop(name, None)  # something that isn't known
                awaited = []
                continue
            self.definitions.append(found)
            for d in awaited:
                d.uses.append(number)
            awaited = [found] if again else []
            self.latest[name] = number

    def renamed(self, name: str, literals: list[tuple[int, int]], bare: re.Match | None) -> str:
        """The name, or that which the pair before gave for a `value`."""
        last = re.split(r"[.\-]", name)[-1].lower()
        if last in ("key", "name", "var", "variable") and (literals or bare):
            self.pending = self.text[slice(*literals[0])] if literals else bare["name"]
        elif last in ("value", "val", "default") and self.pending:
            name, self.pending = self.pending, None
        else:
            self.pending = None
        return name

    def value(self, m: re.Match) -> tuple[list[tuple[int, int]], list[int], bool]:
        """Literals and used definitions of a value, and whether it is the target of another assignment."""
        text, at, depth = self.text, m.end(), 0
        literals: list[tuple[int, int]] = []
        uses: list[int] = []
        while True:
            while o := _OPEN.match(text, at):
                at, depth = o.end(), depth + o[0].count("(")
            first = not (literals or uses or depth)
            s = _STRING.match(text, at)
            n = None if s else _NAME.match(text, at)
            if s:
                begin, end = next(s.span(g) for g in "abcde" if s[g] is not None)
                literals.append((begin, end))
                uses += [self.latest[x] for h in _HOLE.finditer(text, begin, end) if (x := h["name"] or h["bare"]) in self.latest]
                at = s.end()
            elif n and n["call"]:
                at, depth = n.end("call"), depth + 1
                continue
            elif n and n["again"]:
                return literals, uses, first
            elif n and n["name"] in self.latest:
                uses.append(self.latest[n["name"]])
                at = n.end()
            elif first and (bare := self.bare(m, at)):
                return [bare], uses, False
            elif n:
                at = n.end()
            else:
                return literals, uses, False
            while depth and (c := _CLOSE.match(text, at)):
                at, depth = c.end(), depth - 1
            j = _JOIN.match(text, at) or depth and _COMMA.match(text, at) or s and _NEXT_STRING.match(text, at)
            if not j:
                return literals, uses, False
            at = j.end()

    def bare(self, m: re.Match, at: int) -> tuple[int, int] | None:
        """An unquoted value with a digit in it, of a name that begins its line or field, up to the end of that."""
        b = _BARE.match(self.text, at)
        if not b or not any(c.isdigit() for c in b[0]):
            return None
        before = self.before_blanks(m.start())
        for word in ("", "export", "set", "env", "ENV", "-"):
            if self.text.endswith(word, 0, before):
                start = self.before_blanks(before - len(word))
                if not start or self.text[start - 1] in "\n\r;&?\"'":
                    return b.span()
        return b.span() if m[0].startswith("--") else None

    def before_blanks(self, at: int) -> int:
        while at and self.text[at - 1] in " \t":
            at -= 1
        return at


def name_score(name: str) -> float:
    """How surely a name is that of a secret, by the words of its last part, or a little less by those before."""
    best = 0.0
    parts = re.split(r"[.:]", name)
    for part, share in ((parts[-1], 1.0), (" ".join(parts[:-1]), 0.8)):
        words = [w.lower() for w in _WORDS.findall(part)]
        joined = "".join(words)
        score = max((TELLING.get(w, 0.0) for w in [*words, joined]), default=0.0)
        if {"key", "keys"} & set(words) and OF_KEYS & set(words) or any(joined.endswith(k + "key") for k in OF_KEYS):
            score = 1.0
        if "de" in words and "passe" in words:
            score = 1.0
        if ABOUT & set(words):
            score *= 0.3
        best = max(best, score * share)
    return best


def literal_score(literal: str, total: int) -> float:
    """How much a literal looks like a secret; total: the characters of the whole value that it is part of."""
    letters = "".join(c for c in literal.lower() if c.isalnum())
    if total < SHORTEST or not letters or len(set(literal)) < min(3, total) or letters in _EMPTY_VALUES or any(x in letters for x in STAND_INS):
        return 0.0
    if literal[0] in "<%{" or literal.startswith(("$", "/", "./", "../")) or "://" in literal:
        return 0.2
    if any(c.isspace() for c in literal):
        return 0.45 if len(literal.split()) < 8 else 0.2
    if all(c.isalpha() or c in "_-." for c in literal):
        return 0.2 if literal.isupper() or any(w in letters for w in ("password", "secret", "token", "key", "credential")) else 0.5
    return min(1.0, 0.4 + len(set(literal)) / 16)


def literal_spans(text: str) -> list[Span]:
    """The literals that reach a telling name, each with the best of its names and the score."""
    if not any(x in text for x in _SIGNS):
        return []
    definitions = _Reader(text).definitions
    total: list[int] = []
    for d in definitions:
        # what a value uses was defined before, but in a = b = ..., whose length isn't known yet
        total.append(sum(b - a for a, b in d.literals) + sum(total[u] if u < len(total) else SHORTEST for u in d.uses))
    scores = {n: name_score(n) for n in {d.name for d in definitions}}
    found: dict[tuple[int, int], Span] = {}
    seen = [False] * len(definitions)
    for first in sorted((i for i, d in enumerate(definitions) if scores[d.name] > 0), key=lambda i: -scores[definitions[i].name]):
        target, todo = definitions[first].name, [first]
        while todo:
            if seen[i := todo.pop()]:
                continue
            seen[i] = True
            todo += definitions[i].uses
            for a, b in definitions[i].literals:
                score = round(scores[target] * literal_score(_HOLE.sub("", text[a:b]), max(total[first], total[i])), 4)
                if score >= THRESHOLD and ((a, b) not in found or found[a, b].score < score):
                    found[a, b] = Span(a, 3, b, target, score)
    return list(found.values())


def secret_spans(text: str) -> list[Span]:
    """All spans in order of start and kind; a literal inside a pattern's match isn't named again."""
    base = sorted(pattern_spans(text))
    ends = [([s.start for s in base if s.kind == k], [s.end for s in base if s.kind == k]) for k in range(3)]

    def inside(s: Span) -> bool:
        return any((i := bisect_right(starts, s.start) - 1) >= 0 and to[i] >= s.end for starts, to in ends)

    return sorted([*base, *(s for s in literal_spans(text) if not inside(s))])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("target", pa.string()), ("score", pa.float64())]))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = ([{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "target": s.target, "score": s.score} for s in secret_spans(t.as_py().decode(errors="replace"))] for t in batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], names=["doc_id", "spans"])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, target, score) of every row of docs(doc_id, text), by start and then kind.

    Places count code points, the end excluded; bytes that aren't UTF-8 count as one each. Matches of the patterns have
    no score. Null and empty texts have no spans; texts of any length are read whole; null doc_ids and repeated rows
    each get their row; an empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).cast("binary").alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, spans array<struct<kind:string,start:long,end:long,target:string,score:double>>")


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for t in batch.column(1):
            text, parts, at = t.as_py().decode(errors="replace"), [], 0
            for s in secret_spans(text):
                if s.end > at:
                    parts += [text[at : max(at, s.start)], "*" * (s.end - max(at, s.start))]
                    at = s.end
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def masked(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row of docs(doc_id, text), an asterisk for each character of a span; null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(F.col("text")).cast("binary").alias("text"))
    return rows.mapInArrow(_masked, "doc_id long, text string")
