"""Secret scans by assignment-aware lexing.

Text is lexed as source or configuration: comments, strings (over several lines too), brackets and assignment operators
(`=`, `:`, `:=`, `=>`). Assignments give name-literal pairs: plain and concatenated values, the items of lists, the
arguments of calls, and keys nested in braces or by indentation, whose path counts where their own name says nothing.
Constants are propagated within the braces that hold them, and by their full path: a literal that reaches a sensitive
name through other names, concatenation or `${name}` is scored by that name. What a comment assigns is reported but
reaches nothing outside it. Three fixed patterns are always reported as well. Values and their literals may have any
length and number: names refer to the values that they are made of, and of a value over `WHOLE` characters only what its
score depends on is kept (both ends, length, counts of characters). Time and memory are in proportion to the text, whatever
is nested in it or left open: a comment is lexed for assignments once, and comments within it are its text.

Defined results: null and empty texts have no spans; rows are judged one by one, so repeated rows give equal results;
an empty table gives an empty table; columns that clash with the new ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, col

#: The base patterns and the least length of what they must hold.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: How strongly a part of a target name speaks for a secret.
NAME_WEIGHTS = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 3.0, "pass": 2.0,
    "secret": 3.0, "credential": 3.0, "credentials": 3.0, "token": 2.5, "apikey": 3.0, "auth": 1.5,
    "private": 1.0, "access": 1.0, "api": 1.0, "key": 1.5, "signing": 1.0, "encryption": 1.0, "bearer": 2.0,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*+|\.+|change_?me.*|your[_-].*|example.*|dummy.*|test|none|null|true|false|todo|<.*>|\$\{.*\}|%\(.*\)s)$")
LEAST_SCORE = 4.5
WHOLE, ENDS = 4096, 64

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.ASCII), re.compile(ACCESS), re.compile(HEX)
_TARGETS = re.compile(r"password|passwd|secret|token|api_?key")
_EVENT = re.compile(
    r"""(?P<comment>(?<![^\s])(?:\#|//))|(?P<block>/\*)|(?P<string>"|'''|(?<![A-Za-z0-9])'|`)"""
    r"""|(?P<open>[\[({])|(?P<close>[\])}])|(?P<assign>(?<![=!<>:+*/%-])(?::=|=>|=(?![=~])|:(?![:/])))"""
)
_INSIDE_LINE = {'"': re.compile(r'"(?:[^"\\\n]|\\.)*+"'), "'": re.compile(r"'(?:[^'\\\n]|\\.)*+'"), "`": re.compile(r"`[^`\n]*`")}
_ATOM = re.compile(r"""(?:([A-Za-z_][A-Za-z0-9_.]*+)|([A-Za-z0-9+/_.=-]++))""")
_BLANK = re.compile(r"[ \t]*")
_AHEAD = re.compile(r"[ \t]*([\[({]|\r?\n|$)")
_CLOSES = {"[": "]", "(": ")", "{": "}"}
#: Keys that the reported name of a target has at most; its score looks at all of them.
NAMED = 8
#: Names that say nothing about what they hold; the key above them does.
GENERIC = frozenset(("value", "values", "default", "data", "text", "literal", "content", "string", "plain", "current", "items", "main", "prod", "dev"))
_PLUS = re.compile(r"[ \t]*\+(?!=)")
_USE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}|\$([A-Za-z_][A-Za-z0-9_]*)|%\(([A-Za-z_][A-Za-z0-9_.]*)\)s")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType())]))


def base_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    found = []
    if _TARGETS.search(text.lower()):
        found += [("assign", m.start(), m.end(), m[1], 0.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), "", 0.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [("hex", m.start(), m.end(), "", 0.0) for m in _HEX.finditer(text)]


def name_score(name: str) -> float:
    parts = [w.lower() for w in _WORDS.findall(name)]
    joined = "".join(parts)
    return max(sum(NAME_WEIGHTS.get(p, NAME_WEIGHTS.get(p.removesuffix("s"), 0.0)) for p in parts), 3.0 if "apikey" in joined else 0.0)


class Value:
    """What a name holds: its characters (`text` up to WHOLE of them, then only the ends and the counts), the spans of
    its own literals, the values that it uses, and the best score of a name that any of them reached."""

    __slots__ = ("text", "head", "tail", "length", "counts", "spans", "uses", "best")

    def __init__(self, text: str = ""):
        self.text, self.head, self.tail, self.length, self.counts = "", "", "", 0, None
        self.spans: list[tuple[int, int]] = []
        self.uses: list[Value] = []
        self.best = ("", 0.0)
        self.add(text)

    def add(self, more: str | Value) -> None:
        other = more if isinstance(more, Value) else None
        length = other.length if other else len(more)
        if not length:
            return
        text = other.text if other else more
        if self.text is not None and text is not None and self.length + length <= WHOLE:
            self.text += text
        else:
            if self.counts is None:
                self.counts = Counter(self.text)
                self.head, self.tail, self.text = self.text[:ENDS], self.text[-ENDS:], None
            head, tail = (text[:ENDS], text[-ENDS:]) if text is not None else (other.head, other.tail)
            self.counts.update(Counter(text) if text is not None else other.counts)
            self.head, self.tail = (self.head + head)[:ENDS], (self.tail + tail)[-ENDS:]
        self.length += length

    def use(self, other: Value) -> None:
        self.add(other)
        self.uses.append(other)


def value_score(value: str | Value) -> float:
    """Length, mixed character classes and entropy speak for a secret; blanks and placeholders against it."""
    v = value if isinstance(value, Value) else Value(value)
    n, counts = v.length, v.counts if v.text is None else Counter(v.text)
    if n < 8 or any(c.isspace() for c in counts):
        return -9.0
    # a placeholder is told by its ends and by which characters it has
    if PLACEHOLDER.match(v.head + "".join(counts) + v.tail if v.text is None else v.text):
        return -9.0
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits, letters = any(c.isdigit() for c in counts), any(c.isalpha() for c in counts)
    return 1.0 + (bits >= 2.8) + (digits and letters) - (not digits)


@dataclass(slots=True)
class Target:
    """A name that is assigned to: the names above it by `above`, and the score of the nearest one that says something
    (`own`: that is the name itself; otherwise it counts a little less)."""

    name: str
    above: Target | None
    score: float
    own: bool

    def path(self) -> str:
        """The last NAMED keys, for reports."""
        names, at = [], self
        while at is not None and len(names) < NAMED:
            names.append(at.name)
            at = at.above
        return ".".join(reversed(names))


def target(name: str, above: Target | None) -> Target:
    score, own = above.score if above else 0.0, False
    for part in name.split("."):
        if own := part.lower() not in GENERIC:
            score = name_score(part)
    return Target(name, above, score, own)


@dataclass(slots=True)
class Frame:
    """An open bracket, or a key with an indented block: the target above, the bracket that ends it (or none), the column
    of the key, the names of the constants in it, the place of its keys in the tree of full paths, and the value that its
    bare literals belong to."""

    above: Target | None
    closes: str
    column: int
    known: dict[str, Value]
    tree: dict
    value: Value | None = None


def _name_before(text: str, at: int, string: tuple[int, int] | None) -> tuple[str, int]:
    """(name, its start) of what stands before an assignment."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if string and string[1] == end:
        return text[string[0] + 1 : end - 1], string[0]
    start = end
    while start and text[start - 1] in _NAME_CHARS:
        start -= 1
    name = text[start:end].lstrip(".-")
    return ("" if name[:1].isdigit() else name), start


def _inside(text: str, start: int, end: int) -> tuple[int, int]:
    """The characters within the quotes of a string."""
    n = 3 if end - start >= 6 and text[start : start + 3] in ('"""', "\'\'\'") else 1
    return start + n, end - n


class Lexer:
    """One pass over a text, or over one comment of it (a comment within a comment is text). What is looked for and isn't
    there is looked for once: ends of block comments and of long strings, and of a string in what is left of a line. Open
    names are found by a dictionary, constants of full paths by a tree of keys, so no step looks at all that is open."""

    def __init__(self, text: str, begin: int = 0, stop: int | None = None, comment: bool = False):
        self.text, self.begin, self.stop, self.comment = text, begin, len(text) if stop is None else stop, comment
        self.out: list[tuple[Target, Value]] = []
        self.tree: dict = {}
        self.frames = [Frame(None, "", -1, {}, self.tree)]
        self.open_names: dict[str, list[Value]] = {}
        self.open_brackets = Counter()
        self.missing: set[str] = set()  # ends that the rest of the text hasn't got
        self.unclosed = {}  # quote: end of the line to which it isn't closed
        self.line, self.looked = begin, begin

    # ---- names

    def find(self, name: str) -> Value | None:
        if held := self.open_names.get(name):
            return held[-1]
        if "." not in name:
            return None
        at = self.tree
        for part in name.split("."):
            if (at := at.get(part)) is None:
                return None
        return at.get("")

    def record(self, to: Target, value: Value) -> None:
        frame = self.frames[-1]
        held = self.open_names.setdefault(to.name, [])
        if to.name in frame.known:
            held[-1] = value
        else:
            held.append(value)
        frame.known[to.name] = value
        self.below(frame.tree, to.name)[""] = value
        self.out.append((to, value))

    @staticmethod
    def below(tree: dict, name: str) -> dict:
        for part in name.split("."):
            tree = tree.setdefault(part, {})
        return tree

    def push(self, above: Target | None, closes: str, column: int, tree: dict, value: Value | None = None) -> None:
        self.frames.append(Frame(above, closes, column, {}, tree, value))
        self.open_brackets[closes] += 1

    def pop(self) -> Frame:
        frame = self.frames.pop()
        self.open_brackets[frame.closes] -= 1
        for name in frame.known:
            self.open_names[name].pop()
        return frame

    # ---- characters

    def until(self, end: str, at: int) -> int:
        """Behind the next `end`, or -1."""
        if end in self.missing:
            return -1
        found = self.text.find(end, at, self.stop)
        if found < 0:
            self.missing.add(end)
        return found + len(end) if found >= 0 else -1

    def string_end(self, at: int, value: bool = False) -> int:
        """Where the string that begins at `at` ends, or -1; an apostrophe behind a letter begins one only as a value."""
        quote = self.text[at]
        if quote != "`" and self.text.startswith(quote * 3, at) and (end := self.until(quote * 3, at + 3)) >= 0:
            return end
        if at < self.unclosed.get(quote, -1) or quote == "'" and at and self.text[at - 1].isascii() and self.text[at - 1].isalnum() and not value:
            return -1
        if m := _INSIDE_LINE[quote].match(self.text, at, self.stop):
            return m.end()
        line = self.text.find("\n", at, self.stop)
        self.unclosed[quote] = self.stop if line < 0 else line
        return -1

    def line_start(self, at: int) -> int:
        if at > self.looked:
            found = self.text.rfind("\n", self.looked, at)
            self.line, self.looked = (found + 1 if found >= 0 else self.line), at
        return self.line

    # ---- values

    def literal(self, value: Value, start: int, end: int, quoted: bool) -> None:
        done = start
        for u in _USE.finditer(self.text, start, end) if quoted else ():
            if used := self.find(u[1] or u[2] or u[3]):
                value.add(self.text[done : u.start()])
                value.use(used)
                done = u.end()
        value.add(self.text[done:end])
        if end > start:
            value.spans.append((start, end))

    def value_at(self, at: int, to: Target) -> tuple[int, Value]:
        """(where it ends, the value): literals and names joined by +, or the arguments of a call."""
        value = Value()
        while True:
            at = _BLANK.match(self.text, at, self.stop).end()
            if at < self.stop and self.text[at] in _INSIDE_LINE and (end := self.string_end(at, True)) >= 0:
                self.literal(value, *_inside(self.text, at, end), True)
            elif a := _ATOM.match(self.text, at, self.stop):
                end = a.end()
                if a.lastindex == 1 and self.text[end : end + 1] == "(" and end < self.stop:
                    self.push(to, ")", -1, self.below(self.frames[-1].tree, to.name), value)
                    return end + 1, value
                if a.lastindex == 1 and (used := self.find(a[1])):
                    value.use(used)
                else:
                    self.literal(value, *a.span(), False)
            else:
                return at, value
            at = end
            if not (p := _PLUS.match(self.text, at, self.stop)):
                return at, value
            at = p.end()

    def assign(self, m: re.Match, string: tuple[int, int] | None) -> int:
        at = m.end()
        name, start = _name_before(self.text, m.start(), string)
        if not name or start < self.begin:
            return at
        line = self.line_start(start)
        while not self.frames[-1].closes and self.frames[-1].column >= start - line and len(self.frames) > 1:
            self.pop()
        to = target(name, self.frames[-1].above)
        if ahead := _AHEAD.match(self.text, at, self.stop):
            if ahead[1] in _CLOSES:
                self.push(to, _CLOSES[ahead[1]], -1, self.below(self.frames[-1].tree, name), None if ahead[1] == "{" else Value())
                return ahead.end()
            # a key with an indented block, or without a value
            if m[0] == ":" and not self.text[line:start].strip(" -\t"):
                self.push(to, "", start - line, self.below(self.frames[-1].tree, name))
            return at
        at, value = self.value_at(at, to)
        if value.spans or value.uses:
            self.record(to, value)
        return at

    def run(self) -> list[tuple[Target, Value]]:
        at, string = self.begin, None
        while m := _EVENT.search(self.text, at, self.stop):
            at, kind = m.end(), m.lastgroup
            if kind == "comment" or kind == "block":
                if self.comment:
                    continue
                if kind == "comment":
                    end = self.text.find("\n", at, self.stop)
                    end = self.stop if end < 0 else end
                elif (end := self.until("*/", at)) < 0:
                    continue
                self.out += Lexer(self.text, at, end, True).run()
                at = end
            elif kind == "string":
                if (end := self.string_end(m.start())) < 0:
                    at = m.start() + 1
                    continue
                at, string, frame = end, (m.start(), end), self.frames[-1]
                if frame.value is not None and frame.above is not None:
                    item = Value()
                    self.literal(item, *_inside(self.text, *string), True)
                    frame.value.uses.append(item)
                    self.out.append((frame.above, item))
            elif kind == "open":
                frame = self.frames[-1]
                self.push(frame.above, _CLOSES[m[0]], -1, frame.tree, frame.value if m[0] != "{" else None)
            elif kind == "close":
                if self.open_brackets[m[0]]:
                    while self.pop().closes != m[0]:
                        pass
            else:
                at = self.assign(m, string)
        return self.out


def literal_pairs(text: str) -> list[tuple[Target, Value]]:
    """(target, value after propagation) of each assignment, in order."""
    return Lexer(text).run()


def lexed_spans(text: str) -> list[tuple[str, int, int, str, float]]:
    if "=" not in text and ":" not in text:
        return []
    best: dict[tuple[int, int], tuple[str, float]] = {}
    for to, value in literal_pairs(text):
        of_name = to.score if to.own else max(0.0, to.score - 0.5)
        if of_name >= 2.0 and (score := of_name + value_score(value)) >= LEAST_SCORE:
            name = to.path()
            # a value that a name of this score has reached has passed it on, so each is visited once a score at most
            ahead = [value]
            while ahead:
                v = ahead.pop()
                if score > v.best[1]:
                    v.best = (name, score)
                    ahead += v.uses
                    for s in v.spans:
                        if score > best.get(s, ("", 0.0))[1]:
                            best[s] = (name, score)
    return [("literal", s, e, *x) for (s, e), x in best.items()]


def all_spans(text: str | None) -> list[tuple[str, int, int, str, float]]:
    return sorted(base_spans(text) + lexed_spans(text), key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if text else []


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """docs plus `out`: every span (kind, start, end in code points with end exclusive, target name, score)."""
    return add_columns(docs, [text], [T.StructField(out, SPANS)], lambda texts: [[[dict(zip(("kind", "start", "end", "name", "score"), s, strict=True)) for s in all_spans(t)] for t in texts]])


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each union of overlapping spans of the text replaced by `mark`; other columns stay."""

    def cleaned(texts):
        out = []
        for t in texts:
            spans, kept, at, until = all_spans(t), [], 0, 0
            for _, s, e, *_ in spans:
                if s >= until:
                    kept += [t[at:s], mark]
                at = until = max(until, e)
            out.append("".join(kept) + t[at:] if spans else t)
        return [out]

    return add_columns(docs, [text], [T.StructField(text, T.StringType())], cleaned).select(*[col(c) for c in docs.columns])


def digest(scanned: DataFrame, spans: str = "secret_spans") -> DataFrame:
    """One row per document: counts by base kind, the hash of the base spans, all spans as text."""
    text = lambda keep: F.array_join(F.transform(F.filter(spans, keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text(lambda s: s["kind"] != "literal"), 256).alias("base_sha256"), text(lambda s: F.lit(True)).alias("spans"), count("literal").alias("n_literal")
    )
