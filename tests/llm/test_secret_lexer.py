"""The secret scan's lexer against a plain one that tries every pattern anew and walks all that is open, and on texts made
to be slow."""

import random
import re
import time
from dataclasses import dataclass

import pytest

from flowsieve.llm import secret_scan
from flowsieve.llm.secret_scan import _NAME_CHARS, _PLUS, _USE, GENERIC, LEAST_SCORE, Value, name_score, value_score

_EVENT = re.compile(
    r"""(?P<comment>(?<![^\s])(?:\#|//)[^\n]*|/\*(?s:.*?)\*/)"""
    r"""|(?P<string>\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|"(?:[^"\\\n]|\\.)*+"|(?<![A-Za-z0-9])'(?:[^'\\\n]|\\.)*+'|`[^`\n]*`)"""
    r"""|(?P<open>[\[({])|(?P<close>[\])}])|(?P<assign>(?<![=!<>:+*/%-])(?::=|=>|=(?![=~])|:(?![:/])))"""
)
_ATOM = re.compile(r"""[ \t]*(?:(\"{3}(?s:.*?)\"{3}|'{3}(?s:.*?)'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*`)|([A-Za-z_][A-Za-z0-9_.]*+)|([A-Za-z0-9+/_.=-]++))""")
_AHEAD = re.compile(r"[ \t]*([\[({]|\r?\n|$)")
_CLOSES = {"[": "]", "(": ")", "{": "}"}


@dataclass
class Frame:
    """An open bracket, or a key with an indented block: `path` of names above, the bracket that ends it (or none), the
    column of the key, the constants in it, and the value that its bare literals belong to."""

    path: tuple[str, ...]
    closes: str
    column: int
    known: dict[str, Value]
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


def literal_pairs(text: str, begin: int = 0, stop: int | None = None, comment: bool = False) -> list[tuple[str, Value]]:
    """(target name with the keys above it, value after propagation) of each assignment, in order."""
    stop = len(text) if stop is None else stop
    frames = [Frame((), "", -1, {})]
    out: list[tuple[str, Value]] = []
    string: tuple[int, int] | None = None

    def find(name: str) -> Value | None:
        return next((f.known[name] for f in reversed(frames) if name in f.known), None)

    def literal(value: Value, start: int, end: int, quoted: bool) -> None:
        done = start
        for u in _USE.finditer(text, start, end) if quoted else ():
            if used := find(u[1] or u[2] or u[3]):
                value.add(text[done : u.start()])
                value.use(used)
                done = u.end()
        value.add(text[done:end])
        if end > start:
            value.spans.append((start, end))

    def record(path: tuple[str, ...], value: Value) -> None:
        frames[-1].known[path[-1]] = value
        if len(path) > 1:
            frames[0].known[".".join(path)] = value
        out.append((".".join(path), value))

    at = begin
    while m := _EVENT.search(text, at, stop):
        at, kind = m.end(), m.lastgroup
        if kind == "comment":
            if comment:
                at = m.start() + 2 if m[0][:2] == "/*" else m.start() + 1
            else:
                out += literal_pairs(text, m.start() + 1, m.end(), True)
        elif kind == "string":
            string = (m.start(), m.end())
            if frames[-1].value is not None:
                item = Value()
                literal(item, *_inside(text, *string), True)
                frames[-1].value.uses.append(item)
                out.append((".".join(frames[-1].path), item))
        elif kind == "open":
            frames.append(Frame(frames[-1].path, _CLOSES[m[0]], -1, {}, frames[-1].value if m[0] != "{" else None))
        elif kind == "close":
            depth = next((k for k in range(len(frames) - 1, 0, -1) if frames[k].closes == m[0]), 0)
            if depth:
                del frames[depth:]
        else:
            name, start = _name_before(text, m.start(), string)
            if not name or start < begin:
                continue
            column = start - (text.rfind("\n", 0, start) + 1)
            while not frames[-1].closes and frames[-1].column >= column and len(frames) > 1:
                frames.pop()
            path = (*frames[-1].path, name)
            ahead = _AHEAD.match(text, at, stop)
            if ahead and ahead[1] in _CLOSES:
                frames.append(Frame(path, _CLOSES[ahead[1]], -1, {}, None if ahead[1] == "{" else Value()))
                at = ahead.end()
                continue
            if ahead:  # a key with an indented block, or without a value
                if m[0] == ":" and not text[text.rfind("\n", 0, start) + 1 : start].strip(" -\t"):
                    frames.append(Frame(path, "", column, {}))
                continue
            value = Value()
            while a := _ATOM.match(text, at, stop):
                at = a.end()
                group = a.lastindex
                piece = a[group]
                if group == 2 and text[at : at + 1] == "(":  # a call: its arguments are the name's
                    frames.append(Frame(path, ")", -1, {}, value))
                    at += 1
                    break
                if group == 2 and (used := find(piece)):
                    value.use(used)
                else:
                    literal(value, *(_inside(text, a.start(1), a.end(1)) if group == 1 else a.span(group)), group == 1)
                if not (p := _PLUS.match(text, at, stop)):
                    break
                at = p.end()
            if value.spans or value.uses:
                record(path, value)
    return out


def path_score(path: str) -> float:
    """The score of the last name; where that says nothing, of the nearest one above that does, a little less."""
    *above, name = path.split(".") if "." in path else [path]
    if (own := name_score(name)) or name.lower() not in GENERIC:
        return own
    return max(0.0, next((name_score(n) for n in reversed(above) if n.lower() not in GENERIC), 0.0) - 0.5)


def plain_spans(text):
    best: dict[tuple[int, int], float] = {}
    for name, value in literal_pairs(text):
        if (of_name := path_score(name)) >= 2.0 and (score := of_name + value_score(value)) >= LEAST_SCORE:
            ahead, seen = [value], set()
            while ahead:
                v = ahead.pop()
                if id(v) not in seen:
                    seen.add(id(v))
                    ahead += v.uses
                    best |= {s: max(score, best.get(s, 0.0)) for s in v.spans}
    return sorted((s, e, round(x, 6)) for (s, e), x in best.items())


BITS = [
    "password", "api_key", "value", "db", "x", "token", "name", "=", ":", "= ", ": ", ":=", "{", "}", "[", "]", "(", ")", "\n", "\n  ", "\n    ", '"Zx91kfQw77aa"', "'q8Zr2LmN4x1'", '"${x}/v1x9"', "Zx91kfQw", "+", " + ",
    "f(", ",", ";", "# ", "// ", "/* ", " */", '"', "'", "`", '"""', "'''", "\\", '\\"', "db.x", "-", " ",
    'password = "Zx91kfQw77aa"', "api_key: ", 'token = f("q8Zr2LmN4x1"', 'x = "Zx91kfQw"\n', "token = x + ", "token: [", "password: {value: ", "db:\n  token:\n    value: ", "password=Zx91kfQw77ab\n", "secrets = {", '"api_key": "Zx91kfQw77ac"',
]


@pytest.mark.parametrize("seed", range(5))
def test_spans_by_a_plain_lexer(seed):
    rng, some = random.Random(seed), 0
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(1, 30)))
        got = sorted((s, e, round(x, 6)) for _, s, e, _, x in secret_scan.lexed_spans(text))
        assert got == plain_spans(text), text
        some += bool(got)
    assert some > 1000


HOSTILE = {
    "hashes": "a = 1\n" + "# " * 500_000, "slashes": "a = 1\n" + "// " * 333_000, "block comments": "a = 1\n" + "/* " * 333_000, "braces": "a: " + "{" * 1_000_000, "keys": "a: {" * 250_000, "quotes": "a = '1'" + '"' * 1_000_000,
    "escapes": 'a = 1 "' + '\\"' * 500_000, "escaped values": 'a="' + '\\"x=' * 250_000, "apostrophes": "a = 1 " + "' " * 500_000, "ticks": "a = 1 " + "`" * 999_999, "triple quotes": 'a = """' + "'''" * 333_333,
    "closers": "a = 1" + "(" * 300_000 + "]" * 700_000, "steps": "\n".join(" " * k + "k:" for k in range(1400)), "one line": "a=1," * 250_000, "dotted": "a.b.c.d=" * 125_000, "uses": 'a="' + "${" * 500_000 + '"', "sums": "a=" + "b+" * 500_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_take_linear_time(name):
    whole = HOSTILE[name]

    def seconds(text):
        began = time.process_time()
        secret_scan.all_spans(text)
        return time.process_time() - began

    small, large = min(seconds(whole[: len(whole) // 8]) for _ in range(2)), seconds(whole)
    assert large < 20 and large < 24 * max(small, 0.05)


def test_secrets_below_many_generic_keys():
    for depth in (1, 7, 10, 200, 20_000):
        text = "password: {" + "value: {" * depth + 'data: "Zx91kfQw77aa"' + "}" * (depth + 1)
        assert [text[s:e] for _, s, e, *_ in secret_scan.lexed_spans(text)] == ["Zx91kfQw77aa"]


def test_full_paths_reach_constants():
    text = 'db:\n  part:\n    x: "Zx91kfQw77aa"\nother: 1\nauth_token = "${db.part.x}"\n'
    assert "Zx91kfQw77aa" in [text[s:e] for _, s, e, *_ in secret_scan.lexed_spans(text)]


def test_hostile_documents_pass_the_stage(spark):
    docs = spark.createDataFrame([(k, t[:200_000]) for k, t in enumerate(HOSTILE.values())] + [(99, 'password = "Zx91kfQw77aa"')], "doc_id long, text string")
    assert secret_scan.redact_secrets(docs).where("doc_id = 99").head()["text"].count("[SECRET]") == 1
    assert secret_scan.digest(secret_scan.scan_secrets(docs)).count() == len(HOSTILE) + 1
