"""Imports and declarations of source files, read from their tokens.

A file is cut into tokens once, comments left out, so names in comments and strings are never taken for code. Each language
says which keywords declare something, and has a function that reads its import statements from the tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache


@dataclass(frozen=True)
class Token:
    """``kind`` is word, text (a string without its quotes) or mark; ``first`` tells the first token of a line."""

    kind: str
    value: str
    first: bool
    line: int


@dataclass
class Found:
    """(relation, how, value) of references, external names, (kind, name) of declarations, and the package if there is one."""

    references: list[tuple[str, str, str]] = field(default_factory=list)
    external: list[str] = field(default_factory=list)
    symbols: list[tuple[str, str]] = field(default_factory=list)
    package: str | None = None


@cache
def _lexer(comment: str, block: str, quotes: str, extra: str) -> re.Pattern:
    parts = []
    if "`" in quotes:  # a regular expression stands where no value can end before it
        parts.append(r"(?P<regex>(?:(?<=[=(,:;!&|?{}\[\n])|(?<=return)|\A)[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*)")
    if block:
        a, b = block.split(" ")
        parts.append(f"(?P<block>{re.escape(a)}.*?(?:{re.escape(b)}|\\Z))")
    if comment:
        parts.append("(?P<comment>(?:" + "|".join(map(re.escape, comment.split(" "))) + ")[^\n]*)")
    for k, q in enumerate(quotes):
        inside = "[^`]" if q == "`" else f"(?:\\\\.|[^\\\\\n{q}])"
        parts.append(f"(?P<text{k}>{q}{inside}*{q})")
    parts += [f"(?P<word>[\\w{extra}]+)", r"(?P<mark>[^\s\w])", r"(?P<line>\n)"]
    return re.compile("|".join(parts), re.DOTALL)


def tokens(text: str, comment: str = "//", block: str = "/* */", quotes: str = "\"'`", extra: str = "") -> list[Token]:
    """Tokens of a text; ``extra`` are characters that words may hold besides letters, digits and underscores."""
    out: list[Token] = []
    first, line = True, 0
    for m in _lexer(comment, block, quotes, extra).finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "line":
            first, line = True, line + 1
        elif kind in ("block", "comment", "regex"):
            line += value.count("\n")
        else:
            named = kind[:4] if kind.startswith("text") else kind
            out.append(Token(named, value[1:-1] if named == "text" else value, first, line))
            first = False
            line += value.count("\n")
    return out


class Reader:
    """Tokens with look-ahead; beyond the end stands an empty mark."""

    def __init__(self, toks: list[Token]):
        self.toks = toks

    def __getitem__(self, i: int) -> Token:
        return self.toks[i] if 0 <= i < len(self.toks) else Token("mark", "", True, -1)

    def words(self, *names: str) -> Iterator[int]:
        """Places of words that are one of ``names`` and no member of something."""
        for i, t in enumerate(self.toks):
            if t.kind == "word" and t.value in names and self[i - 1].value not in (".", "@", ":"):
                yield i

    def name(self, i: int, joiners: str) -> tuple[str, int]:
        """(words from ``i`` on that ``joiners`` connect on one line, the place behind them)."""
        out, line = "", self[i].line
        while self[i].line == line and (self[i].kind == "word" or (self[i].value and self[i].value in joiners)):
            if self[i].kind == "word" and out and out[-1] not in joiners:
                break
            out += self[i].value
            i += 1
        return out, i

    def rest(self, i: int, end: str) -> str:
        """Text of the tokens from ``i`` up to the mark ``end``; words side by side are parted by a space."""
        out = ""
        while self[i].value and self[i].value != end:
            out += (" " if out and out[-1].isalnum() and self[i].kind == "word" else "") + self[i].value
            i += 1
        return out


def declared(r: Reader, kinds: dict[str, str], called: tuple[str, ...] = (), skip: tuple[str, ...] = ("*",), joiners: str = "") -> Iterator[tuple[int, str, str]]:
    """(place, kind, name) of the word behind each declaring keyword; names of keywords in ``called`` are followed by parameters."""
    for i in r.words(*kinds):
        at = i + 1
        while r[at].value in skip:
            at += 1
        if r[at].kind != "word" or r[at].value[0].isdigit():
            continue
        name, behind = r.name(at, joiners) if joiners else (r[at].value, at + 1)
        if r[i].value in called and r[behind].value not in ("(", "<"):
            continue
        yield i, kinds[r[i].value], name


def _text_behind(r: Reader, i: int, stops: tuple[str, ...]) -> str | None:
    """The first string from ``i`` on before one of ``stops``."""
    while r[i].value not in stops or r[i].kind == "text":
        if r[i].kind == "text":
            return r[i].value
        if not r[i].value:
            return None
        i += 1
    return None


def javascript(text: str) -> Found:
    r, out = Reader(tokens(text, extra="$")), Found()
    for i in r.words("import", "require", "export"):
        after = r[i + 1].value
        if r[i].value == "require":
            ref = r[i + 2].value if after == "(" and r[i + 2].kind == "text" else None
        elif r[i].value == "import":
            ref = r[i + 2].value if after == "(" and r[i + 2].kind == "text" else None if after == "(" else _text_behind(r, i + 1, (";", "=", "import", "export", ""))
        else:  # only an export with a source refers to something
            ref = _text_behind(r, i + 1, (";", "=", "(", "import", "export", "function", "class", "const", "let", "var", "default", "")) if after in ("{", "*", "type") else None
        if ref is not None:
            out.references.append(("imports", "module", ref))
    kinds = dict.fromkeys(("function", "class", "interface", "type", "enum"), "symbol") | dict.fromkeys(("const", "let", "var"), "variable")
    out.symbols = [(kind, name) for i, kind, name in declared(r, kinds) if r[i].value != "type" or r[i + 2].value in ("=", "<")]
    return out


def rust(text: str) -> Found:
    # A quote begins a lifetime more often than a character, so only double quotes make strings.
    r, out = Reader(tokens(text, quotes='"')), Found()
    for i in r.words("mod", "use", "extern"):
        word = r[i].value
        if word == "mod" and r[i + 2].value == ";":
            out.references.append(("imports", "rust_module", r[i + 1].value))
        elif word == "use":
            out.references.append(("imports", "qualified", r.rest(i + 1, ";")))
        elif word == "extern" and r[i + 1].value == "crate":
            out.external.append(r[i + 2].value)
    out.symbols = [(k, n) for _, k, n in declared(r, {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait"})]
    return out


def java(text: str) -> Found:
    r, out = Reader(tokens(text)), Found()
    for i in r.words("package", "import"):
        at = i + 1 + (r[i + 1].value == "static")
        name = r.name(at, ".*")[0]
        if r[i].first and r[i].value == "package":
            out.package = out.package or name
        elif r[i].first and name:
            out.references.append(("imports", "qualified", name))
    kinds = {k: k for k in ("class", "interface", "enum", "object")} | {"fun": "function"}
    out.symbols = [(k, n) for _, k, n in declared(r, kinds, called=("fun",))]
    return out


def c(text: str) -> Found:
    r, out = Reader(tokens(text, quotes="\"'")), Found()
    depth, i = 0, 0
    while i < len(r.toks):
        t = r[i]
        if t.value == "#" and t.first and r[i + 1].value == "include":
            if r[i + 2].kind == "text":
                out.references.append(("includes", "relative", r[i + 2].value))
            elif r[i + 2].value == "<":
                out.references.append(("includes", "system", r.rest(i + 3, ">").replace(" ", "")))
        elif t.kind == "word" and t.value in ("class", "struct", "enum") and r[i + 1].kind == "word" and r[i - 1].value != "enum":
            name = r[i + 2].value if r[i + 1].value == "class" else r[i + 1].value
            out.symbols.append(("type", name))
        elif t.value == "namespace" or (t.value == "extern" and r[i + 1].kind == "text"):
            while r[i].value not in ("{", ";", ""):  # what a namespace holds is as good as outside
                i += 1
        elif t.value in ("{", "}") and t.kind == "mark":
            depth = max(0, depth + (1 if t.value == "{" else -1))
        elif t.value == "(" and depth == 0 and r[i - 1].kind == "word":
            name, open_marks, at = r[i - 1].value, 1, i + 1
            while open_marks and r[at].value:
                open_marks += (r[at].value == "(") - (r[at].value == ")")
                at += 1
            while r[at].value in ("const", "noexcept", "override", "final"):
                at += 1
            if r[at].value == "{" and name not in ("if", "for", "while", "switch"):
                out.symbols.append(("function", name))
            i = at - 1
        i += 1
    return out


def csharp(text: str) -> Found:
    r, out = Reader(tokens(text)), Found()
    for i in r.words("namespace", "using"):
        name, behind = r.name(i + 1 + (r[i + 1].value == "static"), ".")
        if r[i].value == "namespace":
            out.package = out.package or name
        elif r[i].first and r[behind].value == ";" and name:
            out.external.append(name.split(".")[0])
    out.symbols = [(k, n) for _, k, n in declared(r, {k: k for k in ("class", "interface", "record", "enum")}, skip=("struct",)) if n != "class"]
    return out


def ruby(text: str) -> Found:
    r, out = Reader(tokens(text, comment="#", block="", quotes="\"'")), Found()
    for i in r.words("require_relative", "require", "load"):
        at = i + 1 + (r[i + 1].value == "(")
        if r[i].first and r[at].kind == "text":
            out.references.append(("imports", "relative" if r[i].value == "require_relative" else "module", r[at].value))
    for i, kind, name in declared(r, {"class": "class", "module": "module", "def": "function"}, joiners=":"):
        if kind == "function":
            at = i + 1 + 2 * (r[i + 1].value == "self" and r[i + 2].value == ".")
            name = r[at].value + (r[at + 1].value if r[at + 1].value in ("!", "?", "=") and r[at + 1].line == r[at].line else "")
        if r[i].first:
            out.symbols.append((kind, name))
    return out


def php(text: str) -> Found:
    r, out = Reader(tokens(text, comment="// #")), Found()
    for i, t in enumerate(r.toks):
        if t.kind == "word" and t.value.lower() in ("include", "include_once", "require", "require_once"):
            at = i + 1 + (r[i + 1].value == "(")
            if r[at].kind == "text":
                out.references.append(("imports", "relative", r[at].value))
        elif t.kind == "word" and t.value == "use" and t.first:
            name = r.name(i + 1, "\\")[0].lstrip("\\")
            if name:
                out.external.append(name.split("\\")[0])
    out.symbols = [(k, n) for _, k, n in declared(r, {k: k for k in ("class", "interface", "function")}, called=("function",), skip=("&",))]
    return out


def swift(text: str) -> Found:
    r, out = Reader(tokens(text, quotes='"')), Found()
    out.external = [r[i + 1].value for i in r.words("import") if r[i].first and r[i + 1].kind == "word"]
    out.symbols = [(k, n) for _, k, n in declared(r, {k: k for k in ("class", "struct", "protocol", "enum")} | {"func": "function"}, called=("func",)) if n not in ("func", "var")]
    return out


def shell(text: str) -> Found:
    out = Found()
    for line in text.split("\n"):
        words = line.split()
        if len(words) > 1 and words[0] in ("source", "."):
            out.references.append(("sources", "relative", words[1].strip("'\"")))
        head = line.strip().removeprefix("function ").lstrip()
        name, bracket, behind = head.partition("(")
        if bracket and name.strip().isidentifier() and behind.lstrip().startswith(")") and behind.lstrip()[1:].lstrip().startswith("{"):
            out.symbols.append(("function", name.strip()))
    return out


def lua(text: str) -> Found:
    r, out = Reader(tokens(text, comment="--", block="--[[ ]]", quotes="\"'")), Found()
    for i in r.words("require"):
        at = i + 1 + (r[i + 1].value == "(")
        if r[at].kind == "text":
            out.external.append(r[at].value)
    out.symbols = [(k, n) for _, k, n in declared(r, {"function": "function"}, joiners=".")]
    return out


def go(text: str) -> Found:
    r, out = Reader(tokens(text, quotes="\"`")), Found()
    for i in r.words("package", "import"):
        if not r[i].first:
            continue
        if r[i].value == "package":
            out.package = out.package or r[i + 1].value
        elif r[i + 1].value == "(":
            at = i + 2
            while r[at].value not in (")", "") or r[at].kind == "text":
                if r[at].kind == "text":
                    out.references.append(("imports", "go", r[at].value))
                at += 1
        else:
            ref = r[i + 1] if r[i + 1].kind == "text" else r[i + 2]
            if ref.kind == "text":
                out.references.append(("imports", "go", ref.value))
    for i in r.words("type", "func"):
        at = i + 1
        if r[i].value == "func" and r[at].value == "(":  # the receiver
            while r[at].value not in (")", ""):
                at += 1
            at += 1
        if r[i].first and r[at].kind == "word":
            out.symbols.append(("type" if r[i].value == "type" else "function", r[at].value))
    return out


READERS: dict[str, Callable[[str], Found]] = {f.__name__: f for f in (javascript, rust, java, c, csharp, ruby, php, swift, shell, lua, go)}


def headings(text: str) -> list[str]:
    """Texts of Markdown headings: one to six number signs, white space, the text, and perhaps closing signs."""
    out = []
    for line in text.split("\n"):
        body = line.lstrip("#")
        depth = len(line) - len(body)
        if 1 <= depth <= 6 and body[:1].isspace() and (title := body.strip().rstrip("#").rstrip()):
            out.append(" ".join(title.split()))
    return out


def links(text: str) -> Iterator[tuple[str, str]]:
    """(label, target) of Markdown links and images, and (\"\", target) of wiki links, in the order of their places."""
    at = text.find("[")
    while at >= 0:
        if text.startswith("[[", at):
            end = text.find("]]", at)
            if end > 0 and (target := text[at + 2 : end].split("|")[0].split("#")[0]).strip():
                yield "", target
            at = text.find("[", at + 2)
            continue
        end = text.find("]", at)
        if end < 0:
            return
        if text.startswith("(", end + 1):
            close = text.find(")", end)
            target = text[end + 2 : close].split() if close > 0 else []
            if target and (len(target) == 1 or target[1][0] in "\"'"):
                yield text[at + 1 : end], target[0]
        at = text.find("[", at + 1)
