"""A small sandboxed template language, compiled to Python closures.

``{{ expression }}`` writes a value, ``{% for x in list %} ... {% endfor %}``, ``{% if %} ... {% elif %} ... {% else %} ... {%
endif %}``, ``{% set name = expression %}`` and ``{# comment #}`` work as usual, a ``-`` at a tag trims the white space beside
it, and ``{% generation %} ... {% endgeneration %}`` marks what a model is trained to write. Expressions have names, keys
(``a.b`` and ``a['b']``), strings, integers, ``true``, ``false``, ``none``, ``+``, ``==``, ``!=``, ``in``, ``not``, ``and``,
``or``, parentheses and the filters of ``FILTERS`` and of the caller.

Source -> tokens -> syntax tree -> folded tree -> closures. A template reaches only the values it is given: keys of
dictionaries, items of lists and listed filters; there are no attributes, calls or loops without a list.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: as_text(v).strip(), "lower": lambda v: as_text(v).lower(), "upper": lambda v: as_text(v).upper(),
    "length": lambda v: len(v) if isinstance(v, (str, list, dict)) else 0,
}
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_WORD = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|[-+()\[\].|=]))", re.S)
_KEYWORDS = {"and", "or", "not", "in", "true", "false", "none"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template is not in the language."""


def as_text(value: Any) -> str:
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


# Syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Apply:
    """An operator or a filter."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Write:
    value: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Choose:
    ways: tuple  # of (condition, body); the last condition may be Const(True)


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# Parser


class _Expression:
    """Recursive descent over the words of one tag."""

    def __init__(self, source: str, filters: Mapping[str, Callable]):
        self.words, self.at, self.filters = [], 0, filters
        place = 0
        while source[place:].strip():
            found = _WORD.match(source, place)
            if not found:
                raise TemplateError(f"cannot read {source[place:].strip()[:30]!r}")
            number, text, name, sign = found.groups()
            if number:
                self.words.append(("const", int(number)))
            elif text:
                self.words.append(("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)))
            else:
                self.words.append(("name" if name and name not in _KEYWORDS else "sign", name or sign))
            place = found.end()

    def peek(self, *signs: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] == "sign" and self.words[self.at][1] in signs

    def take(self, kind: str, value: Any = None) -> Any:
        if self.at >= len(self.words) or self.words[self.at][0] != kind or value not in (None, self.words[self.at][1]):
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return self.words[self.at - 1][1]

    def _left(self, part: Callable, *signs: str) -> Any:
        node = part()
        while self.peek(*signs):
            sign = self.take("sign")
            node = Apply(sign, (node, part()))
        return node

    def either(self) -> Any:
        return self._left(self.both, "or")

    def both(self) -> Any:
        return self._left(self.negated, "and")

    def negated(self) -> Any:
        if self.peek("not"):
            self.take("sign")
            return Apply("not", (self.negated(),))
        return self._left(self.total, "==", "!=", "in")

    def total(self) -> Any:
        return self._left(self.filtered, "+")

    def filtered(self) -> Any:
        node = self.keyed()
        while self.peek("|"):
            self.take("sign")
            name = self.take("name")
            if name not in self.filters:
                raise TemplateError(f"no filter {name}")
            node = Apply(f"|{name}", (node,))
        return node

    def keyed(self) -> Any:
        node = self.single()
        while self.peek(".", "["):
            if self.take("sign") == ".":
                node = Key(node, Const(self.take("name")))
            else:
                node = Key(node, self.either())
                self.take("sign", "]")
        return node

    def single(self) -> Any:
        if self.at >= len(self.words):
            raise TemplateError("an expression is missing")
        kind, value = self.words[self.at]
        self.at += 1
        if kind == "const":
            return Const(value)
        if kind == "name":
            return Name(value)
        if value in ("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[value])
        if value == "-":
            number = self.take("const")
            if not isinstance(number, int):
                raise TemplateError("a minus stands before a number")
            return Const(-number)
        if value == "(":
            node = self.either()
            self.take("sign", ")")
            return node
        raise TemplateError(f"unexpected {value!r}")

    def whole(self) -> Any:
        node = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return node


def parse(source: str, filters: Mapping[str, Callable] = FILTERS) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    parts: list[tuple[str, str]] = []
    place, trim = 0, False
    for tag in _TAG.finditer(source):
        text = source[place:tag.start()]
        text = text.lstrip() if trim else text
        before, after = (tag[1] or tag[4]), (tag[3] or tag[6])
        parts.append(("text", text.rstrip() if before else text))
        if tag[2] is not None:
            parts.append(("write", tag[2]))
        elif tag[5] is not None:
            parts.append(("do", tag[5].strip()))
        place, trim = tag.end(), bool(after)
    rest = source[place:]
    parts.append(("text", rest.lstrip() if trim else rest))
    if any(kind == "text" and re.search(r"\{\{|\{%|\{#", text) for kind, text in parts):
        raise TemplateError("a tag is not closed")
    parts.reverse()
    body, end = _statements(parts, filters)
    if end is not None:
        raise TemplateError(f"unexpected {end!r}")
    return body


def _statements(parts: list[tuple[str, str]], filters: Mapping[str, Callable]) -> tuple[tuple, str | None]:
    """Statements up to a tag that is none (an ``else``, an ``end...``), and that tag."""
    expression = lambda text: _Expression(text, filters).whole()
    out: list[Any] = []
    while parts:
        kind, text = parts.pop()
        if kind == "text":
            out.append(Write(Const(text)))
        elif kind == "write":
            out.append(Write(expression(text)))
        elif found := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", text, re.S):
            body, end = _statements(parts, filters)
            _expect(end, "endfor")
            out.append(Loop(found[1], expression(found[2]), body))
        elif found := re.fullmatch(r"if\s+(.+)", text, re.S):
            ways, condition = [], expression(found[1])
            while True:
                body, end = _statements(parts, filters)
                ways.append((condition, body))
                if end == "else":
                    body, end = _statements(parts, filters)
                    ways.append((Const(True), body))
                    _expect(end, "endif")
                if end == "endif":
                    break
                if not (found := re.fullmatch(r"elif\s+(.+)", end or "", re.S)):
                    raise TemplateError("an if is not closed")
                condition = expression(found[1])
            out.append(Choose(tuple(ways)))
        elif text == "generation":
            body, end = _statements(parts, filters)
            _expect(end, "endgeneration")
            out.append(Generation(body))
        elif found := re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=\s*(.+)", text, re.S):
            out.append(Assign(found[1], expression(found[2])))
        elif text in ("else", "endif", "endfor", "endgeneration") or text.startswith("elif"):
            return tuple(out), text
        else:
            raise TemplateError(f"no statement {text!r}")
    return tuple(out), None


def _expect(end: str | None, wanted: str) -> None:
    if end != wanted:
        raise TemplateError(f"expected {wanted}")


# Meaning of operators


def _plus(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else as_text(a) + as_text(b)


def _inside(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return as_text(a) in b
    return a in b if isinstance(b, (list, dict)) else False


def _key(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key) if isinstance(key, (str, int)) else None
    if isinstance(of, list) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


_OPERATORS: dict[str, Callable] = {
    "+": _plus, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": _inside, "not": lambda a: not a,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


# Constant folding


def fold(node: Any, filters: Mapping[str, Callable] = FILTERS) -> Any:
    """The same tree with constant expressions worked out, constant texts joined and impossible branches dropped."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for each in node:
            each = fold(each, filters)
            for one in each if isinstance(each, tuple) else (each,):
                if isinstance(one, Write) and isinstance(one.value, Const):
                    text = as_text(one.value.value)
                    if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                        out[-1] = Write(Const(out[-1].value.value + text))
                        continue
                    one = Write(Const(text))
                    if not text:
                        continue
                out.append(one)
        return tuple(out)
    if isinstance(node, Key):
        of, key = fold(node.of, filters), fold(node.key, filters)
        return Const(_key(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Key(of, key)
    if isinstance(node, Apply):
        args = tuple(fold(a, filters) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(_function(node.name, filters)(*(a.value for a in args)))
        if node.name in ("and", "or") and isinstance(args[0], Const):  # the second argument decides, or the first does
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        return Apply(node.name, args)
    if isinstance(node, Write):
        return Write(fold(node.value, filters))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value, filters))
    if isinstance(node, Loop):
        over, body = fold(node.over, filters), fold(node.body, filters)
        return () if isinstance(over, Const) and not over.value else Loop(node.name, over, body)
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, Choose):
        ways = []
        for condition, body in node.ways:
            condition = fold(condition, filters)
            if isinstance(condition, Const) and not condition.value:
                continue
            ways.append((condition, fold(body, filters)))
            if isinstance(condition, Const):
                break
        if not ways:
            return ()
        return ways[0][1] if isinstance(ways[0][0], Const) else Choose(tuple(ways))
    return node


def _function(name: str, filters: Mapping[str, Callable]) -> Callable:
    return filters[name[1:]] if name.startswith("|") else _OPERATORS[name]


# Closures


class Output:
    """What a template has written: pieces of text, and the spans [start, end) of code points under generation marks."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.size = self.depth = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Key):
        of, key = _value(node.of, filters), _value(node.key, filters)
        return lambda scope: _key(of(scope), key(scope))
    args = [_value(a, filters) for a in node.args]
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    function = _function(node.name, filters)
    if len(args) == 1:
        return lambda scope, a=args[0]: function(a(scope))
    return lambda scope, a=args[0], b=args[1]: function(a(scope), b(scope))


def _statement(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    if isinstance(node, tuple):
        steps = [_statement(n, filters) for n in node]

        def run(scope: dict, out: Output) -> None:
            for step in steps:
                step(scope, out)

        return steps[0] if len(steps) == 1 else run
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            return lambda scope, out, text=as_text(node.value.value): out.write(text)
        value = _value(node.value, filters)
        return lambda scope, out: out.write(as_text(value(scope)))
    if isinstance(node, Assign):
        value = _value(node.value, filters)
        return lambda scope, out: scope.__setitem__(node.name, value(scope))
    if isinstance(node, Loop):
        over, body = _value(node.over, filters), _statement(node.body, filters)

        def loop(scope: dict, out: Output) -> None:
            items = over(scope)
            if not isinstance(items, list):
                return
            inner, n = dict(scope), len(items)  # what the body sets ends with the loop
            for k, item in enumerate(items):
                inner[node.name] = item
                inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == n - 1, "length": n}
                body(inner, out)

        return loop
    if isinstance(node, Choose):
        ways = [(_value(c, filters), _statement(b, filters)) for c, b in node.ways]

        def choose(scope: dict, out: Output) -> None:
            for condition, body in ways:
                if condition(scope):
                    body(scope, out)
                    return

        return choose
    body = _statement(node.body, filters)

    def generation(scope: dict, out: Output) -> None:
        start, out.depth = out.size, out.depth + 1
        body(scope, out)
        out.depth -= 1
        if not out.depth and out.size > start:
            out.spans.append((start, out.size))

    return generation


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a scope (names to values) to the text and its generation spans."""
    known = {**FILTERS, **(filters or {})}
    run = _statement(fold(parse(source, known), known), known)

    def render(scope: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(scope), out)
        return "".join(out.pieces), out.spans

    return render


# Control strings


class Controls:
    """Escapes control strings inside texts, reversibly.

    A backslash is doubled, and one is put after the first character of each place where a control string begins. So no
    control string is left, overlapping or not, and ``unescape`` gives back the text exactly.
    """

    def __init__(self, strings: tuple[str, ...]):
        if any("\\" in s or len(s) < 2 for s in strings):
            raise TemplateError("control strings have two characters or more and no backslash")
        self.strings = strings
        self._start = re.compile("(?=" + "|".join(map(re.escape, sorted(strings, key=len, reverse=True))) + ")(.)", re.S)

    def escape(self, value: Any) -> str:
        return self._start.sub(r"\1\\", as_text(value).replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)
