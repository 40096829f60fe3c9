"""A small template language, compiled to Python closures.

Text with ``{{ expression }}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}`` /
``{% endif %}``, ``{% for x in list %}`` / ``{% endfor %}``, ``{% set x = e %}`` and
``{% generation %}`` / ``{% endgeneration %}``, which marks the characters rendered
inside it.  A ``-`` next to a bracket strips the white space on its side.

Expressions: string and integer literals, true, false, none, names, ``a.b``,
``a['b']``, ``a[0]``, ``not``, ``and``, ``or``, ``== != < > <= >=``, ``in``,
``+ - * %``, ``x if c else y`` and ``value | filter``.  Within a loop ``loop.index``,
``loop.index0``, ``loop.first``, ``loop.last`` and ``loop.length`` are known.

Sandbox: values are strings, integers, booleans, none, lists and dictionaries; a dot
and brackets look keys and positions up and never reach Python attributes; nothing
can be called but the filters given to the compiler; only lists are looped over; the
nesting of tags and expressions, the length of results and the number of loop steps
are limited.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

MAX_DEPTH = 40
MAX_STEPS = 10_000_000
MAX_CHARS = 1 << 30


class TemplateError(ValueError):
    pass


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Item(NamedTuple):
    of: Any
    key: Any


class Unary(NamedTuple):
    op: str
    a: Any


class Binary(NamedTuple):
    op: str
    a: Any
    b: Any


class Choice(NamedTuple):
    test: Any
    a: Any
    b: Any


class Filter(NamedTuple):
    name: str
    a: Any


class Output(NamedTuple):
    value: Any


class Set(NamedTuple):
    name: str
    value: Any


class If(NamedTuple):
    cases: tuple  # of (test, body)


class For(NamedTuple):
    name: str
    of: Any
    body: tuple


class Generation(NamedTuple):
    body: tuple


TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%<>()\[\].|=]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}


def tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at : at + 12]!r}")
        at, kind = m.end(), m.lastgroup
        value: Any = m[kind]
        if kind == "str":
            value = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[0]), value[1:-1], flags=re.S)
        elif kind == "int":
            value = int(value)
        elif kind == "name" and value in WORDS:
            kind = "op"
        out.append((kind, value))
    return [*out, ("end", None)]


class Expression:
    """Recursive descent over one expression; folds constants as it goes."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.at, self.list, self.filters, self.depth = 0, tokens(source), filters, 0

    def ask(self, *ops: str) -> str | None:
        kind, value = self.list[self.at]
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def need(self, op: str) -> None:
        if not self.ask(op):
            raise TemplateError(f"{op!r} expected, found {self.list[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.list[self.at]
        if kind != "name":
            raise TemplateError(f"a name expected, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        node = self.choice()
        if self.list[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.list[self.at][1]!r}")
        return node

    def choice(self) -> Any:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("expression nested too deeply")
        node = self.levels(0)
        if self.ask("if"):
            test = self.levels(0)
            other = self.choice() if self.ask("else") else Const("")
            node = (node if test.value else other) if isinstance(test, Const) else Choice(test, node, other)
        self.depth -= 1
        return node

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-"), ("*", "%"))

    def levels(self, k: int) -> Any:
        if k == len(self.LEVELS):
            return self.unary()
        node = self.levels(k + 1)
        while op := self.ask(*self.LEVELS[k]):
            node = fold(Binary(op, node, self.levels(k + 1)))
        return node

    def unary(self) -> Any:
        if op := self.ask("not", "-"):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise TemplateError("expression nested too deeply")
            node = fold(Unary(op, self.unary()))
            self.depth -= 1
            return node
        kind, value = self.list[self.at]
        self.at += 1
        if kind in ("str", "int"):
            node: Any = Const(value)
        elif kind == "name":
            node = Name(value)
        elif kind == "op" and value in ("true", "false", "none"):
            node = Const({"true": True, "false": False, "none": None}[value])
        elif kind == "op" and value == "(":
            node = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.ask(".", "[", "|"):
            if op == ".":
                node = Item(node, Const(self.name()))
            elif op == "[":
                node = Item(node, self.choice())
                self.need("]")
            else:
                if (name := self.name()) not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                node = fold(Filter(name, node), self.filters)
        return node


def fold(node: Any, filters: dict[str, Callable] | None = None) -> Any:
    """A constant in place of an expression over constants."""
    if all(isinstance(x, Const) for x in node[1:]):
        try:
            return Const(evaluator(node, filters or {})({}))
        except TemplateError:
            pass  # an error is for the rendering, if it ever gets there
    return node


def _item(of: Any, key: Any) -> Any:
    if type(of) is dict:
        return of.get(key) if isinstance(key, str | int) else None
    if type(of) in (list, tuple, str) and type(key) is int:
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _add(a: Any, b: Any) -> Any:
    if type(a) is type(b) and type(a) in (str, int):
        return a + b
    raise TemplateError("+ needs two strings or two integers")


def _number(f: Callable) -> Callable:
    def of(a: Any, b: Any) -> Any:
        if type(a) is int and type(b) is int and not (f is _mod and b == 0) and max(abs(a), abs(b)) < 1 << 31:
            return f(a, b)
        raise TemplateError("small integers needed")

    return of


def _mod(a: int, b: int) -> int:
    return a % b


def _order(f: Callable) -> Callable:
    def of(a: Any, b: Any) -> bool:
        if type(a) is type(b) and type(a) in (str, int):
            return f(a, b)
        raise TemplateError("only strings or integers have an order")

    return of


def _in(a: Any, b: Any) -> bool:
    if type(b) is str:
        return type(a) is str and a in b
    return type(b) in (list, tuple, dict) and a in b


BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _order(lambda a, b: a < b), ">": _order(lambda a, b: a > b),
    "<=": _order(lambda a, b: a <= b), ">=": _order(lambda a, b: a >= b), "in": _in, "+": _add,
    "-": _number(lambda a, b: a - b), "*": _number(lambda a, b: a * b), "%": _number(_mod),
}


def evaluator(node: Any, filters: dict[str, Callable]) -> Callable[[dict], Any]:
    """A closure over the names in scope."""
    match node:
        case Const(value):
            return lambda scope: value
        case Name(name):
            return lambda scope: scope.get(name)
        case Item(of, key):
            get, at = evaluator(of, filters), evaluator(key, filters)
            if isinstance(key, Const):
                k = key.value
                return lambda scope: _item(get(scope), k)
            return lambda scope: _item(get(scope), at(scope))
        case Unary("not", a):
            get = evaluator(a, filters)
            return lambda scope: not get(scope)
        case Unary(_, a):
            get, minus = evaluator(a, filters), BINARY["-"]
            return lambda scope: minus(0, get(scope))
        case Binary("and", a, b):
            x, y = evaluator(a, filters), evaluator(b, filters)
            return lambda scope: x(scope) and y(scope)
        case Binary("or", a, b):
            x, y = evaluator(a, filters), evaluator(b, filters)
            return lambda scope: x(scope) or y(scope)
        case Binary(op, a, b):
            x, y, f = evaluator(a, filters), evaluator(b, filters), BINARY[op]
            return lambda scope: f(x(scope), y(scope))
        case Choice(test, a, b):
            t, x, y = evaluator(test, filters), evaluator(a, filters), evaluator(b, filters)
            return lambda scope: x(scope) if t(scope) else y(scope)
        case Filter(name, a):
            get, f = evaluator(a, filters), filters[name]
            return lambda scope: f(get(scope))
    raise TemplateError(f"not an expression: {node!r}")


TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}", re.S)


def parse(source: str, filters: dict[str, Callable]) -> tuple:
    """The syntax tree: nodes with constants folded, neighbouring constant text joined, dead branches gone."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in TAG.finditer(source):
        left, right = (m[1], m[3]) if m[2] is not None else (m[4], m[6])
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if left else text))
        pieces.append(("value", m[2]) if m[2] is not None else ("tag", m[5].strip()))
        at, strip = m.end(), bool(right)
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    place = 0

    def block(ends: tuple[str, ...], depth: int) -> tuple[tuple, str]:
        nonlocal place
        if depth > MAX_DEPTH:
            raise TemplateError("tags nested too deeply")
        out: list = []
        while place < len(pieces):
            kind, what = pieces[place]
            place += 1
            if kind == "text":
                out.append(Output(Const(what)))
                continue
            if kind == "value":
                out.append(Output(Expression(what, filters).whole()))
                continue
            word, _, rest = what.partition(" ")
            if word in ends:
                return joined(out), what
            if word == "if":
                cases, test = [], Expression(rest, filters).whole()
                while True:
                    body, end = block(("elif", "else", "endif"), depth + 1)
                    cases.append((test, body))
                    if end == "endif":
                        break
                    if end == "else":
                        cases.append((Const(True), block(("endif",), depth + 1)[0]))
                        break
                    test = Expression(end.partition(" ")[2], filters).whole()
                live = []
                for test, body in cases:
                    if isinstance(test, Const) and not test.value:
                        continue
                    live.append((test, body))
                    if isinstance(test, Const):
                        break
                if live and isinstance(live[0][0], Const):
                    out.extend(live[0][1])
                elif live:
                    out.append(If(tuple(live)))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m or m[1] in WORDS:
                    raise TemplateError(f"for {rest!r}")
                of = Expression(m[2], filters).whole()
                out.append(For(m[1], of, block(("endfor",), depth + 1)[0]))
            elif word == "set":
                name, equals, value = rest.partition("=")
                if not equals or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()) or name.strip() in WORDS:
                    raise TemplateError(f"set {rest!r}")
                out.append(Set(name.strip(), Expression(value, filters).whole()))
            elif what == "generation":
                out.append(Generation(block(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"unknown tag {what!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} expected")
        return joined(out), ""

    return block((), 0)[0]


def joined(nodes: list) -> tuple:
    out: list = []
    for n in nodes:
        if isinstance(n, Output) and isinstance(n.value, Const):
            text = shown(n.value.value)
            if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                text = out.pop().value.value + text
            if text:
                out.append(Output(Const(text)))
        else:
            out.append(n)
    return tuple(out)


def shown(value: Any) -> str:
    if type(value) is str:
        return value
    if value is None:
        return ""
    if type(value) in (int, bool):
        return str(value)
    raise TemplateError("only strings, numbers and truth values can be shown")


class Sink:
    """What is rendered so far, and the marked spans in characters."""

    def __init__(self):
        self.parts: list[str] = []
        self.chars = self.steps = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.chars += len(text)
        if self.chars > MAX_CHARS:
            raise TemplateError("output too long")


def compiler(nodes: tuple, filters: dict[str, Callable]) -> Callable[[dict, Sink], None]:
    steps: list[Callable[[dict, Sink], None]] = []
    for node in nodes:
        match node:
            case Output(Const(text)):
                steps.append(lambda scope, sink, text=text: sink.put(text))
            case Output(value):
                steps.append(lambda scope, sink, get=evaluator(value, filters): sink.put(shown(get(scope))))
            case Set(name, value):

                def assign(scope, sink, name=name, get=evaluator(value, filters)):
                    scope[name] = get(scope)

                steps.append(assign)
            case If(cases):

                def choose(scope, sink, cases=[(evaluator(t, filters), compiler(b, filters)) for t, b in cases]):
                    for test, body in cases:
                        if test(scope):
                            body(scope, sink)
                            return

                steps.append(choose)
            case For(name, of, body):

                def loop(scope, sink, name=name, get=evaluator(of, filters), body=compiler(body, filters)):
                    rows = get(scope)
                    if rows is None:
                        return
                    if type(rows) not in (list, tuple):
                        raise TemplateError("only lists can be looped over")
                    n = len(rows)
                    for i, row in enumerate(rows):
                        sink.steps += 1
                        if sink.steps > MAX_STEPS:
                            raise TemplateError("too many loop steps")
                        body(scope | {name: row, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}}, sink)

                steps.append(loop)
            case Generation(body):

                def mark(scope, sink, body=compiler(body, filters)):
                    start = sink.chars
                    body(scope, sink)
                    if sink.chars > start:
                        sink.spans.append((start, sink.chars))

                steps.append(mark)
    if len(steps) == 1:
        return steps[0]

    def run(scope, sink, steps=tuple(steps)):
        for step in steps:
            step(scope, sink)

    return run


class Template:
    """``render(names)`` gives the text and the spans of its generation blocks."""

    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]] | None = None):
        filters = {"trim": lambda v: shown(v).strip(" \t\r\n"), "lower": lambda v: shown(v).lower(), "upper": lambda v: shown(v).upper()} | (filters or {})
        self.tree = parse(source, filters)
        self.run = compiler(self.tree, filters)

    def render(self, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        self.run(dict(names), sink)
        return "".join(sink.parts), sink.spans
