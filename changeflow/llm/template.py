"""Compiler of a sandboxed chat template language.

    {{ expression }}                     its value, as text
    {% for x in list %} ... {% endfor %} with loop.index0, loop.first
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}   marks what a model is trained on

Expressions: 'text', whole numbers, true, false, none, names, x.key, ==, !=, not,
and, or, ~ (joins texts), x | filter, parentheses. A template reaches the values it
is given, keys of dicts and the filters it is given, and nothing else: there are no
calls, no attributes of objects and no writes.

``compile_template`` parses a template into a syntax tree, folds what is constant,
and returns a Python closure that renders lazily: it yields (text, in_generation)
pieces, and takes messages from their iterator one at a time, so a conversation
need not be held as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

MAX_DEPTH = 50
PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
WORDS = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*')|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[.|~()]))")
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template isn't of the language, or reaches for what isn't there."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: object
    key: str


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: object


@dataclass(frozen=True)
class Output:
    expr: object


@dataclass(frozen=True)
class If:
    cases: tuple            # of (expression, body)


@dataclass(frozen=True)
class For:
    name: str
    expr: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = WORDS.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Expression:
    """Recursive descent: or, and, not, comparison, ~, filters, keys."""

    def __init__(self, source: str):
        self.rest, self.depth = tokens(source), 0

    def take(self, *values: str) -> str | None:
        if self.rest and self.rest[0][0] != "text" and self.rest[0][1] in values:
            return self.rest.pop(0)[1]
        return None

    def need(self, kind: str) -> str:
        if not self.rest or self.rest[0][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        return self.rest.pop(0)[1]

    def whole(self) -> object:
        e = self.either()
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")
        return e

    def chain(self, part: Callable[[], object], *signs: str) -> object:
        e = part()
        while sign := self.take(*signs):
            e = Op(sign, (e, part()))
        return e

    def either(self) -> object:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        e = self.chain(lambda: self.chain(self.negated, "and"), "or")
        self.depth -= 1
        return e

    def negated(self) -> object:
        negate = False
        while self.take("not"):
            negate = not negate
        e = self.chain(lambda: self.chain(self.filtered, "~"), "==", "!=")
        return Op("not", (e,)) if negate else e

    def filtered(self) -> object:
        e = self.atom()
        while self.take("|"):
            e = Filter(self.need("name"), e)
        return e

    def atom(self) -> object:
        if self.take("("):
            e = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
        elif not self.rest:
            raise TemplateError("an expression is missing")
        else:
            kind, word = self.rest.pop(0)
            if kind == "text":
                e = Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
            elif kind == "number":
                e = Const(int(word))
            elif kind == "name":
                e = Const({"true": True, "false": False, "none": None}[word]) if word in ("true", "false", "none") else Name(word)
            else:
                raise TemplateError(f"unexpected {word!r}")
        while self.take("."):
            e = Key(e, self.need("name"))
        return e


def parse(source: str) -> tuple:
    """The template's syntax tree."""
    parts, depth = PARTS.split(source), 0

    def body(*ends: str) -> tuple[tuple, str, str]:
        nonlocal depth
        depth += 1
        if depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        out: list = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                out.append(Output(Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    depth -= 1
                    return tuple(out), word, rest
                out.append(statement(word, rest))
            elif part:
                out.append(Output(Const(part)))
        if ends[0]:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), "", ""

    def statement(word: str, rest: str) -> object:
        if word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError("for needs: name in expression")
            return For(m[1], Expression(m[2]).whole(), body("endfor")[0])
        if word == "generation":
            return Generation(body("endgeneration")[0])
        if word == "if":
            cases, test = [], Expression(rest).whole()
            while True:
                inner, end, more = body("elif", "else", "endif")
                cases.append((test, inner))
                if end == "elif":
                    test = Expression(more).whole()
                elif end == "else":
                    cases.append((Const(True), body("endif")[0]))
                    return If(tuple(cases))
                else:
                    return If(tuple(cases))
        raise TemplateError(f"unknown statement {word!r}")

    return body("")[0]


def as_text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


APPLY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a,
                              "~": lambda a, b: as_text(a) + as_text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(node: object, filters: dict[str, Callable]) -> object:
    """An expression with its constant parts computed."""
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(APPLY[node.sign](*(a.value for a in args)))
        if node.sign in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.sign == "and") else args[0]
        return Op(node.sign, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        of = fold(node.of, filters)
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Key):
        return Key(fold(node.of, filters), node.key)
    return node


def fold_body(body: tuple, filters: dict[str, Callable]) -> tuple:
    """A body with constant outputs joined and cases that can't be reached left out."""
    out: list = []
    for node in body:
        if isinstance(node, Output):
            e = fold(node.expr, filters)
            node = Output(Const(as_text(e.value)) if isinstance(e, Const) else e)
        elif isinstance(node, For):
            node = For(node.name, fold(node.expr, filters), fold_body(node.body, filters))
        elif isinstance(node, Generation):
            node = Generation(fold_body(node.body, filters))
        elif isinstance(node, If):
            cases = []
            for test, inner in node.cases:
                test = fold(test, filters)
                if not isinstance(test, Const) or test.value:
                    cases.append((test, fold_body(inner, filters)))
                if isinstance(test, Const) and test.value:
                    break
            if cases and isinstance(cases[0][0], Const):
                nodes = cases[0][1]
                for x in nodes:
                    _append(out, x)
                continue
            node = If(tuple(cases))
        _append(out, node)
    return tuple(out)


def _append(out: list, node: object) -> None:
    constant = lambda x: isinstance(x, Output) and isinstance(x.expr, Const)
    if constant(node) and out and constant(out[-1]):
        out[-1] = Output(Const(out[-1].expr.value + node.expr.value))
    elif not (constant(node) and not node.expr.value):
        out.append(node)


def value_of(node: object, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """A closure from the names in scope to the expression's value."""
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):
        def name(scope: dict) -> object:
            if node.name not in scope:
                raise TemplateError(f"unknown name {node.name!r}")
            return scope[node.name]
        return name
    if isinstance(node, Key):
        of = value_of(node.of, filters)

        def key(scope: dict) -> object:
            held = of(scope)
            if type(held) is not dict or node.key not in held:
                raise TemplateError(f"no key {node.key!r}")
            return held[node.key]
        return key
    if isinstance(node, Filter):
        of, apply = value_of(node.of, filters), filters[node.name]
        return lambda scope: apply(of(scope))
    args = [value_of(a, filters) for a in node.args]
    if node.sign == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.sign == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    apply = APPLY[node.sign]
    return lambda scope: apply(*[a(scope) for a in args])


Render = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def renderer(body: tuple, filters: dict[str, Callable]) -> Render:
    """A closure that yields the body's pieces."""
    steps = [_step(node, filters) for node in body]

    def render(scope: dict, marked: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope, marked)
    return render


def _step(node: object, filters: dict[str, Callable]) -> Render:
    if isinstance(node, Output):
        value = value_of(node.expr, filters)

        def output(scope: dict, marked: bool) -> Iterator[tuple[str, bool]]:
            if text := as_text(value(scope)):
                yield text, marked
        return output
    if isinstance(node, Generation):
        inner = renderer(node.body, filters)
        return lambda scope, marked: inner(scope, True)
    if isinstance(node, For):
        items, inner = value_of(node.expr, filters), renderer(node.body, filters)

        def loop(scope: dict, marked: bool) -> Iterator[tuple[str, bool]]:
            for k, item in enumerate(items(scope)):
                yield from inner(scope | {node.name: item, "loop": {"index0": k, "first": k == 0}}, marked)
        return loop
    cases = [(value_of(test, filters), renderer(body, filters)) for test, body in node.cases]

    def choose(scope: dict, marked: bool) -> Iterator[tuple[str, bool]]:
        for test, inner in cases:
            if test(scope):
                yield from inner(scope, marked)
                return
    return choose


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[..., Iterator[tuple[str, bool]]]:
    """``render(**values)`` yields the text's pieces with their generation mark."""
    filters = filters or {}
    render = renderer(fold_body(parse(source), filters), filters)
    return lambda **values: render(values, False)
