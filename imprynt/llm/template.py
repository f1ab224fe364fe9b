"""A small sandboxed template language: source -> syntax tree -> folded tree -> Python closures.

    {{ expr }}   {% if a %} {% elif b %} {% else %} {% endif %}   {% for m in xs %} {% endfor %}
    {% set x = expr %}   {% generation %} {% endgeneration %}

Expressions: strings, integers, true/false/none, names, fields (m.role), + == != and or not,
parentheses and the filters given to compile_template. There are no calls, no indexing and no
attributes: a field is a key of a dict, and a name that starts with "_" is refused, so a template
reaches only what it is given. A render is a stream of (text, under_generation) pieces, so a loop
over a lazy sequence never holds more than one element.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().]))")
ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None}


class TemplateError(ValueError):
    pass


# ---- expressions: tuples (kind, ...)


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(source.rstrip()):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unreadable expression: {source[at:]!r}")
        text, number, name, sign = m.groups()
        if text is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: ESCAPED.get(e[1], e[1]), text[1:-1], flags=re.S)))
        elif number is not None:
            out.append(("const", int(number)))
        else:
            out.append(("name", name) if name is not None else ("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Precedence, loosest first: or, and, not, == !=, +, filters, fields."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.left, self.filters, self.source = _tokens(source), filters, source

    def take(self, *wanted: tuple[str, object]):
        if self.left and (not wanted or self.left[0] in wanted):
            return self.left.pop(0)
        return None

    def whole(self):
        e = self.either()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0][1]!r} in {self.source!r}")
        return e

    def either(self):
        e = self.both()
        while self.take(("name", "or")):
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.negated()
        while self.take(("name", "and")):
            e = ("and", e, self.negated())
        return e

    def negated(self):
        return ("not", self.negated()) if self.take(("name", "not")) else self.compared()

    def compared(self):
        e = self.added()
        while t := self.take(("sign", "=="), ("sign", "!=")):
            e = (t[1], e, self.added())
        return e

    def added(self):
        e = self.filtered()
        while self.take(("sign", "+")):
            e = ("+", e, self.filtered())
        return e

    def filtered(self):
        e = self.atom()
        while self.take(("sign", "|")):
            t = self.take()
            if not t or t[0] != "name" or t[1] not in self.filters:
                raise TemplateError(f"unknown filter in {self.source!r}")
            e = ("filter", t[1], e)
        return e

    def atom(self):
        if self.take(("sign", "(")):
            e = self.either()
            if not self.take(("sign", ")")):
                raise TemplateError(f"unclosed bracket in {self.source!r}")
            return e
        t = self.take()
        if t is None or t[0] == "sign":
            raise TemplateError(f"a value is missing in {self.source!r}")
        if t[0] == "const":
            return t
        if t[1] in WORDS:
            return ("const", WORDS[t[1]])
        e = ("name", _public(t[1]))
        while self.take(("sign", ".")):
            field = self.take()
            if not field or field[0] != "name":
                raise TemplateError(f"a field name is missing in {self.source!r}")
            e = ("field", e, _public(field[1]))
        return e


def _public(name: str) -> str:
    if name.startswith("_"):
        raise TemplateError(f"{name!r} is not allowed")
    return name


# ---- statements


def parse(source: str, filters: dict[str, Callable]) -> list[tuple]:
    """The syntax tree: nodes ("text", s) ("out", e) ("if", [(e, body)...]) ("for", x, e, body) ("set", x, e) ("gen", body)."""
    pieces, at = [], 0
    for m in TAG.finditer(source):
        pieces += [("text", source[at : m.start()])] if m.start() > at else []
        pieces.append(("out", m[1].strip()) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    pieces += [("text", source[at:])] if at < len(source) else []
    tree, rest, end = _block(pieces, 0, filters, ())
    assert end is None and rest == len(pieces)
    return tree


def _block(pieces: list, at: int, filters: dict, ends: tuple[str, ...]):
    body: list[tuple] = []
    while at < len(pieces):
        kind, text = pieces[at]
        at += 1
        if kind == "text":
            body.append(("text", text))
            continue
        if kind == "out":
            body.append(("out", _Expression(text, filters).whole()))
            continue
        word, _, rest = text.partition(" ")
        if word in ends:
            return body, at, (word, rest)
        if word == "if":
            arms, test = [], _Expression(rest, filters).whole()
            while True:
                inner, at, (end, more) = _needed(_block(pieces, at, filters, ("elif", "else", "endif")), "endif")
                arms.append((test, inner))
                if end == "endif":
                    break
                test = _Expression(more, filters).whole() if end == "elif" else ("const", True)
            body.append(("if", arms))
        elif word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"unreadable loop: {text!r}")
            inner, at, _ = _needed(_block(pieces, at, filters, ("endfor",)), "endfor")
            body.append(("for", _public(m[1]), _Expression(m[2], filters).whole(), inner))
        elif word == "set":
            m = re.fullmatch(r"(\w+)\s*=\s*(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"unreadable assignment: {text!r}")
            body.append(("set", _public(m[1]), _Expression(m[2], filters).whole()))
        elif word == "generation":
            inner, at, _ = _needed(_block(pieces, at, filters, ("endgeneration",)), "endgeneration")
            body.append(("gen", inner))
        else:
            raise TemplateError(f"unknown statement: {text!r}")
    return body, at, None


def _needed(block: tuple, end: str):
    if block[2] is None:
        raise TemplateError(f"{end} is missing")
    return block


# ---- constant folding


def fold_expression(e: tuple, filters: dict) -> tuple:
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind == "field":
        return ("field", fold_expression(e[1], filters), e[2])
    if kind == "filter":
        inner = fold_expression(e[2], filters)
        return ("const", filters[e[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", e[1], inner)
    parts = [fold_expression(x, filters) for x in e[1:]]
    if all(p[0] == "const" for p in parts):
        return ("const", _closure((kind, *parts), filters)({}))
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def fold(tree: list[tuple], filters: dict) -> list[tuple]:
    """Constant expressions become text, neighbouring texts one text, branches never taken go."""
    out: list[tuple] = []
    for node in tree:
        kind, new = node[0], [node]
        if kind == "out":
            e = fold_expression(node[1], filters)
            new = [("text", _text(e[1])) if e[0] == "const" else ("out", e)]
        elif kind == "set":
            new = [("set", node[1], fold_expression(node[2], filters))]
        elif kind == "for":
            new = [("for", node[1], fold_expression(node[2], filters), fold(node[3], filters))]
        elif kind == "gen":
            inner = fold(node[1], filters)
            new = [("gen", inner)] if inner else []
        elif kind == "if":
            arms = []
            for test, body in node[1]:
                test = fold_expression(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(body, filters)))
                if test[0] == "const":
                    break
            new = [] if not arms else arms[0][1] if arms[0][0][0] == "const" else [("if", arms)]
        for n in new:
            if n == ("text", ""):
                continue
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            else:
                out.append(n)
    return out


# ---- closures


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _closure(e: tuple, filters: dict) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda scope, v=e[1]: v
    if kind == "name":
        return lambda scope, n=e[1]: scope.get(n)
    if kind == "field":
        inner = _closure(e[1], filters)
        return lambda scope, n=e[2]: v.get(n) if isinstance(v := inner(scope), dict) else None
    if kind == "filter":
        inner, f = _closure(e[2], filters), filters[e[1]]
        return lambda scope: f(_text(inner(scope)))
    a = _closure(e[1], filters)
    if kind == "not":
        return lambda scope: not a(scope)
    b = _closure(e[2], filters)
    return {
        "+": lambda scope: x + y if isinstance(x := a(scope), int) and isinstance(y := b(scope), int) else _text(x) + _text(b(scope)),
        "==": lambda scope: a(scope) == b(scope),
        "!=": lambda scope: a(scope) != b(scope),
        "and": lambda scope: a(scope) and b(scope),
        "or": lambda scope: a(scope) or b(scope),
    }[kind]


Render = Callable[[dict], Iterator[tuple[str, bool]]]


def _node(node: tuple, filters: dict, inside: bool) -> Render:
    kind = node[0]
    if kind == "text":
        return lambda scope, s=node[1]: iter(((s, inside),))
    if kind == "out":
        value = _closure(node[1], filters)
        return lambda scope: iter(((_text(value(scope)), inside),))
    if kind == "gen":
        return _sequence(node[1], filters, True)
    if kind == "set":
        value = _closure(node[2], filters)

        def assign(scope, name=node[1]):
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "if":
        arms = [(_closure(t, filters), _sequence(b, filters, inside)) for t, b in node[1]]
        return lambda scope: next((body(scope) for test, body in arms if test(scope)), iter(()))
    source, body, name = _closure(node[2], filters), _sequence(node[3], filters, inside), node[1]

    def loop(scope):
        items, index = iter(source(scope) or ()), 0
        for item, last in _with_last(items):
            yield from body({**scope, name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": last}})
            index += 1

    return loop


def _with_last(items):
    try:
        held = next(items)
    except StopIteration:
        return
    for item in items:
        yield held, False
        held = item
    yield held, True


def _sequence(tree: list[tuple], filters: dict, inside: bool) -> Render:
    nodes = [_node(n, filters, inside) for n in tree]
    if len(nodes) == 1:
        return nodes[0]

    def run(scope):
        for n in nodes:
            yield from n(scope)

    return run


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Render:
    """source as a function of a scope that yields (text, under_generation) pieces."""
    return _sequence(fold(parse(source, filters), filters), filters, False)
