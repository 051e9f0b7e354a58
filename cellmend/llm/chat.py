"""Operator 10: chat formatting by a template compiler.

Templates are text with `{{ expression }}` and `{% statement %}`: for/else, if/elif/else,
set, and generation, which marks what a model is trained on. A minus sign inside a delimiter
trims the white space next to it; strings may hold delimiters. Expressions have literals,
names, members, indexes, comparisons, and/or/not/in, `+`, `~` (joining as text) and filters.
The parser makes a syntax tree, constants are folded, and each node becomes a Python closure.
The language is sandboxed: members are looked up in mappings and lists only, never as Python
attributes, nothing can be called but the listed filters, and loops run over given lists.

Control strings inside texts are escaped reversibly: the escape character (itself
escaped) is put behind the first character of each place where one begins, so no text can
make a marker. Output is read back by the markers of ChatML-like templates.

Null texts and roles count as empty. Turns are ordered by their number (null first), ties by
role and text; repeated rows are turns of their own. Rows of null id make one conversation.
An empty table gives no conversations. A conversation is one row of text and so is held whole
by one task.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmend.llm.common import append_columns, col

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Strings that would steer a model, of common chat formats.
CONTROLS = (BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\x1a"
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' }}{{ m.role | escape_name }}{{ '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
_BEGINS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(ESCAPE + "([012])")


class TemplateError(ValueError):
    """The template is malformed, or asks for what the sandbox doesn't have."""


def escape(text: str) -> str:
    return _BEGINS.sub(lambda m: m[0] + ESCAPE + "1", text.replace(ESCAPE, ESCAPE + "0"))


def escape_name(text: str) -> str:
    """For what stands before a line's end."""
    return escape(text).replace("\n", ESCAPE + "2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"0": ESCAPE, "1": "", "2": "\n"}[m[1]], text)


def shown(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


#: All that a template can call.
FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(shown(x)),
    "escape_name": lambda x: escape_name(shown(x)),
    "trim": lambda x: shown(x).strip(),
    "upper": lambda x: shown(x).upper(),
    "lower": lambda x: shown(x).lower(),
    "length": lambda x: len(x or ""),
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, a, b: shown(x).replace(shown(a), shown(b)),
}


@dataclass(frozen=True)
class Node:
    """A node of the syntax tree: its kind, a value, and the nodes below."""

    kind: str
    value: object = None
    below: tuple = ()


_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().,|\[\]=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: What tags hold: strings are whole, whatever they hold.
_INSIDE = r"((?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?)"
_PARTS = re.compile(rf"\{{\{{(-?){_INSIDE}(-?)\}}\}}|\{{%(-?){_INSIDE}(-?)%\}}|\{{#(-?).*?(-?)#\}}", re.S)


class Expressions:
    """A recursive-descent parser of one expression."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *values: str) -> str | None:
        if (x := self.peek()) in values and x is not None:
            self.at += 1
            return x
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name expected")

    def whole(self) -> Node:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.chain("or")
        if self.take("if"):
            test = self.chain("or")
            self.need("else")
            node = Node("choice", None, (test, node, self.choice()))
        return node

    def chain(self, word: str) -> Node:
        part = self.negation if word == "and" else lambda: self.chain("and")
        node = part()
        while self.take(word):
            node = Node(word, None, (node, part()))
        return node

    def negation(self) -> Node:
        return Node("not", None, (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        node = self.sum()
        if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            return Node("compare", op, (node, self.sum()))
        if self.peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
            self.at += 2
            return Node("not", None, (Node("compare", "in", (node, self.sum())),))
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while op := self.take("+", "-", "~"):
            node = Node("sum", op, (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.member()
        while self.take("|"):
            name, more = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    more.append(self.choice())
                    self.take(",")
            node = Node("filter", name, (node, *more))
        return node

    def member(self) -> Node:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = Node("member", None, (node, Node("constant", self.name())))
            else:
                node = Node("member", None, (node, self.choice()))
                self.need("]")
        return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.take("-"):
            return Node("sum", "-", (Node("constant", 0), self.atom()))
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Node("constant", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Node("constant", int(value))
        if kind == "name":
            known = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return Node("constant", known[value]) if value in known else Node("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> Node:
    """The template's syntax tree."""
    parts, at, trimmed = [], 0, False
    for m in _PARTS.finditer(template):
        text = template[at : m.start()]
        text = text.lstrip() if trimmed else text
        parts.append(("text", text.rstrip() if m[1] or m[4] or m[7] else text))
        at, trimmed = m.end(), bool(m[3] or m[6] or m[8])
        if m[2] is not None:
            parts.append(("show", m[2]))
        elif m[5] is not None:
            parts.append(("do", m[5].strip()))
    parts.append(("text", template[at:].lstrip() if trimmed else template[at:]))
    place = 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal place
        nodes = []
        while place < len(parts):
            kind, text = parts[place]
            place += 1
            if kind == "text":
                nodes.append(Node("show", None, (Node("constant", text),)))
                continue
            if kind == "show":
                nodes.append(Node("show", None, (Expressions(text).whole(),)))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return Node("block", None, tuple(nodes)), text
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"malformed loop {text!r}")
                body, end = block("endfor", "else")
                other = block("endfor")[0] if end == "else" else Node("block")
                nodes.append(Node("for", m[1], (Expressions(m[2]).whole(), body, other)))
            elif word == "if":
                nodes.append(condition(rest))
            elif word == "set":
                name, sign, value = rest.partition("=")
                if not sign or not name.strip().isidentifier():
                    raise TemplateError(f"malformed {text!r}")
                nodes.append(Node("set", name.strip(), (Expressions(value).whole(),)))
            elif word == "generation":
                nodes.append(Node("generation", None, (block("endgeneration")[0],)))
            else:
                raise TemplateError(f"unknown statement {text!r}")
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return Node("block", None, tuple(nodes)), ""

    def condition(test: str) -> Node:
        body, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            other = condition(end.partition(" ")[2])
        else:
            other = block("endif")[0] if end == "else" else Node("block")
        return Node("if", None, (Expressions(test).whole(), body, other))

    return block()[0]


def member(x, key):
    """Of a mapping or list; None where there is none. Python's attributes are out of reach."""
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, list | tuple | str) and isinstance(key, int) and -len(x) <= key < len(x):
        return x[key]
    return None


_COMPARE = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
_SUM = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "~": lambda a, b: shown(a) + shown(b)}
_PURE = {"compare", "sum", "not", "and", "or", "choice", "member"}


def fold(node: Node) -> Node:
    """The tree with its constant parts computed, and neighbouring constant output joined."""
    below = tuple(map(fold, node.below))
    node = Node(node.kind, node.value, below)
    if (node.kind in _PURE or node.kind == "filter") and all(b.kind == "constant" for b in below):
        try:
            return Node("constant", compiled(node)({}))
        except TypeError:  # fails where it is rendered, if it is
            return node
    if node.kind == "choice" and below[0].kind == "constant":
        return below[1] if below[0].value else below[2]
    if node.kind == "if" and below[0].kind == "constant":
        return below[1] if below[0].value else below[2]
    if node.kind == "block":
        out: list[Node] = []
        for b in below:
            for x in b.below if b.kind == "block" else (b,):
                constant = x.kind == "show" and x.below[0].kind == "constant"
                if constant and not shown(x.below[0].value):
                    continue
                if constant and out and out[-1].kind == "show" and out[-1].below[0].kind == "constant":
                    out[-1] = Node("show", None, (Node("constant", shown(out[-1].below[0].value) + shown(x.below[0].value)),))
                else:
                    out.append(x)
        return Node("block", None, tuple(out))
    return node


def compiled(node: Node) -> Callable[[dict], object]:
    """The closure that evaluates an expression in a scope."""
    kind, value, parts = node.kind, node.value, [compiled(b) for b in node.below]
    if kind == "constant":
        return lambda scope: value
    if kind == "name":
        return lambda scope: scope.get(value)
    if kind == "member":
        return lambda scope, a=parts[0], b=parts[1]: member(a(scope), b(scope))
    if kind in ("compare", "sum"):
        f = (_COMPARE if kind == "compare" else _SUM)[value]
        return lambda scope, a=parts[0], b=parts[1]: f(a(scope), b(scope))
    if kind == "not":
        return lambda scope, a=parts[0]: not a(scope)
    if kind == "and":
        return lambda scope, a=parts[0], b=parts[1]: a(scope) and b(scope)
    if kind == "or":
        return lambda scope, a=parts[0], b=parts[1]: a(scope) or b(scope)
    if kind == "choice":
        return lambda scope, t=parts[0], a=parts[1], b=parts[2]: a(scope) if t(scope) else b(scope)
    if kind == "filter":
        f, first, more = FILTERS[value], parts[0], parts[1:]
        return (lambda scope: f(first(scope), *(m(scope) for m in more))) if more else (lambda scope: f(first(scope)))
    raise TemplateError(f"no expression: {kind}")


class Output:
    """Rendered text and the spans of it that are trained on."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _statement(node: Node) -> Callable[[dict, Output], None]:
    kind, value, below = node.kind, node.value, node.below
    if kind == "block":
        steps = [_statement(b) for b in below]

        def block(scope, out):
            for step in steps:
                step(scope, out)

        return block
    if kind == "show":
        if below[0].kind == "constant":
            text = shown(below[0].value)
            return lambda scope, out: out.add(text)
        of = compiled(below[0])
        return lambda scope, out: out.add(shown(of(scope)))
    if kind == "set":
        of = compiled(below[0])
        return lambda scope, out: scope.__setitem__(value, of(scope))
    if kind == "if":
        test, yes, no = compiled(below[0]), _statement(below[1]), _statement(below[2])
        return lambda scope, out: yes(scope, out) if test(scope) else no(scope, out)
    if kind == "generation":
        body = _statement(below[0])

        def generation(scope, out):
            start = out.size
            body(scope, out)
            out.spans.append((start, out.size))

        return generation
    if kind == "for":
        over, body, other = compiled(below[0]), _statement(below[1]), _statement(below[2])

        def loop(scope, out):
            found = over(scope)
            if not isinstance(found, list | tuple) or not found:
                other(scope, out)
                return
            outer = {k: scope[k] for k in (value, "loop") if k in scope}
            for i, x in enumerate(found):
                scope[value] = x
                scope["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i + 1 == len(found), "length": len(found)}
                body(scope, out)
            for k in (value, "loop"):
                scope.pop(k, None)
            scope.update(outer)

        return loop
    raise TemplateError(f"no statement: {kind}")


@functools.lru_cache(64)
def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from the template's names to its text and the spans under the loss mask."""
    run = _statement(fold(parse(template)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run(dict(names), out)
        return "".join(out.parts), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn, of a text that marks them as TEMPLATE does."""
    turns = []
    for part in formatted.split(BEGIN)[1:]:
        turn, end, _ = part.partition(END)
        if not end:
            raise TemplateError(f"a turn has no end marker: {part[:40]!r}")
        role, _, text = turn.partition("\n")
        turns.append((unescape(role), unescape(text)))
    return turns


_TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _renderer(template: str):
    render = compile_template(template)

    def work(turns: pa.Array) -> list[list]:
        done = [render({"messages": [{"role": t["role"] or "", "text": t["text"] or ""} for t in x or ()]}) for x in turns.to_pylist()]
        return [[text for text, _ in done], [[{"start": a, "end": b} for a, b in spans] for _, spans in done]]

    return work


def format_conversations(df: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss_spans): a row for each conversation; spans are code points of it."""
    compile_template(template)  # a malformed one fails here
    turns = df.groupBy(col(id_col).alias(id_col)).agg(F.array_sort(F.collect_list(F.struct(F.coalesce(col(turn_col).cast("double"), F.lit(float("-inf"))).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text")))).alias("__turns"))
    fields = [T.StructField("formatted", T.StringType()), T.StructField("loss_spans", _SPANS)]
    return append_columns(turns, ["__turns"], fields, _renderer, template).select(col(id_col), "formatted", "loss_spans")


def _reader():
    def work(formatted: pa.Array, spans: pa.Array) -> list[list]:
        turns, loss = [], []
        for text, at in zip(formatted.to_pylist(), spans.to_pylist(), strict=True):
            turns.append([{"role": r, "text": x} for r, x in read_back(text)])
            loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in at))
        return [turns, loss]

    return work


def read_conversations(df: DataFrame) -> DataFrame:
    """df of format_conversations() with `turns` (roles and texts) and `loss_text`, from its output."""
    return append_columns(df, ["formatted", "loss_spans"], [T.StructField("turns", _TURNS), T.StructField("loss_text", T.StringType())], _reader)
