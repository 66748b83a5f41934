"""Chat formatting with a compiled template.

A template is parsed into a syntax tree, constants are folded, and the tree
becomes Python generators (closures) that stream a conversation's text turn by
turn with markers of what the loss covers.

The language: text, ``{{ expression }}``, ``{% for x in y %}``, ``{% if %}``
``{% elif %}`` ``{% else %}``, ``{% generation %}`` (each ended by ``{% end... %}``);
expressions of names, ``.field``, strings, integers, true, false, none, ``==``,
``!=``, ``~`` (join as text), ``not``, ``and``, ``or`` and ``| filter``.  It is
sandboxed: it has no calls, no Python attributes, no imports, only the fields
of the given values and the filters listed here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from enum import Enum
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of the standard template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
#: A user's turn, an assistant's (under the loss mask) and any other.
TEMPLATE = (
    "{% for message in messages %}"
    "{% if message.role == 'user' %}[INST]{{ message.text | escape }}[/INST]"
    "{% elif message.role == 'assistant' %}<s>{% generation %}{{ message.text | escape }}{% endgeneration %}</s>"
    "{% else %}[ROLE]{{ message.role | escape }}[/ROLE]{{ message.text | escape }}</s>{% endif %}"
    "{% endfor %}")
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Break control strings by a backslash behind their first character, and double backslashes."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class Mark(Enum):
    """What a rendering yields besides text."""

    LOSS_ON, LOSS_OFF, TURN = range(3)


LOSS_ON, LOSS_OFF, TURN = Mark


class TemplateError(ValueError):
    pass


# --- syntax tree: tuples whose first element names the node ---------------------

_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'[^']*'|\"[^\"]*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|.()]))")


def _tokens(source: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
        found.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return found


class _Expression:
    """Recursive descent, loosest binding first."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0
        self.tree = self.binary(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {source!r}")

    LEVELS = (("or",), ("and",), ("==", "!="), ("~",))

    def peek(self):
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, kind=None):
        if self.at >= len(self.tokens) or kind and self.tokens[self.at][0] != kind:
            raise TemplateError("the expression ends too early or has a wrong part")
        self.at += 1
        return self.tokens[self.at - 1]

    def binary(self, level):
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in self.LEVELS[level]:
            left = (self.take()[1], left, self.binary(level + 1))
        return left

    def unary(self):
        if self.peek() == "not":
            self.take()
            return ("not", self.unary())
        kind, text = self.take()
        if text == "(":
            tree = self.binary(0)
            if self.take()[1] != ")":
                raise TemplateError("missing )")
        elif kind == "str":
            tree = ("const", text[1:-1])
        elif kind == "int":
            tree = ("const", int(text))
        elif text in ("true", "false", "none"):
            tree = ("const", {"true": True, "false": False, "none": None}[text])
        elif kind == "name":
            tree = ("name", text)
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek() in (".", "|"):
            op, name = self.take()[1], self.take("name")[1]
            if op == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("field" if op == "." else "filter", tree, name)
        return tree


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts, at = [], 0
    for m in _PART.finditer(source):
        parts += [("text", source[at:m.start()]), ("print", m[1]) if m[1] is not None else ("tag", m[2].strip())]
        at = m.end()
    parts.append(("text", source[at:]))
    body, rest = _block(parts, 0, ())
    return body


def _block(parts, at, ends):
    """Nodes up to a tag whose first word is in ``ends``, and the place of that tag."""
    nodes = []
    while at < len(parts):
        kind, value = parts[at]
        if kind == "text":
            nodes += [("text", value)] if value else []
        elif kind == "print":
            nodes.append(("print", _Expression(value).tree))
        else:
            word, _, rest = value.partition(" ")
            if word in ends:
                return nodes, at
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip())
                if not m:
                    raise TemplateError(f"bad for: {value!r}")
                body, at = _block(parts, at + 1, ("endfor",))
                nodes.append(("for", m[1], _Expression(m[2]).tree, body))
            elif word == "if":
                branches, condition = [], _Expression(rest).tree
                while True:
                    body, at = _block(parts, at + 1, ("elif", "else", "endif"))
                    branches.append((condition, body))
                    word, _, rest = parts[at][1].partition(" ")
                    if word == "endif":
                        break
                    condition = _Expression(rest).tree if word == "elif" else ("const", True)
                nodes.append(("if", branches))
            elif word == "generation":
                body, at = _block(parts, at + 1, ("endgeneration",))
                nodes.append(("generation", body))
            else:
                raise TemplateError(f"unknown or misplaced tag {value!r}")
        at += 1
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return nodes, at


# --- constant folding ------------------------------------------------------------


def _text(value) -> str:
    return "" if value is None else str(value)


_OPERATORS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b),
    "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold_expression(tree):
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind in ("field", "filter"):
        inner = fold_expression(tree[1])
        if kind == "filter" and inner[0] == "const":
            return ("const", FILTERS[tree[2]](_text(inner[1])))
        return (kind, inner, tree[2])
    parts = [fold_expression(t) for t in tree[1:]]
    if all(p[0] == "const" for p in parts):
        return ("const", not parts[0][1] if kind == "not" else _OPERATORS[kind](*(p[1] for p in parts)))
    return (kind, *parts)


def fold(nodes: list) -> list:
    """Constant expressions become text, constant conditions choose their branch, and neighbouring text is joined."""
    out: list = []
    for node in nodes:
        if node[0] == "print":
            tree = fold_expression(node[1])
            new = [("text", _text(tree[1]))] if tree[0] == "const" else [("print", tree)]
        elif node[0] == "for":
            new = [("for", node[1], fold_expression(node[2]), fold(node[3]))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1]))]
        elif node[0] == "if":
            branches = []
            for condition, body in node[1]:
                condition = fold_expression(condition)
                if condition[0] != "const" or condition[1]:
                    branches.append((condition, fold(body)))
                if condition[0] == "const" and condition[1]:
                    break
            known = branches and branches[0][0][0] == "const"
            new = branches[0][1] if known else [("if", branches)] if branches else []
        else:
            new = [node]
        for n in new:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)
    return out


# --- closures ------------------------------------------------------------------------


def _value(tree) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env: tree[1]
    if kind == "name":
        return lambda env: env.get(tree[1])
    if kind == "field":
        inner, name = _value(tree[1]), tree[2]
        return lambda env: v.get(name) if isinstance(v := inner(env), dict) else None
    if kind == "filter":
        inner, use = _value(tree[1]), FILTERS[tree[2]]
        return lambda env: use(_text(inner(env)))
    if kind == "not":
        inner = _value(tree[1])
        return lambda env: not inner(env)
    left, right, operator = _value(tree[1]), _value(tree[2]), _OPERATORS[kind]
    if kind == "and":
        return lambda env: left(env) and right(env)
    if kind == "or":
        return lambda env: left(env) or right(env)
    return lambda env: operator(left(env), right(env))


def _with_last(items: Iterable) -> Iterator[tuple[object, bool]]:
    items = iter(items)
    for item in items:
        for following in items:
            yield item, False
            item = following
        yield item, True


def _render(nodes: list) -> Callable[[dict], Iterator]:
    parts = [_node(n) for n in nodes]

    def run(env):
        for part in parts:
            yield from part(env)
    return run


def _node(node) -> Callable[[dict], Iterator]:
    if node[0] == "text":
        return lambda env: (node[1],)
    if node[0] == "print":
        value = _value(node[1])
        return lambda env: (_text(value(env)),)
    if node[0] == "generation":
        body = _render(node[1])

        def generation(env):
            yield LOSS_ON
            yield from body(env)
            yield LOSS_OFF
        return generation
    if node[0] == "if":
        branches = [(_value(c), _render(body)) for c, body in node[1]]

        def choose(env):
            for condition, body in branches:
                if condition(env):
                    return body(env)
            return ()
        return choose
    _, name, over, body = node[0], node[1], _value(node[2]), _render(node[3])

    def loop(env):
        for n, (item, last) in enumerate(_with_last(over(env) or ())):
            yield TURN
            yield from body({**env, name: item, "loop": {"index0": n, "index": n + 1, "first": n == 0, "last": last}})
    return loop


def compile_template(source: str) -> Callable[[dict], Iterator]:
    """A function that streams text, ``LOSS_ON``, ``LOSS_OFF`` and ``TURN`` (at each
    turn of a loop) for an environment; ``messages`` may be an iterator."""
    return _render(fold(parse(source)))


# --- Spark -------------------------------------------------------------------------------

_PARTS = "conv_id long, part long, formatted string, loss_start array<int>, loss_end array<int>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Format ``rows`` (``conv_id``, ``turn``, ``role``, ``text``).

    One row per turn, in order within its partition: ``conv_id``, ``part`` (0,
    1, ...), ``formatted`` (the parts of a conversation joined are its text)
    and where in it the loss mask begins and ends (code points).  Text of the
    template before the first turn goes with it, and text after the last one
    with that.  A conversation is one sequence, so one task formats it, but it
    streams: no more than a turn is held.

    NULL roles and texts are empty, rows with equal turns are ordered by role
    and text (repeats stay), NULL turns come first, rows without a conv_id are
    one conversation; other columns are ignored."""
    def run(batches):
        render = compile_template(template)  # closures are made in the task: the template travels as text

        def messages():
            for batch in batches:
                for row in batch.to_pylist():
                    yield row["conv_id"], {"role": row["role"], "text": row["text"]}

        out: list[tuple] = []
        for key, group in groupby(messages(), key=lambda m: m[0]):
            part, text, on, off, length = 0, [], [], [], 0
            for piece in render({"messages": (m for _, m in group)}):
                if piece is TURN:
                    if part:
                        out.append((key, part - 1, "".join(text), on, off))
                        text, on, off, length = [], [], [], 0
                    part += 1
                elif piece is LOSS_ON:
                    on.append(length)
                elif piece is LOSS_OFF:
                    off.append(length)
                else:
                    text.append(piece)
                    length += len(piece)
                if len(out) >= 2000:
                    yield _batch(out)
                    out = []
            out.append((key, max(part - 1, 0), "".join(text), on, off))
        yield _batch(out)

    empty = F.lit("")
    plain = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                        F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    ordered = plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, _PARTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["conv_id", "part", "formatted", "loss_start", "loss_end"])


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a text that the standard template made."""
    at = 0
    while at < len(formatted):
        if formatted.startswith("[INST]", at):
            role, begin, close = "user", at + 6, "[/INST]"
        elif formatted.startswith("<s>", at):
            role, begin, close = "assistant", at + 3, "</s>"
        elif formatted.startswith("[ROLE]", at):
            end = formatted.index("[/ROLE]", at)
            role, begin, close = unescape(formatted[at + 6:end]), end + 7, "</s>"
        else:
            raise ValueError(f"no turn begins at {at}")
        end = formatted.index(close, begin)
        yield role, unescape(formatted[begin:end])
        at = end + len(close)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the conversations that :func:`format_conversations` made with
    the standard template, from their formatted text and loss mask alone, in the
    order of its parts (however its rows are stored): ``conv_id``, ``n_turns``, ``turns_sha256``,
    ``loss_chars``, ``loss_sha256``, ``formatted_chars``."""
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")))

        out = []
        for key, parts in groupby(rows(), key=lambda r: r[0]):
            turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, begins, ends in parts:
                chars += len(text)
                for role, said in read_turns(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for a, b in zip(begins, ends):
                    said = unescape(text[a:b])
                    loss_chars += len(said)
                    loss.update(said.encode())
            out.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        columns = list(zip(*out)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    # one conversation's parts in one task, one after another
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long")
