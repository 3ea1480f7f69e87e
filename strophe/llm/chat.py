"""Chat formatting with a compiled, sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree is
compiled to Python closures that yield ``(text, trained)`` pieces, where
``trained`` marks what stands inside ``{% generation %}``. Closures stream, so
a conversation of any length is rendered in bounded memory.

The language: ``{{ expr }}``, ``{% for x in expr %}``, ``{% if %}``,
``{% elif %}``, ``{% else %}``, ``{% generation %}`` and their ``end`` tags,
``{# #}``. Expressions: strings, integers, names, ``x.field``, ``+``, ``~``,
``== != not and or``, parentheses, and the filters given to ``compile``.
There is no other way to reach Python: names come from the rendered mapping
alone, fields from mappings alone, and there are no calls.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import ship


class TemplateError(ValueError):
    """The template does not parse, or asks for what isn't there."""


# --- syntax tree: nodes are tuples, the first item names the kind -----------

LEXEME = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+~|().]))""", re.S)
BACKSLASHED = {"n": "\n", "t": "\t", "r": "\r"}


def lexemes(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = LEXEME.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return [*out, ("end", "")]


class Expression:
    """Recursive descent: or, and, not, comparison, sum, filter, field, atom."""

    def __init__(self, source: str):
        self.items, self.at = lexemes(source), 0

    def take(self, *values: str) -> str | None:
        kind, value = self.items[self.at]
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.items[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.joined()
        while op := self.take("==", "!="):
            tree = (op, tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while op := self.take("+", "~"):
            tree = (op, tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.field()
        while self.take("|"):
            tree = ("filter", self.name(), tree)
        return tree

    def field(self) -> tuple:
        tree = self.atom()
        while self.take("."):
            tree = ("field", tree, self.name())
        return tree

    def name(self) -> str:
        kind, value = self.items[self.at]
        if kind != "name" or value.startswith("_"):
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def atom(self) -> tuple:
        kind, value = self.items[self.at]
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is open")
            return tree
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: BACKSLASHED.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value in ("true", "false"):
            return ("const", value == "true")
        if kind == "name" and not value.startswith("_"):
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


#: A tag; the signs that end one may stand in its strings.
STRING = r"""\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"""
TAG = re.compile(rf"""(\{{\#.*?\#\}}|\{{\{{(?:{STRING}|[^\"'])*?\}}\}}|\{{%(?:{STRING}|[^\"'])*?%\}})""", re.S)


def parse(template: str) -> tuple:
    """The tree: ``("block", [nodes])``. A ``-`` inside a tag trims blanks on that side."""
    parts = TAG.split(template)
    if left := next((p for p in parts[::2] if re.search(r"\{[{%#]", p)), None):
        raise TemplateError(f"a tag is open in {left!r}")
    for k in range(1, len(parts), 2):
        if parts[k][2] == "-":
            parts[k - 1] = parts[k - 1].rstrip()
        if parts[k][-3] == "-":
            parts[k + 1] = parts[k + 1].lstrip()
    stack: list[tuple[str, list]] = [("", [])]

    def close(tag: str) -> list:
        if stack[-1][0] != tag:
            raise TemplateError(f"end{tag} without {tag}")
        return stack.pop()[1]

    def add(node: tuple) -> None:
        stack[-1][1].append(node)

    branches: list[list] = []
    for k, part in enumerate(parts):
        if k % 2 == 0:
            if part:
                add(("text", part))
            continue
        inside = part[2:-2].strip("-").strip() if part[2:-2].strip() != "-" else ""
        if part.startswith("{#"):
            continue
        if part.startswith("{{"):
            add(("put", Expression(inside).whole()))
            continue
        word, rest = re.match(r"(\w*)\s*(.*)", inside, re.S).groups()
        if word == "for":
            m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"can't read {part!r}")
            stack.append(("for", []))
            branches.append([m[1], Expression(m[2]).whole()])
        elif word == "endfor":
            body = close("for")
            name, over = branches.pop()
            add(("for", name, over, ("block", body)))
        elif word == "if":
            stack.append(("if", []))
            branches.append([[Expression(rest).whole(), None]])
        elif word in ("elif", "else"):
            branches[-1][-1][1] = ("block", close("if"))
            branches[-1].append([Expression(rest).whole() if word == "elif" else ("const", True), None])
            stack.append(("if", []))
        elif word == "endif":
            branches[-1][-1][1] = ("block", close("if"))
            add(("if", [tuple(x) for x in branches.pop()]))
        elif word == "generation":
            stack.append(("generation", []))
        elif word == "endgeneration":
            add(("generation", ("block", close("generation"))))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    return ("block", close(""))


def fold(tree: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    """Constants computed once: operators on constants, dead branches, neighbouring texts."""
    kind = tree[0]
    if kind in ("const", "name", "text"):
        return tree
    if kind == "field":
        return ("field", fold(tree[1], filters), tree[2])
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"unknown filter {tree[1]!r}")
        inner = fold(tree[2], filters)
        return ("const", filters[tree[1]](shown(inner[1]))) if inner[0] == "const" else ("filter", tree[1], inner)
    if kind == "not":
        inner = fold(tree[1], filters)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind in BINARY:
        a, b = fold(tree[1], filters), fold(tree[2], filters)
        if a[0] == "const" and (b[0] == "const" or kind in ("and", "or")):
            if kind == "and":
                return b if a[1] else a
            if kind == "or":
                return a if a[1] else b
            return ("const", BINARY[kind](a[1], b[1]))
        return (kind, a, b)
    if kind == "put":
        inner = fold(tree[1], filters)
        return ("text", shown(inner[1])) if inner[0] == "const" else ("put", inner)
    if kind == "generation":
        return ("generation", fold(tree[1], filters))
    if kind == "for":
        return ("for", tree[1], fold(tree[2], filters), fold(tree[3], filters))
    if kind == "if":
        live = []
        for test, body in ((fold(t, filters), fold(b, filters)) for t, b in tree[1]):
            if test[0] == "const" and not test[1]:
                continue
            live.append((test, body))
            if test[0] == "const":
                break
        if not live:
            return ("text", "")
        return live[0][1] if live[0][0][0] == "const" else ("if", live)
    out: list[tuple] = []
    for node in (fold(x, filters) for x in tree[1]):
        for x in node[1] if node[0] == "block" else [node]:
            if x == ("text", ""):
                continue
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return ("block", out)


def shown(value) -> str:
    return "" if value is None else str(value)


BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else shown(a) + shown(b),
    "~": lambda a, b: shown(a) + shown(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def value_of(tree: tuple, filters: dict) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda names, v=tree[1]: v
    if kind == "name":
        return lambda names, n=tree[1]: names.get(n)
    if kind == "field":
        inner, field = value_of(tree[1], filters), tree[2]

        def look(names: dict):
            x = inner(names)
            return x.get(field) if type(x) is dict else None

        return look
    if kind == "filter":
        f, inner = filters[tree[1]], value_of(tree[2], filters)
        return lambda names: f(shown(inner(names)))
    if kind == "not":
        inner = value_of(tree[1], filters)
        return lambda names: not inner(names)
    a, b = value_of(tree[1], filters), value_of(tree[2], filters)
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    return lambda names, f=BINARY[kind]: f(a(names), b(names))


Piece = tuple[str, bool]


def closure(tree: tuple, filters: dict) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = tree[0]
    if kind == "text":
        return lambda names, on, s=tree[1]: iter(((s, on),))
    if kind == "put":
        inner = value_of(tree[1], filters)
        return lambda names, on: iter(((shown(inner(names)), on),))
    if kind == "generation":
        body = closure(tree[1], filters)
        return lambda names, on: body(names, True)
    if kind == "if":
        cases = [(value_of(t, filters), closure(b, filters)) for t, b in tree[1]]

        def choose(names: dict, on: bool) -> Iterator[Piece]:
            for test, body in cases:
                if test(names):
                    yield from body(names, on)
                    return

        return choose
    if kind == "for":
        name, over, body = tree[1], value_of(tree[2], filters), closure(tree[3], filters)

        def loop(names: dict, on: bool) -> Iterator[Piece]:
            items = iter(over(names) or ())
            now, k = next(items, loop), 0
            while now is not loop:
                then = next(items, loop)
                yield from body(names | {name: now, "loop": {"index0": k, "index": k + 1, "first": k == 0, "last": then is loop}}, on)
                now, k = then, k + 1

        return loop
    bodies = [closure(x, filters) for x in tree[1]]

    def run(names: dict, on: bool) -> Iterator[Piece]:
        for body in bodies:
            yield from body(names, on)

    return run


def compile_template(template: str, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Iterator[Piece]]:
    """Renderer of a template: a mapping of names gives ``(text, trained)`` pieces."""
    run = closure(fold(parse(template), filters), filters)
    return lambda names: (p for p in run(names, False) if p[0])


# --- the default template and its reading -----------------------------------


def escape(text: str) -> str:
    r"""Texts can't hold a control string: ``<`` and ``|`` are parted by one more ``\``."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_line(text: str) -> str:
    r"""For a role, which ends its line: line ends and ``\`` are escaped first."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS = {"escape": escape, "escape_line": escape_line}
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_start|>' + (m.role | escape_line) + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str, int]]:
    """``(role, text, trained text, characters)`` of each turn in rendered output.

    Works on the output's characters and the mask over them alone: turns end
    where the end mark stands, however the output is cut into pieces.
    """
    held: list[Piece] = []
    for piece in pieces:
        held.append(piece)
        if "<|im_end|>\n" not in "".join(t for t, _ in held[-12:]):
            continue
        whole = "".join(t for t, _ in held)
        spans, at = [], 0
        for t, on in held:
            spans.append((at, at + len(t), on))
            at += len(t)
        start = 0
        while (end := whole.find("<|im_end|>\n", start)) >= 0:
            turn, stop = whole[start:end], end + len("<|im_end|>\n")
            if not turn.startswith("<|im_start|>"):
                raise ValueError("a turn has no start mark")
            role, _, text = turn[len("<|im_start|>"):].partition("\n")
            trained = "".join(whole[max(a, start):min(b, stop)] for a, b, on in spans if on and a < stop and b > start)
            yield unescape_line(role), unescape(text), unescape(trained), stop - start
            start = stop
        held = [(whole[max(a, start):b], on) for a, b, on in spans if b > start]
    if "".join(t for t, _ in held):
        raise ValueError("the last turn has no end mark")


def by_turn(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows dealt by conversation, sorted so that each can be streamed.

    Rows with the same turn go by role, then text; null turns come first.
    """
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of sorted batches; each one's turns are read as they are asked for."""
    from itertools import groupby

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for conv, turns in groupby(rows(), key=lambda r: r[0]):
        yield conv, ({"role": role, "text": text} for _, role, text in turns)


def chunks(out: Iterator[tuple], schema: pa.Schema, size: int = 2000, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in out:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or weight >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def format_chats(conversations: DataFrame, template: str = TEMPLATE, filters: dict | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, part, text, trained``: the formatted text, in parts that are joined in order.

    ``trained`` says whether the part stands under the loss mask. Null role or
    text counts as empty; a null id is a conversation of its own. No rows: no
    rows. Other columns are ignored.
    """
    filters = filters or FILTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, filters)
        out = ((conv, k, text, on) for conv, turns in streams(batches) for k, (text, on) in enumerate(render({"messages": turns})))
        return chunks(out, pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("trained", pa.bool_())]))

    return by_turn(conversations, id_col, turn_col, role_col, text_col).mapInArrow(run, "conv_id long, part long, text string, trained boolean")


def chat_digests(conversations: DataFrame, template: str = TEMPLATE, filters: dict | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Digests of what is read back from the formatted output, one row per conversation.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars``. Needs a template that ``read_back`` can read. Nulls,
    ties and empty input as in ``format_chats``.
    """
    filters = filters or FILTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, filters)

        def rows():
            for conv, turns in streams(batches):
                all_turns, loss, n, n_loss, n_out = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for role, text, trained, size in read_back(render({"messages": turns})):
                    all_turns.update(f"{role}\n{text}\n".encode())
                    loss.update(trained.encode())
                    n, n_loss, n_out = n + 1, n_loss + len(trained), n_out + size
                yield conv, n, all_turns.hexdigest(), n_loss, loss.hexdigest(), n_out

        return chunks(rows(), pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return by_turn(conversations, id_col, turn_col, role_col, text_col).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ship(__name__)
