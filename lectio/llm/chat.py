"""Chat formatting by compiled templates.

A template is text with {{ expressions }} and {% for %}, {% if %}, {% set %} and {% generation %} blocks, in a language of
its own that can do nothing but look up names and items, compare, join and filter. It is parsed into a syntax tree, its
constants are folded (with the settings that don't change from one conversation to the next), and what is left becomes a
tree of Python closures that yield text. Text inside a generation block is marked: it bears the loss. A for block knows
loop.first, loop.last, loop.index and loop.index0.

The filter `escaped` puts a backslash before each backslash and before each control string inside a text, so that no
text can look like a turn's marks; Reader takes that back, and tells of each piece whether it was marked. A conversation
is rendered once, as a whole. A template that names `messages` only in one for block gets them one by one, so that a
conversation is never held as a whole, however many turns it has; others get a list.

Defined results. Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own. A
null text or role is the empty string. Rows with a null conv_id make one conversation. No rows give no conversations.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectio.llm.common import ship, table

TURNS = (
    "{% for m in messages %}{{ turn_start }}{{ m.role | escaped }}{{ head_end }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escaped }}{% endgeneration %}{% else %}{{ m.text | escaped }}{% endif %}"
    "{{ turn_end }}{% endfor %}"
)
MARKS = {"turn_start": "### ", "head_end": ": ", "turn_end": "</turn>\n"}
#: What is escaped within texts and roles: the escape itself and whatever the reader takes for a mark.
CONTROL = ("\\", "###", ": ", "</turn>")
ESCAPE = re.compile("|".join(map(re.escape, CONTROL)))


class TemplateError(ValueError):
    pass


# --- syntax tree ---------------------------------------------------------------------------------------------------


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Attr(NamedTuple):
    of: Any
    name: str


class Index(NamedTuple):
    of: Any
    at: Any


class Filter(NamedTuple):
    of: Any
    name: str


class Binary(NamedTuple):
    op: str
    left: Any
    right: Any


class Not(NamedTuple):
    of: Any


class Emit(NamedTuple):
    of: Any


class Set(NamedTuple):
    name: str
    of: Any


class For(NamedTuple):
    name: str
    over: Any
    body: tuple


class If(NamedTuple):
    branches: tuple  # of (condition, body)
    other: tuple


class Generation(NamedTuple):
    body: tuple


#: Filters take the text of what is no text; length also takes lists and messages
FILTERS: dict[str, Callable[[Any], Any]] = {
    "escaped": lambda v: ESCAPE.sub(lambda m: "\\" + m[0], str(v)),
    "trim": lambda v: str(v).strip(" \t\n\r\x0b\x0c"),
    "upper": lambda v: str(v).upper(),
    "lower": lambda v: str(v).lower(),
    "length": lambda v: len(v) if hasattr(v, "__len__") else len(str(v)),
}
OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: f"{a}{b}",
}
TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()\[\]]))")
TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)


class _Expression:
    """Recursive descent: or, and, not, comparison, + and ~, filters, attributes and items."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, kind: str | None = None) -> str:
        if self.at >= len(self.tokens) or (kind and self.tokens[self.at][0] != kind):
            raise TemplateError(f"expected {kind or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        node = self.disjunction()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def disjunction(self):
        node = self.conjunction()
        while self.peek("or"):
            self.take()
            node = Binary("or", node, self.conjunction())
        return node

    def conjunction(self):
        node = self.negation()
        while self.peek("and"):
            self.take()
            node = Binary("and", node, self.negation())
        return node

    def negation(self):
        if self.peek("not"):
            self.take()
            return Not(self.negation())
        node = self.sum()
        if self.peek("==", "!=", "<", "<=", ">", ">=", "in"):
            node = Binary(self.take(), node, self.sum())
        elif self.peek("not"):
            self.take()
            if not self.peek("in"):
                raise TemplateError("expected in")
            node = Not(Binary(self.take(), node, self.sum()))
        return node

    def sum(self):
        node = self.filtered()
        while self.peek("+", "~"):
            node = Binary(self.take(), node, self.filtered())
        return node

    def filtered(self):
        node = self.value()
        while self.peek("|"):
            self.take()
            name = self.take("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Filter(node, name)
        return node

    def value(self):
        if self.peek("("):
            self.take()
            node = self.disjunction()
            if not self.peek(")"):
                raise TemplateError("expected )")
            self.take()
        else:
            kind = self.tokens[self.at][0] if self.at < len(self.tokens) else None
            if kind == "str":
                node = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), self.take()[1:-1], flags=re.S))
            elif kind == "int":
                node = Const(int(self.take()))
            else:
                name = self.take("name")
                node = Const({"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else Name(name)
        while self.peek(".", "["):
            if self.take() == "[":
                node = Index(node, self.disjunction())
                if not self.peek("]"):
                    raise TemplateError("expected ]")
                self.take()
                continue
            name = self.take("name")
            if name.startswith("_"):
                raise TemplateError(f"no attribute {name!r}")
            node = Attr(node, name)
        return node


def parse(template: str) -> tuple:
    """The syntax tree of a template: a tuple of statements."""
    pieces, at = [], 0
    for m in TAG.finditer(template):
        if m.start() > at:
            pieces.append(("text", template[at : m.start()]))
        if m[1] is not None:
            pieces.append(("emit", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(template):
        pieces.append(("text", template[at:]))
    pieces.reverse()

    def block(*ends: str) -> tuple[tuple, str]:
        body = []
        while pieces:
            kind, text = pieces.pop()
            if kind == "text":
                body.append(Emit(Const(text)))
            elif kind == "emit":
                body.append(Emit(_Expression(text).whole()))
            elif (word := text.split(None, 1)[0] if text else "") in ends:
                return tuple(body), text
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", text, re.S)
                if not m:
                    raise TemplateError(text)
                body.append(For(m[1], _Expression(m[2]).whole(), block("endfor")[0]))
            elif word == "if":
                branches, other, end = [], (), text
                while end.split(None, 1)[0] in ("if", "elif"):
                    condition = _Expression(end.split(None, 1)[1]).whole()
                    inner, end = block("elif", "else", "endif")
                    branches.append((condition, inner))
                if end == "else":
                    other = block("endif")[0]
                body.append(If(tuple(branches), other))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            elif word == "set":
                m = re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=(?!=)\s*(.+)", text, re.S)
                if not m:
                    raise TemplateError(text)
                body.append(Set(m[1], _Expression(m[2]).whole()))
            else:
                raise TemplateError(f"unexpected {text!r}")
        if ends:
            raise TemplateError(f"expected {' or '.join(ends)}")
        return tuple(body), ""

    return block()[0]


def nodes(tree: Any) -> Iterator[Any]:
    """All nodes of a tree, itself included."""
    if isinstance(tree, tuple):
        if type(tree) is not tuple:
            yield tree
        if not isinstance(tree, Const):
            for part in tree:
                yield from nodes(part)


#: The value of names, fields and items that aren't there
MISSING = ""


def member(of: Any, key: Any) -> Any:
    """A field or item; MISSING where there is none."""
    try:
        return of[key]
    except (KeyError, IndexError, TypeError):
        return MISSING


def shown(node: Any) -> str:
    """An expression as a template has it, to say where something went wrong."""
    if isinstance(node, Const):
        return repr(node.value)
    if isinstance(node, Name):
        return node.name
    if isinstance(node, Attr):
        return f"{shown(node.of)}.{node.name}"
    if isinstance(node, Index):
        return f"{shown(node.of)}[{shown(node.at)}]"
    if isinstance(node, Filter):
        return f"{shown(node.of)} | {node.name}"
    if isinstance(node, Not):
        return f"not {shown(node.of)}"
    return f"{shown(node.left)} {node.op} {shown(node.right)}"


def applied(node: Any, f: Callable, *values: Any) -> Any:
    """f of the values; what fails is one kind of error, which names the expression."""
    try:
        return f(*values)
    except (TypeError, ValueError, AttributeError) as e:
        raise TemplateError(f"{shown(node)}: {e}") from e


def fold(node: Any, known: dict[str, Any]) -> Any:
    """An expression with what is known put in and computed. What can't be computed stays: its branch may never run."""
    if isinstance(node, Name):
        return Const(known[node.name]) if node.name in known else node
    if isinstance(node, (Attr, Filter, Not)):
        node = node._replace(of=fold(node.of, known))
        if not isinstance(node.of, Const) or isinstance(node, Attr):
            return node
        f = FILTERS[node.name] if isinstance(node, Filter) else operator.not_
        return computed(node, f, node.of.value)
    if isinstance(node, Index):
        node = Index(fold(node.of, known), fold(node.at, known))
        return Const(member(node.of.value, node.at.value)) if isinstance(node.of, Const) and isinstance(node.at, Const) else node
    if isinstance(node, Binary):
        node = Binary(node.op, fold(node.left, known), fold(node.right, known))
        if node.op in ("and", "or"):
            if isinstance(node.left, Const):
                return node.right if bool(node.left.value) == (node.op == "and") else node.left
        elif isinstance(node.left, Const) and isinstance(node.right, Const):
            return computed(node, OPERATORS[node.op], node.left.value, node.right.value)
    return node


def computed(node: Any, f: Callable, *values: Any) -> Any:
    try:
        return Const(applied(node, f, *values))
    except TemplateError:
        return node


def fold_body(body: tuple, known: dict[str, Any]) -> tuple:
    """Statements with constants folded: neighbouring texts become one, decided branches go."""
    out: list = []

    def push(s: Any) -> None:
        if isinstance(s, Emit) and isinstance(s.of, Const):
            text = str(s.of.value)
            if out and isinstance(out[-1], Emit) and isinstance(out[-1].of, Const):
                out[-1] = Emit(Const(out[-1].of.value + text))
            elif text:
                out.append(Emit(Const(text)))
        else:
            out.append(s)

    for s in body:
        if isinstance(s, Emit):
            push(Emit(fold(s.of, known)))
        elif isinstance(s, For):
            inner = {k: v for k, v in known.items() if k not in (s.name, "loop")}
            push(For(s.name, fold(s.over, known), fold_body(s.body, inner)))
        elif isinstance(s, Generation):
            push(Generation(fold_body(s.body, known)))
        elif isinstance(s, Set):
            push(Set(s.name, fold(s.of, known)))
        else:
            branches, other = [], s.other
            for condition, inner in s.branches:
                condition = fold(condition, known)
                if not isinstance(condition, Const):
                    branches.append((condition, fold_body(inner, known)))
                elif condition.value:
                    other = inner
                    break
            other = fold_body(other, known)
            if branches:
                push(If(tuple(branches), other))
            else:
                for inner in other:
                    push(inner)
    return tuple(out)


# --- closures ------------------------------------------------------------------------------------------------------


def closure(node: Any) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        return lambda scope, n=node.name: scope.get(n, MISSING)
    if isinstance(node, Attr):
        return lambda scope, of=closure(node.of), n=node.name: member(of(scope), n)
    if isinstance(node, Index):
        return lambda scope, of=closure(node.of), at=closure(node.at): member(of(scope), at(scope))
    if isinstance(node, Filter):
        return lambda scope, of=closure(node.of), f=FILTERS[node.name]: applied(node, f, of(scope))
    if isinstance(node, Not):
        return lambda scope, of=closure(node.of): not of(scope)
    left, right = closure(node.left), closure(node.right)
    if node.op == "and":
        return lambda scope: left(scope) and right(scope)
    if node.op == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope, f=OPERATORS[node.op]: applied(node, f, left(scope), right(scope))


def body_closure(body: tuple, marked: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    steps = [statement_closure(s, marked) for s in body]

    def run(scope: dict) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(scope)

    return run


def statement_closure(s: Any, marked: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    if isinstance(s, Emit):
        return lambda scope, of=closure(s.of): ((str(of(scope)), marked),)
    if isinstance(s, Generation):
        return body_closure(s.body, True)
    if isinstance(s, If):
        branches = [(closure(c), body_closure(b, marked)) for c, b in s.branches]
        other = body_closure(s.other, marked)
        return lambda scope: next((b for c, b in branches if c(scope)), other)(scope)
    if isinstance(s, Set):
        return lambda scope, of=closure(s.of), n=s.name: scope.update({n: of(scope)}) or ()
    over, body = closure(s.over), body_closure(s.body, marked)

    def loop(scope: dict) -> Iterator[tuple[str, bool]]:
        items = applied(s.over, iter, over(scope))
        ahead, k = next(items, END), 0
        while ahead is not END:
            item, ahead = ahead, next(items, END)  # one ahead, for loop.last
            yield from body({**scope, s.name: item, "loop": {"first": k == 0, "last": ahead is END, "index": k + 1, "index0": k}})
            k += 1

    return loop


END = object()


class Template:
    """render(messages=...): pieces of (text, whether it bears the loss)."""

    def __init__(self, template: str, settings: dict[str, Any]):
        tree = parse(template)
        assigned = {n.name for n in nodes(tree) if isinstance(n, Set)}
        self.tree = fold_body(tree, {k: v for k, v in settings.items() if k not in assigned})
        self.run = body_closure(self.tree)

    def __call__(self, **scope: Any) -> Iterator[tuple[str, bool]]:
        return self.run(dict(scope))

    def streams(self, name: str) -> bool:
        """Whether the name is needed once only, to go through it; not inside another loop."""
        uses = sum(isinstance(n, Name) and n.name == name for n in nodes(self.tree))
        loops = [n for n in nodes(self.tree) if isinstance(n, For)]
        own = [n for n in loops if n.over == Name(name)]
        return uses == len(own) == 1 and not any(n is not own[0] and any(x is own[0] for x in nodes(n.body)) for n in loops)


def compiled(template: str, settings: dict[str, Any]) -> Template:
    return Template(template, settings)


# --- reading back --------------------------------------------------------------------------------------------------


class Reader:
    """Reads formatted text back, piece by piece: events ("between" | "role" | "text" | "head" | "end", unescaped text,
    whether it was marked)."""

    #: The escape or a mark; a mark's beginning at the end of what is there has to wait for more.
    SEEN = re.compile(r"\\(?:" + "|".join(map(re.escape, CONTROL)) + r")|###[ ]|: |</turn>\n", re.S)
    LONGEST = 1 + max(map(len, (*CONTROL, *MARKS.values())))

    def __init__(self):
        self.rest, self.state = "", "between"
        self.runs: list[list] = []  # of rest: [characters, marked]

    def pieces(self, a: int, b: int) -> Iterator[tuple[str, str, bool]]:
        """rest[a:b], cut where the marking changes."""
        at = 0
        for n, marked in self.runs:
            low, high = max(a, at), min(b, at + n)
            if low < high:
                yield self.state, self.rest[low:high], marked
            at += n

    def drop(self, n: int) -> None:
        self.rest = self.rest[n:]
        while n:
            take = min(n, self.runs[0][0])
            self.runs[0][0] -= take
            n -= take
            if not self.runs[0][0]:
                self.runs.pop(0)

    def feed(self, text: str, marked: bool = False, last: bool = False) -> Iterator[tuple[str, str, bool]]:
        if text:
            self.rest += text
            if self.runs and self.runs[-1][1] == marked:
                self.runs[-1][0] += len(text)
            else:
                self.runs.append([len(text), marked])
        at = 0
        for m in self.SEEN.finditer(self.rest):
            if not last and m.start() > len(self.rest) - self.LONGEST:
                break
            yield from self.pieces(at, m.start())
            mark, at = m[0], m.end()
            if mark[0] == "\\":  # what the escape stands for is marked as the escape is
                yield self.state, mark[1:], next(self.pieces(m.start(), m.end()))[2]
            elif self.state == "between" and mark == MARKS["turn_start"]:
                self.state = "role"
            elif self.state == "role" and mark == MARKS["head_end"]:
                self.state = "text"
                yield "head", "", False
            elif self.state == "text" and mark == MARKS["turn_end"]:
                self.state = "between"
                yield "end", "", False
            else:
                raise ValueError(f"a mark that doesn't belong here: {mark!r}")
        safe = len(self.rest) if last else max(at, len(self.rest) - self.LONGEST)
        yield from self.pieces(at, safe)
        self.drop(safe)
        if last and self.state != "between":
            raise ValueError("the text ends within a turn")


class Digest:
    """What is read back of one conversation, turn by turn; of the loss, all unescaped text that was marked."""

    def __init__(self):
        self.turns, self.loss, self.role = hashlib.sha256(), hashlib.sha256(), ""
        self.n_turns = self.loss_chars = self.formatted = self.marked = 0
        self.reader = Reader()

    def add(self, text: str, marked: bool = False, last: bool = False) -> None:
        self.formatted += len(text)
        self.marked += marked * len(text)
        for what, piece, loss in self.reader.feed(text, marked, last):
            if loss:
                self.loss.update(piece.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(piece)
            if what == "role":
                self.role += piece
            elif what == "head":
                self.turns.update(f"{self.role}\n".encode("utf-8", "surrogatepass"))
            elif what == "text":
                self.turns.update(piece.encode("utf-8", "surrogatepass"))
            elif what == "end":
                self.turns.update(b"\n")
                self.n_turns += 1
                self.role = ""

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.marked


COLUMNS = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "marked_chars")
ROWS_AT_ONCE, PART_CHARS = 1000, 1 << 20


def ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def rendered(batches: Iterator[pa.RecordBatch], template: str) -> Iterator[tuple[Any, Iterator[tuple[str, bool]]]]:
    """conv_id and the pieces of each conversation; its rows stand next to each other."""
    render = compiled(template, MARKS)
    streams = render.streams("messages")
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    for id_, group in itertools.groupby(rows, key=lambda r: r[0]):
        messages = ({"role": r[1] or "", "text": r[2] or ""} for r in group)
        yield id_, render(messages=messages if streams else list(messages))


def digests(conversations: DataFrame, template: str = TURNS) -> DataFrame:
    """COLUMNS for each conversation, read back from what the template made of it. loss: what the generation blocks marked,
    unescaped; marked_chars: as many formatted characters."""
    ship()
    kind = conversations.schema["conv_id"].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for id_, pieces in rendered(batches, template):
            now = Digest()
            for text, loss in pieces:
                now.add(text, loss)
            now.add("", last=True)
            done.append((id_, *now.row()))
            if len(done) == ROWS_AT_ONCE:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], list(COLUMNS))
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], list(COLUMNS))

    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, marked_chars bigint"
    return ordered(conversations).mapInArrow(run, schema)


def formatted(conversations: DataFrame, template: str = TURNS) -> DataFrame:
    """conv_id, part, formatted and spans (start and end of what bears the loss, within the part). A conversation's text is
    its parts, joined in order; a part has PART_CHARS characters or one piece more."""
    ship()
    kind = conversations.schema["conv_id"].dataType
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types, names = [to_arrow_type(kind), pa.int64(), pa.string(), span], ["conv_id", "part", "formatted", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for id_, pieces in rendered(batches, template):
            texts, spans, at, part = [], [], 0, 0
            for text, loss in itertools.chain(pieces, [(None, False)]):
                if at >= PART_CHARS or (text is None and (at or not part)):
                    rows.append((id_, part, "".join(texts), spans))
                    texts, spans, held, at, part = [], [], held + at, 0, part + 1
                    if held >= PART_CHARS or len(rows) == ROWS_AT_ONCE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if text:
                    if loss:
                        spans.append({"start": at, "end": at + len(text)})
                    texts.append(text)
                    at += len(text)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return ordered(conversations).mapInArrow(run, f"conv_id {kind.simpleString()}, part bigint, formatted string, spans array<struct<start: int, end: int>>")


PROBE = "\\### Assistant: </turn> ok"


def op8_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return digests(rows.unionByName(probe))


_ESCAPES = r"len(regexp_extract_all({0}, '\\|###|: |</turn>'))"
#: The same rows without a template: what each mark and each escape adds is counted.
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + {_ESCAPES.format('text')} AS n, {len(''.join(MARKS.values()))} + length(role) + {_ESCAPES.format('role')} AS around FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n + around)::BIGINT AS formatted_chars, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS marked_chars
FROM e GROUP BY conv_id
"""
