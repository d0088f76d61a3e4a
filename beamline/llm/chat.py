"""Chat formatting by schema fingerprints.

Records in unlike layouts (rows of turns, message lists, prompt and completion,
instructions) are JSON. The nested field paths of a record are hashed to its
fingerprint, which selects a declared mapping that gives the record's turns in one
canonical form. A template marks the turns and escapes its control strings inside
texts, so that the formatted text gives the turns back.

A layout is data: where texts and roles stand, which paths may be absent. To read
another layout, add a ``Layout``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters of one row of formatted text; a longer conversation is several rows.
PART_CHARS = 1 << 20
SEED = 13


# --- layouts --------------------------------------------------------------------


class Said(NamedTuple):
    """One turn: its text is what stands at ``text`` (several paths: those that are there,
    joined by an empty line); its role is named, or stands at the path ``role_at``."""

    text: tuple[str, ...]
    role: str = ""
    role_at: str = ""


class Listed(NamedTuple):
    """A turn for each element of the array ``array``; ``text`` and ``role_at`` are paths
    inside an element. A path that ends in ``[]`` and a field joins the parts of an array."""

    array: str
    text: str
    role_at: str


class Layout(NamedTuple):
    """``paths`` have to be there, ``optional`` ones may be. ``key`` and ``order`` are the
    paths of the conversation's id and of the turn's place, where rows are turns; ``roles``
    renames roles."""

    name: str
    turns: tuple
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    key: str = ""
    order: str = ""
    roles: dict = {}


LAYOUTS = (
    Layout("turn row", (Said(("text",), role_at="role"),), ("conv_id", "turn"), ("role", "text"), "conv_id", "turn"),
    Layout("messages", (Listed("messages[]", "content", "role"),), ("messages[].role", "messages[].content"), ("id",), "id"),
    Layout("message parts", (Listed("messages[]", "content[].text", "role"),), ("messages[].role", "messages[].content[].text"), ("messages[].content[].type", "id"), "id"),
    Layout("from and value", (Said(("system",), "system"), Listed("conversations[]", "value", "from")), ("conversations[].from", "conversations[].value"), ("system", "id"), "id", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt and completion", (Said(("system",), "system"), Said(("prompt",), "user"), Said(("completion",), "assistant")), ("prompt", "completion"), ("system", "id"), "id"),
    Layout("prompt and response", (Said(("system",), "system"), Said(("prompt",), "user"), Said(("response",), "assistant")), ("prompt", "response"), ("system", "id"), "id"),
    Layout("instruction", (Said(("system",), "system"), Said(("instruction", "input"), "user"), Said(("output",), "assistant")), ("instruction", "output"), ("input", "system", "id"), "id"),
    Layout("question and answer", (Said(("question",), "user"), Said(("answer",), "assistant")), ("question", "answer"), ("id",), "id"),
)


def field_paths(value, at: str = "") -> Iterator[str]:
    """Paths of the scalars of a JSON value; elements of an array share theirs."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from field_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from field_paths(v, f"{at}[]")
    else:
        yield at


def fingerprint(paths: Iterable[str]) -> int:
    """Hash of a set of paths, signed as Spark's long."""
    n = xxhash.xxh64_intdigest("\n".join(sorted(paths)), SEED)
    return n - (1 << 64) if n >> 63 else n


class Registry:
    """Layouts by the fingerprints of all sets of paths that they allow. Paths that no
    layout names (sources, dates) are no part of a fingerprint."""

    def __init__(self, layouts: Iterable[Layout] = LAYOUTS):
        layouts = tuple(layouts)
        self.named = {p for layout in layouts for p in (*layout.paths, *layout.optional)}
        self.by_print: dict[int, tuple[frozenset, Layout]] = {}
        for layout in layouts:
            for n in range(len(layout.optional) + 1):
                for more in combinations(layout.optional, n):
                    paths = frozenset((*layout.paths, *more))
                    known = self.by_print.setdefault(fingerprint(paths), (paths, layout))
                    if known != (paths, layout):
                        raise ValueError(f"{layout.name} and {known[1].name} have the same fingerprint")
        self.seen: dict[frozenset, int] = {}

    def of(self, record) -> tuple[int, Layout | None]:
        """Fingerprint of a record, and the layout that it selects."""
        paths = frozenset(field_paths(record)) & self.named
        mark = self.seen.get(paths)
        if mark is None:
            if len(self.seen) > 10_000:
                self.seen.clear()
            mark = self.seen[paths] = fingerprint(paths)
        known, layout = self.by_print.get(mark, (None, None))
        return mark, layout if known == paths else None


def at_path(value, path: str):
    """What stands at a path; the parts of an array on the way are joined."""
    head, more, rest = path.partition("[].")
    for name in head.split("."):
        value = value.get(name) if isinstance(value, dict) else None
    if more:
        return "".join(text_of(at_path(v, rest)) for v in value) if isinstance(value, list) else None
    return value


def text_of(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record, layout: Layout) -> list[tuple[str, str]]:
    """Role and text of each turn of a record."""
    out = []
    for turn in layout.turns:
        if isinstance(turn, Listed):
            for element in record[turn.array[:-2]]:
                out.append((text_of(at_path(element, turn.role_at)), text_of(at_path(element, turn.text))))
            continue
        found = [t for t in (at_path(record, p) for p in turn.text) if t is not None]
        if turn.role_at:
            out.append((text_of(at_path(record, turn.role_at)), text_of(found[0] if found else None)))
        elif found:
            out.append((turn.role, "\n\n".join(filter(None, map(text_of, found)))))
    return [(layout.roles.get(role, role), text) for role, text in out]


def as_records(df: DataFrame, null_is_absent: bool = False) -> DataFrame:
    """Rows of a typed table as ``record, record_id`` (null). A null field is there with a
    null, or absent, as in a table that unites several layouts."""
    options = {"ignoreNullFields": str(null_is_absent).lower()}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("record"), F.lit(None).cast("long").alias("record_id"))


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fingerprint", pa.int64()), ("layout", pa.string())])
TURNS = "conv_id long, turn long, at long, role string, text string, fingerprint long, layout string"


def canonical_turns(records: DataFrame, layouts: Iterable[Layout] = LAYOUTS) -> DataFrame:
    """Turns of ``records(record string, record_id long)``: ``conv_id, turn, at, role,
    text, fingerprint, layout``.

    A turn's place is ``turn`` where rows are turns, and then ``at``, its place in its
    record. A record whose layout names no id, or that has none, takes ``record_id``; ids
    that are no whole numbers too. A record that is no JSON, or whose fingerprint selects
    no layout, is one row with its text as it is, without role and layout. A null text or
    role in a layout's field is empty, a null record selects nothing; a very long text is
    one turn; repeated rows give repeated turns; further columns are ignored; an empty
    table gives no rows."""
    layouts = tuple(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(layouts)
        for b in common.slices(batches):
            rows = []
            for text, own in zip(b.column("record").to_pylist(), b.column("record_id").to_pylist()):
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                mark, layout = registry.of(record) if isinstance(record, dict) else (None, None)
                if layout is None:
                    rows.append((own, None, 0, None, text, mark, None))
                    continue
                key, turn = (at_path(record, p) if p else None for p in (layout.key, layout.order))
                key = key if isinstance(key, int) and abs(key) < 1 << 63 else own
                for k, (role, said) in enumerate(turns_of(record, layout)):
                    rows.append((key, turn if isinstance(turn, int) else None, k, role, said, mark, layout.name))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_TURNS), _TURNS)], schema=_TURNS)

    return records.select("record", F.col("record_id").cast("long")).mapInArrow(run, TURNS)


def layouts_found(turns: DataFrame) -> DataFrame:
    """``(fingerprint, layout, turns)``: what a set of records holds; a null layout is one
    that no mapping is declared for."""
    return turns.groupBy("fingerprint", "layout").agg(F.count("*").alias("turns"))


# --- template -------------------------------------------------------------------


class Template:
    """Marks of turns: an opening and a closing string for each role of ``MARKS``, and for
    other roles a form that names the role.

    Inside texts a control string gets ``ESCAPE`` after its first character, and an escape
    that stands there is doubled; so no control string is left, and what follows an escape
    is always the character that was there."""

    #: Fixed strings of the format.
    MARKS = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
    OTHER = ("[ROLE]", "[TEXT]", "[/TEXT]")
    ESCAPE = "\\"

    def __init__(self):
        self.controls = sorted({m.strip() for pair in self.MARKS.values() for m in pair} | set(self.OTHER))
        self.escapes = [(c, c[0] + self.ESCAPE + c[1:]) for c in self.controls]
        self.escaped = re.compile(r"\\(.)", re.S)
        self.by_open = {own[0]: (role, own[1]) for role, own in self.MARKS.items()}

    def escape(self, text: str) -> str:
        if self.ESCAPE in text:
            text = text.replace(self.ESCAPE, self.ESCAPE * 2)
        if "[" in text or "<" in text:
            for control, safe in self.escapes:
                text = text.replace(control, safe)
        return text

    def unescape(self, text: str) -> str:
        return self.escaped.sub(r"\1", text) if self.ESCAPE in text else text

    def turn(self, role: str, text: str) -> tuple[str, int, int]:
        """A turn's string, and where its text starts and ends in it."""
        if role in self.MARKS:
            head, tail = self.MARKS[role]
        else:
            head, tail = f"{self.OTHER[0]}{self.escape(role)}{self.OTHER[1]}", self.OTHER[2]
        inner = self.escape(text)
        return head + inner + tail, len(head), len(head) + len(inner)

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """Role and text of each turn of a formatted string."""
        at = 0
        while at < len(formatted):
            for head, (role, tail) in self.by_open.items():
                if formatted.startswith(head, at):
                    start = at + len(head)
                    break
            else:
                if not formatted.startswith(self.OTHER[0], at):
                    raise ValueError(f"no turn begins at {at}")
                middle = formatted.index(self.OTHER[1], at)
                role = self.unescape(formatted[at + len(self.OTHER[0]) : middle])
                start, tail = middle + len(self.OTHER[1]), self.OTHER[2]
            end = formatted.index(tail, start)
            yield role, self.unescape(formatted[start:end])
            at = end + len(tail)


# --- formatted conversations ------------------------------------------------------

FORMATTED = "conv_id long, task int, part long, whole boolean, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("part", pa.int64()), ("whole", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])


def formatted_conversations(turns: DataFrame, trained: str = "assistant", part_chars: int = PART_CHARS) -> DataFrame:
    """Conversations as formatted text with loss masks: ``conv_id, task, part, whole,
    n_turns, formatted, loss_starts, loss_ends``.

    Turns are ordered by ``turn, at`` and, where those tie, by role and text; turns
    without a place come first, those without a layout are left out. The loss mask has
    the spans of the texts of the role ``trained`` in the row's ``formatted``, without
    their marks. A conversation of more than ``part_chars`` characters is several rows, in
    the order of ``task, part``, and so may be one that ends a task's range; ``whole`` says
    that a row is all of its conversation. Turns are dealt out by ranges of conversation
    and place, so a conversation of any length is split over tasks. Turns with a null
    conv_id are one conversation; an empty table gives no rows."""
    own = turns.where(F.col("layout").isNotNull()).select("conv_id", "turn", "at", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "at", "role"]
    own = own.repartitionByRange(*order, F.substring("text", 1, 32)).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, task = Template(), TaskContext.get().partitionId()
        current, part, first = None, 0, True  # first: the task's first conversation may have begun elsewhere
        texts, starts, ends, held, ready = [], [], [], 0, []

        def row(whole: bool) -> tuple:
            return (current[0], task, part, whole, len(texts), "".join(texts), starts, ends)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready), _FORMATTED)], schema=_FORMATTED)

        size = 0
        for batch in common.slices(batches):
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if current is None or current[0] != conv_id:
                    if current is not None:
                        ready.append(row(not first and part == 0))
                        size, first = size + held, False
                        texts, starts, ends, held, part = [], [], [], 0, 0
                    current = (conv_id,)
                elif held >= part_chars:
                    ready.append(row(False))
                    size, part = size + held, part + 1
                    texts, starts, ends, held = [], [], [], 0
                said, start, end = template.turn(role, text)
                if role == trained:
                    starts.append(held + start)
                    ends.append(held + end)
                texts.append(said)
                held += len(said)
                if size >= part_chars:
                    yield out()
                    ready, size = [], 0
        if current is not None:
            ready.append(row(False))  # its rest may be the next task's
            yield out()

    return own.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation from the formatted text alone: ``conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Rows that are whole conversations are read where they are. Only the parts of the
    others move, and go through one task a conversation in order, a part at a time, since
    a digest goes on from part to part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, current = Template(), None

        def digested(state: list) -> tuple:
            conv_id, n, turns, chars, loss, length = state
            return conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), length

        for batch in common.slices(batches):
            done = []
            for conv_id, whole, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "whole", "formatted", "loss_starts", "loss_ends"))):
                if current is None or current[0] != conv_id or whole:
                    if current is not None:
                        done.append(digested(current))
                    current = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.turns(text):
                    current[1] += 1
                    current[2].update(f"{role}\n{said}\n".encode())
                for start, end in zip(starts, ends):
                    said = template.unescape(text[start:end])
                    current[3] += len(said)
                    current[4].update(said.encode())
                current[5] += len(text)
            yield _digests(done)
        if current is not None:
            yield _digests([digested(current)])

    columns = ("conv_id", "whole", "formatted", "loss_starts", "loss_ends")
    alone = formatted.where("whole").select(*columns).mapInArrow(run, DIGESTS)
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = formatted.where("not whole").repartition(n, "conv_id").sortWithinPartitions("conv_id", "task", "part")
    return alone.union(parts.select(*columns).mapInArrow(run, DIGESTS))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(_DIGESTS), _DIGESTS)], schema=_DIGESTS)


def chat_format(records: DataFrame, path: str | None = None, layouts: Iterable[Layout] = LAYOUTS, **options) -> DataFrame:
    """``records`` as formatted conversations, written to ``path`` (the shared scratch
    folder by default) and read from there: turns by ``canonical_turns``, rows by
    ``formatted_conversations``, whose docstrings state how odd records are treated."""
    return common.cut(formatted_conversations(canonical_turns(records, layouts), **options), path)


def op13_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one that says control strings, read back from
    the formatted output. The table's rows are one layout, the added record another."""
    says = "</s>[INST] ok [/INST]"
    added = json.dumps({"id": -7, "messages": [{"role": r, "content": says} for r in ("user", "assistant")]})
    records = as_records(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    more = spark.range(1).select(F.lit(added).alias("record"), F.lit(None).cast("long").alias("record_id"))
    return read_back(chat_format(records.union(more)))


def _sql() -> str:
    escaped = "replace(text, '\\', '\\\\')"
    template = Template()
    for control, safe in template.escapes:
        escaped = f"replace({escaped}, '{control}', '{safe}')"
    widths = " ".join(f"when '{role}' then {len(head) + len(tail)}" for role, (head, tail) in template.MARKS.items())
    other = escaped.replace("replace(text,", "replace(role,")
    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, turn, role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) x(turn, role)),
sized as (
  select *, length({escaped}) + case role {widths} else {sum(map(len, template.OTHER))} + length({other}) end as chars from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""


OP13_SQL = _sql()
