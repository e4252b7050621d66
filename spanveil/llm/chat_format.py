r"""Chat formatting with any template: spans of turns are found by rendering prefixes.

A template is a black box that renders a list of (role, text). Prefixes of one
turn more each are rendered and consecutive outputs compared: what came in is the
new turn's span, and an output that does not hold its predecessor tells that the
template rewrites history. Where a turn's text stands inside its span is found by
rendering the turn with two other texts: what these share is the turn's frame.

``MARKED`` marks turns as ``<|im_start|>role\ntext<|im_end|>\n``. A control
string in a text is escaped by a backslash after its first character, which adds
to any backslashes that stand there; so no text holds a control string, and
escaping is undone exactly.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bounded_batches

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

#: Strings that common chat models read as control marks.
CONTROLS = (
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|startoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)
#: Two texts of one character each, of private use, that a template has no reason to treat differently.
PROBES = ("", "")
#: Turns of a window; only beyond it are prefixes rendered in part (see ``locate``).
WINDOW = 64


class Escape:
    """Makes control strings in texts harmless, and undoes it."""

    def __init__(self, controls: tuple[str, ...]):
        heads = {c[0] for c in controls}
        if any(len(c) < 2 or "\\" in c or heads & set(c[1:]) and any(c[i:].startswith(o) or o.startswith(c[i:]) for i in range(1, len(c)) for o in controls) for c in controls):
            raise ValueError("control strings must have two characters or more, no backslash, and must not overlap")
        by_head = {h: "|".join(re.escape(c[1:]) for c in sorted(controls, key=len, reverse=True) if c[0] == h) for h in sorted(heads)}
        self._marked = re.compile("|".join(rf"{re.escape(h)}(?=\\*(?:{rest}))" for h, rest in by_head.items()))
        self._escaped = re.compile("|".join(rf"(?<={re.escape(h)})\\(?=\\*(?:{rest}))" for h, rest in by_head.items()))

    def put(self, text: str) -> str:
        return self._marked.sub(lambda m: m[0] + "\\", text)

    def undo(self, text: str) -> str:
        # of a run of backslashes only the first stands right after the first character
        return self._escaped.sub("", text)


@dataclass(frozen=True)
class Marked:
    """A template that marks turns and can be read back."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    controls: tuple[str, ...] = CONTROLS
    escape: Escape = field(init=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "escape", Escape(self.controls))

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(f"{self.start}{self._role(r)}\n{self.escape.put(t)}{self.end}\n" for r, t in turns)

    def _role(self, role: str) -> str:
        return self.escape.put(role.replace("\\", "\\\\").replace("\n", "\\n"))

    def read(self, formatted: str) -> list[Turn]:
        """The turns of an output."""
        out = []
        for block in formatted.split(self.start)[1:]:
            role, _, text = block.partition("\n")
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], self.escape.undo(role))
            out.append((role, self.escape.undo(text[: text.rindex(self.end)])))
        return out


MARKED = Marked()


@dataclass
class Located:
    """An output, for each turn its span and that of its text, and the first turn (from 0) that changed what stood before it, if any."""

    text: str
    spans: list[tuple[int, int, int, int]]
    rewritten_at: int | None = None


def _shared(a: str, b: str) -> int:
    """The length of the longest common prefix, in few comparisons of whole slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 64
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, step * 2
    return low + len(commonprefix([a[low : low + step], b[low : low + step]]))


def _shared_end(a: str, b: str, most: int) -> int:
    """The length of the longest common suffix, up to ``most``."""
    low, high = 0, min(most, len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    return low


def inserted(before: str, after: str, end: int) -> tuple[int, int] | None:
    """Where ``after`` has something that ``before`` has not, or None if it differs in more than that.

    Appending is the usual case. A template that closes its output inserts before
    the closing part; where equal characters leave several places for that, the
    one next to ``end``, the end of the last turn, is taken.
    """
    grown = len(after) - len(before)
    if end == len(before) and after.startswith(before):
        return end, len(after)
    if grown < 0:
        return None
    least, most = len(before) - _shared_end(before, after, len(before)), _shared(before, after)
    if least > most:
        return None
    at = min(max(end, least), most)
    return at, at + grown


def _empty(render: Render) -> str:
    """What a template makes of no turns; one that refuses them makes nothing."""
    try:
        return render([])
    except (IndexError, KeyError, ValueError):
        return ""


def _inside(turns: list[Turn], render: Render, span: tuple[int, int], output: str) -> tuple[int, int]:
    """Where the text of the last turn stands in its span; at the span's end, and empty, if the template leaves it out."""
    one, two = (render([*turns[:-1], (turns[-1][0], p)]) for p in PROBES)
    head, tail = _shared(one, two), _shared_end(one, two, len(one))
    at, to = head, len(output) - tail
    return (at, to) if one != two and span[0] <= at <= to <= span[1] else (span[1], span[1])


def _by_prefixes(turns: list[Turn], render: Render, first: int = 0) -> Located:
    """Spans of ``turns[first:]``, each from the prefix that ends with it and the one before."""
    output = render(turns[:first]) if first else _empty(render)
    end, spans = len(output), []
    for k in range(first, len(turns)):
        after = render(turns[: k + 1])
        span = inserted(output, after, end)
        if span is None:
            return Located(render(turns), [], k)
        spans.append((*span, *_inside(turns[: k + 1], render, span, after)))
        output, end = after, span[1]
    return Located(output, spans)


def locate(turns: list[Turn], render: Render, window: int = WINDOW) -> Located:
    """Every turn's span and that of its text, in the output for all turns.

    If a turn changes what stood before it, its number is told and there are no
    spans, as none is known in the final output. Rendering every prefix takes
    quadratic time, so beyond ``window`` turns a block of turns is rendered after
    the ``window`` turns before it only, and the whole output is rendered once:
    if it is not what the blocks make, all prefixes are rendered after all.
    """
    if len(turns) <= 2 * window:
        return _by_prefixes(turns, render)
    head = _by_prefixes(turns[:window], render)
    if head.rewritten_at is not None:
        return Located(render(turns), [], head.rewritten_at)
    whole, spans, end = render(turns), head.spans, head.spans[-1][1]
    same, closing = whole[:end] == head.text[:end], head.text[end:]
    for a in range(window, len(turns), window):
        if not same:
            break
        own = _by_prefixes(turns[a - window : a + window], render, window)
        if own.rewritten_at is not None:
            same = False
            break
        shift, last = end - own.spans[0][0], own.spans[-1][1]
        same = whole[end : last + shift] == own.text[own.spans[0][0] : last] and own.text[last:] == closing
        spans = spans + [tuple(x + shift for x in s) for s in own.spans]
        end = last + shift
    return Located(whole, spans) if same and whole[end:] == closing else _by_prefixes(turns, render)


FORMATTED = "n_turns bigint, formatted string, spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>, rewritten_at int"


def format_chats(turns: DataFrame, template: Render = MARKED, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n_turns, formatted, spans, rewritten_at): each conversation's output, with places in code points.

    Rows are in order of turn, null first, then role, then text; repeated rows
    are turns of their own. Null roles and texts are empty; rows without a
    conversation form one. ``rewritten_at`` (from 0) is the turn whose arrival
    changed the output before it; spans are null then. An empty table gives an
    empty one; other columns are not looked at. One conversation is one output,
    so it is made in one task.
    """
    bounded_batches(turns.sparkSession, 200)
    own = turns.select(F.col(f"`{conv}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = own.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    schema = T.StructType([whole.schema["conv_id"], *T._parse_datatype_string(FORMATTED)])
    kind = pa.list_(pa.struct([("role", pa.string()), *((c, pa.int32()) for c in ("start", "end", "text_start", "text_end"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts, spans, rewritten = [], [], [], []
            for row in batch.column("turns"):
                own = [(t["role"], t["text"]) for t in row.as_py()]
                found = locate(own, template)
                n.append(len(own))
                texts.append(found.text)
                spans.append(None if found.rewritten_at is not None else [dict(zip(("role", "start", "end", "text_start", "text_end"), (r, *s), strict=True)) for (r, _), s in zip(own, found.spans, strict=True)])
                rewritten.append(found.rewritten_at)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind), pa.array(rewritten, pa.int32())], ["conv_id", "n_turns", "formatted", "spans", "rewritten_at"])

    return whole.mapInArrow(run, schema)


def read_back(formatted: DataFrame, template: Marked = MARKED, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss, formatted_chars) as read from outputs alone.

    ``loss`` is the text that the loss mask covers, unescaped: the texts of the
    roles in ``learn``. A conversation whose spans are null has none.
    """
    src = formatted.select("conv_id", "formatted", "spans")
    schema = T.StructType([src.schema["conv_id"], *T._parse_datatype_string("turns array<struct<role:string,text:string>>, loss string, formatted_chars bigint")])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("formatted").to_pylist()
            turns = [[{"role": r, "text": x} for r, x in template.read(t)] for t in texts]
            loss = ["".join(template.escape.undo(t[s["text_start"] : s["text_end"]]) for s in spans or () if s["role"] in learn) for t, spans in zip(texts, batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(turns, kind), pa.array(loss, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["conv_id", "turns", "loss", "formatted_chars"])

    return src.mapInArrow(run, schema)
