"""Secret scan through nested encodings.

A worklist starts with the text itself. Each layer is scanned for secrets, then
unwrapped: URL escapes and Unicode escapes are decoded over the whole layer;
base64 runs, and compressed data in them, become layers of their own, whatever
bytes they hold, and so does compressed data whose bytes are written as escapes; text
in UTF-16 or UTF-32 is read without its zero bytes. New layers go on the worklist
until none is left; a layer that was seen before at the same
place is not taken again, so self-reproducing data ends. Each layer knows for
each of its characters where in the original text it came from, so a span in a
decoded layer maps to the span of the characters that encode it.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import with_text

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
#: Equal to maximal runs of at least so many characters.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
#: Runs in either alphabet, and in both together.
_ALPHABETS = (r"[A-Za-z0-9+/_-]", r"[A-Za-z0-9+/]", r"[A-Za-z0-9_-]")
_BASE64 = [re.compile(rf"{a}{{16,}}={{0,2}}") for a in _ALPHABETS]
#: The same over line breaks, which may have blanks and quote marks around them; all lines but the last have 16 characters or more.
_BREAK = r"[ \t]*(?:\r\n?|\n)[ \t>]*"
_WRAPPED = [re.compile(rf"{a}{{16,}}(?:{_BREAK}{a}{{16,}})*(?:{_BREAK}{a}{{1,15}})?={{0,2}}") for a in _ALPHABETS]
_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
_LINE_START, _LINE_END = re.compile(r"(?:^|[\r\n])[ \t>]*\Z"), re.compile(r"[ \t]*(?:[\r\n]|\Z)")
_URLSAFE = str.maketrans("-_", "+/")

#: Characters with a zero (or three) between them, as UTF-16 and UTF-32 spell ASCII.
_WIDE = re.compile(r"(?:[^\0]\0{3}){6,}[^\0]?|(?:[^\0]\0){6,}[^\0]?")
#: Decompressed data comes in pieces of so many bytes, and is scanned in chunks that end where no secret or run can go on.
PIECE_BYTES = 1 << 22
#: A run without such an end is cut at so many bytes, and the next chunk repeats the last so many of them.
MAX_RUN_BYTES, OVERLAP_BYTES = 1 << 26, 1 << 20
_END = re.compile(rb"(?s).*(?:[^A-Za-z0-9+/_.=\-\"':%\\{}> \t\r\n\0]|\0{4})")
_ERRORS = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)


def scan_layer(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in one layer: per kind leftmost and non-overlapping, too short ones dropped."""
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if _KEYWORD.search(text) else []
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    return out + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def _promises(text: str) -> bool:
    """False only if the text holds neither a secret nor a further layer."""
    low = text.lower()
    return (
        any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key"))
        or "AKIA" in text
        or ("%" in text and _URL.search(text) is not None)
        or ("\\" in text and _UNICODE.search(text) is not None)
        or ("\0" in text and _WIDE.search(text) is not None)
        or _BASE64[0].search(text) is not None  # and hex
    )


class _Layer:
    """A text whose character i stands for original characters start(i) to end(i).

    ``blocks`` are (first position here, original start, original end, one to
    one): what a stretch of characters came from. A stretch is either copied, or
    decoded from one unit of the layer before. Without a parent it is the text.
    """

    #: Made of a base64 run, or of compressed data.
    inside = opened = False

    def __init__(self, text: str, parent: _Layer | None, blocks: list[tuple[int, int, int, bool]]):
        self.text, self.parent, self.blocks = text, parent, blocks
        self.firsts = [b[0] for b in blocks]
        self.inside = self.inside or (parent is not None and parent.inside)

    def key(self) -> tuple:
        """Equal for layers of the same text from the same places."""
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), hash(tuple(self.blocks))

    def original(self, start: int, end: int) -> tuple[int, int]:
        if self.parent is None:
            return start, end
        a = self.blocks[bisect.bisect_right(self.firsts, start) - 1]
        b = self.blocks[bisect.bisect_right(self.firsts, end - 1) - 1]
        return (a[1] + start - a[0] if a[3] else a[1]), (b[1] + end - b[0] if b[3] else b[2])

    def traced(self, blocks: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int, bool]]:
        """Blocks over this layer's characters as blocks over the original's."""
        if self.parent is None:
            return blocks
        out: list[tuple[int, int, int, bool]] = []
        for here, start, end, copied in blocks:
            if not copied:
                out.append((here, *self.original(start, end), False))
                continue
            at = start
            while at < end:  # one piece for each block that the stretch crosses
                n = bisect.bisect_right(self.firsts, at) - 1
                first, a, b, same = self.blocks[n]
                to = min(end, self.firsts[n + 1] if n + 1 < len(self.blocks) else end)
                piece = (here + at - start, a + at - first, a + to - first, True) if same else (here + at - start, a, b, False)
                if out and same and out[-1][3] and out[-1][2] == piece[1] and out[-1][0] + out[-1][2] - out[-1][1] == piece[0]:
                    out[-1] = (out[-1][0], out[-1][1], piece[2], True)
                else:
                    out.append(piece)
                at = to
        return out


def _rewritten(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with each match replaced by its decoded units; None if there is none."""
    parts, blocks, at, here = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        units = decode(m)
        if units is None:
            continue
        if m.start() > at:
            parts.append(layer.text[at : m.start()])
            blocks.append((here, at, m.start(), True))
            here += m.start() - at
        for text, start, end in units:
            parts.append(text)
            blocks.append((here, start, end, False))
            here += len(text)
        at = m.end()
    if not parts and not blocks:
        return None
    if at < len(layer.text):
        parts.append(layer.text[at:])
        blocks.append((here, at, len(layer.text), True))
    return _Layer("".join(parts), layer, layer.traced(blocks))


def _utf8_units(raw: bytes, where) -> list[tuple[str, int, int]]:
    """(character, start, end) of each character; bytes that aren't UTF-8 stand for themselves. ``where(i)``: the place of byte i."""
    out, i = [], 0
    while i < len(raw):
        n = next((n for n in (1, 2, 3, 4) if _decodes(raw[i : i + n])), 0)
        out.append((raw[i : i + n].decode("utf-8") if n else chr(raw[i]), where(i)[0], where(i + max(n, 1) - 1)[1]))
        i += max(n, 1)
    return out


def _decodes(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def _url_units(m: re.Match) -> list[tuple[str, int, int]]:
    return _utf8_units(bytes.fromhex(m[0].replace("%", "")), lambda i: (m.start() + 3 * i, m.start() + 3 * i + 3))


def _unicode_code(m: re.Match) -> int | None:
    code = int(next(g for g in m.groups() if g), 16)
    return code if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _unicode_units(m: re.Match) -> list[tuple[str, int, int]] | None:
    code = _unicode_code(m)
    return None if code is None else [(chr(code), *m.span())]


def _wide_units(m: re.Match) -> list[tuple[str, int, int]]:
    return [(c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0]) if c != "\0"]


def _tool(raw: bytes):
    """A decompressor for data that begins so; None if it is none of gzip, zlib, bzip2 and xz."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 1 and raw[0] & 0x8F == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if raw[:6] == b"\xfd7zXZ\x00" else None


def _inflate(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """What compressed data holds, piece by piece: all its members, and as much as there is of a broken or truncated one."""
    pieces, held, tool, members = iter(pieces), b"", None, 0
    while True:
        if tool is None:
            while len(held) < 6 and (more := next(pieces, None)) is not None:
                held = (held + more).lstrip(b"\0") if members else held + more
            held = held.lstrip(b"\0") if members else held  # padding between members
            if len(held) < 6 and (more := next(pieces, None)) is not None:
                held += more
                continue
            tool = _tool(held)
            if tool is None:
                return
            members += 1
        zipped = not isinstance(tool, bz2.BZ2Decompressor | lzma.LZMADecompressor)
        back = tool.copy() if zipped else None
        try:
            out = tool.decompress(held, PIECE_BYTES)
        except _ERRORS:
            yield from _until_broken(back, held)
            return
        if out:
            yield out
        if tool.eof:
            held, tool = tool.unused_data, None
            continue
        held = tool.unconsumed_tail if zipped else b""
        if not held and (len(out) < PIECE_BYTES if zipped else tool.needs_input):
            held = next(pieces, b"")
            if not held:
                return


def _until_broken(tool, raw: bytes) -> Iterator[bytes]:
    """What zlib can read of ``raw`` up to the byte that breaks it."""
    try:
        for i in range(len(raw) if tool is not None else 0):
            if out := tool.decompress(raw[i : i + 1]):
                yield out
    except _ERRORS:
        return


def _extent(raw: memoryview) -> int:
    """Up to where compressed data goes that begins here: after the last whole member, or to the end of a broken or truncated one."""
    at = 0
    while (tool := _tool(bytes(raw[at : at + 6]))) is not None:
        fed = at
        try:
            while not tool.eof:
                if fed >= len(raw):
                    return len(raw)
                more = bytes(raw[fed : fed + 4096])
                fed += len(more)
                while more or not getattr(tool, "needs_input", True):
                    tool.decompress(more, PIECE_BYTES)
                    more = getattr(tool, "unconsumed_tail", b"")
                    if tool.eof:
                        break
        except _ERRORS:
            return len(raw)
        at = fed - len(tool.unused_data)
    return at


def _split(raw: bytes) -> Iterator[bytes]:
    return (bytes(raw[i : i + 4096]) for i in range(0, len(raw), 4096))


def _chunks(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The data in chunks that can be scanned each by itself."""
    held = b""
    for piece in pieces:
        held += piece
        if len(held) < PIECE_BYTES:
            continue
        if m := _END.match(held):
            yield held[: m.end()]
            held = held[m.end() :]
        elif len(held) >= MAX_RUN_BYTES:
            yield held
            held = held[-OVERLAP_BYTES:]
    if held:
        yield held


def _opened(raw: bytes, layer: _Layer, span: tuple[int, int], seen: set) -> Iterator[_Layer]:
    """Layers of what compressed data holds, and of compressed data in it; all their characters stand for the whole run.

    Data within data is read by a further pass from the outermost on, so that
    nothing but a chunk is held. Data seen before at the same place ends it.
    """
    source: Callable[[], Iterator[bytes]] = lambda: _split(raw)
    while True:
        source = lambda outer=source: _inflate(outer())
        digest, head = hashlib.blake2b(digest_size=16), b""

        def noted(pieces: Iterator[bytes]) -> Iterator[bytes]:
            nonlocal head
            for piece in pieces:
                digest.update(piece)  # noqa: B023
                head = head if len(head) >= 6 else head + piece[:6]
                yield piece

        for chunk in _chunks(noted(source())):
            text = chunk.decode("utf-8", "replace")
            if _promises(text):
                new = _Layer(text, layer, [(0, *layer.original(*span), False)])
                new.opened = new.inside = True
                yield new
        key = (digest.digest(), layer.original(*span))
        if _tool(head) is None or key in seen:
            return
        seen.add(key)


def _wrapped_runs(text: str) -> set[tuple[tuple[int, int], ...]]:
    """Base64 over several lines, each run as the (start, end) of its part of each line.

    Where lines follow each other, all of them are a run, also without a first
    or last one that shares its line with other text; and so is each stretch of
    lines of one length with the shorter line after it.
    """
    out = set()
    for m in (m for p in _WRAPPED for m in p.finditer(text)):
        if "\n" not in m[0] and "\r" not in m[0]:
            continue
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
        head = 0 if _LINE_START.search(text, max(0, m.start() - 200), m.start()) else 1
        tail = len(lines) - (0 if _LINE_END.match(text, m.end()) else 1)
        runs = [(i, j) for i in {0, head} for j in {tail, len(lines)}]
        width, first = [e - s for s, e in lines], 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or width[i] != width[first]:
                runs.append((first, i + (i < len(lines) and width[i] < width[first])))
                first = i
        out.update(tuple(lines[i:j]) for i, j in runs if j - i > 1)
    return out


class _Decoded(_Layer):
    """A layer of bytes decoded from base64: a UTF-8 character, or a byte that is part of none, stands for the characters that encode it."""

    inside = True

    def __init__(self, raw: bytes, parent: _Layer, lines: tuple[tuple[int, int], ...]):
        text = raw.decode("utf-8", "surrogateescape")
        super().__init__(_LONE.sub("\ufffd", text), parent, [])
        self.lines, self.line_firsts = lines, [0, *accumulate(e - s for s, e in lines)]
        self.bytes_at = None if raw.isascii() else [0, *accumulate(1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text)]

    def key(self) -> tuple:
        run, here = [], 0
        for s, e in self.lines:
            run.append((here, s, e, True))
            here += e - s
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), hash(tuple(self.parent.traced(run)))

    def _place(self, i: int) -> int:
        """Where character i of the run stands in the parent."""
        n = bisect.bisect_right(self.line_firsts, i, 0, len(self.lines)) - 1
        return self.lines[n][0] + i - self.line_firsts[n]

    def original(self, start: int, end: int) -> tuple[int, int]:
        first, last = (start, end - 1) if self.bytes_at is None else (self.bytes_at[start], self.bytes_at[end] - 1)
        return self.parent.original(self._place(first * 8 // 6), self._place((last * 8 + 7) // 6) + 1)

    def traced(self, blocks: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int, bool]]:
        """A character of this layer is a unit of its own."""
        out: list[tuple[int, int, int, bool]] = []
        for here, start, end, copied in blocks:
            if copied:
                out += ((here + i, *self.original(start + i, start + i + 1), False) for i in range(end - start))
            else:
                out.append((here, *self.original(start, end), False))
        return out


_LONE = re.compile("[\udc80-\udcff]")

#: Runs of bytes as URL escapes, or as escapes of string literals, with characters that stand for themselves.
_BYTE_RUNS = (
    ("%", re.compile(r"%1f%8b|%fd(?:7zXZ|%37%7a%58%5a)%00|(?:BZh|%42%5a%68)[0-9%]|(?:x|%78)(?:%01|%5e|\^|%9c|%da)", re.IGNORECASE), re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+!'()*-])+")),
    ("\\", re.compile(r"\\(?:x|u00)1f\\(?:x|u00)8b|\\(?:x|u00)fd7zXZ|BZh[0-9]|\\(?:x|u00)42\\(?:x|u00)5a\\(?:x|u00)68|(?:x|\\x78|\\u0078)(?:\\(?:x|u00)(?:01|5e|9c|da)|\^)", re.IGNORECASE), re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[abtnvfr0\\'\"]|[\x20-\x5B\x5D-\x7E])+")),
)
_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\([abtnvfr0\\'\"])|(.)", re.DOTALL)
_NAMED_BYTES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "0": 0, "\\": 92, "'": 39, '"': 34}
_MAGIC = re.compile(rb"\x1f\x8b\x08|\xfd7zXZ\x00|BZh[1-9]1AY&SY|x[\x01\x5e\x9c\xda]")


def _escaped_data(layer: _Layer, seen: set) -> Iterator[_Layer]:
    """Layers of compressed data whose bytes are written as escapes. In a run, the first place where something opens counts."""
    for sign, trace, run in _BYTE_RUNS:
        if sign not in layer.text or not trace.search(layer.text):
            continue
        for m in run.finditer(layer.text):
            if sign not in m[0] or not trace.search(m[0]):
                continue
            raw, at = bytearray(), []
            for b in _BYTE.finditer(m[0]):
                own = b[1] if sign == "%" else b[2] or b[3]
                text = [int(own, 16)] if own else [_NAMED_BYTES[b[4]]] if b[4] and sign != "%" else b[0].encode("latin-1")
                raw += bytes(text)
                at += [m.start() + b.start()] * len(text)
            for magic in _MAGIC.finditer(bytes(raw)):
                data, found = memoryview(raw)[magic.start() :], False
                size = _extent(data)
                end = at[magic.start() + size] if size < len(data) else m.end()
                for new in _opened(data[:size], layer, (at[magic.start()], end), seen):
                    found = True
                    yield new
                if found:
                    break


def _base64_layers(layer: _Layer, seen: set) -> Iterator[_Layer]:
    runs = {(m.span(),) for p in _BASE64 for m in p.finditer(layer.text)}
    if "\n" in layer.text or "\r" in layer.text:
        runs |= _wrapped_runs(layer.text)
    for lines in runs:
        run = "".join(layer.text[s:e] for s, e in lines).rstrip("=").translate(_URLSAFE)
        run = run[: len(run) - (len(run) % 4 == 1)]  # a last character alone holds no byte
        raw = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
        if _promises(raw.decode("utf-8", "replace")):
            yield _Decoded(raw, layer, lines)
        if _tool(raw) is not None:
            yield from _opened(raw, layer, (lines[0][0], lines[-1][1]), seen)


def _unwrapped(layer: _Layer, seen: set) -> Iterator[_Layer]:
    yield from _escaped_data(layer, seen)
    for sign, pattern, units in (("%", _URL, _url_units), ("\\", _UNICODE, _unicode_units), ("\0", _WIDE, _wide_units)):
        if sign in layer.text and (new := _rewritten(layer, pattern, units)):
            yield new
    yield from _base64_layers(layer, seen)


#: Layers are made one by one until they hold so many characters in all, or so many times the text's own; from there on
#: they are made of shared cells (``layer_cells``), which finds the same and takes less where layers are many.
LEAST_WORK, WORK = 1 << 22, 32
#: Characters that are in no escape, secret, base64 run or sign of compressed data, and that no escape changes.
_APART = re.compile(r"""[^A-Za-z0-9+/_.=\-"':%\\{}> \t\r\n\0^]""")


def _explore(root: _Layer, least: int, apart: bool, seen: set, found: set[tuple[int, int, str]], above: frozenset) -> None:
    """Add the spans of all layers of one to ``found``. Opened data are roots of their own.

    ``apart``: the root is a stretch of a text between characters that nothing
    goes across; ``Crossing`` tells that zero bytes or compressed data might.
    """
    from .layer_cells import Crossing, Layers

    def open_all(layers: Iterator[_Layer]) -> None:
        for layer in layers:
            key = layer.key()
            if key not in above and key not in seen:
                seen.add(key)
                found.update((*layer.original(s, e), kind) for s, e, kind in scan_layer(layer.text))
                _explore(layer, LEAST_WORK, False, seen, found, above | {key})

    work, left = [iter([root])], max(least, WORK * len(root.text))
    while work and left >= 0:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.opened and layer is not root:
            open_all(iter([layer]))
            continue
        if apart and not layer.inside and ("\0" in layer.text or any(trace.search(layer.text) for _, trace, _ in _BYTE_RUNS)):
            raise Crossing
        if layer is not root:
            key = layer.key()
            if key in seen or not layer.text:
                continue
            seen.add(key)
            found.update((*layer.original(s, e), kind) for s, e, kind in scan_layer(layer.text))
            left -= len(layer.text)
        work.append(_unwrapped(layer, seen))
    if not work:
        return
    work.clear()
    cuts = [] if apart else [m.start() for m in _APART.finditer(root.text)]
    if cuts:
        try:
            for start, end in zip([0, *cuts], [*(c + 1 for c in cuts), len(root.text)], strict=True):
                if end - start > 2:
                    part = _Layer(root.text[start:end], root, root.traced([(0, start, end, True)]))
                    part.inside = False
                    _explore(part, 0, True, set(), found, above)
            return
        except Crossing:
            pass
    layers = Layers(root, seen := set(), apart)
    open_all(layers.opened())
    found |= layers.found


def secret_spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, further spans from decoded layers), each (start, end, kind) in the text, sorted."""
    if not text:
        return [], []
    base, found = scan_layer(text), set()
    _explore(_Layer(text, None, []), LEAST_WORK, False, set(), found, frozenset())
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base, key=order), sorted(found - set(base), key=order)


def spelled(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


FIELDS = "n_assign: bigint, n_access: bigint, n_hex: bigint, n_decoded: bigint, base_spans: string, spans: string"


def _batch(column: pa.Array) -> list[pa.Array]:
    cols: list[list] = [[] for _ in range(6)]
    for text in column.to_pylist():
        base, more = secret_spans(text)
        every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
        for col, value in zip(cols, (*(sum(s[2] == k for s in base) for k in KINDS), len(more), spelled(base), spelled(every)), strict=True):
            col.append(value)
    return [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)]


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row, got): the kept columns; counts of base spans by kind and of decoded ones, base spans and all spans as text.

    Offsets are code points of the text, end exclusive. A null text is empty; an
    empty one has no spans, and an empty table gives an empty one. Repeated rows
    are scanned alike. Texts of any length are scanned whole, and every layer is
    scanned, however deep. Where layers hold many times a text's characters they
    share what they have in common. Other columns of any name pass through.
    """
    return with_text(docs, _batch, FIELDS, keep=keep)
