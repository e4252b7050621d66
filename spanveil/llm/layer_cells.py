"""All layers of a text with deep escapes, each worked out only where it differs from the others.

A layer is a list of stretches, and a stretch a list of cells (character,
origin, next cell). Equal cells and equal lists are one, so layers share their
tails; what is found from a cell on depends on its tail alone and is kept with
it. A stretch begins with the sign of an escape, which no secret and no base64
run goes across: while it decodes to a sign again, only its own cells change.
What stands before the first escape is kept on a stack until it meets something
new. So a layer that unwraps some escapes costs a few cells, and not its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from .secret_scan import _BYTE_RUNS, _KEYWORD, _UNICODE, _decodes, _escaped_data, _Layer, _opened, _tool, _unicode_code

_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Characters of runs: hex digits, values, both base64 alphabets together; and such runs as are looked at where they matter only.
_HEX, _VALUE, _ANY64, _ACCESS, _PLAIN64, _URL64 = range(6)
_CLASSES = [frozenset(map(ord, c)) for c in ("0123456789abcdef", _ALNUM + "+/_.=-", _ALNUM + "+/_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _ALNUM + "+/", _ALNUM + "_-")]
_BITS = {c: sum(1 << n for n in range(3) if c in _CLASSES[n]) for c in range(128)}
_ALPHABETS = (_ANY64, _PLAIN64, _URL64)
#: By alphabet, what characters of a run of both it lacks.
_LACKS = {_PLAIN64: 2, _URL64: 1}
_SPECIAL = {ord("+"): 1, ord("/"): 1, ord("-"): 2, ord("_"): 2}
_DIGITS = frozenset(map(ord, "0123456789abcdefABCDEF"))
_PERCENT, _BACKSLASH = ord("%"), ord("\\")
_SIGNS = {_PERCENT, _BACKSLASH}
_INITIALS, _TRACES = frozenset(map(ord, "pPsStTaA")), frozenset(map(ord, "%\\xXbB"))
_OPENS = _INITIALS | frozenset(map(ord, "%\\\0"))
_BREAKS, _BLANKS = {10, 13}, {9, 32}
_QUOTES = {ord("'"), ord('"')}
_SEXTET = {ord(c): i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {ord("-"): 62, ord("_"): 63}
_FAR = 999
#: More than the longest sign of compressed data.
_TAIL = 24
#: How signs of compressed data begin.
_HINTS, _HINT = frozenset(map(ord, "1fF47")), re.compile(r"%(?:1f|fd|42|78)|\\(?:x|u00)(?:1f|fd|42|78)|bz|x[%\\^]", re.IGNORECASE)
#: A secret or layer may begin so in decoded bytes.
_OPEN = re.compile(rf"{_KEYWORD.pattern}|%[0-9a-f]{{2}}|\\[ux]|\0", re.IGNORECASE | re.ASCII)
_NOT_ASCII = re.compile(r"%[89A-Fa-f][0-9A-Fa-f]\Z")


class Crossing(Exception):
    """A part of a text that isn't independent of the rest: zero bytes, or compressed data as escapes."""


class _Cells:
    """Cell 0 is the end of a layer, cell 1 the end of a stretch before another one."""

    def __init__(self) -> None:
        self.code, self.start, self.end, self.next, self.length = [-1, -2], [0, 0], [0, 0], [0, 1], [0, 0]
        self.runs = [([0, 1], [0, 0]) for _ in range(3)]  # of each class: cell after the run, end of its last character
        self.marks = [0, 0]  # searches that were made from here on
        self.special = [0, 0]  # of a base64 run: 1 for + and /, 2 for - and _
        self.later: dict[tuple[int, int], tuple[int, int]] = {}
        self.flags = [0, 0]  # of the list from here on: 1 zero bytes, 2 signs of compressed data, 8 a line break, 16 and 32 escapes of either kind
        self.escape, self.tail = [0, 0], [0, 1]  # first escape; the last cells
        self.first, self.others = [0, 0], {}
        self.memos = {sign: [0, 1] for sign in _SIGNS}
        self.adds = [a.append for a in (self.code, self.start, self.end, self.next, self.length, self.first, self.marks, *self.memos.values())]
        self.appends = [(1 << n, to, last, to.append, last.append) for n, (to, last) in enumerate(self.runs)]
        self.byte, self.byte_start, self.byte_end, self.byte_next, self.byte_text = [-1], [0], [0], [0], [0]
        self.quad_cell, self.quad_bits, self.quad_size, self.quad_next, self.quad_byte = [0], [0], [0], [0], [0]
        self.quad_run = [0]  # length of the base64 run here; -1 where the rest may hold a secret or layer
        self.units: dict[int, tuple[int, int]] = {}  # of escapes
        self.tails: dict[int, str] = {}
        self.appended: dict[int, dict[int, int]] = {}
        self.wide: dict[tuple[int, int], int] = {(0, s): 0 for s in range(3)}
        self.quads: dict[int, int] = {}

    def new(self, code: int, start: int, end: int, then: int) -> int:
        at = self.first[then]
        if at:
            if self.code[at] == code and self.start[at] == start and self.end[at] == end:
                return at
            at = self.others.get((code, start, end, then), 0)
            if at:
                return at
        at = len(self.code)
        if self.first[then]:
            self.others[code, start, end, then] = at
        else:
            self.first[then] = at
        add_code, add_start, add_end, add_next, add_length, add_first, add_mark, add_url, add_unicode = self.adds
        add_code(code)
        add_start(start)
        add_end(end)
        add_next(then)
        add_length(self.length[then] + 1)
        add_first(0)
        add_mark(0)
        add_url(-1)
        add_unicode(-1)
        bits = _BITS.get(code, 0)
        if not bits:
            for _, _, _, add_to, add_last in self.appends:
                add_to(at)
                add_last(start)
            self.special.append(0)
        else:
            for bit, to, last, add_to, add_last in self.appends:
                if bits & bit:
                    after = to[then]
                    add_to(after)
                    add_last(end if after == then else last[then])
                else:
                    add_to(at)
                    add_last(start)
            self.special.append(self.special[then] | _SPECIAL.get(code, 0) if bits & 4 else 0)
        flags, escape = self.flags[then], False
        if code == 0:
            flags |= 1
        elif code in _SIGNS:
            unit = self._url(at) if code == _PERCENT else self._unicode(at)
            if unit is not None:
                escape, self.units[at] = True, unit
                flags |= 16 if code == _PERCENT else 32
        elif code in _BREAKS:
            flags |= 8
        if code in _TRACES and not flags & 2:
            if (code != _PERCENT or self.code[then] in _HINTS) and _HINT.match(self.peek(at, 6)):
                text = self.peek(at, _TAIL)
                if any(trace.match(text) for _, trace, _ in _BYTE_RUNS):
                    flags |= 2
        self.flags.append(flags)
        self.escape.append(at if escape else self.escape[then])
        self.tail.append(at if self.length[at] <= _TAIL else self.tail[then])
        return at

    def peek(self, at: int, n: int) -> str:
        out = []
        while at > 1 and len(out) < n:
            out.append(chr(self.code[at]))
            at = self.next[at]
        return "".join(out)

    def skip(self, at: int, n: int) -> tuple[int, int]:
        """The cell after the next ``n``, and where the last of these ends."""
        end = 0
        for _ in range(n):
            end, at = self.end[at], self.next[at]
        return at, end

    def run(self, n: int, at: int) -> tuple[int, int]:
        """The cell after a run of a class, and where its last character ends."""
        if n in _LACKS and not self.special[at] & _LACKS[n]:
            n = _ANY64
        if n < len(self.runs):
            return self.runs[n][0][at], self.runs[n][1][at]
        path, chars = [], _CLASSES[n]
        while (n, at) not in self.later and self.code[at] in chars:
            path.append(at)
            at = self.next[at]
        to, end = self.later.get((n, at), (at, 0))
        for c in reversed(path):
            end = end or self.end[c]
            self.later[n, c] = to, end
        return to, end

    def walk(self, at: int) -> Iterator[int]:
        while at > 1:
            yield at
            at = self.next[at]

    # ---- rewriting: a unit is (its character, its number of cells), or None where a cell stands for itself ----
    def _url(self, at: int) -> tuple[int, int] | None:
        if self.code[at] != _PERCENT:
            return None
        raw = bytearray()
        while len(raw) < 4 and self.code[at] == _PERCENT:
            a = self.next[at]
            b = self.next[a]
            if self.code[a] not in _DIGITS or self.code[b] not in _DIGITS:
                break
            raw.append(int(chr(self.code[a]) + chr(self.code[b]), 16))
            if raw[0] < 128:
                return raw[0], 3
            at = self.next[b]
        if not raw:
            return None
        n = next((n for n in (1, 2, 3, 4) if _decodes(raw[:n])), 0)
        return (ord(raw[:n].decode()), 3 * len(raw[:n])) if n else (raw[0], 3)

    def _unicode(self, at: int) -> tuple[int, int] | None:
        if self.code[at] != _BACKSLASH:
            return None
        m = _UNICODE.match(self.peek(at, 10))
        code = _unicode_code(m) if m else None
        return None if code is None else (code, m.end())

    def last(self, head: int) -> str:
        """The last characters of a list."""
        at = self.tail[head]
        if at not in self.tails:
            self.tails[at] = self.peek(at, _TAIL)
        return self.tails[at]

    def rewritten(self, head: int, sign: int) -> int:
        """Escapes of one kind decoded."""
        path, at, memo = [], head, self.memos[sign]
        while memo[at] < 0:
            got = self.units.get(at) if self.code[at] == sign else None
            if got is None:
                path.append((at, -1, 0))
                at = self.next[at]
            else:
                after, end = self.skip(at, got[1])
                path.append((at, got[0], end))
                at = after
        out = memo[at]
        for at, code, end in reversed(path):
            if code >= 0:
                out = self.new(code, self.start[at], end, out)
            else:
                out = at if out == self.next[at] else self.new(self.code[at], self.start[at], self.end[at], out)
            memo[at] = out
        return out

    def narrowed(self, head: int) -> int:
        """Without the zero bytes of wide characters; the state is the width of the match at hand: none, 4 or 2 bytes."""
        path, at, state = [], head, 0

        def pairs(at: int, width: int, least: int) -> bool:
            for _ in range(least):
                if not at or self.code[at] == 0:
                    return False
                for _ in range(width - 1):
                    at = self.next[at]
                    if not at or self.code[at] != 0:
                        return False
                at = self.next[at]
            return True

        while (at, state) not in self.wide:
            if state == 0 and (pairs(at, 4, 6) or pairs(at, 2, 6)):
                path.append((at, state, False))
                state = 1 if pairs(at, 4, 6) else 2
                continue
            kept = state == 0 or self.code[at] != 0
            path.append((at, state, kept))
            if state and pairs(at, 4 if state == 1 else 2, 1):
                at = self.skip(at, 4 if state == 1 else 2)[0]
            else:
                at, state = self.next[at] if kept else at, 0
        out = self.wide[at, state]
        for at, state, kept in reversed(path):
            if kept:
                out = self.new(self.code[at], self.start[at], self.end[at], out)
            self.wide[at, state] = out
        return out

    def decoded(self, at: int, to: int) -> int:
        """Quads of the base64 characters from a cell up to another one, whatever breaks are between them."""
        path, runs, known, code, following = [], self.runs[_ANY64][0], self.quads, self.code, self.next
        while True:
            while at != to and runs[at] == at:
                at = following[at]
            if at == to or at << 32 | to in known:
                break
            first, bits, n = at, 0, 0
            while at != to and n < 4:
                if runs[at] != at:
                    bits = bits << 6 | _SEXTET[code[at]]
                    n += 1
                at = following[at]
            path.append((first, bits << 6 * (4 - n), n - 1))
        out = 0 if at == to else known[at << 32 | to]
        for first, bits, n in reversed(path):
            if n:
                run, opens = self.quad_run[out], False
                for byte in (bits & 255, bits >> 8 & 255, bits >> 16)[3 - n :]:
                    opens = opens or byte in _OPENS
                    run = run if run < 0 or run >= 16 else run + 1 if byte in _CLASSES[_ANY64] else 0
                self.quad_cell.append(first)
                self.quad_bits.append(bits)
                self.quad_size.append(n)
                self.quad_next.append(out)
                self.quad_run.append(-1 if run >= 16 else run)
                self.quad_byte.append(-1)
                out = len(self.quad_cell) - 1
                if opens and run >= 0 and _OPEN.search(self.read(out, 12).decode("latin-1")):
                    self.quad_run[out] = -1
            known[first << 32 | to] = out
        return out

    def read(self, at: int, n: int = 1 << 62) -> bytes:
        """Bytes of quads."""
        raw = bytearray()
        while at and len(raw) < n:
            raw += self.quad_bits[at].to_bytes(3, "big")[: self.quad_size[at]]
            at = self.quad_next[at]
        return bytes(raw[:n])

    def bytes_of(self, at: int) -> int:
        """Bytes of quads with their places, each once."""
        path = []
        while self.quad_byte[at] < 0:
            path.append(at)
            at = self.quad_next[at]
        out = self.quad_byte[at]
        for quad in reversed(path):
            cells, at = [], self.quad_cell[quad]
            while len(cells) <= self.quad_size[quad]:
                if self.runs[_ANY64][0][at] != at:
                    cells.append(at)
                at = self.next[at]
            for i in range(self.quad_size[quad] - 1, -1, -1):
                self.byte.append(self.quad_bits[quad] >> 16 - 8 * i & 255)
                self.byte_start.append(self.start[cells[i]])
                self.byte_end.append(self.end[cells[i + 1]])
                self.byte_next.append(out)
                self.byte_text.append(-1)
                out = len(self.byte) - 1
            self.quad_byte[quad] = out
        return out

    def text_of(self, head: int) -> int:
        """Cells of the characters of bytes; one that is part of none is U+FFFD."""
        path, at = [], head
        while self.byte_text[at] < 0:
            code, end, after = self.byte[at], self.byte_end[at], self.byte_next[at]
            if code >= 128:
                raw, i = bytearray(), at
                while i and len(raw) < 4:
                    raw.append(self.byte[i])
                    i = self.byte_next[i]
                n = next((n for n in range(2, len(raw) + 1) if _decodes(raw[:n])), 0)
                code = ord(raw[:n].decode()) if n else 0xFFFD
                for _ in range(n - 1):
                    end, after = self.byte_end[after], self.byte_next[after]
            path.append((at, code, end))
            at = after
        out = self.byte_text[at]
        for at, code, end in reversed(path):
            out = self.byte_text[at] = self.new(code, self.byte_start[at], end, out)
        return out

    def append(self, head: int, then: int) -> int:
        """A stretch and what follows it as one list."""
        memo, path = self.appended.setdefault(then, {1: then}), []
        while head not in memo:
            path.append(head)
            head = self.next[head]
        out = memo[head]
        for head in reversed(path):
            out = memo[head] = self.new(self.code[head], self.start[head], self.end[head], out)
        return out


class Layers:
    """Spans, and layers of opened data, of all that a layer holds."""

    def __init__(self, layer: _Layer, seen: set, apart: bool) -> None:
        self.root, self.seen, self.apart = layer, seen, apart
        self.cells, self.found, self.done = _Cells(), set(), set()
        self.searches = [(64, self._hex), (128, self._access), (256, self._assign)]
        self.scanned: set[tuple[int, int]] = set()  # list of stretches, characters since the start of a line
        self.wrapped: set[tuple[int, int, int]] = set()
        self.found64: list[tuple[int, int, int]] = []
        self.ids: dict[int, int] = {}  # lists of stretches: (first cell, further list), flags
        self.lists, self.flags = [(0, 0)], [0]
        self.memos: dict[int, dict[int, int]] = {sign: {0: 0} for sign in _SIGNS}
        self.starts: dict[int, str] = {}
        self.lefts: dict[tuple, int] = {}  # (left before, its last stretch)
        self.left_of: list[tuple] = [(0, ())]

    def opened(self) -> Iterator[_Layer]:
        """Layers of opened data; spans are in ``found`` at the end."""
        k, text, head, layer = self.cells, self.root.text, 0, 0
        for i in range(len(text) - 1, -1, -1):
            head = k.new(ord(text[i]), *self.root.original(i, i + 1), head)
            if i and k.escape[head] == head and not _NOT_ASCII.search(text, max(0, i - 3), i):
                head, layer = 1, self._list(head, layer)
        work, known = [(0, self._list(head, layer), False)], set()
        while work:
            left, layer, inside = work.pop()
            state = (left << 32 | layer) << 1 | inside
            if state in known:
                continue
            known.add(state)
            whole = 0
            if self.flags[layer] & 3:
                if self.apart and not inside:
                    raise Crossing
                whole = self._joined(left, layer)
                left, layer = 0, self._list(whole, 0)
            if self.flags[layer] & 2:
                yield from self._escaped(whole)
            at, since = layer, _FAR if left else 0
            while at and (at, since) not in self.scanned:
                self.scanned.add((at, since))
                head, at = self.lists[at]
                if k.code[head] in _SIGNS:  # begins nothing
                    head, since = k.next[head], _FAR
                for mark, match in self.searches:
                    self._search(mark, head, match)
                for run in self._base64(head, since):
                    raw = k.decoded(*run[:2])
                    if raw and (k.quad_bits[raw] >> 16 & 0x8F == 8 or k.quad_bits[raw] >> 16 in b"\x1fB\xfd") and _tool(k.read(raw, 6)) is not None:
                        yield from _opened(k.read(raw), _Layer("", None, []), (k.start[run[0]], run[2]), self.seen)
                    if k.quad_run[raw] < 0:
                        work.append((0, self._split(k.text_of(k.bytes_of(raw))), True))
                since = _FAR
            if not whole:
                left, layer = self._parted(left, layer)
            for flag, sign in ((16, _PERCENT), (32, _BACKSLASH)):
                if self.flags[layer] & flag:
                    work.append((*self._met(left, self._rewritten(layer, sign)), inside))
            if self.flags[layer] & 1:
                new = k.narrowed(whole)
                if new != whole:
                    work.append((0, self._list(new, 0), inside))

    # ---- lists of stretches ----
    def _list(self, head: int, more: int) -> int:
        key = head << 32 | more
        if key not in self.ids:
            k = self.cells
            flags = k.flags[head] | self.flags[more]
            if more and not flags & 2:
                text = k.last(head) + self._peek(more)
                if _HINT.search(text) and any(trace.search(text) for _, trace, _ in _BYTE_RUNS):
                    flags |= 2
            self.ids[key] = len(self.lists)
            self.lists.append((head, more))
            self.flags.append(flags)
        return self.ids[key]

    def _peek(self, layer: int) -> str:
        if layer not in self.starts:
            out, at = "", layer
            while at and len(out) < _TAIL:
                head, at = self.lists[at]
                out += self.cells.peek(head, _TAIL)
            self.starts[layer] = out
        return self.starts[layer]

    def _onto(self, cells: Iterable[tuple[int, int, int]], head: int) -> int:
        for cell in reversed(list(cells)):
            head = self.cells.new(*cell, head)
        return head

    def _read(self, head: int) -> Iterator[tuple[int, int, int]]:
        k = self.cells
        return ((k.code[c], k.start[c], k.end[c]) for c in k.walk(head))

    def _split(self, head: int) -> int:
        """Cut before each escape, but not in bytes of one character. Zero bytes and compressed data are found only by the whole."""
        k, parts, part = self.cells, [], []
        if k.flags[head] & 3 or not k.escape[head]:
            return self._list(head, 0) if head else 0
        for c in k.walk(head):
            if k.escape[c] == c and part and not (len(part) > 2 and _NOT_ASCII.search("".join(chr(x[0]) for x in part[-3:]))):
                parts.append(part)
                part = []
            part.append((k.code[c], k.start[c], k.end[c]))
        out = self._list(self._onto(part, 0), 0)
        for part in reversed(parts):
            out = self._list(self._onto(part, 1), out)
        return out

    def _rewritten(self, layer: int, sign: int) -> int:
        k, memo, path = self.cells, self.memos[sign], []
        flag = 16 if sign == _PERCENT else 32
        while layer not in memo:
            if not self.flags[layer] & flag:
                memo[layer] = layer
                break
            path.append(layer)
            layer = self.lists[layer][1]
        out = memo[layer]
        for layer in reversed(path):
            head = k.rewritten(self.lists[layer][0], sign)
            if out:
                then, more = self.lists[out]
                if k.code[then] not in _SIGNS or (k.code[then] == _PERCENT and _NOT_ASCII.search(k.last(head))):
                    head, out = k.append(head, then), more
            out = memo[layer] = self._list(head, out)
        return out

    # ---- what is left of the first escape: stretches from one sign to before the next ----
    def _parted(self, left: int, layer: int) -> tuple[int, int]:
        k = self.cells
        while layer:
            head, more = self.lists[layer]
            if not more or k.escape[head]:
                break
            stretch: list[tuple[int, int, int]] = []
            for cell in [*self._read(head), (_PERCENT, 0, 0)]:
                if cell[0] in _SIGNS and stretch:
                    key = (left, tuple(stretch))
                    if key not in self.lefts:
                        self.lefts[key] = len(self.left_of)
                        self.left_of.append(key)
                    left, stretch = self.lefts[key], []
                stretch.append(cell)
            layer = more
        return left, layer

    def _met(self, left: int, layer: int) -> tuple[int, int]:
        """The last stretch goes back to the cells if what follows it is no sign any more."""
        head, more = self.lists[layer]
        if not left or self.cells.code[head] in _SIGNS:
            return left, layer
        before, stretch = self.left_of[left]
        return before, self._list(self._onto(stretch, head), more)

    def _joined(self, left: int, layer: int) -> int:
        heads = []
        while layer:
            heads.append(self.lists[layer][0])
            layer = self.lists[layer][1]
        out = heads.pop() if heads else 0
        while heads:
            out = self.cells.append(heads.pop(), out)
        while left:
            left, stretch = self.left_of[left]
            out = self._onto(stretch, out)
        return out

    # ---- scans: each goes on to the first cell from which it was made before ----
    def _search(self, mark: int, at: int, match: Callable[[int], int]) -> None:
        """``match``: the cell where the search goes on."""
        marks = self.cells.marks
        while at > 1 and not marks[at] & mark:
            marks[at] |= mark
            at = match(at)

    def _hex(self, at: int) -> int:
        k = self.cells
        to, last = k.runs[_HEX]
        if to[at] == at:
            return k.next[at]
        if k.length[at] - k.length[to[at]] >= 24:
            self.found.add((k.start[at], last[at], "hex"))
        return to[at]

    def _access(self, at: int) -> int:
        k = self.cells
        if k.code[at] == 65 and k.peek(at, 4) == "AKIA":
            to, end = k.run(_ACCESS, at)
            if k.length[at] - k.length[to] >= 20:
                self.found.add((k.start[at], end, "access"))
                return to
        return k.next[at]

    def _assign(self, at: int) -> int:
        k = self.cells
        if k.code[at] not in _INITIALS or not (m := _KEYWORD.match(k.peek(at, 8))):
            return k.next[at]
        x = k.skip(at, m.end())[0]
        x = k.next[x] if k.code[x] in _QUOTES else x
        while k.code[x] == 32:
            x = k.next[x]
        if k.code[x] not in (58, 61):
            return k.next[at]
        x = k.next[x]
        while k.code[x] == 32:
            x = k.next[x]
        x = k.next[x] if k.code[x] in _QUOTES else x
        to, last = k.runs[_VALUE]
        if to[x] == x:
            return k.next[at]
        if k.length[x] - k.length[to[x]] >= 6:
            self.found.add((k.start[at], last[x], "assign"))
        return to[x]

    def _escaped(self, head: int) -> Iterator[_Layer]:
        k = self.cells
        cells = list(k.walk(head))
        blocks = [(i, k.start[c], k.end[c], False) for i, c in enumerate(cells)]
        yield from _escaped_data(_Layer("".join(chr(k.code[c]) for c in cells), self.root, blocks), self.seen)

    def _padded(self, at: int, end: int) -> tuple[int, int]:
        for _ in range(2):
            if self.cells.code[at] == 61:
                at, end = self.cells.next[at], self.cells.end[at]
        return at, end

    def _base64(self, head: int, since: int) -> list[tuple[int, int, int]]:
        """(first cell, cell after the last, end) of base64 runs; ``since``: characters since the start of a line."""
        self.found64 = []
        self._search(1 << _ANY64, head, self._run64)
        if self.cells.flags[head] & 8:
            for n in _ALPHABETS:
                self.found64 += self._wrapped(head, n, since)
        runs = [run for run in self.found64 if run not in self.done]
        self.done.update(runs)
        return runs

    def _run64(self, at: int, n: int = _ANY64) -> int:
        k = self.cells
        to, end = k.run(n, at)
        if to == at:
            return k.next[at]
        if k.length[at] - k.length[to] >= 16:
            self.found64.append((at, to, self._padded(to, end)[1]))
            if n == _ANY64 and k.special[at]:
                for m in _LACKS:
                    if k.special[at] & _LACKS[m]:  # else it is the same run
                        self._search(1 << m, at, lambda at, m=m: self._run64(at, m))
        return to

    def _wrapped(self, at: int, n: int, since: int) -> Iterator[tuple[int, int, int]]:
        k = self.cells
        while at > 1 and (n, at, since) not in self.wrapped:
            self.wrapped.add((n, at, since))
            to, end = k.run(n, at)
            if to == at:
                since = 1 if k.code[at] in _BREAKS else since + 1 if since < _FAR and k.code[at] in (9, 32, 62) else _FAR
                since = since if since <= 200 else _FAR
                at = k.next[at]
                continue
            if k.length[at] - k.length[to] < 16:
                at, since = to, _FAR
                continue
            lines = [(at, to, end)]
            while (x := self._after_break(to)) and (more := k.run(n, x))[0] != x:
                to = more[0]
                lines.append((x, *more))
                if k.length[x] - k.length[to] < 16:
                    break
            at, end = self._padded(*lines[-1][1:])
            if len(lines) > 1:
                x = at
                while k.code[x] in _BLANKS:
                    x = k.next[x]
                skipped, tail = int(since > 200), len(lines) - int(x != 0 and k.code[x] not in _BREAKS)
                width = [k.length[s] - k.length[e] for s, e, _ in lines[:-1]] + [k.length[lines[-1][0]] - k.length[at]]
                runs, first = {(i, j) for i in (0, skipped) for j in (tail, len(lines))}, 0
                for i in range(1, len(lines) + 1):
                    if i == len(lines) or width[i] != width[first]:
                        runs.add((first, i + (i < len(lines) and width[i] < width[first])))
                        first = i
                for i, j in runs:
                    if j - i > 1:
                        yield lines[i][0], lines[j - 1][1], end if j == len(lines) else lines[j - 1][2]
            since = _FAR

    def _after_break(self, at: int) -> int:
        k = self.cells
        while k.code[at] in _BLANKS:
            at = k.next[at]
        if k.code[at] not in _BREAKS:
            return 0
        at = k.next[at] if k.code[at] == 13 and k.code[k.next[at]] == 10 else at
        at = k.next[at]
        while k.code[at] in (9, 32, 62):
            at = k.next[at]
        return at
