"""Where a message introduces, labels or signs a name, found by walking over its words.

A place is an index into the text. Walkers return where they stop, or None
where what they look for isn't there; words are the longest runs, and give back
their end only where a word must end at a word boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from spanveil import lexicon as lx

WORD = re.compile(lx.WORD)
PLAIN = re.compile(lx.PLAIN_WORD)
RUN = re.compile(r"\w+")
TAIL_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9'\-]*")
DASHES = "-–—"
Place = tuple[int, int]


# ---- walkers ----
def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _edge(text: str, at: int) -> bool:
    """Whether a word begins or ends at a place."""
    return (at > 0 and _in_word(text[at - 1])) != (at < len(text) and _in_word(text[at]))


def _gap(text: str, at: int) -> int:
    """Past white space, if there is any."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def _apart(text: str, at: int) -> int | None:
    """Past white space that must be there."""
    end = _gap(text, at)
    return end if end > at else None


def _word(text: str, at: int | None, kind: re.Pattern = WORD) -> Place | None:
    m = None if at is None else kind.match(text, at)
    return m.span() if m else None


def _ended(text: str, place: Place | None, closed: bool) -> Place | None:
    """The longest part of a word that ends at a word boundary; a ``closed`` word doesn't end in ' or -."""
    if place is None:
        return None
    start, end = place
    while end > start and not (_edge(text, end) and not (closed and text[end - 1] in "'-")):
        end -= 1
    return (start, end) if end > start else None


def _capital(text: str, at: int | None) -> Place | None:
    """A plain word that begins with A to Z."""
    place = _word(text, at, PLAIN)
    return place if place and text[place[0]].isupper() else None


def _says(text: str, at: int | None, phrases: tuple[str, ...]) -> tuple[str, int] | None:
    """The first of the phrases that stands at a place, in any case and spacing, and its end."""
    for phrase in phrases if at is not None else ():
        here: int | None = at
        for i, w in enumerate(phrase.split()):
            here = _apart(text, here) if i else here
            if here is None or text[here : here + len(w)].lower() != w:
                here = None
                break
            here += len(w)
        if here is not None:
            return phrase, here
    return None


def _mark(text: str, at: int, marks: str) -> int | None:
    """Past one of the marks and the white space around it."""
    at = _gap(text, at)
    return _gap(text, at + 1) if at < len(text) and text[at] in marks else None


def _begins(text: str, after: int = 0) -> Iterator[int]:
    """Places where a run of word characters begins."""
    return (m.start() for m in RUN.finditer(text) if m.start() >= after)


# ---- what stands where ----
def acknowledgement(text: str) -> int | None:
    """Past a leading yes or ok and what parts it from the rest."""
    at = _gap(text, 0)
    run = RUN.match(text, at)
    if not run or run[0].lower() not in lx.ACKNOWLEDGEMENTS:
        return None
    end = _gap(text, run.end())
    if end < len(text) and text[end] in ",.;:!?":
        while end < len(text) and text[end] in ",.;:!?":
            end += 1
        return _gap(text, end)
    if end < len(text) and text[end] in DASHES:
        return _gap(text, end + 1)
    return end if end > run.end() else None


def _label_ends(text: str, name: int, lead: str) -> Iterator[int]:
    """Where a label with "name" at a place may end: with its note in brackets, without, or as "names"."""
    end = name + 4
    if lead in ("", "your"):
        at = _gap(text, end)
        if at < len(text) and text[at] == "(":
            said = _says(text, _gap(text, at + 1), ("first",))
            joint = said and _says(text, _gap(text, said[1]), ("and", "&"))
            last = joint and _says(text, _gap(text, joint[1]), ("last",))
            close = _gap(text, last[1]) if last else len(text)
            if close < len(text) and text[close] == ")":
                yield close + 1
    yield end
    if not lead and text[end : end + 1].lower() == "s":
        yield end + 1


def keyed_names(text: str) -> Iterator[tuple[str, list[Place]]]:
    """(label, one or two words) of "name: First Last" and its kin, one after the other."""
    done, low = 0, text.lower() if len(text.lower()) == len(text) else text
    name = low.find("name")
    while name >= 0:
        before = len(text[:name].rstrip())
        leads = [w for w in ("your", "first", "last") if before < name and low[:before].endswith(w) and _edge(text, before - len(w))]
        starts = [(before - len(w), w) for w in leads] + ([(name, "")] if _edge(text, name) else [])
        for start, lead in starts:
            found = None
            for end in _label_ends(text, name, lead) if start >= done else ():
                first = _word(text, _mark(text, end, ":-"), PLAIN)
                if first:
                    second = _word(text, _apart(text, first[1]), PLAIN)
                    found = " ".join(text[start:end].lower().split()), [first, second] if second else [first]
                    break
            if found:
                yield found
                done = found[1][-1][1]
                break
        name = low.find("name", max(name + 1, done))


def labelled_name(text: str) -> Iterator[tuple[str, str, Place]]:
    """(how, label, name) at the start, in this order: "Smith last name" (after), "last name: Smith" (keyed), "last name Smith" (plain)."""
    at = _gap(text, 0)
    name = _word(text, at, PLAIN)
    said = _says(text, _apart(text, name[1]), lx.NAME_LABELS) if name else None
    if said and _edge(text, said[1]):
        yield "after", said[0], name
    said = _says(text, at, lx.NAME_LABELS)
    if said and (name := _ended(text, _word(text, _mark(text, said[1], ":-"), PLAIN), False)):
        yield "keyed", said[0], name
    said = _says(text, at, lx.LAST_NAME_LABELS)
    if said and (name := _ended(text, _word(text, _apart(text, said[1]), PLAIN), False)):
        yield "plain", said[0], name


def told_last_name(text: str) -> Place | None:
    """The name in "last name is Smith", wherever it stands."""
    for at in _begins(text):
        said = _says(text, at, tuple(f"{label} is" for label in lx.LAST_NAME_LABELS))
        if said and (name := _ended(text, _word(text, _apart(text, said[1])), True)):
            return name
    return None


def name_before_firm(text: str) -> tuple[Place, Place, list[str]] | None:
    """Two words after the end of a sentence, and the one to six words with which the text ends after them."""
    before = text.rsplit(None, 6)
    least = len(before[0]) if len(before) == 7 else 0  # from here on there are six words at most
    for at in (i for i, c in enumerate(text) if c in "?.!"):
        a = _word(text, _apart(text, at + 1))
        b = _word(text, _apart(text, a[1])) if a else None
        if b and b[1] >= least and text[b[1] : b[1] + 1].isspace():
            tail = text[b[1] :].split()
            if tail and all(TAIL_WORD.fullmatch(t) for t in tail):
                return a, b, tail
    return None


def signature(text: str) -> tuple[int, Place, str | None, Place] | None:
    """(start, first, middle initial, last) of a name that ends the text after a stop, a dash or in brackets."""
    end = len(text.rstrip())
    for at in (i for i, c in enumerate(text) if c in ".!?(" or c in DASHES):
        a = _word(text, _gap(text, at + 1))
        after = _apart(text, a[1]) if a else None
        if after is None:
            continue
        initial = _initial(text, after)
        for middle, b in ((text[after : after + 1], _word(text, initial)), (None, _word(text, after))):
            if b is None:
                continue
            close = text[b[1] : b[1] + 1] == ")"
            if b[1] + close >= end:
                return (at, a, middle, b) if close or text[at] != "(" else None
    return None


def _initial(text: str, at: int | None) -> int | None:
    """Past a single letter, its full stop if it has one, and white space."""
    if at is None or at >= len(text) or not WORD.match(text, at):
        return None
    return _apart(text, at + 1 + (text[at + 1 : at + 2] == "."))


def two_agents(text: str) -> list[Place] | None:
    """The four words of "First Last, First Last, realtors" at the start."""
    out: list[Place] = []
    at: int | None = _gap(text, 0)
    for step in (_apart, None, _apart, None):
        place = _word(text, at)
        if place is None:
            return None
        out.append(place)
        at = step(text, place[1]) if step else _mark(text, place[1], ",")
    run = RUN.match(text, at) if at is not None else None
    return out if run and run[0].lower() in lx.AGENT_TITLES else None


def alias(text: str) -> tuple[Place, Place, int] | None:
    """(name, other name, end) of "Jem (Jemima)", "Jem - short for Jemima", "Jem-Jemima" at the start."""
    lead = _word(text, _gap(text, 0))
    if lead is None:
        return None
    hyphens = [i for i in range(lead[1] - 1, lead[0], -1) if text[i] == "-"]
    for end in (lead[1], *hyphens):
        at = _gap(text, end)
        if text[at : at + 1] == "(":
            other = _word(text, at + 1)
            if other and text[other[1] : other[1] + 1] == ")":
                return (lead[0], end), other, other[1] + 1
        elif at < len(text) and text[at] in DASHES:
            at = _gap(text, at + 1)
            said = _says(text, at, lx.ALIAS_CUES)
            other = (_word(text, _apart(text, said[1])) if said else None) or _word(text, at)
            if other:
                return (lead[0], end), other, other[1]
    return None


def with_initial(text: str) -> tuple[Place, int, Place] | None:
    """(first, place of the initial, last) of "Orla H. Quist" at the start."""
    a = _word(text, _gap(text, 0))
    at = _apart(text, a[1]) if a else None
    b = _ended(text, _word(text, _initial(text, at)), True)
    return (a, at, b) if b else None


def introduced(text: str) -> Iterator[tuple[str, Place]]:
    """(cue as it is spaced, one to five words) after "my name is", "I am" and their kin, one after the other."""
    done = 0
    for at in _begins(text):
        said = _says(text, at, lx.INTRODUCTIONS) if at >= done else None
        first = _word(text, _apart(text, said[1]), PLAIN) if said else None
        if first:
            end = first[1]
            for _ in range(4):
                more = _word(text, _apart(text, end), PLAIN)
                if more is None:
                    break
                end = more[1]
            yield text[at : said[1]].lower(), (first[0], end)
            done = end


def this_is_from(text: str) -> Iterator[tuple[Place, Place]]:
    """The two words of "this is First Last with", "from" or "at"."""
    done = 0
    for at in _begins(text):
        said = _says(text, at, ("this is",)) if at >= done else None
        a = _word(text, _apart(text, said[1]), PLAIN) if said else None
        b = _word(text, _apart(text, a[1]), PLAIN) if a else None
        cue = _says(text, _apart(text, b[1]), ("with", "from", "at")) if b else None
        if cue and _edge(text, cue[1]):
            yield a, b
            done = cue[1]


def _joined(text: str, at: int | None) -> int | None:
    """Past "and" or "&" and white space."""
    for w in ("and", "&") if at is not None else ():
        if text.startswith(w, at):
            return _apart(text, at + len(w))
    return None


def two_names(text: str) -> Iterator[tuple[Place, Place, Place, Place]]:
    """The four words of "First Last and First Last", each with a capital."""
    done = 0
    for at in _begins(text):
        a = _capital(text, at) if at >= done else None
        b = _capital(text, _apart(text, a[1])) if a else None
        c = _capital(text, _joined(text, _apart(text, b[1]))) if b else None
        d = _ended(text, _capital(text, _apart(text, c[1])), False) if c else None
        if d:
            yield a, b, c, d
            done = d[1]


def shared_last_name(text: str) -> Iterator[Place]:
    """The stretch of "First and First Last", the first and the last word with a capital."""
    done = 0
    for at in _begins(text):
        a = _capital(text, at) if at >= done else None
        b = _word(text, _joined(text, _apart(text, a[1])), PLAIN) if a else None
        c = _ended(text, _capital(text, _apart(text, b[1])), False) if b else None
        if c:
            yield a[0], c[1]
            done = c[1]


def all_capitalised(text: str) -> bool:
    """Nothing but one to five words with capitals, and a closing mark."""
    body = text.strip()
    body = body[:-1] if body[-1:] in tuple(".!?") else body
    words = body.split()
    return body == body.rstrip() and 1 <= len(words) <= 5 and all(_capital(w, 0) == (0, len(w)) for w in words)


def untitled(text: str) -> str:
    """Without a leading title, its full stop and the white space after it."""
    run = RUN.match(text)
    if not run or run[0].lower() not in lx.TITLES:
        return text
    rest = text[run.end() + (text[run.end() : run.end() + 1] == ".") :]
    return rest.lstrip() if rest[:1].isspace() else text
