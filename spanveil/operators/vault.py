"""The token vault of one scope: which value has which placeholder.

Plain Python, used by the stateful fold in batch and in streaming. Tokens of an
entity are numbered by first appearance; equal values (after normalising) share
a token.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from spanveil.lexicon import ENTITIES, NAME_ENTITIES

TOKEN = re.compile(r"<(?P<entity>[a-z0-9]+)_(?P<n>\d+)>")


def normalise(entity: str, value: str) -> str:
    """What makes two values of an entity equal.

    Names keep ASCII letters and digits only, so accents vanish and names in
    other scripts all become the empty string; phones keep digits.
    """
    folded = " ".join(value.split()).lower()
    if entity in NAME_ENTITIES:
        return "".join(c for c in folded if c.isascii() and c.isalnum())
    if entity == "ph":
        return "".join(c for c in folded if c.isdecimal())
    return folded


@dataclass
class Vault:
    """Tokens in order of creation, by entity, and an index of normalised values."""

    profile: int = 1
    values: dict[str, str] = field(default_factory=dict)
    tokens: dict[str, list[str]] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    _index: dict[tuple[str, str], str] = field(default_factory=dict)
    #: Tokens whose values are new, in order; what follows the values reads on from where it was.
    changes: list[str] = field(default_factory=list, compare=False, repr=False)
    #: Made by ``names.repeats`` for this vault.
    repeats: object = field(default=None, compare=False, repr=False)

    def assign(self, entity: str, value: str, replace_latest: bool = False) -> str:
        """The value's token. A new value takes over the newest token if ``replace_latest``, else gets the next number."""
        if entity not in ENTITIES:
            raise ValueError(f"not an entity: {entity}")
        if not value:
            raise ValueError("a value must not be empty")
        key = entity, normalise(entity, value)
        known = self._index.get(key)
        if known:
            return known
        newest = self.latest(entity)
        if replace_latest and newest:
            old = self.values.get(newest)
            if old:
                self._index.pop((entity, normalise(entity, old)), None)
            token = newest
        else:
            n = self.counters.get(entity, 0) + 1
            while f"<{entity}_{n}>" in self.values:
                n += 1
            self.counters[entity] = n
            token = f"<{entity}_{n}>"
            self.tokens.setdefault(entity, []).append(token)
        self.values[token] = value
        self.changes.append(token)
        self._index[key] = token
        return token

    def latest(self, entity: str) -> str | None:
        own = self.tokens.get(entity)
        return own[-1] if own else None

    def latest_value(self, entity: str) -> str:
        return self.values.get(self.latest(entity) or "", "")

    def next_profile(self) -> int:
        """A profile is a count of users only; numbering goes on."""
        self.profile += 1
        return self.profile

    def of_profile(self, n: int | None = None) -> dict[str, str]:
        """The token numbered ``n`` (the current profile if not given) of each entity that has it."""
        n = self.profile if n is None else n
        return {e: t for e in ENTITIES if (t := f"<{e}_{n}>") in self.values}

    def token_of(self, entity: str, n: int | None = None) -> str | None:
        return self.latest(entity) if n is None and entity in ENTITIES else self.of_profile(n).get(entity) if n is not None else None

    def clear(self) -> None:
        self.profile = 1
        for part in (self.values, self.tokens, self.counters, self._index, self.changes):
            part.clear()
        self.repeats = None

    def snapshot(self) -> dict:
        most = max(self.counters.values(), default=0)
        by_number = {str(n): p for n in range(1, most + 1) if (p := self.of_profile(n))}
        return {
            "current_profile": self.profile,
            "token_to_value": dict(self.values),
            "entity_to_tokens": {e: list(t) for e, t in self.tokens.items()},
            "entity_counters": dict(self.counters),
            "profile_entity_to_token": by_number,
        }

    @classmethod
    def restore(cls, data: dict) -> Vault:
        """From a snapshot. What parts of it lack, or hold in another shape, the others make up for.

        The order of an entity's tokens is the listed one, else that of their
        numbers among the profiles, else among the values; a counter is the given
        one, or, if none is given, the highest number.
        """
        part = lambda name: data[name] if isinstance(data.get(name), dict) else {}
        out = cls(profile=int(data.get("current_profile", 1)), values={str(t): str(v) for t, v in part("token_to_value").items()})
        out.changes = list(out.values)
        named = {t: m for t in out.values if (m := TOKEN.match(t))}
        sources = (
            (((e, t) for e, ts in part("entity_to_tokens").items() if isinstance(ts, list) for t in ts), False),
            (((e, t) for own in part("profile_entity_to_token").values() if isinstance(own, dict) for e, t in own.items()), True),
            (((m["entity"], t) for t, m in named.items()), True),
        )
        out.tokens = next((found for pairs, by_number in sources if (found := _by_entity(pairs, by_number))), {})
        out.counters = {e: int(n) for e, n in part("entity_counters").items() if e in ENTITIES and _whole(n)}
        if not out.counters:
            out.counters = {e: top for e, ts in out.tokens.items() if (top := max(map(_number, ts))) > 0}
        out._index = {(m["entity"], normalise(m["entity"], out.values[t])): t for t, m in named.items() if m["entity"] in ENTITIES and out.values[t]}
        return out


def _number(token: str) -> int:
    m = TOKEN.match(token)
    return int(m["n"]) if m else 0


def _whole(n) -> bool:
    try:
        int(n)
    except (TypeError, ValueError):
        return False
    return True


def _by_entity(pairs, by_number: bool) -> dict[str, list[str]]:
    """Tokens of each entity, as they come, or each once by their numbers."""
    found: dict[str, list[str]] = {}
    for entity, token in pairs:
        if entity in ENTITIES and isinstance(token, str):
            found.setdefault(entity, []).append(token)
    return {e: sorted(set(ts), key=lambda t: (_number(t), t)) for e, ts in found.items()} if by_number else found
