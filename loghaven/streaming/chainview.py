"""What the chain says now: canonical headers, and where stored history leaves them.

The provider is the only authority. Announced heads are hints that something changed; a
hint is believed when the provider has the same header at its height.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from loghaven.errors import Fatal
from loghaven.sources.provider import Head, NotFound, Provider

#: Heights that a search for the fork looks at.
FORK_WALK = 1024


class Stored(Protocol):
    """Reads of the store that the comparison needs."""

    def stored_hash(self, number: int) -> str | None: ...


class ChainView:
    """Canonical headers of a provider, with errors that say what they were for."""

    def __init__(self, provider: Provider):
        self.provider = provider

    def head(self, number: int, purpose: str) -> Head | None:
        """The header at a height; None where the chain does not reach."""
        try:
            return self.provider.head_by_number(number)
        except NotFound:
            return None
        except Exception as e:
            raise Fatal(f"{purpose}: {e}") from e

    def span(self, low: int, high: int, purpose: str) -> list[Head]:
        """All headers of a range, in one request where the provider can."""
        try:
            if hasattr(self.provider, "heads"):
                return self.provider.heads(low, high)
            return [self.provider.head_by_number(n) for n in range(low, high + 1)]
        except Exception as e:
            raise Fatal(f"{purpose}: {e}") from e

    def newest(self, announced: Iterable[Head]) -> Head | None:
        """The highest announced head that is on the chain; heads of stale branches are passed over."""
        for head in sorted(set(announced), key=lambda h: -h.number):
            real = self.head(head.number, f"look up announced head {head.number}")
            if real is not None and real.hash == head.hash:
                return head
        return None

    def fork_point(self, store: Stored, height: int) -> Head:
        """The highest stored block below ``height`` that the chain still has.

        The stored hashes come in one read. Below a common block all blocks are common,
        so the chain is asked for a number of headers that is logarithmic in the range.
        """
        lowest = max(0, height - FORK_WALK)
        stored = _hashes(store, lowest, height - 1)
        missing = next((n for n in range(height - 1, lowest - 1, -1) if n not in stored), lowest - 1)
        good, bad = missing, height
        found = None
        while bad - good > 1:
            middle = (good + bad) // 2
            real = self.head(middle, f"compare block {middle} with the chain")
            if real is not None and real.hash == stored[middle]:
                good, found = middle, real
            else:
                bad = middle
        if found is None:
            if missing >= lowest:
                raise Fatal(f"block {missing} is not stored, the fork reaches below warehouse coverage; rebuild from the export")
            raise Fatal("no common ancestor above genesis" if lowest == 0 else f"no common ancestor within {FORK_WALK} blocks below {height}; verify the chain and rewind manually")
        return found


def _hashes(store: Stored, low: int, high: int) -> dict[int, str]:
    if hasattr(store, "hashes"):
        return store.hashes(low, high)
    found = {n: store.stored_hash(n) for n in range(high, low - 1, -1)}
    return {n: h for n, h in found.items() if h is not None}


def first_break(headers: list[Head], below: Head | None) -> int | None:
    """The lowest height whose header does not name the one below it."""
    chain = [below, *headers] if below is not None else headers
    return next((b.number for a, b in zip(chain, chain[1:], strict=False) if b.parent != a.hash), None)
