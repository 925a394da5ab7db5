"""Drilling into the map: TRV-19 to TRV-24, API-12, STR-13, STR-15. The tree on a screen is a small value;
callees and reach come from the engine's frames for the nodes that are drilled."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from .. import schema as S


@dataclass(frozen=True)
class Entry:
    """kind node: a card; ref: a link to a card shown elsewhere; more: a stub for `hidden` callees."""

    kind: str
    parent: str | None
    depth: int
    id: str | None = None
    reach: int = 0
    hidden: int = 0


Callees = Callable[[str], Iterable[str]]
Reach = Callable[[str], int]


@dataclass(frozen=True)
class Tree:
    entries: tuple[Entry, ...]

    @classmethod
    def of(cls, candidates: Iterable[tuple[str, int]]) -> Tree:
        return cls(tuple(Entry("node", None, 0, i, r) for i, r in candidates))

    def shown(self) -> dict[str, Entry]:
        return {e.id: e for e in self.entries if e.kind == "node"}

    def expanded(self, node: str) -> bool:
        return any(e.parent == node for e in self.entries)

    def _layer(self, node: str, depth: int, callees: Callees, reach: Reach, skip: frozenset[str] = frozenset()) -> tuple[Tree, list[str]]:
        known = self.shown()
        found = set(callees(node)) - skip
        new = sorted(found - known.keys(), key=lambda c: (-reach(c), c))
        cards, hidden = new[: S.REVEAL_LAYER], len(new) - S.REVEAL_LAYER
        more = [Entry("node", node, depth, c, reach(c)) for c in cards] + [Entry("ref", node, depth, c) for c in sorted(found & known.keys())]
        if hidden > 0:
            more.append(Entry("more", node, depth, hidden=hidden))
        return Tree(self.entries + tuple(more)), cards

    def expand(self, node: str, callees: Callees, reach: Reach) -> Tree:
        """TRV-19: the node's callees; theirs too, if few are new."""
        at = self.shown().get(node)
        if at is None or self.expanded(node):
            return self
        tree, cards = self._layer(node, at.depth + 1, callees, reach)
        if len(cards) <= S.REVEAL_TWO_LAYERS:
            for c in cards:
                tree, _ = tree._layer(c, at.depth + 2, callees, reach)
        return tree

    def expand_more(self, node: str, callees: Callees, reach: Reach) -> Tree:
        """TRV-20: the next callees in place of the node's stub."""
        stub = next((e for e in self.entries if e.kind == "more" and e.parent == node), None)
        if stub is None:
            return self
        under = frozenset(e.id for e in self.entries if e.parent == node and e.id)
        return Tree(tuple(e for e in self.entries if e is not stub))._layer(node, stub.depth, callees, reach, under)[0]

    def collapse(self, node: str) -> Tree:
        """TRV-21: without what hangs below the node; what is linked from elsewhere moves to its first link.

        A descent over (parent, id): rounds add the ids whose parent is under the node, until none is new.
        """
        if node not in self.shown():
            return self
        hung = {e.id: e for e in self.entries if e.kind == "node" and e.parent is not None}
        under: set[str] = set()
        while more := {i for i, e in hung.items() if e.parent in under | {node}} - under - {node}:
            under |= more
        stays = [e for e in self.entries if (e.id not in under if e.kind == "node" else e.parent not in under | {node})]
        first = {e.id: k for k, e in reversed(list(enumerate(stays))) if e.kind == "ref" and e.id in under}
        return Tree(tuple(Entry("node", e.parent, e.depth, e.id, hung[e.id].reach) if first.get(e.id) == k and e.kind == "ref" else e for k, e in enumerate(stays)))

    def refreshed(self, known: set[str], callees: Callees, reach: Reach) -> Tree:
        """TRV-22: after a new map: without unknown nodes and what hung below them, reach renewed, and new callees of expanded nodes added."""
        kept: list[Entry] = []
        alive: set[str] = set()
        for e in sorted(self.entries, key=lambda e: e.depth):
            if e.kind == "node" and e.id in known and (e.parent is None or e.parent in alive):
                alive.add(e.id)
        expanded = [n for n in dict.fromkeys(e.parent for e in self.entries if e.parent) if n in alive]
        for e in self.entries:
            if e.kind == "node" and e.id in alive and (e.parent is None or e.parent in alive):
                kept.append(replace(e, reach=reach(e.id)))
            elif e.kind == "ref" and e.id in alive and e.parent in alive:
                kept.append(e)
        tree = Tree(tuple(kept))
        for n in expanded:
            under = frozenset(e.id for e in tree.entries if e.parent == n and e.id)
            tree, _ = tree._layer(n, tree.shown()[n].depth + 1, callees, reach, under)
        return tree

    def controls(self, callees: Callees) -> dict[str, int]:
        """TRV-23: for each card, how many callees aren't shown yet; cards without any are left out."""
        known = self.shown()
        counts = {n: len(set(callees(n)) - known.keys()) for n in known}
        return {n: c for n, c in counts.items() if c}

    def cards(self, name_of: Callable[[str], str]) -> list[tuple[str, str, str]]:
        """TRV-24: kind, parent and text of links and stubs, each once."""
        out = {(e.kind, e.parent, name_of(e.id) if e.kind == "ref" else f"{e.hidden} more"): None for e in self.entries if e.kind != "node"}
        return list(out)


@dataclass(frozen=True)
class History:
    """STR-13: places visited, HISTORY_MAX at most; a new one drops those ahead."""

    places: tuple = ()
    at: int = -1

    def push(self, place) -> History:
        if self.at >= 0 and self.places[self.at] == place:
            return self
        places = (*self.places[: self.at + 1], place)[-S.HISTORY_MAX :]
        return History(places, len(places) - 1)

    def move(self, by: int) -> History:
        to = self.at + by
        return replace(self, at=to) if 0 <= to < len(self.places) else self


def toggle_pin(pins: list[str], node: str) -> tuple[str, list[str]]:
    """STR-15: removed, added or full, and the pins."""
    if node in pins:
        return "removed", [p for p in pins if p != node]
    return ("full", pins) if len(pins) >= S.PINS_MAX else ("added", [*pins, node])
