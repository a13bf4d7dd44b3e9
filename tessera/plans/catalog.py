"""Tables, sequences, macros and other named things of one graph.

A table is an immutable DataFrame plus its declaration; changing one means
putting another DataFrame in its place, so a transaction is a copy of the
dictionaries.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .parser import QueryError


@dataclass
class NodeTable:
    """Rows of one label; ``pk`` is both the primary key and the node's id."""

    name: str
    df: DataFrame
    pk: str
    number: int
    comment: str = ""
    types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, tuple] = field(default_factory=dict)
    partition: tuple | None = None

    @property
    def props(self) -> list[str]:
        return self.df.columns


@dataclass
class RelTable:
    """Relationships of one label: a DataFrame with _src, _dst, _rid and the
    properties for each (FROM, TO) pair of node labels."""

    name: str
    parts: dict[tuple[str, str], DataFrame]
    number: int
    mult: str = "MANY_MANY"
    comment: str = ""
    types: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, tuple] = field(default_factory=dict)

    @property
    def props(self) -> list[str]:
        return [c for c in next(iter(self.parts.values())).columns if c not in ("_src", "_dst", "_rid")]


@dataclass
class Sequence:
    name: str
    start: int = 1
    by: int = 1
    low: int = 1
    high: int = 2**63 - 1
    cycle: bool = False
    value: int | None = None

    def current(self) -> int:
        if self.value is None:
            raise QueryError(f'currval: sequence "{self.name}" is not yet defined. To define the sequence, call nextval first.')
        return self.value

    def advance(self) -> int:
        first, _, _, _ = self.spread(1)
        return first

    def spread(self, n: int) -> tuple[int, int, int, int]:
        """Reserve the next ``n`` values: (first, left, again, size). Value i is first +
        i * by for i < left, and again + (i - left) % size * by from there on."""
        nxt = self.start if self.value is None else self.value + self.by
        step, again = abs(self.by), self.low if self.by > 0 else self.high
        size = (self.high - self.low) // step + 1
        left = max(0, (self.high - nxt if self.by > 0 else nxt - self.low) // step + 1)
        if not self.cycle and left < n:
            raise QueryError(f"nextval: reached limit of sequence {self.name}")
        if not left:
            nxt, left = again, size
        if n:
            self.value = nxt + (n - 1) * self.by if n <= left else again + (n - 1 - left) % size * self.by
        return nxt, left, again, size


class Catalog:
    def __init__(self):
        self.nodes: dict[str, NodeTable] = {}
        self.rels: dict[str, RelTable] = {}
        self.sequences: dict[str, Sequence] = {}
        self.macros: dict[str, tuple] = {}
        self.types: dict[str, str] = {}
        self.indexes: dict[str, dict] = {}
        self.projected: dict[str, dict] = {}
        self.version = 0
        self.next_number = 0

    def snapshot(self) -> Catalog:
        out = copy.copy(self)
        for k in ("nodes", "rels", "sequences"):
            setattr(out, k, {n: copy.copy(v) for n, v in getattr(self, k).items()})
        for t in out.rels.values():
            t.parts = dict(t.parts)
        for k in ("macros", "types", "indexes", "projected"):
            setattr(out, k, dict(getattr(self, k)))
        return out

    def number(self) -> int:
        self.next_number += 1
        self.version += 1
        return self.next_number - 1

    @staticmethod
    def _find(where: dict, name: str):
        if name in where:
            return where[name]
        for k, v in where.items():
            if k.upper() == name.upper():
                return v
        return None

    def node(self, name: str) -> NodeTable:
        found = self._find(self.nodes, name)
        if found is None:
            raise QueryError(f"Table {name} does not exist.")
        return found

    def rel(self, name: str) -> RelTable:
        found = self._find(self.rels, name)
        if found is None:
            raise QueryError(f"Table {name} does not exist.")
        return found

    def has(self, name: str) -> bool:
        return self._find(self.nodes, name) is not None or self._find(self.rels, name) is not None

    def sequence(self, name: str) -> Sequence:
        found = self._find(self.sequences, name)
        if found is None:
            raise QueryError(f"Sequence {name} does not exist.")
        return found
