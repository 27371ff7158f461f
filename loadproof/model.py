"""What a reference between tables is."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Edge:
    """A foreign key: columns pair by position; the parent columns may be any key of the parent."""

    name: str
    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    child_key: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.child_columns or len(self.child_columns) != len(self.parent_columns):
            raise ValueError(f"{self.name}: the columns of child and parent don't pair up")
