"""Settings passed to the operators: column names and task descriptions."""

from __future__ import annotations

from dataclasses import dataclass, field

SPLITS = ("train", "val", "test")
SPLIT = "__split"


@dataclass(frozen=True)
class Columns:
    """Names of the columns that give a corpus its meaning."""

    doc_id: str = "doc_id"
    author: str = "author"
    created_at: str = "created_at"
    text: str = "text"
    label: str = "label"
    split: str = SPLIT


@dataclass(frozen=True)
class TaskSpec:
    """One prediction task over a corpus.

    A task's own ``split`` wins over the split of the corpus. ``merge`` makes the
    author the unit of prediction; ``group_by_author`` keeps documents as the
    unit but reports one vote per author.
    """

    name: str
    label: str
    split: str | None = None
    merge: bool = False
    group_by_author: bool = False
    task_type: str = "classification"
    average: str = "macro"
    balanced: bool | None = None
    language: str = "es"
    shares: tuple[float, float, float] = (0.6, 0.2, 0.2)
    columns: Columns = field(default_factory=Columns)

    @property
    def primary_key(self) -> str:
        return self.columns.author if self.merge else self.columns.doc_id
