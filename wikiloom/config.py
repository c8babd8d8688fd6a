"""Settings of index, retrieval and evaluation runs, with a JSON round trip."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Config:
    passages_path: str | None = None
    queries_path: str | None = None
    triples_path: str | None = None
    index_path: str | None = None
    dataset_mode: str = "QQP"
    passages_per_query: int | None = None
    similarity: str = "cosine"
    doc_maxlen: int = 220
    query_maxlen: int = 32
    min_df: int = 5
    k: int = 100
    spread: float = 2.0

    def __post_init__(self):
        if self.dataset_mode not in ("QQP", "QPP"):
            raise ValueError("dataset_mode is QQP or QPP")
        if self.similarity not in ("cosine", "l2"):
            raise ValueError("similarity is cosine or l2")


#: Presets of the two kinds of data sets.
PAGES = Config(dataset_mode="QQP")
SEARCH = Config(dataset_mode="QPP", passages_per_query=10)


def save(config: Config, path: str) -> None:
    with open(path, "w") as f:
        json.dump(asdict(config), f, indent=1)


def load(path: str) -> Config:
    """Unknown keys are an error, so that a mistyped setting is not ignored."""
    with open(path) as f:
        values = json.load(f)
    if unknown := set(values) - {f.name for f in fields(Config)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Config(**values)
