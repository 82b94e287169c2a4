"""Parameters of the stages with their defaults."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Ingest:
    min_caption_chars: int = 1
    primary: str = "longest"
    train: float = 0.90
    val: float = 0.05
    seed: int = 13
    drop_missing_caption: bool = True
    drop_missing_tags: bool = False
    drop_missing_audio: bool = False


@dataclass(frozen=True)
class CaptionJoin:
    separator: str = "§§"
    strategy: str = "longest"
    keep_unmatched: bool = True
    overwrite: bool = False


@dataclass(frozen=True)
class Lyrics:
    only_vocal: bool = True
    allowed_vocals: tuple[str, ...] = ("vocal",)
    most_suffix_words: int = 2


@dataclass(frozen=True)
class StructuredView:
    strip_outer: bool = False
    top_tags: int | None = None


@dataclass(frozen=True)
class Embeddings:
    batch: int = 512
    truncate: int | None = None
    overwrite: bool = False


@dataclass(frozen=True)
class Neighborhood:
    audio_top_k: int = 500
    retain: int = 100
    audio_weight: float = 0.5
    text_weight: float = 0.5
    exclude_same_track: bool = True
    most_changed_tags: int | None = 6
    least_similarity: float | None = None
    block_rows: int = 4096


@dataclass(frozen=True)
class Graph:
    most_changed_tags: int = 6
    weights: tuple[float, float, float] = (0.4, 0.4, 0.2)
    shards: int = 4096


@dataclass(frozen=True)
class Chains:
    chains: int = 1_000_000
    shortest: int = 1
    longest: int = 6
    mu: float = 0.7
    sigma: float = 0.75
    seed: int = 13


@dataclass(frozen=True)
class Instructions:
    variants: int = 5
    verbosity: tuple[float, float, float] = (0.4, 0.3, 0.3)
    clauses: tuple[float, ...] = (0.5, 0.3, 0.15, 0.05)
    extra_change: float = 0.67
    most_clauses: int = 4
    most_terms: int = 8
    most_phrases: int = 6
    seed: int = 13


@dataclass(frozen=True)
class Validation:
    require_both: bool = True
    min_chars: int = 12


@dataclass(frozen=True)
class Pool:
    candidates: int = 96
    solvable_rank: int = 3
    solvable_score: float = 0.35


@dataclass(frozen=True)
class Gate:
    threshold: float = 4.0
    policy: str = "best"
    mean_chain_score: bool = False
    contextual: str = "truncate"


@dataclass(frozen=True)
class Config:
    ingest: Ingest = field(default_factory=Ingest)
    caption_join: CaptionJoin = field(default_factory=CaptionJoin)
    lyrics: Lyrics = field(default_factory=Lyrics)
    structured_view: StructuredView = field(default_factory=StructuredView)
    embeddings: Embeddings = field(default_factory=Embeddings)
    neighborhood: Neighborhood = field(default_factory=Neighborhood)
    graph: Graph = field(default_factory=Graph)
    chains: Chains = field(default_factory=Chains)
    instructions: Instructions = field(default_factory=Instructions)
    validation: Validation = field(default_factory=Validation)
    pool: Pool = field(default_factory=Pool)
    gate: Gate = field(default_factory=Gate)

    def signature(self) -> str:
        """SHA-256 of the canonical JSON: outputs of runs with other parameters are told apart by it."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()
