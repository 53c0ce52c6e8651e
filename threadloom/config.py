"""Thresholds and other tunables, grouped the way the jobs use them."""

from __future__ import annotations

from dataclasses import dataclass

SEED = 42


@dataclass(frozen=True)
class EscalationLimits:
    """Cut-offs of the escalation rules; `echo` is only reported, never applied."""

    intent_confidence: float = 0.4
    retrieval_quality: float = 0.3
    echo: float = 0.5


# Used when no configuration is given.
UNCONFIGURED_LIMITS = EscalationLimits(intent_confidence=0.45, retrieval_quality=0.35)


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 5
    min_similarity: float = 0.35
    gate_similarity: float = 0.3
    overlap_boost: float = 0.05
    intent_boost: float = 0.05
    context_chars: int = 200

    @property
    def pool(self) -> int:
        return max(self.top_k * 3, 15)


@dataclass(frozen=True)
class BrandScoreSettings:
    min_outbound: int = 500
    min_inbound: int = 100
    sample_openings: int | None = None  # all


@dataclass(frozen=True)
class TermSettings:
    """Vocabulary limits and weighting of a TF-IDF model."""

    min_df: int = 2
    max_df: float = 0.9
    max_features: int = 10_000
    sublinear: bool = False


DISCOVERY_TERMS = TermSettings(min_df=5, max_df=0.8, max_features=5_000, sublinear=True)
CLASSIFIER_TERMS = TermSettings(min_df=2, max_df=0.9, max_features=10_000, sublinear=True)
BASELINE_TERMS = TermSettings(min_df=2, max_df=0.9, max_features=10_000, sublinear=False)

# A side is broadcast only after its size was counted and found below this.
BROADCAST_BYTES = 64 * 1024 * 1024
