"""Settings of each stage; the defaults are the published ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CorpusConfig:
    total_samples: int = 240_000
    min_words: int = 50
    max_words: int = 512
    min_unique_ratio: float = 0.20
    train_ratio: float = 0.70
    val_ratio: float = 0.15
    test_ratio: float = 0.15
    seed: int = 42
    language_chars: int = 500
    rows_per_chat_file: int = 15_000
    human_source_target: int = 20_000


@dataclass(frozen=True)
class GenreConfig:
    samples_per_class: int = 20_000
    max_tokens: int | None = None  # whole texts; a number cuts them
    max_chars: int = 1_500
    hash_features: int = 1 << 16
    val_ratio: float = 0.1
    test_ratio: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class StyloConfig:
    """Boosted trees on the stylometric features."""

    trees: int = 1_000
    depth: int = 8
    step: float = 0.03
    row_fraction: float = 0.9
    feature_fraction: float = 0.9
    min_child_weight: float = 5.0
    gamma: float = 0.1
    l1: float = 0.1
    l2: float = 1.0
    max_bins: int = 256
    patience: int = 50
    importance_threshold: float = 0.01
    seed: int = 42
    rows_in_task: int = 200_000  # nodes of more rows are split by jobs over all tasks
    rounds_per_job: int = 100  # where one task has all rows


@dataclass(frozen=True)
class SemanticConfig:
    max_tokens: int | None = None  # whole texts; a number cuts them
    hash_features: int = 1 << 18
    max_iter: int = 50
    reg: float = 1e-3


@dataclass(frozen=True)
class RatioConfig:
    """Cross-perplexity of two counted n-gram models."""

    max_tokens: int | None = None  # whole texts; a number cuts them
    bigram_weight: float = 0.7
    trigram_weight: float = 0.7
    floor: float = 1e-6
    neutral: float = 1.0
    max_loss: float = 0.0  # nats a fitting token that pruning the trigrams may cost; 0 keeps all


@dataclass(frozen=True)
class FusionConfig:
    hidden: tuple[int, ...] = (32, 16)
    dropout: tuple[float, ...] = (0.2, 0.1)
    max_iter: int = 50  # epochs
    rate: float = 1e-3
    batch_rows: int = 256  # more where an epoch would have over max_steps steps
    max_steps: int = 64
    patience: int = 10
    folds: int = 3  # base models that score train rows never saw them; 0 or 1: they did
    rows_in_task: int = 200_000
    saturation: float = 0.990
    low_percentile: float = 0.05
    high_percentile: float = 0.95
    spread_floor: float = 1e-6
    neutral_probability: float = 0.5
    neutral_formality: float = 0.5
    seed: int = 42


@dataclass(frozen=True)
class ScoringConfig:
    min_words: int = 20
    long_newlines: int = 30
    min_words_after_strip: int = 100
    threshold: float = 0.50
    sentence_human: float = 0.35
    verdict_ai: float = 0.65
    verdict_human: float = 0.35
    long_document_sentences: int = 50
    conflict_high: float = 0.80
    conflict_high_share: float = 0.15
    conflict_low: float = 0.20
    conflict_low_share: float = 0.85
    preview_chars: int = 120
    report_preview_chars: int = 800
