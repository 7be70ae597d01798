"""Tunables of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

CANONICAL_FIELDS = ("tx_id", "timestamp", "src_wallet", "dst_wallet", "amount_btc", "broadcast_ip", "asn")

# The twelve features of an entity, in the order that models and outputs use.
FEATURES = (
    "tx_count",
    "fan_in",
    "fan_out",
    "amount_mean",
    "amount_std",
    "amount_cv",
    "inter_tx_time_mean",
    "inter_tx_time_std",
    "distinct_ip_count",
    "distinct_asn_count",
    "network_obfuscation_score",
    "round_trip_time_mean",
)

EPSILON = 1e-9


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    # Fixed values from here to alert_threshold: rules and weights that results depend on.
    # linkage
    pass_through_gap_s: int = 600
    retention: float = 0.8
    entity_id_chars: int = 10
    # motifs
    peel_gap_s: int = 600
    peel_min_hops: int = 3
    fan_threshold: int = 6
    fan_window_s: int = 1800
    rapid_median_s: float = 300.0
    # detectors
    forest_trees: int = 200
    forest_sample: int = 256
    autoencoder_hidden: int = 8
    autoencoder_epochs: int = 30
    autoencoder_rate: float = 1e-3
    # fusion
    fusion_weights: dict[str, float] = field(default_factory=lambda: {"isolation_forest_score": 0.35, "autoencoder_score": 0.35, "motif_score": 0.30})
    alert_threshold: float = 0.6
    min_feedback: int = 8
    # explanation
    evidence_hops: int = 2
    explained_top: int = 50


DEFAULTS = Settings()
