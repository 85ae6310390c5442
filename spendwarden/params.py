"""Rule thresholds. Defaults are fixed values of the audit programme."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    as_of: dt.date = dt.date(2001, 7, 31)

    contract_splitting_min: float = 45000
    contract_splitting_max: float = 50000
    contract_splitting_count: int = 3
    contract_splitting_months: int = 12
    esbd_threshold: float = 25000
    esbd_band: float = 3000

    duplicate_payment_window_days: int = 30
    duplicate_min_amount: float = 100
    near_duplicate_min_amount: float = 5000
    related_duplicate_min_amount: float = 1000

    vendor_name_similarity: float = 0.85
    sequential_similarity: float = 0.70

    round_number_amounts: tuple = (10000, 25000, 50000, 100000)
    round_number_min_count: int = 5
    round_number_min_share: float = 0.25
    new_vendor_large_payment: float = 100000
    new_vendor_days: int = 730
    simple_ghost_min_total: float = 50000
    august_share: float = 0.20

    confidentiality_rate_threshold: float = 0.20
    confidentiality_min_count: int = 100
    confidentiality_recent_min: int = 50
    confidentiality_history_min: int = 100
    confidentiality_spike_delta: float = 0.10
    vendor_confidentiality_rate: float = 0.50
    vendor_confidentiality_min_count: int = 10

    hub_sigmas: float = 2.0
    hub_min_degree: int = 10
    cluster_min_size: int = 3
    cluster_max_size: int = 20
    exclusive_min_total: float = 100000
    exclusive_share: float = 0.80

    name_match_threshold: int = 90
    min_single_contribution: float = 500
    min_contribution_for_alert: float = 5000
    ghost_vendor_min_amount: float = 10000

    employee_vendor_name_similarity: float = 0.90

    ghost_vendor_min_payment: float = 25000

    fy_end_spike_multiplier: float = 2.0
    fy_end_min_amount: float = 100000
    fy_vendor_min_total: float = 50000
    fy_vendor_share: float = 0.70

    related_party_min_network_size: int = 3
    related_party_min_value: float = 500000
    triangle_similarity: float = 0.80
    circular_min_confidence: float = 0.70
    circular_min_total: float = 50000

    debarment_name_similarity: float = 0.90
    debarment_min_payment: float = 1000
    single_screen_similarity: float = 0.85

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
