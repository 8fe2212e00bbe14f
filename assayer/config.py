"""Thresholds of scoring, gates and stop rules, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # fixed values: scores and gates
    fuzzy: float = 95.0
    fuzzy_authors: float = 98.0
    list_correct: float = 0.9
    fuzzy_credit: float = 0.9
    gate: float = 0.90
    kappa_gate: float = 0.80
    recall_floor: float = 0.85
    sensitivity_floor: float = 0.70
    class_support: int = 5
    least_classes: int = 2
    abstention_credit: float = 0.5
    excerpt_match: float = 90.0
    excerpt_penalty: float = 0.5
    judge_margin: float = 0.10
    visible_classes: int = 12
    # fixed values: stop rule and liveness
    iteration_budget: int = 25
    least_iterations: int = 5
    plateau: int = 3
    task_limit_gap: float = 0.05
    stale_job_s: int = 300
    least_heartbeat_s: int = 900
    stage_records: int = 100


T = Thresholds()
Z95, Z95_SHORT = 1.959964, 1.96
