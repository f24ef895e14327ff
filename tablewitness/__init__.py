"""Table authenticity analytics on Spark: measure how natural a table looks, and say why."""

from tablewitness.operators.benford import first_digit_table
from tablewitness.operators.corruption import METHODS, augment, corrupt, perturb
from tablewitness.operators.domain import detect_domain
from tablewitness.operators.temporal import temporal_features
from tablewitness.plans.calibrate import calibrate
from tablewitness.plans.profile import profile
from tablewitness.plans.score import score, score_csv

__all__ = [
    "METHODS",
    "augment",
    "calibrate",
    "corrupt",
    "detect_domain",
    "first_digit_table",
    "perturb",
    "profile",
    "score",
    "score_csv",
    "temporal_features",
]
