"""Association discovery and hypothesis checking as Spark DataFrame jobs."""

from siftwright.operators.prep import Prep, PrepModel
from siftwright.operators.profile import ProfileConfig, profile
from siftwright.operators.screen import ScreenConfig, screen
from siftwright.operators.split import split_summary, train_test_split
from siftwright.plans.pipeline import discover

__all__ = [
    "Prep",
    "PrepModel",
    "ProfileConfig",
    "ScreenConfig",
    "discover",
    "profile",
    "screen",
    "split_summary",
    "train_test_split",
]
