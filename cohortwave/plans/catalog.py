"""All registered queries."""

from . import bind_evaluate, bind_models, bind_segments, bind_sources, bind_stats  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
