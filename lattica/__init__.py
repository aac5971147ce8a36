"""Multimodal audit analytics on Spark."""

from .functions.labels import canonical_answer
from .functions.parse import parse_response
from .functions.scoring import score_response
from .functions.text import audit_prompt
from .operators.rewards import make_reward
from .types import TYPE_ORDER

__all__ = ["TYPE_ORDER", "audit_prompt", "canonical_answer", "make_reward", "parse_response", "score_response"]
