"""Security-event analytics on PySpark: scoring, zero-trust policy, response, ledger, rules, memory."""

from flowwarden.config import Policy
from flowwarden.session import build_session

__all__ = ["Policy", "build_session"]
