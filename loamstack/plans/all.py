"""Every plan's queries in one place."""

from . import answers, corpus, logs, pluggable, retrieval, service, vectors  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
