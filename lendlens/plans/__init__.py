"""Composed plans: the audit pipeline and the registered queries."""

from .pipeline import AuditPipeline  # noqa: F401
