"""Rule operators: each turns a snapshot of repositories into findings."""

from .base import FINDINGS, Snapshot
from .registry import RULES, scan, scan_configured

__all__ = ["FINDINGS", "RULES", "Snapshot", "scan", "scan_configured"]
