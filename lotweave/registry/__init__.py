"""All registered queries; importing the modules fills the registry."""

from lotweave.registry import extraction, jobs, scalars, structure  # noqa: F401
from lotweave.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
