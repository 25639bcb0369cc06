"""All registered queries; importing the modules registers them."""

from promptmill.plans import annotations, documents, lifecycle, streams, versions  # noqa: F401
from promptmill.plans.registry import ORACLES, QUERIES  # noqa: F401
