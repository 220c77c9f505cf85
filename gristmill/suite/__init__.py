"""All registered queries; importing a section registers its queries."""

from gristmill.suite import aggregates, joins, models, operations, preparation, reshape, rows, sources, streams, windows  # noqa: F401
from gristmill.suite.registry import ORACLE, QUERIES  # noqa: F401
