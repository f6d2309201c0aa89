"""All registered queries."""

from workload import conditions, learning, rates, scans, streams, windows  # noqa: F401
from workload.base import ORACLE, QUERIES  # noqa: F401
