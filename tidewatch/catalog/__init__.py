"""Every registered query with its SQL twin, by topic."""

from tidewatch.catalog.registry import entries  # noqa: F401
