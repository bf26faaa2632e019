"""The registered queries of the engine, by subject; importing this package registers them all."""

from . import filings, frames, geometry, reports, statistics, universe, walkforward  # noqa: F401
