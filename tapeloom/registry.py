"""All registered queries of the recording operators and their SQL."""

from __future__ import annotations

from .queries import archive, breaks, catalogue, clocks, cuts, gaps, hot, intervals, runs, streams

FLAGSHIP = "d3_break_blocks"
_MODULES = (intervals, gaps, runs, clocks, breaks, cuts, catalogue, archive, streams, hot)
QUERIES = {f.__name__: f for m in _MODULES for f in m.QUERIES}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
