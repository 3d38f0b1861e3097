"""All registered queries of the talk engine and their SQL."""

from __future__ import annotations

from rostrum.queries import alignment, assembly, coherence, deck, delivery, nested, probe, report, signals, training

QUERIES: dict = {}
ORACLE: dict = {}
for _part in (delivery, deck, coherence, report, training, alignment, assembly, probe, signals, nested):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE
