"""The whole comparison of two call graphs."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame

from callweave.operators.stages import exact_match, inline_match, similar_match, structural_match
from callweave.schema import Options
from callweave.session import cut

log = logging.getLogger(__name__)


def match_graphs(g1: DataFrame, g2: DataFrame, options: Options | None = None, metrics: dict[str, int] | None = None) -> DataFrame:
    """g2_idx, g1_idx, stage, score: a one-to-one partial match of g2 (base) to g1 (reference) functions.

    Equal names first, then similar names, then structure, and with
    ``options.inline`` reach. Each stage sees what those before it matched; its
    rows are kept before the next begins. ``metrics`` gets the rows of each stage.
    """
    options = options or Options()
    g1, g2 = g1.persist(), g2.persist()
    try:
        match = cut(exact_match(g1, g2))
        stages = [("similar", lambda m: similar_match(g1, g2, m, options.least)), ("structural", lambda m: structural_match(g1, g2, m, options.max_rounds))]
        if options.inline:
            stages.append(("inline", lambda m: inline_match(g1, g2, m, options.least, options.depth)))
        _note(metrics, "exact", match)
        for name, stage in stages:
            new = cut(stage(match))
            _note(metrics, name, new)
            match = match.unionAll(new)
        return cut(match)
    finally:
        g1.unpersist()
        g2.unpersist()


def _note(metrics: dict[str, int] | None, stage: str, rows: DataFrame) -> None:
    if metrics is not None:
        metrics[stage] = rows.count()
        log.info("%s: %d matched", stage, metrics[stage])
