"""Columns over the seed struct that posts carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKED = ("politician", "influencer")
FOREIGN_EXCLUDED = ("media", "state")


def tracked_actor(seed: str = "seed") -> Column:
    """Actors under study; a foreign actor with unknown subtype is left out, as the comparison with null is null."""
    main, sub = F.col(f"{seed}.MainType"), F.col(f"{seed}.SubType")
    return main.isin(*TRACKED) | ((main == "foreign") & ~sub.isin(*FOREIGN_EXCLUDED))
