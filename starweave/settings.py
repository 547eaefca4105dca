"""Fixed values of the rating rules, and the sizes that steer physical plans.

The first block and the model profiles must stay as they are: results depend
on them.  ``Tuning`` changes only how the work is spread, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
NEUTRAL_RATING = 3.45       # stands in for the mean of an unknown user or item
RATING_SPAN = 5.0           # divisor of the mean-difference similarity
FEW_CO_RATERS = 2           # up to this many co-raters Pearson is not used
SHRINKAGE = 10              # damping of the cosine similarity
PEARSON_NEIGHBOURS = 10
COSINE_NEIGHBOURS = 15
LOWEST_STAR, HIGHEST_STAR = 1.0, 5.0
POPULAR_ITEMS = 20
TOP_FEATURES = 15
MISSING_CATEGORY = "missing"
UNKNOWN_CODE = -1.0         # unknown category, as the tree models see it


@dataclass(frozen=True)
class BoostingProfile:
    """Parameters of one gradient-boosted tree model."""

    max_depth: int
    step_size: float
    trees: int
    row_share: float = 0.8
    column_share: float = 0.5
    min_rows_per_node: int = 1  # least second derivative on either side; squared error: rows
    seed: int = 7
    penalty: float = 1.0        # L2 term of the leaves


# --- fixed values: model parameters -----------------------------------------
FEATURE_MODEL = BoostingProfile(14, 0.051, 200, 0.8, 0.5, 60)
HYBRID_MODEL = BoostingProfile(14, 0.061, 300, 0.8, 0.6, 100)
SELECTOR_MODEL = BoostingProfile(16, 0.051, 300, 0.8, 0.6, 100, penalty=9.0)
# the same with fewer trees, for the registered query that trains two models one after the other
SHORT_HYBRID = BoostingProfile(14, 0.061, 60, 0.8, 0.6, 100)
SHORT_SELECTOR = BoostingProfile(16, 0.051, 60, 0.8, 0.6, 100, penalty=9.0)
# small profile for tests and smoke runs
QUICK_MODEL = BoostingProfile(4, 0.2, 5, 0.8, 1.0, 5)


@dataclass(frozen=True)
class Tuning:
    """Sizes used to route work; every setting gives the same rows."""

    # A user with more ratings than this is not self-joined: its co-ratings
    # are looked up for the requested item pairs only.
    heavy_user: int = 4_000
    # Most rows of one key that one cell of a many-to-many join may hold.
    grid_block: int = 10_000
    # Most fact rows of one key that one slot of a lookup join may hold.
    rows_per_slot: int = 1_000_000
    # Most measured hot keys of a key set (they are broadcast); the others are
    # split by the count of the least one.
    hot_keys: int = 10_000
    # Largest dictionary (rows, bytes of values) that is broadcast; larger ones
    # are shuffled.
    broadcast_rows: int = 100_000
    broadcast_bytes: int = 8 << 20

    @property
    def hot_from(self) -> int:
        """Row count from which a key is worth knowing about."""
        return min(self.heavy_user, self.grid_block, self.rows_per_slot)


DEFAULT_TUNING = Tuning()
