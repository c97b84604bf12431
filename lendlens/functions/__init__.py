"""Column-level helpers."""

from .exprs import (  # noqa: F401
    band,
    below,
    col,
    dlit,
    exceeds,
    guarded_least,
    ieee_divide,
    join_nonnull,
    label_map,
    md5_unit,
    nan_to_null,
    num_text,
    round_doubles,
    safe_divide,
    stable_hash64,
)
from .vectors import cosine_distance, dot, element, euclidean, l2_norm, normalize  # noqa: F401
