"""Column-level functions (built-in Spark expressions only)."""

from cadenza.functions.columns import (  # noqa: F401
    confidence, cosine, dot, hash_user_id, l2_distance, normalize, safe_div, sorted_json,
)
