from ardoise.functions.aggspec import (  # noqa: F401
    AggSpec,
    aggregate_columns,
    category_share,
    dummy_columns,
    dummy_five,
    five_numbers,
)
from ardoise.functions.exprs import (  # noqa: F401
    above,
    add_ratios,
    ascii_upper_name,
    clamp_zero,
    clean_label,
    decide,
    finite,
    hash_bucket,
    ieee_div,
    null_sentinel,
    round_half_even,
    score_band,
    sign_label,
    truncate_percent,
)
