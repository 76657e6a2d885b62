from ledgerloom.functions.columns import (  # noqa: F401
    attach_row,
    calendar_months_between,
    elapsed_days,
    month_of,
    ntz,
    safe_std,
)
from ledgerloom.functions.quantiles import exact_quantiles  # noqa: F401
