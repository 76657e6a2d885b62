from ledgerloom.sources.transactions import (  # noqa: F401
    TX_SCHEMA,
    load_transactions,
    union_extracts,
)
from ledgerloom.sources.tables import (  # noqa: F401
    order_lines,
    purchase_events,
    split_extracts,
)
from ledgerloom.sources.sinks import write_outputs  # noqa: F401
from ledgerloom.sources.publishing import (  # noqa: F401
    publish_outputs,
    read_published,
)
from ledgerloom.sources.tolerant import load_tolerant  # noqa: F401
