from .sink import same_multiset, same_order, write_text  # noqa: F401
from .stats import column_stats, has_histogram, histogram, physical_order, profile  # noqa: F401
from .iocost import io_cost  # noqa: F401
