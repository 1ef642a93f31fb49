"""Plan-shape helpers: reshaping, skew-safe ordered statistics, checked broadcasts."""

from probity.plans.ordering import average_ranks, order_bucket, row_numbers, running_sums
from probity.plans.reshape import bounded_broadcast, checked_broadcast, to_long

__all__ = ["average_ranks", "bounded_broadcast", "checked_broadcast", "order_bucket",
           "row_numbers", "running_sums", "to_long"]
