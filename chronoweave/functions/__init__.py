from chronoweave.functions.timecols import (
    add_micros, bucket_of, micros_between, seconds_between, to_ntz,
)
from chronoweave.functions.ordered import ordered_columns, ordered_lag, ordered_cumsum

__all__ = ["add_micros", "bucket_of", "micros_between", "seconds_between", "to_ntz",
           "ordered_columns", "ordered_lag", "ordered_cumsum"]
