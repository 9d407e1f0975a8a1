"""The fixed "as of" values of the registered queries."""

from datetime import date, datetime

from sojourn.functions.dates import period_window, trailing_months

AS_OF = date(2001, 8, 1)
NOW = datetime(2024, 1, 31)

# Trailing 12 calendar months and the 12 before.
YEAR = period_window("month", AS_OF)
SPAN = {"start": YEAR.start, "end": YEAR.end}
BOTH = {**SPAN, "prev_start": YEAR.prev_start, "prev_end": YEAR.prev_end}
# Trailing 13 calendar months.
_start13, _end13 = trailing_months(AS_OF)
SPAN13 = {"start": _start13, "end": _end13}

# The same, for the oracle texts.
AS_OF_SQL = "date '2001-08-01'"
NOW_SQL = "timestamp '2024-01-31 00:00:00'"
IN_SPAN = "between timestamp '2000-09-01' and timestamp '2001-08-31 23:59:59.999999'"
IN_PREV = "between timestamp '1999-09-01' and timestamp '2000-08-31 23:59:59.999999'"
IN_SPAN13 = "between timestamp '2000-08-01' and timestamp '2001-08-31 23:59:59.999999'"
