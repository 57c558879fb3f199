"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86400e6
EPOCH_2000 = "2000-01-01"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_gap(later, earlier, *, dates: bool = False) -> Column:
    """Fractional days from ``earlier`` to ``later``.

    With ``dates=True`` both sides are calendar dates and the integer
    ``datediff`` is used; otherwise both are cast to timestamps and the
    microsecond difference is divided by one day.
    """
    if dates:
        return F.datediff(_c(later), _c(earlier)).cast("double")
    return (F.unix_micros(_c(later).cast("timestamp")) - F.unix_micros(_c(earlier).cast("timestamp"))) / F.lit(DAY_MICROS)


def day_number(c, origin: str = EPOCH_2000) -> Column:
    """Whole days since ``origin``, truncated toward zero like numpy."""
    return day_gap(_c(c), F.lit(origin).cast("timestamp")).cast("long")


def floor_day(c) -> Column:
    """Timestamp floored to midnight."""
    return F.date_trunc("day", _c(c))


def age_years(at, dob) -> Column:
    """Age as days / 365."""
    return day_gap(at, dob) / F.lit(365.0)


def parse_date(c, fmt: str = "M/d/yyyy", n_chars: int | None = None) -> Column:
    """Parse the first ``n_chars`` characters with ``fmt``; bad input -> null."""
    s = _c(c)
    if n_chars is not None:
        s = F.substring(s, 1, n_chars)
    return F.to_date(F.try_to_timestamp(s, F.lit(fmt)))


def parse_timestamp(c, fmt: str = "yyyy-MM-dd HH:mm", n_chars: int | None = 16) -> Column:
    s = _c(c)
    if n_chars is not None:
        s = F.substring(s, 1, n_chars)
    return F.try_to_timestamp(s, F.lit(fmt))


def follow_up_days(death, last_contact, origin) -> Column:
    """max(death - origin, last contact - origin) skipping nulls."""
    return F.greatest(F.datediff(_c(death), _c(origin)), F.datediff(_c(last_contact), _c(origin)))


def cap_at(c, cap) -> Column:
    """``c`` capped at ``cap`` when ``cap`` is known."""
    return F.when(_c(cap).isNotNull() & (_c(c) > _c(cap)), _c(cap)).otherwise(_c(c))


def censor_time(t, horizon: float) -> Column:
    """Administrative censoring time."""
    return F.least(_c(t), F.lit(horizon))


def censor_event(dead, t, horizon: float) -> Column:
    return F.when(_c(t) > F.lit(horizon), F.lit(False)).otherwise(_c(dead))
