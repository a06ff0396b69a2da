"""Row predicates."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_space

# --- fixed values -----------------------------------------------------------
# File states.
STATUS_PROCESSING = "processing"
STATUS_DONE = "done"
STATUS_FAILED = "failed"
STATUS_TO_REVIEW = "to_review"
STATUSES = (STATUS_PROCESSING, STATUS_DONE, STATUS_FAILED, STATUS_TO_REVIEW)
# Operational defaults: tolerated bad rows per file, checkpoint cadence in
# valid rows, stale-lease timeout in seconds.
DEFAULT_MAX_ROW_ERRORS = 10
DEFAULT_CHECKPOINT_INTERVAL = 100
DEFAULT_HEARTBEAT_TIMEOUT_SECS = 20
# E-mail address (RFC 5322 section 3.4, letters beyond ASCII allowed, without
# comments): an addr-spec with a dot-atom or quoted local part, alone or in
# angle brackets after an optional display name.
_ATEXT = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~\x{80}-\x{10FFFF}-]"
_DOT_ATOM = rf"{_ATEXT}++(?:\.{_ATEXT}++)*+"
_QUOTED = r'"(?:[^"\\\x00-\x1F\x7F]|\\[^\x00-\x1F\x7F])*+"'
_ADDRESS = rf"(?:{_DOT_ATOM}|{_QUOTED})@{_DOT_ATOM}"
_NAME = rf"(?:(?:{_DOT_ATOM}|{_QUOTED})[ \t]*+)*+"
EMAIL_PATTERN = rf"^(?:{_ADDRESS}|{_NAME}<[ \t]*{_ADDRESS}[ \t]*>)$"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_credit(amount) -> Column:
    """Strictly positive amounts are credits; zero and negatives debits."""
    return _c(amount) > 0


def is_debit(amount) -> Column:
    return _c(amount) <= 0


def valid_email(col) -> Column:
    """P10: address check. NULL and malformed addresses are invalid."""
    return F.coalesce(trim_space(_c(col)).rlike(EMAIL_PATTERN), F.lit(False))


def not_delivered(email_sent) -> Column:
    """P11."""
    return ~F.coalesce(_c(email_sent), F.lit(False))


def as_timestamp(now) -> Column:
    if isinstance(now, Column):
        return now
    if isinstance(now, _dt.datetime):
        now = now.isoformat(sep=" ")
    return F.lit(now).cast("timestamp_ntz")


def lease_is_fresh(status, heartbeat_at, now, timeout_secs: int) -> Column:
    """A ``processing`` lease whose heartbeat is younger than the
    timeout. ``now`` is a parameter so that results are reproducible."""
    cutoff = as_timestamp(now) - F.make_dt_interval(secs=F.lit(timeout_secs))
    return (_c(status) == STATUS_PROCESSING) & (_c(heartbeat_at) > cutoff)

