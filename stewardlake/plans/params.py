"""Fixed parameters of the registered queries (explicit points in time)."""

from ..sources.fixtures import ts_ntz

REQUESTS_AS_OF_TEXT = "2001-08-01 00:00:00"
FRESHNESS_AS_OF_TEXT = "2001-11-04 00:00:00"


def requests_as_of():
    return ts_ntz(REQUESTS_AS_OF_TEXT)


def freshness_as_of():
    return ts_ntz(FRESHNESS_AS_OF_TEXT)


# A decision batch is made by this steward, except that requesters of the
# BUILDING segment try to approve their own requests (self-approval guard).
STEWARD_EMAIL = "steward@example.org"
