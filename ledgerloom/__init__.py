"""Analytics over corporate disclosure filings, declared as Spark DataFrames."""

from ledgerloom.session import build_session, ship

__all__ = ["build_session", "ship"]
