"""geopanel: geo-temporal sentiment panels on Spark DataFrames."""

from geopanel.session import get_session

__all__ = ["get_session"]
