"""sparkgauge: Spark-native analytics over engineering and content data."""

from sparkgauge.session import build_session, configure

__all__ = ["build_session", "configure"]
