"""Job-posting analytics as Spark jobs: extract, maintain, search, report, stream."""

from vacantia.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
