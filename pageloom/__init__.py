"""pageloom: jobs over tables of web pages, written as Spark DataFrame operators."""

from pageloom.session import build_session, shared_dir

__all__ = ["build_session", "shared_dir"]
