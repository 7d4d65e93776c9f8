"""riskloom: privacy-audit operators for Spark DataFrames."""

from riskloom.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
