"""Imports every plan module so their queries register."""

from . import generic_html, listing, netlog_jobs, run_jobs, stream_jobs  # noqa: F401
