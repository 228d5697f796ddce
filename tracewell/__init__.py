"""tracewell: code forensics over file corpora, expressed as Spark DataFrame jobs."""

from tracewell.options import ScanOptions
from tracewell.plans.scan import scan, scan_with_filenames

__all__ = ["ScanOptions", "scan", "scan_with_filenames"]
