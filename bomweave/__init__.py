"""AI bill-of-materials analytics on Spark."""

from .functions.dims import Dictionaries
from .plans.scan_report import Branding, ScanReport, scan_report

__all__ = ["Branding", "Dictionaries", "ScanReport", "scan_report"]
