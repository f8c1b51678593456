"""Data cleaning and analytics on PySpark DataFrames."""

from .operators.constraints import ConstraintCorrector, Dependency, parse_rules
from .operators.dedup import Deduplicator
from .operators.outliers import OutlierDetector
from .operators.transform import Cleaner

__all__ = ["Cleaner", "ConstraintCorrector", "Deduplicator", "Dependency", "OutlierDetector", "parse_rules"]
