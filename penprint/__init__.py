"""Author-analysis operators on Spark DataFrames.

Sub-packages: ``sources`` (readers, writers, exports), ``functions`` (column
expressions and the ordering helpers), ``operators`` (DataFrame to DataFrame
work and fitted stages), ``plans`` (whole jobs built from operators) and
``catalog`` (one runnable query per operator, with the SQL it must agree with).
"""

from penprint.spec import Columns, TaskSpec

__all__ = ["Columns", "TaskSpec"]
