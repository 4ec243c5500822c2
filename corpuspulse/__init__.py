"""corpuspulse: media-coverage analytics on Spark DataFrames.

Operators are plain functions ``DataFrame -> DataFrame`` (or ``Column -> Column``)
so that Catalyst sees one declarative plan per report.
"""

from corpuspulse.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
