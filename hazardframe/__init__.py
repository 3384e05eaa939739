"""hazardframe: chemical-safety table processing as Spark DataFrame plans.

Sub-packages:
  sources    readers / writers (CSV, delimited text, Parquet, JSON documents, keyed tables)
  functions  Column builders (text normalisation, edit-distance metrics, Jaro-Winkler,
             identifier rules, hazard-class and route normalisers)
  operators  DataFrame operators (cleaning, joins, priority pick, labels, metrics, features, ML)
  plans      end-to-end plans that stitch operators together over the driver tables
  streaming  incremental runners for the stateless operators over arriving files
"""

from hazardframe.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
