"""Spark-native analytics for labelled network-flow tables.

Every operator takes and returns Spark DataFrames.  Fitted statistics (class
counts, cut points, minima and maxima) are small DataFrames whose size is
checked before they are broadcast; the flow table itself is only filtered and
projected wherever the semantics allow it.
"""

__version__ = "0.1.0"
