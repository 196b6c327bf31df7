"""Stock, order, supplier and staff analytics as Spark DataFrame jobs.

Every public function takes a ``tables`` mapping (table name -> DataFrame, see
``stocklens.sources.schemas``) plus keyword parameters and returns DataFrames.
"""
