"""Spark-native analytics for personal and business transactions.

``sources`` read statements into RAW_TXN frames, ``operators`` normalise them (transfers, categories, tags, splits, FX,
edits), ``sinks`` keep them in partitioned Parquet, ``plans`` are the reports, ``streaming`` runs the same ingest
incrementally. Every public function takes and returns DataFrames or Columns and stays lazy unless it says otherwise.
"""
