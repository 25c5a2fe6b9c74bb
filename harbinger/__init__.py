"""Early-warning panels for regions, as Spark DataFrame jobs.

Every public function takes DataFrames and returns DataFrames (or Columns);
nothing here collects data, and no Python function runs per row.
"""
