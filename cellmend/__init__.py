"""Data repair on Spark: find wrong cells of tables, and mend them."""
