"""lattix: sparse space-time data cubes and text-corpus operators on PySpark."""
