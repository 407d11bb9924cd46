"""Readers and writers.  Nothing here opens a file on the driver: paths go to Spark's readers."""
