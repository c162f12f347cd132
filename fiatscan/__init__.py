"""Spark jobs that find, convert and compare prices over tables of any size."""
