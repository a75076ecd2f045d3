"""Genomic interval, sequence and variant analytics as Spark DataFrame operators."""
