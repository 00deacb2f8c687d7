"""Readers and writers; all files are reached through Spark, so any store works."""
