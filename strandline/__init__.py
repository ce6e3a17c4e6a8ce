"""Strandline: analytics over sampled signals, scan positions and trial tables, on PySpark."""
