"""Cadenza: episodes, clocks and corpora as Spark DataFrames."""
