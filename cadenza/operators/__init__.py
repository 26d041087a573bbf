"""Operators on episodes: frames keyed by (ep, f), as DataFrame expressions that share one partitioning by episode."""
