"""Barloom: market-analytics and corpus operators expressed as Spark plans."""
