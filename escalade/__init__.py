"""escalade — cascaded text-classification analytics on Spark.

DataFrame in, DataFrame out: text preparation, tier scoring, confidence
routing, threshold sweeps and decision analytics, all as Spark plans.
"""

__version__ = "0.1.0"
