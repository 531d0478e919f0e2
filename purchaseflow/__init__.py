"""purchaseflow: receipt extraction pipeline as Spark DataFrame plans."""

__version__ = "0.1.0"
