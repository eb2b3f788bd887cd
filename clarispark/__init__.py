"""clarispark: interpretable rule mining, additive models and attribution on Spark."""

__version__ = "0.1.0"
