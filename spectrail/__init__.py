"""spectrail: metabolite-annotation analytics and record cleaning on Spark DataFrames."""

__version__ = "0.1.0"
