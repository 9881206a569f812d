"""A bitmap-sketch algebra and data-processing engine on Spark DataFrames."""
