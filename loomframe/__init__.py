"""loomframe: the data plane of language-model post-training on Spark DataFrames."""

__version__ = "0.1.0"
