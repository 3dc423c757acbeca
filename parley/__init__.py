"""Parley: conversation-to-labelled-dataset analytics on Spark DataFrames."""

__version__ = "0.1.0"
