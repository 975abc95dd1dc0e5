"""Signature clustering, nearest-neighbour trees and bulk data preparation on Spark DataFrames."""

__version__ = "0.1.0"
