"""plumbline: a PySpark engine that audits labelled datasets and evaluates binary classifiers.

Everything is expressed on DataFrames; Python code only runs where built-in
expressions cannot say what is meant, and then on Arrow batches.
"""

__version__ = "0.1.0"
