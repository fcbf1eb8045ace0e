"""cueflow: timed-text (subtitle and lyrics) processing on Spark DataFrames."""
