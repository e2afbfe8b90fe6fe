"""tidewash: cleaning and profiling of tabular data with Spark DataFrames."""

ROW_ID = "_row_id"
