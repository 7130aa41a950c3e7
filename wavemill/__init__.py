"""Signal analytics on Spark: long recordings as DataFrames, filtered, resampled and analysed by declarative plans."""
