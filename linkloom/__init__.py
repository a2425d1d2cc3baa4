"""Link discovery and keyphrase analytics over large note collections, on Spark DataFrames."""
