"""loamdex: a document search and analytics engine on Spark DataFrames."""
