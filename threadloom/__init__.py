"""threadloom: retrieval and text processing over conversational records, on Spark DataFrames."""
