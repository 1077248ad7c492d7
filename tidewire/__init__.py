"""tidewire: daily news-and-market signal panels on Spark DataFrames."""
