"""vigil: account-takeover analytics on Spark DataFrames."""
