"""loomweb: web-crawl analytics on Spark DataFrames."""
