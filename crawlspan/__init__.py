"""Crawl and site-audit analytics on Spark DataFrames."""
