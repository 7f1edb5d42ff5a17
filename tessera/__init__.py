"""Analytics over a memory store of text chunks, written for Spark."""
