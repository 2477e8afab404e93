"""Analytics over semi-structured postings, profiles and events, on Spark."""
