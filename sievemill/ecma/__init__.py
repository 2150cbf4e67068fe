"""JavaScript as text, tokens and trees, in plain Python: nothing here needs Spark."""
