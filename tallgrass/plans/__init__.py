"""The query catalogue: every query with its equivalent SQL where SQL can express it."""
