"""Joins, windows and distributions that hold when one key owns a third of all rows."""
