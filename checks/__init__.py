"""Profiles derived from the test tables, and the independent SQL answers for them."""
