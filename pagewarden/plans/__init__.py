"""Whole jobs put together from the steps."""
