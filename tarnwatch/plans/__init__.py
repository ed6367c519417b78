"""Queries over the driver's tables: logical inputs, registered plans and their oracle SQL."""
