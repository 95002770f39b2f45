"""Queries over the driver's tables, with the SQL each must agree with."""
