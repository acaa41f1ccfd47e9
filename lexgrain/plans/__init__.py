"""Whole workflows, and the relations and queries of the driver contract."""
