"""Whole plans: composed screening, views over the test tables, registered queries."""
