"""Dimension and fact loads, reports, menus and the jobs that tie them together."""
