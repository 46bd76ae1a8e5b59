"""Queries made of several operators: impact, plan, verification, and the workspace with its named tools."""
