"""Whole plans: the engine, the registered queries and the tables that they derive."""
