"""Queries: operators put together over the tables of a folder, each with its SQL counterpart."""
