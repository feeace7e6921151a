"""Operators of a training-data pipeline over documents and web pages.

Each module holds one operator with its own interface; ``catalog`` derives the
registered queries from them. Every operator selects the columns it needs by
name, so further columns of its input, whatever they are called, change nothing.
"""
