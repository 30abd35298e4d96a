"""Operators of a training-data pipeline over a ``documents`` table; nothing outside this folder imports them."""
