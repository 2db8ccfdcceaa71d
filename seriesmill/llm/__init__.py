"""Operators that prepare text for training language models.

Nothing outside this folder imports it; the driver contract adds its queries when it is present.
Each operator takes a DataFrame and the names of its id and text columns, reads only those, and leaves
every other column alone.
"""
