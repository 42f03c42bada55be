"""Training-data operators: stand-alone Spark operators over document tables.

Nothing outside this folder imports it; the rest of the library works without it.
"""
