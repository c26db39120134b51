"""Web-corpus analytics expressed as PySpark DataFrame jobs.

``functions`` holds column builders, ``sources`` readers and sinks,
``operators`` table-to-table jobs, ``plans`` the named queries over the
benchmark tables and ``streaming`` the Structured Streaming jobs.
"""
