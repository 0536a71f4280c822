"""Training-data operators: ten dealt methods, each a Spark job over whole tables.

Nothing outside this package imports it; the registry in ``queries.py`` is picked up
by ``__spark_entry__`` only when the package is present.
"""
