"""linkloom: a Spark-native engine for link graphs over collections of Markdown notes.

``operators``  graph, query, maintenance and general data operators
``sources``    vault scans, text sinks, snapshot storage
``functions``  Column-level building blocks (paths, links, globs)
``plans``      the registered queries and the vault projection they run on
``streaming``  the change feed
``llm``        text and corpus operators; nothing else in the package imports it
"""
