"""lodestone: a PySpark analytics engine for corpora of source code, documents and chat.

Sub-packages
------------
``sources``    readers, writers and the table store
``functions``  column expressions and the few Arrow-backed functions
``operators``  relational operators: rules, merge, graph, chunks, indexes, ranking, metrics
``plans``      complete pipelines: analyze, index, ask, evaluate
``streaming``  continuous ingest
``llm``        training-data operators; optional, nothing above depends on it
"""

__version__ = "0.1.0"
