"""docloom: document ingest, retrieval and feedback analytics as Spark DataFrame jobs.

Every public operator takes DataFrames and returns a DataFrame; the work runs on
executors and is planned by Catalyst.  Models, parsers and tokenizers are injected
by the caller as plain Python callables that run inside Arrow-batched tasks.
"""

__version__ = "0.1.0"
