"""Training-data operators (language ID, near duplicates, token files, ...).

Nothing else in the library imports this subpackage; the registered queries are
in ``strata.llm.queries`` and the staged pipeline in ``corpus_pipeline.py``.
"""
