"""Training-data operators. Nothing outside this subpackage (but for the optional hook in
``__spark_entry__.py`` and ``corpus_pipeline.py``) imports it."""
