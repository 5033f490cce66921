"""Training-data operators: extraction, sharding, archives, tokens, dedup, decontamination.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only
when it can be imported.
"""
