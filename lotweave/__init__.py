"""lotweave: vehicle-listing extraction over whole page corpora, on Spark.

A page is one row.  Its HTML becomes two array columns (``nodes``, ``texts``) in one Arrow pass;
selectors, text patterns and scoring are Column expressions over those arrays, so extraction is a
narrow job with no shuffle.  Only work that truly crosses pages (lookups, ranking, comparison,
reports) uses joins, windows and aggregates, and those carry slim rows without page bodies.
"""
