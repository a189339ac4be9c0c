"""All queries of the library by name: (spark, sf_dir) to a DataFrame; and SQL that says the same, where SQL can."""

from __future__ import annotations

from zonegrain.plans import image_queries, io_queries, model_queries, study_queries, volume_queries

QUERIES = {**volume_queries.QUERIES, **image_queries.QUERIES, **study_queries.QUERIES, **model_queries.QUERIES, **io_queries.QUERIES}
ORACLE = {**volume_queries.ORACLE, **image_queries.ORACLE, **study_queries.ORACLE, **model_queries.ORACLE, **io_queries.ORACLE}
