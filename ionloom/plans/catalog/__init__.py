"""Every operator as a query over the given tables, with a SQL check where SQL can say it."""

from ionloom.plans.catalog import (  # noqa: F401  (importing registers the queries)
    digestion_queries,
    encoding_queries,
    mass_queries,
    matching_queries,
    model_queries,
    source_queries,
    statistics_queries,
)
from ionloom.plans.catalog.registry import QUERIES, SQL  # noqa: F401
