"""All registered queries of the library proper."""

from verdure.plans import inference_queries, label_queries, log_queries, matrix_queries, model_queries, more_queries, ontology_queries, report_queries, sink_queries, source_queries, stat_queries, store_queries, stream_queries, table_queries  # noqa: F401
from verdure.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
