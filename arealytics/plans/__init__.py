"""Whole jobs built from the operators: the index of areas, its reports, and the registered queries."""
from . import index_queries, layer_queries, layout_queries, quality_queries, source_queries, spatial_queries


def registered():
    queries, oracle = {}, {}
    for module in (index_queries, spatial_queries, quality_queries, source_queries, layout_queries, layer_queries):
        queries.update(module.QUERIES)
        oracle.update(module.ORACLE)
    return queries, oracle
