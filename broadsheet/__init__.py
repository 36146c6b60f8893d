"""Mining newspaper corpora with Spark: search, locate, collocate, map."""

from broadsheet.operators.collocation import Options
from broadsheet.operators.locations import apply_coordinates, missing_coordinates
from broadsheet.operators.ranks import global_terms, home_bin_terms, rank_matrix, top_collocates
from broadsheet.plans.naming import collocation_paths
from broadsheet.plans.runs import (
    collocation_run,
    coordinates_run,
    locate_run,
    map_tables,
    run_term,
    search_run,
)
from broadsheet.streaming.search import stream_search, stream_search_capped

__all__ = [
    "Options",
    "apply_coordinates",
    "collocation_paths",
    "collocation_run",
    "coordinates_run",
    "global_terms",
    "home_bin_terms",
    "locate_run",
    "map_tables",
    "missing_coordinates",
    "rank_matrix",
    "run_term",
    "search_run",
    "stream_search",
    "stream_search_capped",
    "top_collocates",
]
