"""Event query discovery on Spark: stream databases, query tables, matching, discovery."""

from streamquarry.operators.abstraction import (
    bin_values, explode_attribute, map_values, mask_top_values, mask_values, project,
    split_attributes, uniquify_frequent,
)
from streamquarry.operators.containment import weaker_queries, weaker_than
from streamquarry.operators.discovery import (
    compare_query_sets, descriptive, discover, discover_by_templates, discover_patterns,
    discover_types, flag_descriptive, query_lattice, supported_queries,
)
from streamquarry.operators.matching import (
    classify_queries, count_instances, instances, match, match_ends, match_types, matched_streams,
    reached_length, streams_before_query, support, support_of, supported, update_matches, update_support, witness,
)
from streamquarry.operators.profiling import (
    alphabet, count_streams, database_profile, disjointness_score, length_distribution,
    ngram_distribution, profile_report, repeated_values, stream_lengths, supported_alphabet,
    type_pattern_disjointness, value_distribution, value_presence, vertical_index,
)
from streamquarry.operators.queries import (
    dedupe_queries, describe_queries, generalisations, normal_form, queries_from_strings,
    to_strings, validate_queries,
)
from streamquarry.operators.shaping import (
    drop_longer_than, keep_last, limit_streams, require_values,
)
from streamquarry.sources.tables import (
    read_streams, streams_before_match, streams_from_table, write_streams,
)
from streamquarry.sources.traces import read_traces

__all__ = [name for name in dir() if not name.startswith("_")]
