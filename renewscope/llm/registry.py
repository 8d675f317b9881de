"""All queries of this subpackage and their SQL."""

from importlib import import_module

_MODULES = (
    "ppm_query", "mixing_query", "quality_query", "simhash_query", "toxicity_query", "token_files_query",
    "packing_query", "secrets_query", "pivots_query", "forest_query", "fingerprints_query", "variants_query", "filter_audit_query",
)


def load():
    queries, oracles = {}, {}
    for name in _MODULES:
        module = import_module(f"renewscope.llm.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
