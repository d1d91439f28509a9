"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import cotraining, fingerprints, licenses, lines, mixing, packing, quality_rules, secrets, simhash, suffixes

_MODULES = {
    "op1_suffix_dedup": suffixes,
    "op2_line_dedup": lines,
    "op3_fingerprints": fingerprints,
    "op4_simhash": simhash,
    "op5_quality_classifier": cotraining,
    "op6_packing": packing,
    "op7_mixing": mixing,
    "op8_licenses": licenses,
    "op9_quality_rules": quality_rules,
    "op10_secrets": secrets,
}
QUERIES = {name: m.query for name, m in _MODULES.items()}
SQL = {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
