"""Rules by engine: each takes an Analysis and gives drafts of findings."""

from __future__ import annotations

from . import architecture, dead_code, dependencies, measures, risks

#: engine -> (category, rules)
ENGINES = {
    "dead-code": ("dead-code", [dead_code.unused_files, dead_code.unused_exports, dead_code.unused_imports, dead_code.unused_locals, dead_code.unreachable_code, dead_code.duplicate_exports]),
    "members": ("dead-code", [dead_code.unused_members]),
    "commented": ("dead-code", [dead_code.commented_code]),
    "deps": ("dependency-hygiene", [dependencies.unused_dependencies, dependencies.undeclared_dependencies, dependencies.misplaced_dependencies, dependencies.unresolved_imports]),
    "circular": ("circular-dependency", [architecture.circular]),
    "arch": ("architecture", [architecture.layers, architecture.contracts, architecture.private_imports, architecture.policies]),
    "complexity": ("complexity", [measures.complex_functions]),
    "hotspots": ("complexity", [measures.hotspots]),
    "cohesion": ("complexity", [measures.low_cohesion]),
    "dupes": ("duplication", [measures.duplication]),
    "types": ("type-health", [measures.untyped_functions, measures.type_leaks]),
    "security": ("security", [risks.security]),
    "supply-chain": ("security", [risks.vulnerable_pins, risks.vulnerable_ranges]),
    "coverage": ("dead-code", [dead_code.cold_code]),
}
#: Those that an audit runs; coverage and advisories join it where they are given.
AUDIT = [e for e in ENGINES if e != "coverage"]
