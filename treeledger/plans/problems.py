"""The core problem queries by name."""

from __future__ import annotations

from treeledger.operators.references import p1_found, p1_rates
from treeledger.operators.snapshots import p5_counts, p5_found

PROBLEMS = {"p1_found": p1_found, "p1_rates": p1_rates, "p5_found": p5_found, "p5_counts": p5_counts}
