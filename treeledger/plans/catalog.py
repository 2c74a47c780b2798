"""All core queries and their oracle texts."""

from __future__ import annotations

from treeledger.plans.problem_sql import PROBLEM_SQL
from treeledger.plans.problems import PROBLEMS
from treeledger.plans.queries import CATALOGUE
from treeledger.plans.query_sql import CATALOGUE_SQL

QUERIES = {**PROBLEMS, **CATALOGUE}
ORACLES = {**PROBLEM_SQL, **CATALOGUE_SQL}
flagship = CATALOGUE["token_report"]
