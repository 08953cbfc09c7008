"""All registered queries."""

from treecorpus.plans import corpus_queries, eval_queries, goal_queries, learn_queries, misc_queries, set_queries, tree_queries  # noqa: F401
from treecorpus.plans.registry import ORACLES, QUERIES  # noqa: F401
