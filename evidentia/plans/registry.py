"""All queries by name and their SQL."""

from evidentia.plans import corpora, decisions, retrieval, structures, texts  # noqa: F401
from evidentia.plans.register import ORACLE_SQL, QUERIES  # noqa: F401
