"""Where queries are registered: name to function, and name to the same query in SQL over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The conditions and patterns of queries, by name, so that tests can try every form of them.
CONDITIONS, PATTERNS = {}, {}
TOK = views.ORDERS_SQL
#: All tokens of the orders view, words, multiword and empty tokens, with a kind.
ALL = TOK + """, alltok AS (
  SELECT sent, id, 'WORD' AS kind FROM tok
  UNION ALL SELECT DISTINCT sent, 1, 'MWT' FROM tok WHERE sent % 3 = 0 AND n > 2
  UNION ALL SELECT DISTINCT sent, 1, 'EMPTY' FROM tok WHERE sent % 5 = 0)
"""
#: The system's version of the orders view.
SYS = TOK + """, sys AS (
  SELECT sent, id, form, lemma, xpos, size, disc, line, brand, psize, CASE WHEN part % 7 = 0 THEN 'X' ELSE upos END AS upos,
    CASE WHEN part % 11 = 0 AND head > 1 THEN head - 1 ELSE head END AS head, CASE WHEN id = 1 THEN 'root' WHEN part % 13 = 0 THEN 'dep9' ELSE deprel END AS deprel FROM tok)
"""


def query(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def scratch(spark: SparkSession) -> str:
    """A new folder name that driver and executors share: below spark.checkpoint.dir, or, unset in a local session, in a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="treeq-")
    return f"{where.rstrip('/')}/treeq-{uuid.uuid4().hex}"
