"""Views that read the given tables as decisions, attempts, outcomes and retrieval tasks.

Each is SQL that Spark and DuckDB both run, so query and oracle start from the same rows.  `{name}` is a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ATTEMPTS = """
SELECT user_id * 10000 + CAST(FLOOR((rn - 1) / 3.0) AS BIGINT) AS task_id, arm, CAST((rn - 1) % 3 + 1 AS INT) AS attempt_no, output,
       CASE WHEN user_id % 7 = 0 THEN 'other_task' ELSE 'python.hard_masked_direct_call' END AS task, 4 AS n_candidates, CAST(user_id % 4 AS INT) AS answer_index,
       'ns' || CAST(user_id % 5 AS VARCHAR(9)) AS namespace, 'ns' || CAST(user_id % 5 AS VARCHAR(9)) || '::f' || CAST(user_id % 30 AS VARCHAR(9)) AS source
FROM (SELECT user_id, arm, output, ROW_NUMBER() OVER (PARTITION BY user_id, arm ORDER BY ts, event_id) AS rn
      FROM (SELECT user_id, event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'assisted' END AS arm,
                   CASE event_type WHEN 'error' THEN 'none of them' WHEN 'view' THEN k WHEN 'click' THEN 'candidate ' || k WHEN 'signup' THEN '  Candidate ' || k || ': ' ELSE k || '.' END AS output
            FROM (SELECT *, CAST(CAST(FLOOR(value) AS BIGINT) % 5 + 1 AS VARCHAR(9)) AS k FROM {events}) e) o) r
"""

RECOMMENDATIONS = """
SELECT task_id, CAST(MIN(CASE WHEN task_id % 3 = 0 THEN answer_index ELSE (answer_index + task_id) % 4 END) AS INT) AS recommendation FROM ({attempts}) x GROUP BY task_id
"""

PAIRS = """
SELECT l_orderkey * 10 + l_linenumber AS task_id, n_name AS namespace, n_name || '::' || CAST(s_suppkey AS VARCHAR(19)) AS source, 'f' || CAST(l_linenumber % 2 AS VARCHAR(9)) AS family,
       l_returnflag = 'R' AS b_ok, l_linestatus = 'O' AS a_ok, CAST(1 + l_linenumber % 3 AS BIGINT) AS b_attempts, CAST(1 + CAST(l_quantity AS BIGINT) % 3 AS BIGINT) AS a_attempts,
       l_returnflag = 'R' AND l_linenumber % 3 = 0 AS b_first, l_linestatus = 'O' AND CAST(l_quantity AS BIGINT) % 3 = 0 AS a_first, l_discount * 10 AS confidence
FROM {lineitem} l JOIN {supplier} s ON l_suppkey = s_suppkey JOIN {nation} n ON s_nationkey = n_nationkey
"""

EXAMPLES = """
SELECT d.doc_id AS task_id, lang AS namespace, lang || '::' || source AS source, quality AS answer, toxic AS prediction FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""

#: Queries: every hundredth vector, against all others of its label; the target is the lowest other id of the label.
RETRIEVAL = """
SELECT q.vec_id AS task_id, c.vec_id AS cand_id, q.label AS namespace, q.embedding AS qv, c.embedding AS cv, ROW_NUMBER() OVER (PARTITION BY q.vec_id ORDER BY c.vec_id) - 1 AS ord
FROM {embeddings} q JOIN {embeddings} c ON q.label = c.label AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
"""


def sql(text: str, **views: str) -> str:
    """The text with inner views in place and table names bare: what DuckDB runs."""
    for name, view in views.items():
        text = text.replace("{" + name + "}", view)
    return re.sub(r"\{(\w+)\}", r"\1", text)


def view(spark: SparkSession, sf_dir: str, text: str, **views: str) -> DataFrame:
    """The text over the Parquet tables in sf_dir."""
    for name, inner in views.items():
        text = text.replace("{" + name + "}", inner)
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})
