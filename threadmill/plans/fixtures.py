"""Inline rows for cases that the tables lack, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

IMAGES = """(VALUES
 ('a', 0, 'user', 'one.png', 51, 'background-image: url("bg.png")'), ('a', 1, 'user', 'icon.png', 50, NULL),
 ('a', 2, 'assistant', 'blob:x', 800, 'color: red'), ('a', 3, 'assistant', '', 400, 'background-image:url(p.png), url(q.png)'),
 ('b', 0, 'user', NULL, 400, 'background-image: url(''r.png'')'), ('b', 1, 'user', 'two.png', 90, 'background-image: url()')
) AS t(chat_url, index, role, src, width, style)"""

POLLS = """(VALUES
 ('still', 1, 2000, false, 2, 1, 'abc'), ('still', 2, 4000, false, 2, 1, 'abc'), ('still', 3, 6000, false, 2, 1, 'abc'), ('still', 4, 8000, false, 2, 1, 'abc'),
 ('pause', 1, 2000, false, 2, 1, 'abc'), ('pause', 2, 4000, true, 2, 1, 'abcd'), ('pause', 3, 6000, false, 2, 1, 'abc'), ('pause', 4, 8000, false, 2, 1, 'abc'),
 ('grow', 1, 2000, false, 2, 1, 'a'), ('grow', 2, 4000, false, 2, 1, 'ab'), ('grow', 3, 6000, false, 2, 1, 'ab'), ('grow', 4, 8000, false, 2, 1, 'ab'),
 ('empty', 1, 2000, false, 2, 1, ''), ('empty', 2, 4000, false, 2, 1, ''), ('empty', 3, 6000, false, 2, 1, ''), ('empty', 4, 301000, false, 1, 1, ''),
 ('old', 1, 2000, false, 1, 1, 'x'), ('old', 2, 301000, true, 2, 1, 'part'), ('open', 1, 2000, true, 1, 1, ''),
 ('both', 1, 299000, false, 2, 1, 'z'), ('both', 2, 299900, false, 2, 1, 'z'), ('both', 3, 300100, false, 2, 1, 'z')
) AS t(key, poll_no, elapsed_ms, generating, assistant_count, pre_count, text)"""

SYNC = """(VALUES ('http://x/c/1', false, '', false), ('http://x/g/1', true, 'draft', true), ('http://x/c/2', true, 'draft', false),
 ('http://x/c/3', false, 'draft', true), ('http://x/c/4', false, ' ', true), ('http://x/c/5', NULL, NULL, NULL)
) AS t(url, generating, composer_text, has_attachments)"""

ROLES = "(VALUES (NULL, 'a'), ('', 'b'), ('user', 'c'), ('assistant', '')) AS t(role, text)"
STATES_JSON = """(VALUES ('{"states": {"u1": {"title": "T", "project": "P", "last_seen_count": 3, "last_checked_at": 1.5}, "u2": {"last_seen_count": 2}, "u3": {}}, "updated_at": 9.0}')) AS t(document)"""
DEDUP_JSON = """(VALUES ('{"keys": ["a:1:x", "b:2:y", "a:1:x"], "updated_at": 9.0}')) AS t(document)"""
CHECKS = """(VALUES ('a', 0.0), ('a', 6.0), ('a', 12.0), ('a', 18.0), ('a', 24.0), ('b', 0.0), ('b', 9.999), ('b', 10.0), ('b', 19.999), ('c', 5.0)
) AS t(chat_url, ts)"""
#: Stored marks: equal, lower than the count by a few and by many, and higher.
STATES = "(VALUES ('0', 3), ('1', 0), ('2', 99), ('3', 1), ('4', 2)) AS t(chat_url, last_seen_count)"
SWITCHES = "(VALUES ('1'), ('TRUE'), ('yes'), ('0'), ('on'), (''), (NULL)) AS t(value)"
PAUSES = "(VALUES (3, 8), (3, 2), (5, 15), (3, 9), (4, 4)) AS t(active, other)"
SCANS = """(VALUES (100.0, 'active_only', true, '1', 0, NULL), (103.0, 'project_recent', true, '2', 2, 'lost page'), (106.0, 'project_recent', true, '2', 1, NULL)
) AS t(looked_at, mode, running, active_chat_url, triggers, error)"""
LOGGED_IN = "(VALUES (1, true), (2, false), (3, NULL)) AS t(id, logged_in)"
BAG = "(VALUES ('h1'), ('h1'), ('h2')) AS t(h)"
OURS = "(VALUES ('h1'), ('h3')) AS t(h)"
SEEN_KEYS = "(SELECT 'k' || CAST(i AS STRING) AS key, CAST(i % 7 AS DOUBLE) AS first_seen FROM range(0, 40) AS r(i)) AS t"


def rows(spark: SparkSession, values: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {values}")
