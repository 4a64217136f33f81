"""One query for each operator on messages and pages, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import full_hash, one_line, prefix, short_hash, suffix, truthy
from ..operators import external, html, images, incremental, links, stability, status, throttle, triggers
from ..sources import documents, messages
from . import fixtures
from .fixtures import rows

Query = Callable[[SparkSession, str], DataFrame]

#: The tables hold no text with the default trigger, so these words stand for it.
PATTERNS = triggers.Patterns(stem="the", reply=r"^\s*\[?\s*[Tt]he\s+")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_MSG = "m AS (SELECT CAST(conv_id AS VARCHAR) AS chat_url, turn AS index, coalesce(nullif(role, ''), 'unknown') AS role, text FROM conversations)"
_COUNT = "c AS (SELECT chat_url, count(*) AS n FROM m GROUP BY chat_url)"
_STATE = "s AS (SELECT CAST(conv_id AS VARCHAR) AS chat_url, greatest(0, count(*) - conv_id % 8) AS seen FROM conversations WHERE conv_id % 5 <> 0 GROUP BY conv_id)"
_FIND = """e AS (SELECT chat_url, index AS message_index, role, CASE WHEN regexp_matches(text, '(?m)^\\s*\\[?\\s*[Tt]he\\s+') THEN 'architect_reply'
  WHEN regexp_matches(text, '(?i)(^|[^\\pL\\pN_])the') THEN 'architect_call' END AS type, left(text, 300) AS text_preview,
  left(sha1(text), 16) AS message_hash FROM m WHERE role = 'user' AND regexp_matches(text, '\\S')), f AS (SELECT * FROM e WHERE type IS NOT NULL)"""
_COLUMNS = "chat_url, index, role, text"


def query(sql: str) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        _SQL[function.__name__] = sql
        return function

    return add


def marked_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored marks made from the table: some messages back, and none for every fifth chat."""
    talks = messages.table(spark, sf_dir, "conversations").where("conv_id % 5 <> 0").groupBy("conv_id").agg(F.count("*").alias("n"))
    return talks.select(
        F.col("conv_id").cast("string").alias("chat_url"), F.greatest(F.lit(0), F.col("n") - F.col("conv_id") % 8).alias("last_seen_count")
    )


def found_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.events(messages.load(spark, sf_dir), PATTERNS, project="p")


# Scans


@query(f"WITH {_MSG} SELECT {_COLUMNS} FROM m")
def messages_scan(spark, sf_dir):
    return messages.load(spark, sf_dir)


@query(f"WITH {_MSG} SELECT chat_url, count(*) AS message_count, count(*) FILTER (role = 'assistant') AS assistant_count FROM m GROUP BY chat_url")
def message_counts(spark, sf_dir):
    return messages.counts(messages.load(spark, sf_dir))


@query(f"WITH {_MSG} SELECT {_COLUMNS} FROM m QUALIFY row_number() OVER (PARTITION BY chat_url ORDER BY index DESC) <= 3")
def read_tail(spark, sf_dir):
    return messages.tail(messages.load(spark, sf_dir), 3)


@query(f"WITH {_MSG} SELECT {_COLUMNS} FROM m")
def read_tail_zero_is_all(spark, sf_dir):
    return messages.tail(messages.load(spark, sf_dir), 0)


@query(f"WITH {_MSG} SELECT {_COLUMNS} FROM m WHERE index > 2")
def read_since(spark, sf_dir):
    return messages.since(messages.load(spark, sf_dir), 2)


@query(f"WITH {_MSG} SELECT {_COLUMNS} FROM m WHERE index >= 1 AND index < 4")
def read_range(spark, sf_dir):
    return messages.between(messages.load(spark, sf_dir), 1, 4)


@query(f"WITH {_MSG}, t AS (SELECT * FROM m WHERE chat_url = '3' QUALIFY row_number() OVER (PARTITION BY chat_url ORDER BY index DESC) <= 10) SELECT count(*) AS count FROM t")
def open_chat_count(spark, sf_dir):
    one = messages.load(spark, sf_dir).where(F.col("chat_url") == "3")
    return messages.tail(one, 10).agg(F.count("*").alias("count"))


@query(f"WITH {_MSG} SELECT {_COLUMNS} FROM m WHERE chat_url <> '3'")
def other_chats(spark, sf_dir):
    return incremental.others(messages.load(spark, sf_dir), "3")


# Triggers


@query(f"WITH {_MSG}, {_FIND} SELECT type, 'p' AS project, '' AS chat_title, chat_url, message_index, role, text_preview, message_hash FROM f")
def trigger_events(spark, sf_dir):
    return found_events(spark, sf_dir)


@query(f"WITH {_MSG}, {_FIND} SELECT count(*) AS trigger_count, count(*) FILTER (type = 'architect_reply') AS reply_count FROM f")
def trigger_count(spark, sf_dir):
    return found_events(spark, sf_dir).agg(F.count("*").alias("trigger_count"), F.count_if(F.col("type") == triggers.REPLY).alias("reply_count"))


_KEY = "chat_url || ':' || CAST(message_index AS VARCHAR) || ':' || message_hash"


@query(f"WITH {_MSG}, {_FIND} SELECT {_KEY} AS key, type, chat_url, message_index FROM f WHERE message_index % 2 <> 0")
def trigger_dedup(spark, sf_dir):
    found = found_events(spark, sf_dir)
    known = triggers.remember(rows(spark, fixtures.SEEN_KEYS), found.where("message_index % 2 = 0"))
    return triggers.unprocessed(found, known).select("key", "type", "chat_url", "message_index")


@query(f"WITH {_MSG}, {_FIND} SELECT {_KEY} AS key FROM f UNION SELECT key FROM {fixtures.SEEN_KEYS}")
def processed_keys(spark, sf_dir):
    return triggers.remember(rows(spark, fixtures.SEEN_KEYS), found_events(spark, sf_dir))


@query(f"WITH {_MSG}, {_FIND} SELECT chat_url, max_by(message_hash, message_index) AS last_trigger_hash FROM f GROUP BY chat_url")
def last_trigger(spark, sf_dir):
    return found_events(spark, sf_dir).groupBy("chat_url").agg(F.max_by("message_hash", "message_index").alias("last_trigger_hash"))


@query(
    f"WITH {_MSG}, {_FIND} SELECT chat_url, message_index, '🔔 GPT → Архитектор' || chr(10) || '[' || type || '] в чате «untitled»' || chr(10) || "
    "'msg#' || CAST(message_index AS VARCHAR) || ': ' || left(text_preview, 150) AS text, 'chat_id=me%401&text=' || "
    "replace(replace(replace(url_encode(text), '%20', '+'), '~', '%7E'), '%2A', '*') AS payload FROM f WHERE type = 'architect_call'"
)
def notify_payload(spark, sf_dir):
    return triggers.notices(found_events(spark, sf_dir), chat="me@1")


@query(f"SELECT key, first_seen FROM {fixtures.SEEN_KEYS} ORDER BY first_seen DESC, key LIMIT 12")
def dedup_cap(spark, sf_dir):
    return triggers.cap(rows(spark, fixtures.SEEN_KEYS), 12)


# Increments

_NEW = "SELECT m.chat_url, m.index, m.role, m.text FROM m JOIN c USING (chat_url) {join} WHERE {where}"


def _sql_new(join: str, where: str) -> str:
    return f"WITH {_MSG}, {_COUNT}, {_STATE} " + _NEW.format(join=join, where=where)


@query(_sql_new("JOIN s USING (chat_url)", "c.n > s.seen AND m.index >= s.seen AND m.index < c.n"))
def new_messages_monotone(spark, sf_dir):
    return incremental.monotone(messages.load(spark, sf_dir), marked_states(spark, sf_dir)).select("chat_url", "index", "role", "text")


@query(_sql_new("JOIN s USING (chat_url)", "c.n <> s.seen AND m.index >= greatest(s.seen, c.n - 5) AND m.index < c.n"))
def new_messages_bounded(spark, sf_dir):
    return incremental.bounded(messages.load(spark, sf_dir), marked_states(spark, sf_dir)).select("chat_url", "index", "role", "text")


@query(_sql_new("LEFT JOIN s USING (chat_url)", "s.seen IS NULL AND m.index >= c.n - 5"))
def backfill_tail(spark, sf_dir):
    return incremental.first_met(messages.load(spark, sf_dir), marked_states(spark, sf_dir)).select("chat_url", "index", "role", "text")


@query(_sql_new("JOIN s USING (chat_url)", "s.seen > 0 AND c.n > s.seen AND m.index >= s.seen"))
def resume_missed(spark, sf_dir):
    return incremental.missed(messages.load(spark, sf_dir), marked_states(spark, sf_dir)).select("chat_url", "index", "role", "text")


_FIXED = f"WITH {_MSG}, {_COUNT}, s AS (SELECT chat_url, last_seen_count AS seen FROM {fixtures.STATES})"


@query(f"{_FIXED} SELECT chat_url, CAST(greatest(coalesce(seen, 0), n) AS BIGINT) AS last_seen_count FROM c LEFT JOIN s USING (chat_url)")
def marks_monotone(spark, sf_dir):
    return incremental.marks(messages.load(spark, sf_dir), rows(spark, fixtures.STATES))


@query(f"{_FIXED} SELECT chat_url, CAST(n AS BIGINT) AS last_seen_count FROM c LEFT JOIN s USING (chat_url)")
def marks_falling(spark, sf_dir):
    return incremental.marks(messages.load(spark, sf_dir), rows(spark, fixtures.STATES), falling=True)


@query(f"{_FIXED} SELECT chat_url, CAST(coalesce(seen, 0) AS BIGINT) AS before, CAST(coalesce(n, 0) AS BIGINT) AS after, CAST(coalesce(n, 0) - coalesce(seen, 0) AS BIGINT) AS new FROM c FULL JOIN s USING (chat_url)")
def count_delta(spark, sf_dir):
    before = rows(spark, fixtures.STATES).select("chat_url", F.col("last_seen_count").cast("long").alias("message_count"))
    return incremental.deltas(before, messages.counts(messages.load(spark, sf_dir)))


@query(f"WITH {_MSG} SELECT chat_url, max_by(left(sha1(text), 16), index) AS last_message_hash FROM m GROUP BY chat_url")
def last_message_hash(spark, sf_dir):
    return incremental.last_hashes(messages.load(spark, sf_dir), short_hash)


# Own and external messages

_SENT = "o AS (SELECT chat_url, sha1(text) AS hash, row_number() OVER (PARTITION BY chat_url, sha1(text)) AS k FROM m WHERE role = 'user' AND index % 4 = 0)"


def _sql_external(seen: str) -> str:
    return f"""WITH {_MSG}, {_SENT}, u AS (SELECT *, sha1({seen}) AS hash, row_number() OVER (PARTITION BY chat_url, sha1({seen}) ORDER BY index) AS k FROM m WHERE role = 'user'),
x AS (SELECT u.chat_url, u.index, u.role, u.text, o.hash IS NULL AS external FROM u LEFT JOIN o USING (chat_url, hash, k)
UNION ALL SELECT chat_url, index, role, text, false FROM m WHERE role <> 'user')"""


def _marked(spark: SparkSession, sf_dir: str, compat: bool) -> DataFrame:
    said = messages.load(spark, sf_dir)
    sent = said.where("role = 'user' AND index % 4 = 0").select("chat_url", "text")
    return external.mark_external(said, sent, compat)


@query(_sql_external("text") + " SELECT chat_url, index, role, external FROM x")
def external_detect(spark, sf_dir):
    return _marked(spark, sf_dir, False).drop("text")


@query(_sql_external("left(text, 500)") + " SELECT chat_url, index, role, external FROM x")
def external_detect_compat(spark, sf_dir):
    return _marked(spark, sf_dir, True).drop("text")


@query(
    _sql_external("text")
    + """ SELECT chat_url, CASE WHEN bool_or(external) THEN 'external_message' ELSE 'new_messages' END AS type, count(*) AS new_count,
 string_agg(CAST(index AS VARCHAR) || ':' || role || ':' || left(text, 500), '|' ORDER BY index) AS messages,
 CAST(any_value((SELECT count(*) FROM m WHERE m.chat_url = x.chat_url)) AS BIGINT) AS total_count FROM x WHERE index >= 2 GROUP BY chat_url"""
)
def watch_events(spark, sf_dir):
    totals = messages.counts(messages.load(spark, sf_dir))
    found = external.watch_events(_marked(spark, sf_dir, False).where("index >= 2"), totals)
    flat = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["index"].cast("string"), m["role"], m["text"])), "|")
    return found.withColumn("messages", flat)


@query(f"SELECT h FROM {fixtures.BAG} EXCEPT ALL SELECT h FROM {fixtures.OURS}")
def bag_difference(spark, sf_dir):
    return external.bag_difference(rows(spark, fixtures.BAG), rows(spark, fixtures.OURS))


# Links

_LINKS = """n AS (SELECT page_id, regexp_extract(html, '(?s)<nav\\b[^>]*>(.*?)</nav>', 1) AS nav FROM pages),
a AS (SELECT page_id, unnest(regexp_extract_all(nav, '(?s)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href,
 unnest(regexp_extract_all(nav, '(?s)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS title, generate_subscripts(regexp_extract_all(nav, '(?s)<a\\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) - 1 AS ordinal FROM n),
l AS (SELECT page_id, CAST(ordinal AS BIGINT) AS ordinal, href, trim(title) AS title FROM a)"""
_FIRST = "QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY ordinal) = 1"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.nav_links(messages.table(spark, sf_dir, "pages"))


@query(f"WITH {_LINKS}, d AS (SELECT * FROM l WHERE contains(href, '/') AND NOT contains(href, '/th') {_FIRST}) SELECT page_id, ordinal, href, left(title, 80) AS title FROM d WHERE title <> ''")
def project_links(spark, sf_dir):
    return links.projects(_links(spark, sf_dir), inside="/", outside="/th")


@query(f"WITH {_LINKS} SELECT page_id, ordinal, href, left(title, 80) AS title FROM l WHERE contains(href, '/t') AND title <> ''")
def chat_links(spark, sf_dir):
    return links.chats(_links(spark, sf_dir), inside="/t")


@query(f"WITH {_LINKS}, d AS (SELECT * FROM l WHERE contains(href, '/') {_FIRST}) SELECT page_id, ordinal, href, left(title, 80) AS title FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ordinal) <= 3")
def recent_links(spark, sf_dir):
    return links.recent(_links(spark, sf_dir), inside="/", n=3)


@query(f"WITH {_LINKS} SELECT page_id, ordinal, href, title FROM l WHERE contains(lower(title), 'th') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY ordinal) = 1")
def find_by_name(spark, sf_dir):
    return links.find(_links(spark, sf_dir), "Th")


@query(f"WITH {_LINKS} SELECT page_id, count(*) AS count FROM l GROUP BY page_id")
def link_counts(spark, sf_dir):
    return _links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("count"))


def _plain(text: str) -> str:
    """SQL for a text with the character references that the pages hold."""
    for name, sign in (("quot;", '"'), ("copy;", "©"), ("middot;", "·")):
        text = f"replace({text}, '&{name}', '{sign}')"
    return f"regexp_replace({text}, '&amp;?', '&', 'g')"


_H1 = "regexp_extract(html, '(?s)<h1\\b[^>]*>(.*?)</h1>', 1)"


@query(f"SELECT page_id, url, trim(regexp_replace({_plain(_H1)}, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS title, contains(url, '/en/') AS is_chat FROM pages")
def page_title(spark, sf_dir):
    return links.info(messages.table(spark, sf_dir, "pages"), chat="/en/")


_TAG = "</?[a-z][^>]*"
_RAW = "|".join(f"<{n}\\b[^>]*>.*?(?:</{n}[^>]*>|\\z)" for n in ("script", "style", "title"))


@query(
    f"""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?(?:-->|\\z)|{_RAW}|{_TAG}>|{_TAG}\\z|<[!?/][^>]*>|[^<]+|<') AS ts FROM pages),
y AS (SELECT page_id, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS place FROM x),
k AS (SELECT *, CASE WHEN NOT starts_with(t, '<') OR t = '<' THEN 'text' WHEN starts_with(t, '<!') OR NOT ends_with(t, '>') THEN 'comment'
 WHEN regexp_matches(t, '^<(script|style|title)[ >]') THEN 'raw' WHEN starts_with(t, '</') THEN 'end' ELSE 'start' END AS kind FROM y),
n AS (SELECT *, CASE WHEN kind IN ('start', 'end', 'raw') THEN regexp_extract(t, '^</?([a-z0-9]+)', 1) END AS name FROM k),
c AS (SELECT *, CASE WHEN kind = 'start' AND name NOT IN ('br', 'meta', 'img', 'link', 'hr', 'input') THEN 1 WHEN kind = 'end' THEN -1 ELSE 0 END AS change FROM n)
SELECT page_id, CAST(place AS BIGINT) AS place, kind, name, CASE kind WHEN 'text' THEN {_plain("t")} WHEN 'comment' THEN t
 WHEN 'raw' THEN CASE name WHEN 'title' THEN {_plain("regexp_extract(t, '(?s)^<title>(.*)</title>$', 1)")} ELSE regexp_extract(t, '(?s)^<[^>]*>(.*)</[a-z]+>$', 1) END END AS text,
 nullif(regexp_extract(t, 'href="([^"]*)"', 1), '') AS href, CASE WHEN kind IN ('start', 'raw') THEN len(regexp_extract_all(regexp_extract(t, '^<[^>]*>'), '="'))::INTEGER ELSE 0 END AS n_attributes,
 CAST(greatest(0, coalesce(sum(change) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS depth FROM c"""
)
def html_tokens(spark, sf_dir):
    found = html.tokens(messages.table(spark, sf_dir, "pages"))
    return found.withColumn("href", F.col("attributes")["href"]).withColumn("n_attributes", F.greatest(F.lit(0), F.size("attributes"))).drop("attributes")


# Images, from inline rows

_STYLE = "regexp_replace(split_part(split_part(style, 'url(', 2), ')', 1), '^[''\"]+|[''\"]+$', '', 'g')"
_IMAGES = f"""i AS (SELECT chat_url, index, role, src, 0 AS part FROM {fixtures.IMAGES} WHERE width > 50 AND coalesce(src, '') <> ''
 UNION ALL SELECT chat_url, index, role, {_STYLE}, 1 FROM {fixtures.IMAGES} WHERE contains(style, 'url(') AND {_STYLE} <> ''),
g AS (SELECT *, row_number() OVER (PARTITION BY chat_url, index ORDER BY part) - 1 AS place FROM i)"""


def _imaged(spark: SparkSession) -> DataFrame:
    base = rows(spark, fixtures.IMAGES).withColumn("index", F.col("index").cast("long"))
    img = F.array(F.struct(F.col("src"), F.lit(None).cast("string").alias("alt"), F.col("width")))
    return images.with_images(base.select("chat_url", "index", "role", img.alias("imgs"), F.array("style").alias("bg_styles")))


@query(
    f"WITH {_IMAGES}, t AS (SELECT chat_url, index FROM {fixtures.IMAGES} QUALIFY row_number() OVER (PARTITION BY chat_url ORDER BY index DESC) <= 3) "
    "SELECT chat_url, CAST(index AS BIGINT) AS message_index, role, CAST(place AS BIGINT) AS image_index, src, '' AS alt, starts_with(src, 'blob:') AS is_blob, NOT starts_with(src, 'blob:') AS downloadable FROM g JOIN t USING (chat_url, index)"
)
def image_list(spark, sf_dir):
    return images.listing(_imaged(spark), 3)


@query("SELECT 'x' AS chat_url, 0::BIGINT AS message_index WHERE false")
def image_list_zero_is_none(spark, sf_dir):
    return images.listing(_imaged(spark), 0).select("chat_url", "message_index")


@query(
    f"WITH {_IMAGES} SELECT t.chat_url, CAST(t.index AS BIGINT) AS index, g.src, CASE WHEN g.src IS NULL THEN 'no_such_image' END AS error "
    f"FROM {fixtures.IMAGES} LEFT JOIN g ON g.chat_url = t.chat_url AND g.index = t.index AND g.place = 1 WHERE t.index = 0"
)
def image_select(spark, sf_dir):
    return images.pick(_imaged(spark), 0, 1)


# States and labels


@query(
    f"SELECT url, CASE WHEN NOT contains(url, '/c/') THEN 'not_on_chat' WHEN generating THEN 'generating' WHEN regexp_matches(composer_text, '\\S') THEN 'composer_has_text' WHEN has_attachments THEN 'composer_has_attachments' END AS reason, "
    f"(contains(url, '/c/') AND NOT coalesce(generating, false) AND NOT coalesce(regexp_matches(composer_text, '\\S'), false) AND NOT coalesce(has_attachments, false)) AS ok FROM {fixtures.SYNC}"
)
def sync_reason(spark, sf_dir):
    return status.sync_reason(rows(spark, fixtures.SYNC))


@query(f"SELECT coalesce(nullif(role, ''), 'unknown') AS role, text FROM {fixtures.ROLES}")
def role_default(spark, sf_dir):
    return status.roles(rows(spark, fixtures.ROLES))


@query(f"SELECT id, CASE WHEN logged_in THEN 'ready' ELSE 'login_required' END AS status FROM {fixtures.LOGGED_IN}")
def health_label(spark, sf_dir):
    return rows(spark, fixtures.LOGGED_IN).select("id", status.health(F.col("logged_in")).alias("status"))


@query(
    f"""WITH k AS (SELECT document, unnest(json_keys(document, '$.states')) AS url FROM {fixtures.STATES_JSON}), v AS (SELECT url, json_extract(document, '$.states.' || url) AS s FROM k)
SELECT url, coalesce(s ->> '$.title', '') AS title, coalesce(s ->> '$.project', '') AS project, CAST(coalesce(s ->> '$.last_seen_count', '0') AS BIGINT) AS last_seen_count,
 CAST(coalesce(s ->> '$.last_checked_at', '0') AS DOUBLE) AS last_checked_at FROM v"""
)
def load_states(spark, sf_dir):
    return documents.chat_states(rows(spark, fixtures.STATES_JSON))


@query(f"SELECT DISTINCT unnest(CAST(json_extract_string(document, '$.keys[*]') AS VARCHAR[])) AS key FROM {fixtures.DEDUP_JSON}")
def load_dedup(spark, sf_dir):
    return documents.dedup_keys(rows(spark, fixtures.DEDUP_JSON))


def _sql_outcomes(polls: str, source: str) -> str:
    return f"""WITH {polls}q AS (SELECT *, lag(text) OVER (PARTITION BY key ORDER BY poll_no) AS was FROM {source} WHERE NOT generating AND assistant_count > pre_count),
r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> text THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY poll_no) AS run FROM q),
d AS (SELECT key, min(poll_no) AS poll_no, min_by(text, poll_no) AS text FROM (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY poll_no) AS k FROM r) WHERE k >= 3 AND text <> '' GROUP BY key),
e AS (SELECT key, poll_no, CASE WHEN assistant_count > pre_count THEN text END AS text FROM {source} WHERE elapsed_ms > 300000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY poll_no) = 1),
j AS (SELECT coalesce(d.key, e.key) AS key, d.poll_no AS dp, d.text AS dt, e.poll_no AS ep, e.text AS et, d.poll_no IS NOT NULL AND (e.poll_no IS NULL OR d.poll_no <= e.poll_no) AS ok FROM d FULL JOIN e ON d.key = e.key)
SELECT key, CASE WHEN ok THEN 'complete' WHEN et IS NOT NULL THEN 'timeout_partial' ELSE 'timeout_empty' END AS status, CASE WHEN ok THEN dt ELSE coalesce(et, '') END AS response, CASE WHEN ok THEN dp ELSE ep END AS poll_no FROM j"""


@query(_sql_outcomes("", fixtures.POLLS))
def response_stability(spark, sf_dir):
    return stability.outcomes(rows(spark, fixtures.POLLS))


@query(
    f"""WITH RECURSIVE k AS (SELECT chat_url, CAST(ts AS DOUBLE) AS ts FROM {fixtures.CHECKS}),
a AS (SELECT chat_url, min(ts) AS ts FROM k GROUP BY chat_url UNION ALL SELECT chat_url, (SELECT min(k.ts) FROM k WHERE k.chat_url = a.chat_url AND k.ts - a.ts >= 10) FROM a WHERE EXISTS (SELECT 1 FROM k WHERE k.chat_url = a.chat_url AND k.ts - a.ts >= 10))
SELECT chat_url, ts FROM a"""
)
def check_throttle(spark, sf_dir):
    return throttle.accepted(rows(spark, fixtures.CHECKS).select("chat_url", F.col("ts").cast("double").alias("ts")))


@query(
    f"WITH {_MSG}, {_FIND} SELECT (SELECT count(DISTINCT chat_url) FROM m) AS tracked_chats, (SELECT count(*) FROM f) AS pending_events, (SELECT count(DISTINCT {_KEY}) FROM f) AS dedup_keys, 61::BIGINT AS uptime_seconds"
)
def monitor_status(spark, sf_dir):
    found = found_events(spark, sf_dir)
    keys = found.select(triggers.event_key().alias("key"))
    return status.monitor(messages.load(spark, sf_dir).select("chat_url"), found, keys, started=100.0, now=161.9)


@query(f"SELECT active, other, greatest(1, other // active)::BIGINT AS looks FROM {fixtures.PAUSES}")
def look_divider(spark, sf_dir):
    return rows(spark, fixtures.PAUSES).withColumn("looks", status.every(F.col("active"), F.col("other")))


@query(f"WITH {_MSG} SELECT * FROM m WHERE chat_url = '3'")
def mode_active_only(spark, sf_dir):
    said = messages.load(spark, sf_dir)
    return status.in_mode(said, "active_only", "3", said)


@query(f"WITH {_MSG} SELECT * FROM m WHERE chat_url IN ('3', '5', '7')")
def mode_recent(spark, sf_dir):
    said = messages.load(spark, sf_dir)
    return status.in_mode(said, "project_recent", "3", said.where("chat_url IN ('5', '7', '3')"))


@query(
    f"WITH {_MSG}, {_FIND}, s AS (SELECT * FROM {fixtures.SCANS}) SELECT true AS running, 'project_recent' AS mode, 100.0::DOUBLE AS started_at, 61::BIGINT AS uptime_sec, "
    "(SELECT count(*) FROM s) AS scan_count, (SELECT sum(triggers)::BIGINT FROM s) AS trigger_count, '2' AS active_chat_url, 'lost page' AS last_error, 103.0::DOUBLE AS last_error_at, "
    f"106.0::DOUBLE AS last_sync_at, (SELECT count(DISTINCT chat_url) FROM m) AS tracked_chats, (SELECT count(*) FROM f) AS pending_events, (SELECT count(DISTINCT {_KEY}) FROM f) AS processed_dedup_keys"
)
def monitor_full_status(spark, sf_dir):
    found = found_events(spark, sf_dir)
    scans = rows(spark, fixtures.SCANS).withColumn("looked_at", F.col("looked_at").cast("double"))
    keys = found.select(triggers.event_key().alias("key"))
    return status.full(messages.load(spark, sf_dir).select("chat_url"), found, keys, scans, now=161.9)


@query(f"SELECT value, lower(value) IN ('1', 'true', 'yes') AS is_on FROM {fixtures.SWITCHES}")
def switch_text(spark, sf_dir):
    return rows(spark, fixtures.SWITCHES).withColumn("is_on", truthy(F.col("value")))


@query(f"WITH {_MSG} SELECT chat_url, index, replace(text, chr(10), ' ') AS line FROM m")
def one_line_text(spark, sf_dir):
    return messages.load(spark, sf_dir).select("chat_url", "index", one_line(F.col("text")).alias("line"))


@query(f"SELECT chat_url, index::BIGINT AS index, role FROM {fixtures.IMAGES}")
def messages_without_images(spark, sf_dir):
    base = rows(spark, fixtures.IMAGES).select("chat_url", F.col("index").cast("long").alias("index"), "role", F.array("style").alias("bg_styles"))
    return images.messages_with(base, include_images=False)


@query(f"WITH {_MSG} SELECT chat_url, index, sha1(text) AS hash, left(text, 500) AS shown, right(text, 20) AS ending FROM m")
def text_functions(spark, sf_dir):
    text = F.col("text")
    return messages.load(spark, sf_dir).select(
        "chat_url", "index", full_hash(text).alias("hash"), prefix(text, 500).alias("shown"), suffix(text, 20).alias("ending")
    )


# The same operators over tables

GAP = 12.0 * 3600


def _event_micros() -> Column:
    """Microseconds since 1970 of an event's local time, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")


def event_checks(events: DataFrame) -> DataFrame:
    """Events as checks (chat_url, ts) of a chat, one for each user."""
    return events.select(F.col("user_id").cast("string").alias("chat_url"), (_event_micros() / F.lit(1000000.0)).alias("ts"))


@query(
    f"""WITH RECURSIVE k AS (SELECT CAST(user_id AS VARCHAR) AS chat_url, epoch_us(ts) / 1000000::DOUBLE AS ts FROM events),
a AS (SELECT chat_url, min(ts) AS ts FROM k GROUP BY chat_url UNION ALL SELECT a.chat_url, min(k.ts) FROM a JOIN k ON k.chat_url = a.chat_url AND k.ts - a.ts >= {GAP} GROUP BY a.chat_url)
SELECT chat_url, ts FROM a"""
)
def throttle_events(spark, sf_dir):
    """Events of a user as checks of a chat: the first, then each at least half a day after the last one taken."""
    return throttle.accepted(event_checks(messages.table(spark, sf_dir, "events")), GAP)


_EVENT_POLLS = """p AS (SELECT CAST(user_id AS VARCHAR) AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS poll_no,
 (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 4320000 AS elapsed_ms, event_type = 'error' AS generating,
 CASE WHEN event_type = 'signup' THEN 1 ELSE 2 END AS assistant_count, 1 AS pre_count, CASE WHEN event_type = 'purchase' THEN '' ELSE event_type END AS text FROM events)"""


@query(_sql_outcomes(_EVENT_POLLS + ", ", "p"))
def stability_events(spark, sf_dir):
    """Events of a user as polls of a text, the kind of event being the text."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros, kind = _event_micros(), F.col("event_type")
    polls = messages.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.row_number().over(order).cast("long").alias("poll_no"),
        F.floor((micros - F.min(micros).over(Window.partitionBy("user_id"))) / 4320000).alias("elapsed_ms"),
        (kind == "error").alias("generating"),
        F.when(kind == "signup", 1).otherwise(2).alias("assistant_count"),
        F.lit(1).alias("pre_count"),
        F.when(kind == "purchase", "").otherwise(kind).alias("text"),
    )
    return stability.outcomes(polls)


@query(f"WITH {_MSG}, {_FIND} SELECT {_KEY} AS key, CAST(message_index AS DOUBLE) AS first_seen FROM f ORDER BY first_seen DESC, key LIMIT 12")
def found_keys_cap(spark, sf_dir):
    keys = found_events(spark, sf_dir).select(triggers.event_key().alias("key"), F.col("message_index").cast("double").alias("first_seen"))
    return triggers.cap(keys, 12)


@query(f"WITH {_MSG} SELECT left(sha1(text), 2) AS hash FROM m WHERE role = 'user' EXCEPT ALL SELECT left(sha1(text), 2) FROM m WHERE role = 'user' AND index % 4 = 0")
def hash_bag_difference(spark, sf_dir):
    """A short part of the hashes, so that many are equal."""
    said = messages.load(spark, sf_dir).where("role = 'user'")
    hashes = lambda rows: rows.select(F.substring(full_hash(F.col("text")), 1, 2).alias("hash"))
    return external.bag_difference(hashes(said), hashes(said.where("index % 4 = 0")))


@query("SELECT CAST(conv_id AS VARCHAR) AS url, '' AS title, CASE WHEN conv_id % 3 = 0 THEN 'p' ELSE '' END AS project, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE count(*) END AS last_seen_count, 0.0::DOUBLE AS last_checked_at FROM conversations GROUP BY conv_id")
def load_chat_states(spark, sf_dir):
    """A state document a chat, with fields left out, read back as rows."""
    talks = messages.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    fields = F.struct(F.when(F.col("conv_id") % 3 == 0, "p").alias("project"), F.when(F.col("conv_id") % 5 != 0, F.col("n")).alias("last_seen_count"))
    states = F.struct(F.create_map(F.col("conv_id").cast("string"), fields).alias("states"))
    return documents.chat_states(talks.select(F.to_json(states).alias("document")))


@query(f"WITH {_MSG}, {_FIND} SELECT DISTINCT {_KEY} AS key FROM f")
def load_found_keys(spark, sf_dir):
    """A document of the keys of each message with a trigger, twice over, read back as distinct keys."""
    key = triggers.event_key()
    written = found_events(spark, sf_dir).select(F.to_json(F.struct(F.array(key, key).alias("keys"))).alias("document"))
    return documents.dedup_keys(written)


def queries() -> dict[str, Query]:
    from . import stream_queries  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import stream_queries  # noqa: F401

    return dict(_SQL)
