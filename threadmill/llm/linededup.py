"""Line dedup by a log-template tree of fixed depth, as DataFrame operations.

A line's first level is its number of tokens, the next levels are its leading
tokens; tokens with digits are variable fields from the start unless they make
up much of the line, as in rows of a table. Only leaves that several documents
reach can hold a recurring template, and only their lines are taken apart.
There, a token is a variable field if no two documents share it at its place,
or if it is rare beside the tokens that most of its line consists of, as long
as most of the line stays fixed. Templates that recur across documents are
dropped after their first line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FIELD = "<*>"
#: Stands for a missing doc_id; such rows count as one document.
NO_ID = -(1 << 63)
#: So many leaves, of eight bytes each, are sent to every task at most; more are joined by a shuffle.
SENT_LEAVES = 500_000


@dataclass
class Settings:
    #: Leading tokens that a leaf goes by.
    depth: int = 3
    #: Lines of fewer tokens than this get no fields but numbers.
    shortest: int = 5
    #: Share of a line's tokens that must stay fixed once it has variable fields.
    fixed: float = 0.8
    #: A token is fixed if at least one in so many of the template's distinct lines has it at its place.
    spread: int = 40
    #: Share of a line's tokens that must be free of digits for the others to be masked; rows of data stay as they are.
    worded: float = 0.75
    #: A line of fewer than ``brief`` tokens must occur so many times, and so must a template
    #: with worded fields of fewer than ``short`` tokens: such lines also meet by chance.
    brief: int = 5
    short: int = 10
    brief_times: int = 10
    #: Whether the first line of a recurring template stays; otherwise all its lines go.
    keep_first: bool = True


#: Drops every line and template that two documents share, however short: nothing is left to chance meetings.
EVERY_LINE = Settings(brief=0, short=0)


def _document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _body() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _keyed(docs: DataFrame, s: Settings) -> DataFrame:
    """Lines with single spaces and masked numbers, their leaf and hash; blank ones are left out."""
    line = F.col("line")
    uneven = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for white in ("  ", "\t", "\r", "\x0b", "\f"):
        uneven |= F.contains(line, F.lit(white))
    even = F.when(uneven, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)
    # from the start of a token on, without a way back
    masked = F.regexp_replace("even", r"(?<![^ ])[^ \d]*+\d[^ ]*+", FIELD)
    length = F.length("even") - F.length(F.replace(F.col("even"), F.lit(" "))) + 1
    fields = F.regexp_count("masked", F.lit(r"(?<![^ ])<\*>(?![^ ])"))
    return (
        # hashed and split once a text, before its lines part
        docs.select(_document().alias("document"), _body().alias("body"), F.split("text", "\n").alias("lines"))
        .select("document", "body", F.posexplode("lines").alias("place", "line"))
        .select("document", "body", "place", even.alias("even"))
        .where("even <> ''")
        .select("document", "body", "place", "even", length.alias("length"), F.when(F.col("even").rlike(r"\d"), masked).alias("masked"))
        .select("document", "body", "place", "length", F.when(F.col("length") - fields >= s.worded * F.col("length"), F.col("masked")).otherwise(F.col("even")).alias("line"))
        .select(
            "document",
            "body",
            "place",
            "length",
            "line",
            F.xxhash64("length", F.substring_index("line", " ", s.depth)).alias("leaf"),
            F.xxhash64("line").alias("line_hash"),
        )
    )


def _ends() -> tuple[Column, ...]:
    """Where a line first stands, the largest document that has it, and how often it occurs."""
    return F.min(F.struct("document", "body", "place")).alias("first"), F.max("document").alias("high"), F.count("*").alias("times")


def _worded(keyed: DataFrame, lines: DataFrame, s: Settings) -> DataFrame:
    """Distinct lines with worded fields: leaf, line_hash, length, first, high, times and template, a hash of the fixed tokens."""
    # a leaf that one document reaches alone holds no template, one with a single line nothing to generalise
    ends = (F.min("document").alias("low"), F.max("document").alias("high"), F.min("line_hash").alias("least"), F.max("line_hash").alias("most"))
    several = cut(lines.where(F.col("length") >= s.shortest).groupBy("leaf").agg(*ends).where("low < high AND least < most").select("leaf"))
    whole = keyed.join(F.broadcast(several) if several.count() <= SENT_LEAVES else several, "leaf")
    # copies fold into one row a line before they are taken apart
    distinct = cut(whole.groupBy("leaf", "line_hash", "length").agg(*_ends(), F.first("line").alias("line")))
    tokens = F.transform(F.split("line", " "), lambda t, i: F.xxhash64(i, t))
    fields = distinct.select("leaf", "line_hash", "length", "first.document", "high", F.explode(tokens).alias("field"))
    # distinct lines are counted, so that copies of a line do not make its values look fixed
    shared = fields.groupBy("leaf", "field").agg(F.min("document").alias("low"), F.max("high").alias("high"), F.count("*").alias("held"))
    shared = cut(shared.where("low < high").select("leaf", "field", "held"))
    found = (
        fields.drop("document", "high")
        .join(shared, ["leaf", "field"])
        .groupBy("leaf", "line_hash", "length")
        .agg(F.sort_array(F.collect_list(F.struct("held", "field")), asc=False).alias("found"))
        .withColumn("needed", F.ceil(s.fixed * F.col("length")).cast("int"))
        .where(F.size("found") >= F.col("needed"))
    )
    # as many lines as the template has at most: the least common of the tokens that must stay fixed tells
    support = F.element_at("found", F.col("needed"))["held"]
    kept = found.withColumn("support", support).withColumn("kept", F.filter("found", lambda t: t["held"] * s.spread >= F.col("support")))
    mark = F.aggregate("kept", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(t["field"]))
    general = kept.where(F.size("kept") < F.col("length")).select("leaf", "line_hash", F.xxhash64(F.size("kept").cast("long"), mark).alias("template"))
    return distinct.drop("line").join(general, ["leaf", "line_hash"])


def recurring(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """document, body and place of the lines to drop, place counted from 0.

    ``document`` is the doc_id, or a fixed number for all rows without one, and
    ``body`` a hash that tells apart texts of one id; rows repeated whole count
    as one. Blank lines are never dropped, and null texts have no lines.
    """
    s = settings or Settings()
    keyed = _keyed(docs, s)
    lines = cut(keyed.drop("line"))
    worded = cut(_worded(keyed, lines, s))
    brief = F.when(F.col("length") < s.short, s.brief_times).otherwise(0)
    again = (
        worded.groupBy("leaf", "template")
        .agg(F.min("first").alias("all_first"), F.max("high").alias("high"), F.sum("times").alias("times"), F.first("length").alias("length"))
        .where((F.col("all_first.document") < F.col("high")) & (F.col("times") >= brief))
        .select("leaf", "template", "all_first")
    )
    by_template = cut(worded.join(cut(again), ["leaf", "template"]).select("leaf", "line_hash", F.col("all_first").alias("first")))
    # other lines recur as they are, also those whose short template does not recur often enough
    least = F.when(F.col("length") < s.brief, s.brief_times).otherwise(0)
    same = lines.groupBy("leaf", "line_hash").agg(*_ends(), F.first("length").alias("length"))
    same = same.where((F.col("first.document") < F.col("high")) & (F.col("times") >= least)).select("leaf", "line_hash", "first")
    hits = cut(same.join(by_template, ["leaf", "line_hash"], "left_anti").unionByName(by_template))
    dropped = lines.join(hits, ["leaf", "line_hash"])
    if s.keep_first:
        dropped = dropped.where(F.struct("document", "body", "place") != F.col("first"))
    return dropped.select("document", "body", "place")


def dedup(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``docs`` with recurring lines cut out of text, and the columns n_lines and n_dropped.

    One row for each row of ``docs``; a text whose lines all go is empty, a null
    text stays null with no lines. Columns of the names used here (n_lines,
    n_dropped, and __gone, __document, __body) are replaced or left out.
    """
    own = ("__gone", "__document", "__body")
    taken = [c for c in docs.columns if c not in ("n_lines", "n_dropped", *own)]
    gone = recurring(docs, settings).groupBy("document", "body").agg(F.array_sort(F.collect_set("place")).alias("__gone"))
    left = docs.select(*taken).withColumns({"__document": _document(), "__body": _body()})
    gone = gone.select(F.col("document").alias("__document"), F.col("body").alias("__body"), "__gone")
    joined = left.join(gone, ["__document", "__body"], "left")
    lines = F.split("text", "\n")

    def rest(lines: Column) -> Column:
        """The lines at the places that are left, found by a hash set: the work grows with the lines alone."""
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
        return F.array_join(F.transform(places, lambda p: F.get(lines, p)), "\n")

    # as an argument of a lambda the text is split once, not once a line
    kept = F.element_at(F.transform(F.array(lines), rest), 1)
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in taken],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).alias("n_dropped"),
    )


#: DuckDB SQL of ``dedup`` over documents with unique ids, with the settings' defaults; tokens stand where Spark takes hashes.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM d),
e AS (SELECT doc_id, place, trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS even FROM x),
t AS (SELECT *, string_split(even, ' ') AS raw FROM e WHERE even <> ''),
m AS (SELECT *, list_transform(raw, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS masked FROM t),
k AS (SELECT doc_id, place, len(raw) AS n, CASE WHEN regexp_matches(even, '[0-9]')
  AND len(list_filter(masked, lambda w: w <> '<*>')) >= 0.75::DOUBLE * len(raw) THEN masked ELSE raw END AS tokens FROM m),
u AS (SELECT tokens, n, tokens[1:3] AS head, min(doc_id) AS low, max(doc_id) AS high, count(*) AS times, min({'d': doc_id, 'p': place}) AS fst
  FROM k GROUP BY tokens, n),
s AS (SELECT n, head FROM u WHERE n >= 5 GROUP BY n, head HAVING min(low) < max(high) AND count(*) > 1),
f AS (SELECT u.tokens, u.n, u.head, u.low, u.high, unnest(u.tokens) AS tok, unnest(range(u.n)) AS pos FROM u JOIN s ON u.n = s.n AND u.head = s.head),
h AS (SELECT n, head, pos, tok, count(*) AS held FROM f GROUP BY n, head, pos, tok HAVING min(low) < max(high)),
q AS (SELECT f.tokens, f.n, list_sort(list(h.held), 'DESC') AS counts, list({'pos': f.pos, 'tok': f.tok, 'held': h.held}) AS items
  FROM f JOIN h ON f.n = h.n AND f.head = h.head AND f.pos = h.pos AND f.tok = h.tok GROUP BY f.tokens, f.n),
r AS (SELECT tokens, n, items, counts[ceil(0.8::DOUBLE * n)::BIGINT] AS support FROM q WHERE len(counts) >= ceil(0.8::DOUBLE * n)),
w AS (SELECT tokens, n, list_sort(list_transform(list_filter(items, lambda i: i.held * 40 >= support), lambda i: {'pos': i.pos, 'tok': i.tok})) AS template FROM r),
y AS (SELECT u.*, w.template FROM u LEFT JOIN w ON u.tokens = w.tokens AND len(w.template) < w.n),
a AS (SELECT n, head, template, min(fst) AS fst FROM y WHERE template IS NOT NULL GROUP BY n, head, template
  HAVING min(low) < max(high) AND sum(times) >= CASE WHEN n < 10 THEN 10 ELSE 0 END),
z AS (SELECT y.tokens, CASE WHEN y.template IS NULL THEN CASE WHEN y.low < y.high AND y.times >= CASE WHEN y.n < 5 THEN 10 ELSE 0 END THEN y.fst END
  ELSE coalesce(a.fst, CASE WHEN y.n < 10 AND y.low < y.high THEN y.fst END) END AS fst
  FROM y LEFT JOIN a ON y.n = a.n AND y.head = a.head AND y.template = a.template),
g AS (SELECT k.doc_id, list(k.place) AS gone FROM k JOIN z ON k.tokens = z.tokens WHERE z.fst IS NOT NULL AND {'d': k.doc_id, 'p': k.place} <> z.fst GROUP BY k.doc_id)
SELECT d.doc_id, CASE WHEN g.gone IS NULL THEN d.text ELSE array_to_string(list_filter(d.ls, lambda line, i: NOT list_contains(g.gone, i - 1)), chr(10)) END AS text,
  coalesce(len(d.ls), 0)::INTEGER AS n_lines, coalesce(len(g.gone), 0)::INTEGER AS n_dropped
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
