"""Quotation linking: quoted passages joined to the messages they come from, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.shared import stage

MARKS = r"^[ \t]*((?:>[ \t]?)*)"
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|\S.*\b(?:wrote|writes)):\s*$"
#: Turns whose lines of one wording are searched together; what lies before them comes from summaries.
TURNS = 64
#: Sentences, in a normalised passage, and the least words of one that is looked for by itself.
SENTENCES, SENTENCE = "[^.!?]+[.!?]*", 3


def quoted_lines(text: Column) -> Column:
    """Lines as structs: level (marks `>` before it), body, norm (lower case, single blanks)."""

    def line(x: Column) -> Column:
        body = F.regexp_replace(x, MARKS, "")
        return F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"),
            body.alias("body"),
            F.lower(F.trim(F.regexp_replace(body, r"\s+", " "))).alias("norm"),
        )

    return F.transform(F.split(F.coalesce(text.cast("string"), F.lit("")), "\r?\n"), line)


def passages(lines: Column) -> Column:
    """Runs of lines of one level with text between, as structs: level, text (their norms joined by blanks).

    A line without text, or of another level, ends a run; so it doesn't matter where a text is wrapped.
    """
    before = F.concat(F.array(F.lit(None).cast("struct<level: int, body: string, norm: string>")), lines)

    def mark(x: Column, p: Column) -> Column:
        norm = F.translate(x["norm"], "\x01\x03", "  ")
        starts = F.coalesce((p["level"] != x["level"]) | (p["norm"] == ""), F.lit(True))
        return F.when(x.isNull() | (x["norm"] == ""), "").when(starts, F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x03"), norm)).otherwise(F.concat(F.lit(" "), norm))

    runs = F.filter(F.split(F.array_join(F.zip_with(lines, before, mark), ""), "\x01"), lambda r: r != "")
    return F.transform(runs, lambda r: F.struct(F.substring_index(r, "\x03", 1).cast("int").alias("level"), F.substring_index(r, "\x03", -1).alias("text")))


def units(text: Column) -> Column:
    """What of a passage is looked for: itself, and its sentences of SENTENCE words or more."""
    words = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
    unit = lambda t, whole: F.struct(F.xxhash64(t).alias("passage"), F.lit(whole).alias("whole"), words(t).cast("long").alias("words"))
    sentences = F.filter(F.transform(F.regexp_extract_all(text, F.lit(SENTENCES), F.lit(0)), lambda t: F.trim(t)), lambda t: words(t) >= SENTENCE)
    return F.array_distinct(F.concat(F.array(unit(text, True)), F.transform(sentences, lambda t: unit(t, False))))


def linked(messages: DataFrame) -> DataFrame:
    """One row a message of messages(conv_id, turn, role, text).

    Columns: conv_id, turn, role, n_quoted (quoted passages), n_linked (those found in an earlier
    message of the conversation), max_level, reply_to (the turn that most words of passages of level
    1 come from, the latest of equals; null if none), root_turn, depth, path (the turns from the root
    to this one, in ten digits; sorting by it puts replies below what they answer), own_text (without
    quotes and their attribution lines).

    A passage is a run of lines of one level. A quoted one belongs to the latest earlier turn that
    has it as a whole, as a passage or sentence of its own words, whatever the quote's level; if none
    has, each of its sentences of SENTENCE words or more belongs to the latest that has that. Null
    texts have no lines. A null conv_id or turn takes part in no link. Rows of one conversation and
    turn count as one message for linking, and each is returned.
    """
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), quoted_lines(F.col("text")).alias("lines"))
    rows = rows.withColumn("passages", passages(F.col("lines")))
    found = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.posexplode("passages").alias("nth", "p"))
    found = found.select("conv_id", "turn", "nth", "p.level", F.explode(units(F.col("p.text"))).alias("u")).select("conv_id", "turn", "nth", "level", "u.*").distinct()
    quotes = stage(found.where("level > 0"), "quotes")
    asked = quotes.select("conv_id", "passage").distinct()
    own = stage(found.where("level = 0").select("conv_id", "passage", "turn").distinct().join(asked, ["conv_id", "passage"], "left_semi"), "originals")

    # the latest original before each quote: within its range of turns, or else of an earlier range
    events = own.withColumn("own", F.col("turn")).unionByName(quotes.select("conv_id", "passage", "turn").distinct().withColumn("own", F.lit(None).cast("long")))
    events = events.withColumn("range", F.floor(F.col("turn") / TURNS))
    within = Window.partitionBy("conv_id", "passage", "range").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id", "passage").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = events.groupBy("conv_id", "passage", "range").agg(F.max("own").alias("last"))
    ranges = ranges.select("conv_id", "passage", "range", F.max("last").over(before).alias("earlier"))
    found = events.withColumn("near", F.max("own").over(within)).where("own IS NULL").join(ranges, ["conv_id", "passage", "range"])
    found = found.select("conv_id", "passage", "turn", F.coalesce("near", "earlier").alias("source"))
    per = quotes.join(found, ["conv_id", "passage", "turn"]).where("source IS NOT NULL")
    of = Window.partitionBy("conv_id", "turn", "nth", "level")
    per = stage(per.withColumn("as_whole", F.max("whole").over(of)).where("whole OR NOT as_whole"), "found")
    votes = per.where("level = 1").groupBy("conv_id", "turn", "source").agg(F.sum("words").alias("n"))
    votes = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("n", "source"))["source"].alias("reply_to"))
    counts = per.select("conv_id", "turn", "nth", "level").distinct().groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"))
    links = stage(counts.join(votes, ["conv_id", "turn"], "left"), "links")
    paths = _paths(links.where("reply_to IS NOT NULL").select("conv_id", "turn", "reply_to"))

    with_text = F.filter("lines", lambda x: (x["level"] > 0) & (x["norm"] != ""))
    # whether a message quotes at all is worked out once, not for each of its lines
    body = lambda quotes: F.array_join(F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~(quotes & x["body"].rlike(ATTRIBUTION))), lambda x: x["body"]), "\n")
    own_text = F.element_at(F.transform(F.array(F.exists("lines", lambda x: (x["level"] > 0) & (x["norm"] != ""))), body), 1)
    out = rows.select(
        "conv_id", "turn", "role", F.size(F.filter("passages", lambda p: p["level"] > 0)).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform(with_text, lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.regexp_replace(own_text, r"^\s+|\s+$", "").alias("own_text"),
    )
    out = out.join(links, ["conv_id", "turn"], "left").join(paths, ["conv_id", "turn"], "left")
    path = F.coalesce("path", F.array("turn"))
    return out.select(
        "conv_id", "turn", "role", "n_quoted", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"), "max_level", "reply_to",
        F.element_at(path, 1).alias("root_turn"), (F.size(path) - 1).cast("long").alias("depth"),
        F.array_join(F.transform(path, lambda t: F.format_string("%010d", t)), ",").alias("path"), "own_text",
    )


def _paths(replies: DataFrame) -> DataFrame:
    """conv_id, turn, path of each reply: each round doubles the part of the path that is known."""
    state = stage(replies.select("conv_id", "turn", F.col("reply_to").alias("up"), F.array("turn").alias("path")), "paths")
    while not state.where("up IS NOT NULL").limit(1).isEmpty():
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        open_ = state.where("up IS NOT NULL").join(above, ["conv_id", "up"], "left")
        open_ = open_.select("conv_id", "turn", F.col("next").alias("up"), F.concat(F.coalesce("above", F.array("up")), "path").alias("path"))
        state = stage(state.where("up IS NULL").unionByName(open_), "paths")
    return state.drop("up")


def conversations(out: DataFrame) -> DataFrame:
    """conv_id and its messages as an array in reply order; for conversations that fit a row."""
    message = F.struct(F.transform(F.split("path", ","), lambda t: t.cast("long")).alias("path"), "turn", "role", "own_text")
    return out.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["turn"], m["role"], m["own_text"])).alias("messages"))


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, unnest(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) AS x,
    unnest(range(1, len(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10))) + 1)) AS k
  FROM conversations),
l AS (
  SELECT conv_id, turn, role, k, length(regexp_replace(regexp_extract(x, '^[ \t]*((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) AS level,
    regexp_replace(x, '^[ \t]*((?:>[ \t]?)*)', '') AS body FROM raw),
n AS (SELECT *, lower(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS norm FROM l),
marked AS (SELECT *, CASE WHEN lag(level) OVER w = level AND lag(norm) OVER w <> '' THEN 0 ELSE 1 END AS starts FROM n WINDOW w AS (PARTITION BY conv_id, turn ORDER BY k)),
runs AS (SELECT conv_id, turn, level, norm, k, sum(starts) OVER (PARTITION BY conv_id, turn ORDER BY k) AS run FROM marked),
psg AS (SELECT conv_id, turn, run, level, string_agg(norm, ' ' ORDER BY k) AS t FROM runs WHERE norm <> '' GROUP BY ALL),
unit AS (
  SELECT conv_id, turn, run, level, t AS u, true AS whole FROM psg
  UNION SELECT conv_id, turn, run, level, trim(x) AS u, false FROM (SELECT *, unnest(regexp_extract_all(t, '[^.!?]+[.!?]*')) AS x FROM psg) WHERE len(string_split(trim(x), ' ')) >= 3),
src AS (
  SELECT q.conv_id, q.turn, q.run, q.level, q.u, q.whole, max(o.turn) AS source
  FROM unit q JOIN unit o ON o.conv_id = q.conv_id AND o.u = q.u AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 GROUP BY ALL),
used AS (SELECT * FROM (SELECT *, bool_or(whole) OVER (PARTITION BY conv_id, turn, run) AS as_whole FROM src) WHERE whole OR NOT as_whole),
votes AS (SELECT conv_id, turn, source, sum(len(string_split(u, ' '))) AS c FROM used WHERE level = 1 GROUP BY ALL),
parent AS (SELECT conv_id, turn, arg_max(source, c * 1000000 + source) AS reply_to FROM votes GROUP BY ALL),
cnt AS (SELECT conv_id, turn, count(DISTINCT run) AS n_linked FROM used GROUP BY ALL),
quoted AS (SELECT conv_id, turn, count(*) FILTER (level > 0) AS n_quoted FROM psg GROUP BY ALL),
msg AS (
  SELECT conv_id, turn, any_value(role) AS role, count(*) FILTER (level > 0 AND norm <> '') AS n_lines,
    coalesce(max(level) FILTER (level > 0 AND norm <> ''), 0) AS max_level FROM n GROUP BY ALL),
own AS (
  SELECT n.conv_id, n.turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (level = 0 AND NOT (n_lines > 0
    AND regexp_matches(body, '(?i)^\s*(?:on\b.*\bwrote|\S.*\b(?:wrote|writes)):\s*$'))), ''), '^\s+|\s+$', '', 'g') AS own_text
  FROM n JOIN msg USING (conv_id, turn) GROUP BY ALL),
tree AS (
  SELECT m.conv_id, m.turn, m.turn AS root_turn, 0 AS depth, printf('%010d', m.turn) AS path FROM msg m LEFT JOIN parent p USING (conv_id, turn) WHERE p.reply_to IS NULL
  UNION ALL
  SELECT t.conv_id, p.turn, t.root_turn, t.depth + 1, t.path || ',' || printf('%010d', p.turn) FROM tree t JOIN parent p ON p.conv_id = t.conv_id AND p.reply_to = t.turn)
SELECT conv_id, turn, role, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked, max_level, reply_to, root_turn, CAST(depth AS BIGINT) AS depth, path, own_text
FROM msg JOIN tree USING (conv_id, turn) JOIN own USING (conv_id, turn) LEFT JOIN cnt USING (conv_id, turn) LEFT JOIN parent USING (conv_id, turn) LEFT JOIN quoted USING (conv_id, turn)
"""
