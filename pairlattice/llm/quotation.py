"""Quotation linking for chat formatting, with DataFrame expressions only.

A message's lines get their quote level (the number of leading ``>``). Lines of level 0 are
its own text, but for a line such as "X wrote:" before a quote. A passage is a run of lines of one level without a
blank line; it is unwrapped to one text and normalised (lower case, single spaces), so that it stays the same when a
mail program breaks its lines elsewhere. Passages and single lines are hashed, quoted and own ones alike, and a
quoted one is linked if an earlier message of its conversation has it as an own one. The words of a quoted passage
of which neither the whole nor a line is found are linked by shingles of SHINGLE words.

All that is linked of a message's level 1 (of the least level with a link) is held
together against every earlier message: a line counts one, a passage its number of lines, a shingle one, each
divided by the number of messages that hold it, so that greetings and signatures hardly count. The message
answers the one with the greatest sum; ties go to the earlier one. Messages that answer
nothing start a thread; the others belong to the thread of what they answer. The
conversation in reply order runs thread by thread, by the threads' first turns, and within a
thread by turn, so every reply follows what it answers, and quotes are left out.

Positions are sums of counts (thread blocks, threads, turn blocks) and a rank within a block,
so that one conversation or thread may hold any part of the rows. Equal quotes are looked up
once. Lines that many messages hold are not paired with them where they cannot decide: a
message that holds only such lines of a quote stays below the best sum, which is at least that
of the quote's heaviest line.

Defined cases: a null text has no lines and an empty own text; rows with a null conv_id or
turn link with nothing and come last; repeated rows get positions of their own; quotes of
unknown origin are left out of the text and counted; the order of a quote's passages does not
matter; a line that names who wrote is the one before a quote or before a blank line and a quote, if it is broken over two lines the first
stays; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairlattice.llm.common import numbered, written

BLOCK = 1024
#: The weight of a line that one message holds; whole numbers, so that sums do not depend on order.
UNIT = 1 << 32
#: Words of a shingle.
SHINGLE = 5
#: Ends of lines that say whom the quote below is by, in some languages (fixed values).
_WROTE = r"(?i)(^|[ \t])(wrote|writes|schrieb|a écrit|escribió|ha scritto|escreveu)([ \t][^:]*)?:[ \t\r]*$"


def _lines(text: Column) -> Column:
    """(level, body) per line."""
    line = F.filter(F.split(text, "\n", -1), lambda x: F.lit(True))
    prefix = lambda x: F.regexp_extract(x, r"^([ \t]*>)*", 0)
    return F.transform(line, lambda x: F.struct(F.length(F.regexp_replace(prefix(x), "[^>]", "")).alias("level"), F.when(prefix(x) == "", x).otherwise(F.substring(x, F.length(prefix(x)) + 1, F.length(x))).alias("body")))


def _normal(body: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(body), r"[\x20\x09-\x0D]+", " "))


def _names_whom(parts: Column, x: Column, i: Column) -> Column:
    """Whether line x, at place i of a message's lines, says whom the quote below it is by."""
    one, two = F.get(parts, i + 1), F.get(parts, i + 2)
    above = F.coalesce((one["level"] > 0) | ((_normal(one["body"]) == "") & (two["level"] > 0)), F.lit(False))
    return (x["level"] == 0) & above & x["body"].rlike(_WROTE)


def _is_own(parts: Column) -> Column:
    """The lines that are the message's own."""
    return F.filter(parts, lambda x, i: (x["level"] == 0) & ~_names_whom(parts, x, i))


def _marked(parts: Column) -> Column:
    """The lines with their place, level (null for a line that says whom a quote is by) and normalised text."""
    level = lambda x, i: F.when(~_names_whom(parts, x, i), x["level"])
    return F.transform(parts, lambda x, i: F.struct(i.alias("i"), level(x, i).alias("level"), _normal(x["body"]).alias("line")))


def _shingles(passages: DataFrame) -> DataFrame:
    """(row, conv_id, turn, level, run, h) of passages of SHINGLE words or more."""
    words = F.split("text", " ")
    each = F.transform(F.sequence(F.lit(1), F.size("words") - SHINGLE + 1), lambda i: F.md5(F.concat(F.lit("s"), F.array_join(F.slice("words", i, SHINGLE), " "))))
    return passages.withColumn("words", words).filter(F.size("words") >= SHINGLE).select("row", "conv_id", "turn", "level", "run", F.explode(F.array_distinct(each)).alias("h"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_linked): messages with a quoted line whose original was found."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id").distinct()
    rows, row = numbered(messages.select("conv_id", "turn", "text").join(quoting, "conv_id", "left_semi"))
    lines = rows.select(row, "conv_id", "turn", _lines(F.col("text")).alias("parts")).select(row, "conv_id", "turn", F.inline(_marked(F.col("parts"))))
    along = W.partitionBy(row).orderBy("i")
    follows = (F.lag("level").over(along) == F.col("level")) & (F.lag("line").over(along) != "") & (F.col("line") != "")
    lines = lines.withColumn("starts", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("run", F.sum("starts").over(along)).filter("line <> '' AND level IS NOT NULL")
    lines = written(lines.select(F.col(row).alias("row"), "conv_id", "turn", "i", "level", "run", "line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ")
    passages = written(lines.groupBy("row", "conv_id", "turn", "level", "run").agg(text.alias("text"), F.count("*").alias("n")))
    of_run = ["row", "conv_id", "turn", "level", "run"]
    units = lines.select(*of_run, F.md5(F.concat(F.lit("l"), "line")).alias("h"), F.lit(1).cast("long").alias("n")).unionByName(passages.select(*of_run, F.md5(F.concat(F.lit("p"), "text")).alias("h"), "n"))

    def holders(own: DataFrame, quoted: DataFrame) -> DataFrame:
        """(conv_id, h, turn): which messages hold what is quoted somewhere."""
        return written(own.filter("turn IS NOT NULL").join(quoted.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi").select("conv_id", "h", "turn").distinct())

    def meeting(quoted: DataFrame, held: DataFrame) -> DataFrame:
        """quoted with the number of messages that hold it, where one of them is earlier."""
        known = held.groupBy("conv_id", "h").agg(F.min("turn").alias("origin"), F.count("*").alias("held"))
        return quoted.join(known, ["conv_id", "h"]).filter("origin < turn")

    quoted = written(units.filter("level > 0"))
    held = holders(units.filter("level = 0"), quoted)
    met = written(meeting(quoted, held))
    left = written(passages.filter("level > 0").join(met.select(*of_run).distinct(), ["row", "run"], "left_anti").select(*(passages[c] for c in (*of_run, "text"))))
    if not left.isEmpty():
        asked = written(_shingles(left).withColumn("n", F.lit(1).cast("long")))
        own = passages.filter("level = 0").join(left.select("conv_id").distinct(), "conv_id", "left_semi")
        more = holders(_shingles(own), asked)
        met, held = written(met.unionByName(meeting(asked, more))), written(held.unionByName(more))
    # lines that are linked themselves, and all lines of runs that are linked as passages or by shingles
    single = lines.select("row", "run", F.md5(F.concat(F.lit("l"), "line")).alias("h")).join(met.select("row", "run", "h").distinct(), ["row", "run", "h"], "left_semi").groupBy("row", "run").agg(F.count("*").alias("n_lines"))
    runs = met.groupBy(*of_run).agg(F.count("*").alias("units")).join(passages.select("row", "run", "text", F.col("n").alias("all_lines")), ["row", "run"])
    whole = met.select("row", "run", "h").distinct()
    by_passage = passages.select("row", "run", F.md5(F.concat(F.lit("p"), "text")).alias("h")).join(whole, ["row", "run", "h"], "left_semi").select("row", "run", F.lit(True).alias("as_whole"))
    counted = runs.join(single, ["row", "run"], "left").join(by_passage, ["row", "run"], "left")
    n_lines = F.when(F.col("as_whole") | F.col("n_lines").isNull(), F.col("all_lines")).otherwise(F.col("n_lines"))
    linked = counted.groupBy("conv_id", "turn").agg(F.min("level").alias("level"), F.sum(n_lines).alias("n_linked"))
    met = written(met.groupBy("conv_id", "turn", "level", "h").agg(F.sum("n").alias("n"), F.first("held").alias("held")))
    weight = F.col("n") * F.floor(F.lit(UNIT) / F.col("held"))
    quotes = met.join(linked, ["conv_id", "turn", "level"]).groupBy("conv_id", "turn").agg(F.first("n_linked").alias("n_linked"), F.sort_array(F.collect_list(F.struct("held", "h", weight.alias("w")))).alias("parts"))
    quotes = written(quotes.withColumn("quote", F.md5(F.to_json("parts"))))
    parts = written(quotes.groupBy("conv_id", "quote").agg(F.first("parts").alias("parts")).select("conv_id", "quote", F.inline("parts")))

    # what only the more widely held lines add up to is less than the heaviest line: they decide nothing without a rarer one
    each = W.partitionBy("conv_id", "quote")
    rest = F.sum("w").over(each.orderBy(F.desc("held"), F.desc("h")).rowsBetween(W.unboundedPreceding, 0))
    deciding = parts.withColumn("rest", rest).withColumn("top", F.max("w").over(each)).filter("rest >= top")
    able = written(deciding.join(held, ["conv_id", "h"]).select("conv_id", "quote", "turn").distinct())
    sums = able.join(held, ["conv_id", "turn"]).join(parts, ["conv_id", "quote", "h"]).groupBy("conv_id", "quote", "turn").agg(F.sum("w").alias("sum"))
    firsts = written(sums.groupBy("conv_id", "quote", "sum").agg(F.min("turn").alias("origin")))
    found = quotes.join(firsts, ["conv_id", "quote"]).filter("origin < turn")
    return found.groupBy("conv_id", "turn").agg(F.min_by("origin", F.struct(-F.col("sum"), "origin")).alias("parent_turn"), F.first("n_linked").alias("n_linked"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn): the first turn of each linked message's thread, by pointer doubling."""
    now = written(links.select("conv_id", "turn", F.col("parent_turn").alias("up")))
    while True:
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("upper"))
        then = written(now.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")))
        now = then.drop("moved")
        if then.filter("moved").isEmpty():
            return now.withColumnRenamed("up", "thread_turn")


def reply_order(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, parent_turn, thread_turn, position, n_quoted, n_linked, own_text: a row per message."""
    parts = _lines(F.col("text"))
    own = F.array_join(F.transform(_is_own(F.col("parts")), lambda x: x["body"]), "\n")
    base = messages.select("conv_id", "turn", "role", parts.alias("parts")).select("conv_id", "turn", "role", F.coalesce(own, F.lit("")).alias("own_text"), F.coalesce(F.size(F.filter("parts", lambda x: x["level"] > 0)), F.lit(0)).cast("long").alias("n_quoted"))
    links = written(link_quotes(messages))
    joined = base.join(links, ["conv_id", "turn"], "left").join(threads(links), ["conv_id", "turn"], "left")
    rows = written(joined.withColumn("thread_turn", F.coalesce("thread_turn", "turn")).withColumn("n_linked", F.coalesce("n_linked", F.lit(0))).withColumn("thread_block", F.floor(F.col("thread_turn") / BLOCK)).withColumn("turn_block", F.floor(F.col("turn") / BLOCK)))

    cells = rows.groupBy("conv_id", "thread_block", "thread_turn", "turn_block").agg(F.count("*").alias("n"))
    before = lambda *keys, by: F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy(F.col(by).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = cells.groupBy("conv_id", "thread_block").agg(F.sum("n").alias("n")).withColumn("before_block", before("conv_id", by="thread_block"))
    within = cells.groupBy("conv_id", "thread_block", "thread_turn").agg(F.sum("n").alias("n")).withColumn("before_thread", before("conv_id", "thread_block", by="thread_turn"))
    turns = cells.withColumn("before_turns", before("conv_id", "thread_turn", by="turn_block"))
    rank = F.row_number().over(W.partitionBy("conv_id", "thread_turn", "turn_block").orderBy(F.col("turn").asc_nulls_last(), "role", "own_text"))
    out = rows.withColumn("rank", rank).alias("r")
    same = lambda b, *keys: [F.col(f"r.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    out = out.join(blocks.alias("b"), same("b", "conv_id", "thread_block")).join(within.alias("w"), same("w", "conv_id", "thread_turn")).join(turns.alias("t"), same("t", "conv_id", "thread_turn", "turn_block"))
    position = F.col("rank") + F.col("before_block") + F.col("before_thread") + F.col("before_turns")
    return out.select("r.conv_id", "r.turn", "r.role", "r.parent_turn", "r.thread_turn", position.cast("long").alias("position"), "r.n_quoted", F.col("r.n_linked").cast("long").alias("n_linked"), "r.own_text")


def query(spark, sf_dir: str) -> DataFrame:
    return reply_order(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS row, * FROM conversations),
raw AS (SELECT row, conv_id, turn, i, string_split(text, chr(10))[i] AS line
        FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM m WHERE text IS NOT NULL)),
cut AS (SELECT *, regexp_extract(line, '^([ \t]*>)*', 0) AS prefix FROM raw),
lines AS (SELECT row, conv_id, turn, i, len(regexp_replace(prefix, '[^>]', '', 'g')) AS level,
                 CASE WHEN prefix = '' THEN line ELSE substr(line, len(prefix) + 1) END AS body FROM cut),
norm AS (SELECT *, trim(regexp_replace(lower(body), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS h FROM lines),
next AS (SELECT *, level = 0 AND coalesce(lead(level) OVER w > 0 OR (lead(h) OVER w = '' AND lead(level, 2) OVER w > 0), FALSE) AND regexp_matches(body, '(?i)(^|[ \t])(wrote|writes|schrieb|a écrit|escribió|ha scritto|escreveu)([ \t][^:]*)?:[ \t\r]*$') AS by_whom
         FROM norm WINDOW w AS (PARTITION BY row ORDER BY i)),
lag_ AS (SELECT *, CASE WHEN by_whom THEN NULL ELSE level END AS lv FROM next),
run_ AS (SELECT *, sum(CASE WHEN coalesce(before = lv AND above <> '' AND h <> '', FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY i) AS run
         FROM (SELECT *, lag(lv) OVER w AS before, lag(h) OVER w AS above FROM lag_ WINDOW w AS (PARTITION BY row ORDER BY i))),
said AS (SELECT row, conv_id, turn, i, lv AS level, run, h AS line FROM run_ WHERE h <> '' AND lv IS NOT NULL),
passage AS (SELECT row, conv_id, turn, level, run, string_agg(line, ' ' ORDER BY i) AS txt, count(*) AS n FROM said GROUP BY ALL),
unit AS (SELECT row, conv_id, turn, level, run, 'l' || line AS u, 1 AS n FROM said UNION ALL SELECT row, conv_id, turn, level, run, 'p' || txt, n FROM passage),
hold AS (SELECT DISTINCT conv_id, u, turn FROM unit WHERE level = 0 AND turn IS NOT NULL),
known AS (SELECT conv_id, u, min(turn) AS origin, count(*) AS held FROM hold GROUP BY ALL),
met1 AS (SELECT q.*, held FROM unit q JOIN known USING (conv_id, u) WHERE q.level > 0 AND origin < q.turn),
words AS (SELECT row, conv_id, turn, level, run, string_split(txt, ' ') AS w FROM passage p
          WHERE level = 0 OR NOT EXISTS (SELECT 1 FROM met1 WHERE met1.row = p.row AND met1.run = p.run)),
shingle AS (SELECT DISTINCT row, conv_id, turn, level, run, 's' || array_to_string(w[k:k + 4], ' ') AS u FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM words WHERE len(w) >= 5)),
hold_s AS (SELECT DISTINCT conv_id, u, turn FROM shingle WHERE level = 0 AND turn IS NOT NULL),
known_s AS (SELECT conv_id, u, min(turn) AS origin, count(*) AS held FROM hold_s GROUP BY ALL),
met AS (SELECT row, conv_id, turn, level, run, u, n, held FROM met1 UNION ALL
        SELECT q.row, q.conv_id, q.turn, q.level, q.run, q.u, 1, held FROM shingle q JOIN known_s USING (conv_id, u) WHERE q.level > 0 AND origin < q.turn),
held_all AS (SELECT * FROM hold UNION ALL SELECT * FROM hold_s),
runs AS (SELECT row, conv_id, turn, level, run, bool_or(u[1] = 'p' OR u[1] = 's') AS whole, count(*) AS units FROM met GROUP BY ALL),
line_count AS (SELECT r.conv_id, r.turn, min(r.level) AS level, CAST(sum(CASE WHEN r.whole THEN p.n ELSE r.units END) AS BIGINT) AS n_linked
               FROM runs r JOIN passage p ON r.row = p.row AND r.run = p.run GROUP BY ALL),
vote AS (SELECT m.conv_id, m.turn, k.turn AS origin, sum(m.n * (4294967296 // m.held)) AS votes
         FROM met m JOIN line_count c ON m.conv_id = c.conv_id AND m.turn = c.turn AND m.level = c.level JOIN held_all k ON k.conv_id = m.conv_id AND k.u = m.u WHERE k.turn < m.turn GROUP BY ALL),
links AS (SELECT v.conv_id, v.turn, arg_min(origin, (-votes, origin)) AS parent_turn, any_value(n_linked) AS n_linked FROM vote v JOIN line_count USING (conv_id, turn) GROUP BY ALL),
up(conv_id, turn, anc) AS (SELECT conv_id, turn, parent_turn FROM links
        UNION ALL SELECT up.conv_id, up.turn, l.parent_turn FROM up JOIN links l ON up.conv_id = l.conv_id AND up.anc = l.turn),
roots AS (SELECT conv_id, turn, min(anc) AS thread_turn FROM up GROUP BY ALL),
own AS (SELECT row, string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT by_whom) AS own_text, count(*) FILTER (level > 0) AS n_quoted FROM next GROUP BY row),
j AS (SELECT m.conv_id, m.turn, m.role, l.parent_turn, coalesce(r.thread_turn, m.turn) AS thread_turn, coalesce(o.n_quoted, 0) AS n_quoted,
             coalesce(l.n_linked, 0) AS n_linked, coalesce(o.own_text, '') AS own_text
      FROM m LEFT JOIN own o USING (row) LEFT JOIN links l ON m.conv_id = l.conv_id AND m.turn = l.turn
             LEFT JOIN roots r ON m.conv_id = r.conv_id AND m.turn = r.turn)
SELECT conv_id, turn, role, parent_turn, thread_turn,
       row_number() OVER (PARTITION BY conv_id ORDER BY thread_turn NULLS LAST, turn NULLS LAST, role NULLS FIRST, own_text) AS position,
       n_quoted, n_linked, own_text
FROM j
"""
