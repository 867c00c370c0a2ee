"""Chat formatting: quotation linking.

A line's quote level is the number of ``>`` it starts with. Neighbouring lines of one level are a passage (a blank
line ends it); its lines, their marks taken away, A-Z lower-cased and white space collapsed, are joined by spaces and
hashed. A quoted passage is joined to the first earlier message of its conversation with the same unquoted passage;
only where there is none, each of its lines is joined to the first earlier message that says the line. So a short
line like "Yes." links to a message that says just that before one that merely has such a line. A message replies to
the original of its shallowest linked quotes, the one with most quoted characters, then the earliest. Replies form
threads; a thread's messages in turn order stand after what they reply to, because an original is always earlier.

Only built-in expressions are used, linear in a text's lines. Originals are reduced to one row for each conversation
and passage before the join (a partial minimum), so a line said thousands of times matches once; text itself goes
through one join and the final ordering. Threads are found by pointer doubling over replies alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeloom.llm.shared import drop_staged, staged

#: Flat classes: a group that repeats would recurse once for each mark.
_MARKS = r"^[ \t]*(>[> \t]*)?"
_BLANKS = r"[\x01\x02\x20\x09-\x0D]+"
_ATTRIBUTION = r"^On .* wrote:[ \t]*\z"
_SPACES = " \t\n\x0b\x0c\r"
#: Marks the ends of a line's words and the places where lines of one passage meet; no normalised line holds them.
_END, _MEET = "\x01", "\x02"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"[ \t]", ""))


def normalised(line: Column, depth: Column) -> Column:
    """A line of a level without quote marks, A-Z lower-cased, white space collapsed and trimmed."""
    bare = F.when(depth > 0, F.regexp_replace(line, _MARKS, "")).otherwise(line)
    folded = F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(folded, _BLANKS, " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines (line, level, said, words), text (without quotes) and n_quoted (quoted lines).

    said: unquoted and no attribution of the quote below it.
    """
    plain = F.transform(F.split("whole", "\n", -1), lambda x: F.struct(x.alias("line"), level(x).alias("level")))
    rows = messages.select("conv_id", "turn", "role", F.col("text").alias("whole")).withColumn("plain", plain)
    said = lambda x, after: (x["level"] == 0) & ~(x["line"].rlike(_ATTRIBUTION) & (F.coalesce(after["level"], F.lit(0)) > 0))
    # Each line beside the next one: an index into an expression would evaluate all of it for each line.
    lines = F.zip_with(
        "plain", F.slice("plain", 2, F.size("plain")),
        lambda x, after: F.struct(x["line"].alias("line"), x["level"].alias("level"), said(x, after).alias("said"), normalised(x["line"], x["level"]).alias("words")),
    )
    rows = rows.withColumn("lines", F.filter(lines, lambda x: x["line"].isNotNull())).drop("plain")
    n = F.size(F.filter("lines", lambda x: x["level"] > 0))
    own = F.btrim(F.array_join(F.transform(F.filter("lines", lambda x: x["said"]), lambda x: x["line"]), "\n"), F.lit(_SPACES))
    rows = rows.withColumn("n_quoted", F.when(F.isnull("whole"), 0).otherwise(n).cast("long"))
    return rows.withColumn("text", F.when(F.col("n_quoted") == 0, F.col("whole")).otherwise(own)).drop("whole")


def passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level (0: said) and words of every passage, its lines held apart by _MEET."""
    mark = lambda x: F.when(x["words"] == "", "-").when(x["level"] > 0, x["level"].cast("string")).when(x["said"], "0").otherwise("-")
    marked = F.array_join(F.transform("lines", lambda x: F.concat(mark(x), F.lit(_END), x["words"], F.lit(_END), mark(x))), "\n")
    joined = F.regexp_replace(marked, rf"{_END}(\d+)\n\1{_END}", _MEET)
    parts = F.split("unit", _END)
    found = rows.select("conv_id", "turn", F.explode(F.split(joined, "\n", -1)).alias("unit")).where(~F.col("unit").startswith("-"))
    return found.select("conv_id", "turn", parts[0].cast("int").alias("level"), parts[1].alias("words"))


def links(rows: DataFrame) -> DataFrame:
    """conv_id, turn and reply_to of the messages whose quotes have an earlier original."""
    hashed = lambda words: F.md5(words.cast("binary"))
    key = lambda kind, words: F.struct(F.lit(kind).alias("kind"), hashed(words).alias("hash"), F.length(words).alias("chars"))
    whole = F.translate("words", _MEET, " ")
    keys = F.concat(F.array(key(1, whole)), F.transform(F.split("words", _MEET), lambda x: key(0, x)))
    # Hashed before the lines are dealt out, or it would be hashed again for each of them.
    keyed = passages(rows.where("conv_id is not null and turn is not null")).withColumn("passage", hashed(whole))
    each = keyed.select("conv_id", "turn", "level", "passage", F.explode(keys).alias("key")).select("conv_id", "turn", "level", "passage", "key.*")
    originals = each.where("level = 0").groupBy("conv_id", "kind", "hash").agg(F.min("turn").alias("origin"))
    matched = each.where("level > 0").distinct().join(originals, ["conv_id", "kind", "hash"]).where("origin < turn")
    # Lines count only where their passage as a whole has no original.
    coarsest = F.max("kind").over(Window.partitionBy("conv_id", "turn", "level", "passage"))
    chosen = matched.withColumn("coarsest", coarsest).where("kind = coarsest")
    weighed = chosen.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("chars").alias("chars"))
    best = F.min_by("origin", F.struct("level", -F.col("chars"), "origin"))
    return weighed.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def threads(replies: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, thread (turn of the first message) and depth (replies from it) by pointer doubling."""
    now = staged(replies.select("*", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        far = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("further"), F.col("depth").alias("steps"))
        on = (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t"))
        if now.join(far, on, "left_semi").isEmpty():
            return now
        joined = now.join(far, on, "left")
        before, now = now, staged(joined.select("conv_id", "turn", "reply_to", F.coalesce("further", "thread").alias("thread"), (F.col("depth") + F.coalesce("steps", F.lit(0))).alias("depth")), "threads")
        drop_staged(before)


def format_chats(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without quotes, n_quoted, reply_to, thread and depth, in reply order.

    Reply order is conversation, thread, turn. A message without a linked quote starts a thread of its own (depth
    0, reply_to null). A null text stays null and a text without quotes as it is; rows without conv_id or turn have
    no links; repeated rows are all returned and are one message to the links; an empty table gives an empty one;
    other columns are not read.
    """
    rows = parsed(messages)
    found = threads(links(rows))
    plain = rows.select("conv_id", "turn", "role", "text", "n_quoted")
    placed = plain.join(found, ["conv_id", "turn"], "left").select(*plain.columns, "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))
    order = ["conv_id", "thread", "turn"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, * FROM conversations),
ln AS (SELECT rid, conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line
       FROM (SELECT *, string_split(text, chr(10)) AS ls FROM m WHERE text IS NOT NULL)),
lv AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(>[> \t]*)?', 1), '[ \t]', '', 'g')) AS level FROM ln),
sd AS (SELECT *, level = 0 AND NOT (regexp_matches(line, '^On .* wrote:[ \t]*\z')
         AND coalesce(lead(level) OVER (PARTITION BY rid ORDER BY i), 0) > 0) AS said FROM lv),
nm AS (SELECT *, trim(regexp_replace(translate(CASE WHEN level > 0 THEN regexp_replace(line, '^[ \t]*(>[> \t]*)?', '') ELSE line END,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x01\x02\x20\x09-\x0D]+', ' ', 'g')) AS words FROM sd),
tg AS (SELECT *, CASE WHEN words = '' THEN NULL WHEN level > 0 THEN level WHEN said THEN 0 END AS depth FROM nm),
rn AS (SELECT *, sum(starts) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
         SELECT *, CASE WHEN depth = lag(depth) OVER (PARTITION BY rid ORDER BY i) THEN 0 ELSE 1 END AS starts FROM tg)),
ps AS (SELECT conv_id, turn, depth, string_agg(words, ' ' ORDER BY i) AS passage, list(words ORDER BY i) AS parts
       FROM rn WHERE depth IS NOT NULL GROUP BY rid, run, conv_id, turn, depth),
ky AS (SELECT DISTINCT * FROM (
         SELECT conv_id, turn, depth, md5(passage) AS passage, 1 AS kind, passage AS words FROM ps
         UNION ALL SELECT conv_id, turn, depth, md5(passage), 0, unnest(parts) FROM ps)),
orig AS (SELECT conv_id, kind, words, min(turn) AS origin FROM ky WHERE depth = 0 GROUP BY ALL),
mt AS (SELECT q.*, o.origin FROM ky q JOIN orig o ON q.conv_id = o.conv_id AND q.kind = o.kind AND q.words = o.words AND o.origin < q.turn WHERE q.depth > 0),
wt AS (SELECT conv_id, turn, depth, origin, sum(length(words)) AS chars FROM (
         SELECT *, max(kind) OVER (PARTITION BY conv_id, turn, depth, passage) AS coarsest FROM mt) WHERE kind = coarsest GROUP BY ALL),
rp AS (SELECT conv_id, turn, origin AS reply_to FROM (
         SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth, chars DESC, origin) AS k FROM wt) WHERE k = 1),
up AS (SELECT conv_id, turn, reply_to, reply_to AS thread, 1 AS depth FROM rp
       UNION ALL
       SELECT up.conv_id, up.turn, up.reply_to, rp.reply_to, up.depth + 1 FROM up JOIN rp ON up.conv_id = rp.conv_id AND up.thread = rp.turn),
th AS (SELECT conv_id, turn, reply_to, min(thread) AS thread, max(depth) AS depth FROM up GROUP BY ALL),
own AS (SELECT rid, count(*) FILTER (WHERE level > 0) AS n_quoted,
          regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE said), ''), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+\z', '') AS body
        FROM sd GROUP BY rid)
SELECT m.conv_id, m.turn, m.role, CASE WHEN coalesce(n_quoted, 0) = 0 THEN m.text ELSE body END AS text,
       coalesce(n_quoted, 0)::BIGINT AS n_quoted, th.reply_to, coalesce(th.thread, m.turn) AS thread, coalesce(th.depth, 0)::BIGINT AS depth
FROM m LEFT JOIN own USING (rid) LEFT JOIN th ON m.conv_id = th.conv_id AND m.turn = th.turn
"""
