"""Chat formatting by quotation linking.

Messages of a conversation quote earlier ones in lines that begin with ``>``, nested to any level. A quoted passage is a paragraph of one level.
Passages, their lines and their sentences are normalised, hashed and joined to those of the messages they came from, so that a passage is found
if it was wrapped anew or cut out of a longer one at sentence or line ends. A message answers the one that its outermost quote is from. What
results is each conversation in the order of its replies, without the quotes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import bound, durable, small_side

MARK = r"^\s{0,3}((?:>\s?+)++)"  # quote marks at the beginning of a line
SENTENCE_END = r"(?<=[.!?\u2026\u3002\uff01\uff1f])\s+"
SAID = r"(?i)^\s*(on\b.*\bwrote|.{1,80}\b(wrote|writes|said)|le\b.*a écrit|am\b.*schrieb|el\b.*escribió)\s*:\s*$"


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "  ")


def _quoting(text: Column) -> Column:
    """Whether any line may begin with a quote mark."""
    return _clean(text).rlike(r"(?m)" + MARK)


def _lines(text: Column) -> Column:
    """[(level, body)] of the lines of a text; level 0 is the message's own."""
    marks = lambda line: F.regexp_extract(line, MARK, 1)
    return F.transform(
        F.split(_clean(text), r"\r\n|\r|\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(marks(line), r"[^>]", "")).alias("level"), F.regexp_replace(line, MARK, "").alias("body")
        ),
    )


def _normal(body: Column) -> Column:
    """What quoting may change is left out: case, white space, marks."""
    return F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " "))


def _passages(lines: Column) -> Column:
    """[(level, passage, piece)]: of every paragraph, which is a run of lines of one level without a blank one, its whole, its lines and its
    sentences, each normalised; passage is the whole.

    Lines are written with their level at both ends, so that one replacement joins all neighbours of equal level.
    """
    marked = F.transform(
        lines,
        lambda x: F.when(F.trim(x["body"]) == "", "-").otherwise(
            F.concat(x["level"].cast("string"), F.lit("\x01"), x["body"], F.lit("\x01"), x["level"].cast("string"))
        ),
    )
    joined = F.regexp_replace(F.array_join(marked, "\x02"), r"\x01(\d+)\x02\1\x01", "\n")

    def pieces(run: Column) -> Column:
        level = F.substring_index(run, "\x01", 1).cast("int")
        body = F.get(F.split(run, "\x01"), F.lit(1))
        parts = F.concat(F.array(body), F.split(body, "\n"), F.split(F.translate(body, "\n", " "), SENTENCE_END))
        return bound(
            F.struct(level.alias("level"), F.array_distinct(F.transform(parts, _normal)).alias("parts")),
            lambda known: F.transform(
                known["parts"],
                lambda part: F.struct(known["level"].alias("level"), known["parts"][0].alias("passage"), part.alias("piece")),
            ),
        )

    runs = F.filter(F.split(joined, "\x02"), lambda run: run != "-")
    return F.filter(F.flatten(F.transform(runs, pieces)), lambda x: x["piece"] != "")


def unquoted(text: Column) -> Column:
    """The text without quoted lines, lines that announce a quote, and the blank lines around them."""

    def own(lines: Column) -> Column:
        marked = F.transform(
            lines,
            lambda x, i: F.struct(
                x["body"].alias("body"),
                ((x["level"] > 0) | (x["body"].rlike(SAID) & (F.coalesce(F.get(lines, i + 1)["level"], F.lit(0)) > 0))).alias("goes"),
            ),
        )
        return F.transform(F.filter(marked, lambda x: ~x["goes"]), lambda x: x["body"])

    whole = F.when(_quoting(text), F.array_join(bound(_lines(text), own), "\n")).otherwise(
        F.regexp_replace(_clean(text), r"\r\n|\r", "\n")
    )
    return F.btrim(F.regexp_replace(whole, r"\n{3,}", "\n\n"), F.lit(" \t\n\x0b\f\r"))


def linked_messages(
    messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message, sorted in reply order: conv_id, turn, role, text (without quotes), reply_to (the turn answered, or null),
    thread (the turn that began the thread), depth (answers since then), quotes (different quoted passages), linked (those found in an earlier
    message).

    Of a passage the longest piece (whole, line or sentence) that another message wrote itself decides where it is from: the earliest such message
    of its conversation. The message answers the latest message that its passages of the lowest level found are from. Only earlier turns are
    linked, so threads have no cycles. In the order by (conv_id, thread, turn) a thread stays together and every answer follows what it answers; a
    conversation without quotes keeps the order of its turns.

    Rows without conversation or turn are kept and linked to nothing; a null text is empty. Of repeated turns those that quote share their links: the turn is what is answered.
    An empty table gives no rows. Nothing gathers a conversation in one task: pieces are keyed by their hash, messages by turn, and messages that
    quote nothing take part in no join.
    """
    base = messages.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    answering = placed & _quoting(F.col("text"))

    def spread(rows: DataFrame, level: Callable[[Column], Column]) -> DataFrame:
        """(conv_id, turn, level, passage, hash, size) of the pieces of that level."""
        chosen = F.filter(_passages(_lines(F.col("text"))), lambda x: level(x["level"]))
        listed = rows.select("conv_id", "turn", F.explode(chosen).alias("p"))
        size = F.length("p.piece").alias("size")
        return listed.select("conv_id", "turn", "p.level", F.md5("p.passage").alias("passage"), F.md5("p.piece").alias("hash"), size)

    quotes = durable(spread(base.where(answering), lambda level: level > 0).distinct())
    # Only pieces that somebody quotes are looked for, each by its hash within its conversation.
    asked = small_side(durable(quotes.select("conv_id").distinct()))
    sources = base.where(placed).join(asked, "conv_id", "left_semi")
    said = spread(sources, lambda level: level == 0).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    found = quotes.join(said, ["conv_id", "hash"]).where(F.col("source") < F.col("turn"))
    longest = F.max(F.struct("size", (-F.col("source")).alias("early"), "source"))["source"].alias("source")
    origins = found.groupBy("conv_id", "turn", "level", "passage").agg(longest)
    answer = F.max(F.struct((-F.col("level")).alias("near"), "source"))["source"]
    links = durable(origins.groupBy("conv_id", "turn").agg(answer.alias("reply_to"), F.countDistinct("passage").alias("linked")))
    counts = quotes.groupBy("conv_id", "turn").agg(F.countDistinct("passage").alias("quotes"))

    keys = ["conv_id", "turn"]
    answers = base.where(answering).join(counts, keys, "left").join(links, keys, "left").join(_threads(links), keys, "left")
    others = base.where(~answering)
    joined = answers.unionByName(others, allowMissingColumns=True)
    return joined.select(
        "conv_id",
        "turn",
        "role",
        unquoted(F.col("text")).alias("text"),
        "reply_to",
        F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("quotes", F.lit(0)).cast("long").alias("quotes"),
        F.coalesce("linked", F.lit(0)).cast("long").alias("linked"),
    ).orderBy("conv_id", "thread", "turn")


def _threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of the answering turns: pointers to the turn answered double their reach each round."""
    reach = links.select("conv_id", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth"))
    while not reach.isEmpty():
        further = reach.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("beyond"), F.col("depth").alias("more"))
        stepped = durable(
            reach.join(further, ["conv_id", "thread"], "left").select(
                "conv_id",
                "turn",
                F.coalesce("beyond", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("beyond").isNotNull().alias("moved"),
            )
        )
        reach = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            break
    return reach


ORACLE_SQL = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, translate(coalesce(text, ''), chr(1) || chr(2), '  ') AS clean FROM conversations),
split AS (
  SELECT id, conv_id, turn, unnest(list) AS line, generate_subscripts(list, 1) AS place
  FROM (SELECT *, regexp_split_to_array(clean, '\r\n|\r|\n') AS list FROM base)),
lines AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^\s{0,3}((?:>\s?)+)', 1), '[^>]', '', 'g')) AS level,
    regexp_replace(line, '^\s{0,3}((?:>\s?)+)', '') AS body
  FROM split),
begun AS (
  SELECT *, CASE WHEN lag(level) OVER w = level AND trim(lag(body) OVER w) <> '' THEN 0 ELSE 1 END AS begins
  FROM lines WINDOW w AS (PARTITION BY id ORDER BY place)),
numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY id ORDER BY place) AS run FROM begun),
runs AS (
  SELECT id, conv_id, turn, level, string_agg(body, chr(10) ORDER BY place) AS body
  FROM numbered WHERE trim(body) <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY id, conv_id, turn, level, run),
parts AS (
  SELECT conv_id, turn, level, body AS whole, unnest(list_concat([body], string_split(body, chr(10)), string_split(
    regexp_replace(replace(body, chr(10), ' '), '([.!?\x{2026}\x{3002}\x{ff01}\x{ff1f}])\s+', '\1' || chr(1), 'g'), chr(1)))) AS part
  FROM runs),
pieces AS (
  SELECT DISTINCT conv_id, turn, level, trim(regexp_replace(lower(whole), '[^\p{L}\p{N}]+', ' ', 'g')) AS passage,
    trim(regexp_replace(lower(part), '[^\p{L}\p{N}]+', ' ', 'g')) AS piece
  FROM parts),
quotes AS (SELECT * FROM pieces WHERE level > 0 AND piece <> ''),
said AS (SELECT conv_id, piece, min(turn) AS source FROM pieces WHERE level = 0 GROUP BY conv_id, piece),
origins AS (
  SELECT conv_id, quotes.turn, level, passage, source FROM quotes JOIN said USING (conv_id, piece) WHERE source < quotes.turn
  QUALIFY row_number() OVER (PARTITION BY conv_id, quotes.turn, level, passage ORDER BY length(piece) DESC, source) = 1),
links AS (
  SELECT conv_id, turn, arg_min(source, (level, -source)) AS reply_to, count(DISTINCT passage) AS linked FROM origins GROUP BY conv_id, turn),
counts AS (SELECT conv_id, turn, count(DISTINCT passage) AS quotes FROM quotes GROUP BY conv_id, turn),
reach AS (
  SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links
  UNION ALL
  SELECT reach.conv_id, reach.turn, links.reply_to, depth + 1 FROM reach JOIN links ON links.conv_id = reach.conv_id AND links.turn = reach.thread),
threads AS (
  SELECT * FROM reach QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY depth DESC) = 1),
said_before AS (
  SELECT *, regexp_matches(body,
      '(?i)^\s*(on\b.*\bwrote|.{1,80}\b(wrote|writes|said)|le\b.*a écrit|am\b.*schrieb|el\b.*escribió)\s*:\s*$')
    AND coalesce(lead(level) OVER (PARTITION BY id ORDER BY place), 0) > 0 AS announces
  FROM lines),
texts AS (
  SELECT id, max(level) > 0 AS quoting,
    trim(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (WHERE level = 0 AND NOT announces), ''), '\n{3,}', chr(10) || chr(10), 'g'),
         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
  FROM said_before GROUP BY id)
SELECT base.conv_id, base.turn, role, text, reply_to, coalesce(thread, base.turn) AS thread, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
  CAST(coalesce(quotes, 0) AS BIGINT) AS quotes, CAST(coalesce(linked, 0) AS BIGINT) AS linked
FROM base JOIN texts USING (id)
LEFT JOIN links ON quoting AND links.conv_id = base.conv_id AND links.turn = base.turn
LEFT JOIN counts ON quoting AND counts.conv_id = base.conv_id AND counts.turn = base.turn
LEFT JOIN threads ON quoting AND threads.conv_id = base.conv_id AND threads.turn = base.turn
"""
