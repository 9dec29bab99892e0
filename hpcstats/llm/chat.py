"""Chat formatting from an event log (DataFrame functions only).

Conversations arrive as events: streamed ``delta`` pieces of a message, an
``edit`` that replaces what a message said so far, a ``regenerate`` that throws
it away, each with its conversation, turn and sequence number.  The log is
partitioned by conversation and message, sorted by sequence and folded into
final messages; the messages of a conversation are rendered with a template
into one string, together with the spans under the loss mask (the assistant's
texts).

Template: ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline per turn.
Control strings inside a text get a backslash after their first character (one
more, if there are some already), so the reader tells them from real ones and
takes exactly that backslash away again.  Roles have backslashes and line ends
escaped, as the role is a line of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hpcstats.llm.shared import with_columns

# What the supported chat templates use as control strings, less the first character.
TAILS = r"(?=\/?s>|\/?INST\]|<\/?SYS>>|\|)"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PIECE = 256
SELF_TEST_ID = -7
SELF_TEST_TEXT = "</s>[INST] ok [/INST]"


def escape(text):
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAILS, r"$1\\$2")


def unescape(text):
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAILS, r"$1$2")


def escape_role(role):
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role):
    # line ends first, but not those whose backslash is itself escaped
    return F.replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), F.lit("\\\\"), F.lit("\\"))


def final_messages(events: DataFrame) -> DataFrame:
    """Fold events (conv_id, turn, message, seq, kind, role, text) into (conv_id, turn, message, role, text).

    ``message`` tells messages of the same turn apart.  Pieces are sorted by
    (seq, kind, text), so ties fold alike in every run.  The text of a message
    is its last ``edit`` (or nothing after a ``regenerate``) plus the deltas
    behind it; NULL texts are empty, and a kind that is not one of the three
    counts as a delta.  The role is that of the first event.
    """
    row = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    logs = events.groupBy("conv_id", "turn", "message").agg(F.sort_array(F.collect_list(row)).alias("log"))
    # everything before the last reset is history
    last = F.expr("coalesce(array_max(transform(log, (e, i) -> if(e.kind in ('edit', 'regenerate'), i, -1))), -1)")
    kept = F.expr("filter(log, (e, i) -> i >= last and not (e.kind <=> 'regenerate'))")
    return logs.withColumn("last", last).select(
        "conv_id", "turn", "message", F.expr("log[0].role").alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """Render (conv_id, turn, message, role, text) to conv_id, formatted, loss_starts, loss_lengths.

    Spans count code points from 0.  Messages are ordered by (turn, message).
    A NULL conversation id is a conversation of its own; conversations without
    messages do not exist, so an empty table gives no rows.
    """
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "message", "role", "text"))).alias("turns"))
    parts = F.transform("turns", lambda m: F.struct(
        F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"),
        (m["role"] == "assistant").alias("loss")))
    tail = CLOSE + "\n"
    sized = F.transform("parts", lambda p: F.struct(
        (F.length(p["head"])).alias("head"), F.length(p["body"]).alias("body"), p["loss"].alias("loss")))
    # running starts: a fold over the lengths
    spans = F.expr(f"""
      aggregate(sized, named_struct('at', 0L, 'starts', cast(array() as array<bigint>), 'lengths', cast(array() as array<bigint>)),
        (s, p) -> named_struct('at', s.at + p.head + p.body + {len(tail)}L,
          'starts', if(p.loss, concat(s.starts, array(s.at + p.head)), s.starts),
          'lengths', if(p.loss, concat(s.lengths, array(cast(p.body as bigint))), s.lengths)))""")
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return (turns.select("conv_id", parts.alias("parts")).select("conv_id", text.alias("formatted"), sized.alias("sized"))
            .select("conv_id", "formatted", spans.alias("spans"))
            .select("conv_id", "formatted", F.col("spans.starts").alias("loss_starts"), F.col("spans.lengths").alias("loss_lengths")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse rendered strings: conv_id, turns (role, text), loss_texts (unescaped), formatted_chars."""
    tail = CLOSE + "\n"
    pieces = F.expr(f"slice(split(formatted, '{_literal(tail)}'), 1, size(split(formatted, '{_literal(tail)}')) - 1)")
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(p.substr(F.instr(p, "\n") + 1, F.length(p))).alias("text"))
    turns = F.transform(pieces, lambda p: turn(p.substr(F.lit(len(OPEN) + 1), F.length(p))))
    loss = F.transform(F.arrays_zip("loss_starts", "loss_lengths"), lambda z: unescape(
        F.col("formatted").substr((z["loss_starts"] + 1).cast("int"), z["loss_lengths"].cast("int"))))
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"),
                            F.length("formatted").cast("long").alias("formatted_chars"))


def _literal(s: str) -> str:
    """A regular expression for the string itself, inside a SQL literal."""
    return s.replace("|", "[|]").replace("\n", "\\n")


def as_events(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """Whole turns (conv_id, turn, role, text) as a stream of delta events of at most ``piece`` code points.

    Rows of the same conversation and turn stay messages of their own, ordered
    by role and text (a message is named by the text's beginning and its rank
    among the texts that begin alike); equal rows are numbered, so repeats are
    kept.
    """
    rows = with_columns(rows, conv_id="long", turn="long", role="string", text="string").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    begin = F.when(F.length("text") > 64, F.substring("text", 1, 64)).otherwise(F.col("text"))
    alike = Window.partitionBy("conv_id", "turn", "role", "begin").orderBy("text")
    ranked = counted.withColumn("begin", begin).withColumn("place", F.row_number().over(alike))
    single = ranked.select("conv_id", "turn", "role", "text", "begin", "place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    message = F.struct("role", "begin", "place", "copy")
    pieces = F.expr(f"transform(sequence(0, greatest(length(text) - 1, 0) div {piece}), i -> named_struct("
                    f"'seq', cast(i as bigint), 'text', substring(text, i * {piece} + 1, {piece})))")
    return single.select("conv_id", "turn", message.alias("message"), "role", F.explode(pieces).alias("p")).select(
        "conv_id", "turn", "message", "p.seq", F.lit("delta").alias("kind"), "role", F.col("p.text").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    rows = with_columns(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="long", turn="long", role="string", text="string")
    test = spark.range(2).select(F.lit(SELF_TEST_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(SELF_TEST_TEXT).alias("text"))
    read = read_back(format_conversations(final_messages(as_events(rows.unionByName(test)))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


_CONTROLS = r"[<\[]\\*(/?s>|/?INST\]|</?SYS>>|\|)"
ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SELF_TEST_TEXT}'
  UNION ALL SELECT -7, 1, 'assistant', '{SELF_TEST_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({len(OPEN) + 1 + len(CLOSE) + 1} + length(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')) + length(text)
      + len(regexp_extract_all(text, '{_CONTROLS}'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
