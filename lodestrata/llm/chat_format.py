"""Chat formatting after collapsing cumulative snapshots.

A chat service that logs a conversation after every turn leaves each state of
it as a conversation of its own. Rolling turn-prefix hashes find them: the hash
of the first n turns is the hash of (hash of the first n - 1 turns, role,
text), so a conversation is a snapshot of a longer one exactly when its last
hash is an inner hash of another. An anti-join against all inner hashes leaves
the maximal conversations, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Turns that are hashed as one chunk, so that a long conversation's chain isn't copied turn by turn.
CHUNK_TURNS = 256


def _bodies(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, body): body holds the distinct turns in order; key is never null."""
    turns = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        "conv_id",
        F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("line"),
    )
    # A turn that is only logged twice is one turn, so that a replayed log line doesn't change the prefix.
    return turns.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_set("line")).alias("body"))


def _chains(bodies: DataFrame) -> DataFrame:
    """(key, conv_id, chain): chain holds the hash of each prefix of the turns."""
    digest = "sha2(concat(s.last, ':', octet_length(t.role), ':', t.role, ':', t.text), 256)"
    nothing = "cast(array() as array<string>)"
    step = f"(s, t) -> transform(array({digest}), h -> named_struct('last', h, 'all', array_append(s.all, h)))[0]"
    chunk = f"aggregate(c, named_struct('last', p.last, 'all', {nothing}), {step})"
    chunks = f"transform(sequence(0, (size(body) - 1) div {CHUNK_TURNS}), i -> slice(body, i * {CHUNK_TURNS} + 1, {CHUNK_TURNS}))"
    joined = f"(p, c) -> transform(array({chunk}), r -> named_struct('last', r.last, 'parts', array_append(p.parts, r.all)))[0]"
    chain = f"flatten(aggregate({chunks}, named_struct('last', '', 'parts', cast(array() as array<array<string>>)), {joined}).parts)"
    return bodies.select("key", "conv_id", F.expr(f"transform({chain}, h -> unhex(h))").alias("chain"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_merged, rendered.

    conversations has conv_id, turn, role, text; other columns are not read.
    Turns are ordered by turn (null first), then role and text; equal rows of a
    conversation count once; a null role is "user" and a null text is empty. Of
    conversations with the same turns the smallest conv_id stays (null last).
    n_merged counts the conversations with the same turns, itself included.
    Rows with a null conv_id form one conversation. No rows give no rows. Texts
    are rendered as they are: a marker inside one is not escaped.

    Only hashes and ids take part in the anti-join; what it leaves meets its
    turns where they were gathered, and is rendered there. A conversation is
    one value in the result, so it has to fit in a task.
    """
    bodies = _bodies(conversations)
    chained = _chains(bodies)
    whole = chained.select("key", "conv_id", F.size("chain").cast("long").alias("n_turns"), F.element_at("chain", -1).alias("last"))
    # The chain is part of the hash, so a prefix of n turns only meets conversations of n turns.
    inner = chained.select(F.explode(F.expr("slice(chain, 1, size(chain) - 1)")).alias("last")).distinct()
    first = F.min(F.struct(F.col("conv_id").isNull(), "conv_id", "key")).alias("first")
    maximal = whole.groupBy("last", "n_turns").agg(F.count("*").alias("n_merged"), first).join(inner, "last", "left_anti")
    lines = F.transform("body", lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")))
    return bodies.join(maximal.select(F.col("first.key").alias("key"), "n_turns", "n_merged"), "key").select("conv_id", "n_turns", "n_merged", F.concat_ws("", lines).alias("rendered"))


ORACLE_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations),
whole AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, text) AS body,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered
  FROM turns GROUP BY conv_id),
inner_prefixes AS (SELECT DISTINCT body[1:n] AS body FROM (SELECT body, unnest(range(1, len(body))) AS n FROM whole)),
merged AS (
  SELECT min(conv_id) AS conv_id, CAST(len(body) AS BIGINT) AS n_turns, CAST(count(*) AS BIGINT) AS n_merged, any_value(rendered) AS rendered, body
  FROM whole GROUP BY body)
SELECT conv_id, n_turns, n_merged, rendered FROM merged WHERE body NOT IN (SELECT body FROM inner_prefixes)
"""
