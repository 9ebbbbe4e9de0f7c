"""Chat formatting: a state machine over roles and a declarative template.

Turns of a conversation are ordered by turn number (ties: role, then text) and
written with the template's marks; control strings inside texts and roles are
escaped by a backslash after their first character (and every backslash is
doubled), so the output can be read back exactly.  The result holds the
formatted text as segments with a loss flag each.  A state machine over the
roles, given as a table (state, role) -> state, tells whether the turns come
in a permitted order and at which turn they first do not.

DataFrame operations only.  Defined results: null texts and roles are empty
strings; rows of a null conversation id form one conversation; repeated rows
are turns of their own; turn numbers may be null (first) or tie; an invalid
order is flagged, never dropped; an empty table gives no rows; other columns
are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table


def _order() -> dict[str, dict[str, str]]:
    return {
        "start": {"system": "instructed", "user": "asked"},
        "instructed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    }


@dataclass(frozen=True)
class Template:
    """Marks of a turn, the control strings that texts must not show, the roles under the
    loss mask and the machine of permitted orders.  No control string holds a backslash,
    and ``before``, ``between`` and ``after`` each hold one."""

    before: str = "<|"
    between: str = "|>\n"
    after: str = "<|end|>\n"
    controls: tuple[str, ...] = ("<|", "|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    order: dict[str, dict[str, str]] = field(default_factory=_order)
    accepting: tuple[str, ...] = ("asked", "answered")


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _next_state(state: Column, role: Column, template: Template) -> Column:
    out = F.lit("rejected")
    for a, moves in template.order.items():
        for r, b in moves.items():
            out = F.when((state == a) & (role == r), F.lit(b)).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, segments array<struct(text, loss)>, formatted, valid, first_invalid (turn
    from 0, null if valid so far; the number of turns if the last state does not accept)."""
    t = template or Template()
    clean = rows.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # marks and escapes are made row by row, before the turns of a conversation meet
    turns = clean.select(
        "conv_id", F.struct(
            "turn", "role", "text",
            F.concat(F.lit(t.before), escape(F.col("role"), t), F.lit(t.between)).alias("head"),
            escape(F.col("text"), t).alias("body"),
            F.col("role").isin(*t.loss_roles).alias("loss")).alias("turn"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(x["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(x["body"].alias("text"), x["loss"].alias("loss")),
        F.struct(F.lit(t.after).alias("text"), F.lit(False).alias("loss")))))
    # the machine's run over the roles: (state, turns read, first turn refused)
    begin = F.struct(F.lit("start").alias("state"), F.lit(0).alias("read"), F.lit(None).cast("int").alias("refused"))

    def step(a, x):
        state = _next_state(a["state"], x["role"], t)
        return F.struct(state.alias("state"), (a["read"] + 1).alias("read"),
                        F.coalesce(a["refused"], F.when(state == "rejected", a["read"])).alias("refused"))

    states = F.reduce("turns", begin, step)
    ended = F.col("run.state").isin(*t.accepting)
    return (chats.select("conv_id", segments.alias("segments"), states.alias("run"))
            .select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"),
                    ended.alias("valid"),
                    F.coalesce("run.refused", F.when(~ended, F.col("run.read"))).alias("first_invalid")))


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """``formatted`` with turns array<struct(role, text)>, parsed from the formatted text, and
    loss_text: the unescaped text of the segments under the loss mask."""
    t = template or Template()
    pieces = F.split("formatted", "\\Q" + t.after + "\\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def parse(piece):
        cut = F.instr(piece, t.between)
        return F.struct(
            unescape(F.substring(piece, F.lit(len(t.before) + 1), cut - len(t.before) - 1)).alias("role"),
            unescape(F.substring(piece, cut + len(t.between), F.length(piece))).alias("text"))

    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return (formatted.withColumn("turns", F.transform(pieces, parse))
            .withColumn("loss_text", F.array_join(masked, "")))


#: A conversation whose texts hold marks of other templates.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string")
    back = read_back(format_chats(rows.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "first_invalid")


OP2_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), shown AS (
  SELECT *, length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>'))
          + length(replace(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'), '|>', '|\\>')) + 13 AS chars,
    row_number() OVER w - 1 AS seat,
    lag(role) OVER w AS before
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE WHEN before IS NULL THEN role IN ('system', 'user')
                 WHEN before = 'system' THEN role = 'user' AND seat = 1
                 WHEN before = 'user' THEN role = 'assistant'
                 WHEN before = 'assistant' THEN role = 'user' ELSE false END AS fits
  FROM shown
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY seat) AS told,
    coalesce(string_agg(text, '' ORDER BY seat) FILTER (role = 'assistant'), '') AS loss,
    sum(chars) AS chars, min(seat) FILTER (NOT fits) AS refused, arg_max(role, seat) AS final
  FROM judged GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars, refused IS NULL AND final IN ('user', 'assistant') AS valid,
  CAST(coalesce(refused, CASE WHEN final NOT IN ('user', 'assistant') THEN n_turns END) AS INTEGER) AS first_invalid
FROM chats
"""
