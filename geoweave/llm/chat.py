"""Chat formatting with tool-call linking (DataFrame functions only).

Calls and results meet in hash joins on (conversation, call id); a result follows its call in topological order even
where the log has it earlier.  Arguments are validated against the tools' schemas, and every event becomes one
canonical JSON object: keys in order, no white space, absent values left out.  Rows stay one event each, so a very long
conversation is never one group; ``anchor, level, turn, seq`` sort it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Argument types and the variant types that satisfy them.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"],
         "object": ["OBJECT"], "array": ["ARRAY"]}


def problems(tool: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted array of what is wrong with a call: unknown tool, arguments that are no JSON object, missing, mistyped or unknown fields.

    ``schemas``: tool -> field -> (type, required).
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    none = F.array().cast("array<string>")
    out = F.array(F.lit("unknown tool"))
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            part = F.try_variant_get(value, f"$.{field}", "variant")
            found = F.regexp_extract(F.schema_of_variant(part), "^[A-Z]+", 0)
            absent = F.coalesce(F.schema_of_variant(part), F.lit("VOID")) == "VOID"
            checks.append(F.when(absent, F.lit(f"missing {field}") if required else F.lit(None).cast("string"))
                          .when(~found.isin(KINDS[kind]), F.lit(f"mistyped {field}")))
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(arguments), none),
                                                        F.array(*[F.lit(x) for x in fields]) if fields else none)),
                            lambda k: F.concat(F.lit("unknown "), k))
        wrong = F.array_sort(F.concat(F.array_compact(F.array(*checks)) if checks else none, extra))
        out = F.when(tool == name, F.when(is_object, wrong).otherwise(F.array(F.lit("not an object")))).otherwise(out)
    return out


def canonical(**fields: Column) -> Column:
    """Canonical JSON object of the given columns; nulls are left out, a variant column nests with its keys in order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]],
               messages: DataFrame | None = None) -> DataFrame:
    """One row per event with ``conv_id, turn, seq, kind, call_id, status, problems, anchor, level, json``.

    ``calls``: ``conv_id, turn, seq, call_id, tool, arguments`` (JSON text); ``results``: ``conv_id, turn, seq, call_id, content``;
    ``messages``: ``conv_id, turn, seq, role, content`` of turns that neither call nor answer, status ``plain``.
    The earliest call of an id (turn, then seq) is linked with the id's earliest result: status ``linked``, alone ``pending`` or ``orphan``, later ones
    of the same id ``repeated``; repeated rows that tie for the first place share its status.  A null conversation or call id links nothing.
    Events sort by ``anchor`` (own turn, or the call's if that is later), ``level`` (1 for linked results), turn and seq: a
    topological order, as a result depends on its call alone.
    """
    key = ["conv_id", "call_id"]
    first = lambda df, name: df.where("conv_id is not null and call_id is not null").groupBy(*key).agg(
        F.min(F.struct("turn", "seq")).alias(name))
    pairs = first(calls, "call").join(first(results, "result"), key, "full")

    def status(df: DataFrame, own: str, other: str, alone: str) -> DataFrame:
        return (df.join(pairs, key, "left").withColumn("status", F.when(F.col(own).isNull(), F.lit(alone))
                .when(F.struct("turn", "seq") != F.col(own), F.lit("repeated"))
                .when(F.col(other).isNull(), F.lit(alone)).otherwise(F.lit("linked"))))

    wrong = problems(F.col("tool"), F.col("arguments"), schemas)
    made = (status(calls, "call", "result", "pending").withColumn("problems", wrong)
            .select(*key, "turn", "seq", F.lit("call").alias("kind"), "status", "problems", F.col("turn").alias("anchor"),
                    F.lit(0).alias("level"),
                    canonical(arguments=F.try_parse_json("arguments"), call_id=F.col("call_id"), kind=F.lit("call"),
                              status=F.col("status"), tool=F.col("tool"), valid=F.size("problems") == 0).alias("json")))
    linked = F.col("status") == "linked"
    given = (status(results, "result", "call", "orphan")
             .select(*key, "turn", "seq", F.lit("result").alias("kind"), "status", F.array().cast("array<string>").alias("problems"),
                     F.when(linked, F.greatest("turn", "call.turn")).otherwise(F.col("turn")).alias("anchor"),
                     linked.cast("int").alias("level"),
                     canonical(call_id=F.col("call_id"), content=F.col("content"), kind=F.lit("result"),
                               status=F.col("status")).alias("json")))
    out = made.unionByName(given)
    if messages is None:
        return out
    none = F.lit(None).cast("string")
    return out.unionByName(messages.select(
        "conv_id", none.alias("call_id"), "turn", "seq", F.lit("message").alias("kind"), F.lit("plain").alias("status"),
        F.array().cast("array<string>").alias("problems"), F.col("turn").alias("anchor"), F.lit(0).alias("level"),
        canonical(content=F.col("content"), kind=F.lit("message"), role=F.col("role")).alias("json")))


#: Schema of the one tool of plain conversations: answering a user's turn.
REPLY = {"reply": {"text": ("string", True), "words": ("integer", True)}}


def conversation_events(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages of plain conversations: a user's turn calls ``reply``, the assistant's next turn is its result.

    The call id names the conversation and the user's turn; turns of other roles, or of none, are messages; a null text makes an absent
    argument.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text",
                                F.lit(0).alias("seq"))
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), turn)
    words = F.size(F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != ""))
    calls = rows.where("role = 'user'").select(
        "conv_id", "turn", "seq", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("tool"),
        F.to_json(F.struct("text", F.when(F.col("text").isNotNull(), words).alias("words"))).alias("arguments"))
    results = rows.where("role = 'assistant'").select(
        "conv_id", "turn", "seq", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    others = rows.where("coalesce(role, '') not in ('user', 'assistant')").select(
        "conv_id", "turn", "seq", "role", F.col("text").alias("content"))
    return calls, results, others
