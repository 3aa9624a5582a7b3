"""Pages and windows of conversations and of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns of a user that stay as they are, and how many turns there are between summaries of what is older.
RECENT_TURNS, SUMMARY_EVERY = 3, 3


def pages_before(messages: DataFrame, cursors: DataFrame, size: int = 3) -> DataFrame:
    """For each cursor (user_id, before) the user's newest size messages before the message of that id; with before null, the newest of all.

    The message is looked up among the user's own: another's id, or one that
    isn't there, gives no page. Times and ids are compared in their own types,
    times first. Of a user with a long history each task passes on no more
    than size messages. A user's second cursor, if there is one, counts as well.
    """
    asked = cursors.select("user_id", F.col("before").alias("_before")).distinct()
    marks = messages.select("user_id", F.col("id").alias("_before"), F.struct("created", "id").alias("_mark"))
    placed = asked.join(marks, ["user_id", "_before"], "left").filter(F.col("_before").isNull() | F.col("_mark").isNotNull())
    older = messages.join(placed, "user_id").filter(F.col("_mark").isNull() | (F.struct("created", "id") < F.col("_mark")))
    newest = W.partitionBy("user_id", "_before").orderBy(F.desc("created"), F.desc("id"))
    page = older.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= max(0, size))
    return page.withColumnRenamed("_before", "before").drop("_mark", "_n").orderBy("user_id", "before", "created", "id")


def page_before(messages: DataFrame, user_id, before=None, size: int = 3) -> DataFrame:
    """The newest size messages of a user before the one of that id, or of all without one; the oldest of them first. See pages_before()."""
    own = messages.filter(F.col("user_id") == user_id)
    if before is not None:
        # An id is one row's, so this is one row at most.
        mark = own.filter(F.col("id") == before).select("user_id", F.struct("created", "id").alias("_mark")).limit(1)
        own = own.join(F.broadcast(mark), "user_id").filter(F.struct("created", "id") < F.col("_mark")).drop("_mark")
    return own.orderBy(F.desc("created"), F.desc("id")).limit(max(0, size)).orderBy("created", "id")


def history(messages: DataFrame) -> DataFrame:
    """All messages of each user, the oldest first: what paging backwards to the start would give."""
    return messages.orderBy("user_id", "created", "id")


def _openers(messages: DataFrame, turns: int) -> DataFrame:
    """(user_id, _turns, _from) of each user who has turns: how many, but at most as many as asked for, and the message that opens the first of these last ones.

    Only the users' own messages are read, and of a user's no task passes on more than that many.
    """
    own = messages.filter(F.col("role") == "user").select("user_id", F.struct("created", "id").alias("_at"))
    newest = W.partitionBy("user_id").orderBy(F.desc("_at"))
    last = own.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= turns)
    return last.groupBy("user_id").agg(F.count("*").alias("_turns"), F.min("_at").alias("_from"))


def recent_turns(messages: DataFrame, turns: int) -> DataFrame:
    """Each user's last messages back to the one that opens the turns-th last turn; all of those who have fewer turns."""
    if turns < 1:
        return messages.limit(0)
    met = messages.join(_openers(messages, turns), "user_id", "left")
    few = F.coalesce("_turns", F.lit(0)) < turns
    return met.filter(few | (F.struct("created", "id") >= F.col("_from"))).select(*messages.columns)


def older_than_recent(messages: DataFrame, turns: int = RECENT_TURNS, every: int = 1) -> DataFrame:
    """For each user how many messages lie before the last turns, and the last of them: what is to be summed up.

    Users with no more than that many turns have none, nor do those whose
    number of turns isn't a multiple of every.
    """
    said = messages.filter(F.col("role") == "user").groupBy("user_id").agg(F.count("*").alias("_said"))
    due = said.filter((F.col("_said") > turns) & (F.col("_said") % every == 0)).join(_openers(messages, turns), "user_id", "left")
    met = messages.select("user_id", "created", "id").join(due, "user_id")
    old = met.filter(F.col("_from").isNull() | (F.struct("created", "id") < F.col("_from")))
    return old.groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("id", F.struct("created", "id")).alias("through"))


def assembled(deltas: DataFrame, key: str, order: str, part: str) -> DataFrame:
    """The parts of each key in order, joined."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x[part]), "")
    return deltas.groupBy(key).agg(whole.alias("text"))


def assembled_calls(deltas: DataFrame, key: str, order: str) -> DataFrame:
    """(key, index, id, name, arguments, whole): tool calls of each key from their parts.

    Parts have order, index, id, name and arguments. The last id and name that
    aren't empty count, arguments are joined in order; whole says whether there
    is an id and a name.
    """
    last = lambda c: F.coalesce(F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))), F.lit("")).alias(c)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "arguments"))), lambda x: F.coalesce(x["arguments"], F.lit(""))), "")
    calls = deltas.groupBy(key, "index").agg(last("id"), last("name"), joined.alias("arguments"))
    return calls.withColumn("whole", (F.col("id") != "") & (F.col("name") != ""))


def after(log: DataFrame, cursor: int, kinds: list[str] | None = None) -> DataFrame:
    """Rows of the log with a larger id, of known kinds only."""
    found = log.filter(F.col("id") > cursor)
    return found.filter(F.col("kind").isin(kinds)) if kinds else found
