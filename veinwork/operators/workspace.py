"""Workspaces: projects, conversations, messages, invite codes, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veinwork.functions.text import blank, filled, strip


def flattened(users: DataFrame) -> DataFrame:
    """Rows of messages out of (projects array<struct<id, conversations array<struct<id, messages array<struct>>>>>)."""
    projects = users.select(F.explode_outer("projects").alias("p"))
    talks = projects.select(F.col("p.id").alias("project_id"), F.explode_outer("p.conversations").alias("c"))
    return talks.select("project_id", F.col("c.id").alias("conversation_id"), F.posexplode_outer("c.messages").alias("pos", "message"))


def history(messages: DataFrame, most: int = 50, characters: int = 80) -> DataFrame:
    """(conv_id, n_messages, n_user, last_turn, title): a row for each conversation, the one with the latest turn first."""
    got = messages.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("turn").alias("last_turn"),
        F.substring(strip(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))), 1, characters).alias("title"),
    )
    return got.orderBy(F.desc("last_turn"), "conv_id").limit(most)


def project_summary(messages: DataFrame, project: Column) -> DataFrame:
    """(project_id, n_conversations, n_messages, n_chars)."""
    return messages.withColumn("project_id", project).groupBy("project_id").agg(F.count_distinct("conv_id").alias("n_conversations"), F.count("*").alias("n_messages"), F.sum(F.length(filled(F.col("text")))).alias("n_chars"))


def last_active(projects: DataFrame, conversations: DataFrame) -> DataFrame:
    """(project_id, last_active): the latest of the project's own time and its conversations'."""
    own = conversations.groupBy("project_id").agg(F.max("updated_at").alias("_latest"))
    return projects.join(own, "project_id", "left").select("project_id", F.greatest("updated_at", "_latest").alias("last_active"))


def find(rows: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows whose text holds every word of the query, whatever the case."""
    for word in query.lower().split():
        rows = rows.where(F.contains(F.lower(filled(text)), F.lit(word)))
    return rows


def split_codes(pasted: Column) -> Column:
    return F.array_distinct(F.filter(F.split(filled(pasted), r"[\s,，;；]+"), lambda t: t != ""))


def import_codes(codes: DataFrame, known: DataFrame) -> DataFrame:
    """The codes that are new: in upper case, without repeats, blanks and those known."""
    fresh = codes.select(F.upper(strip(F.col("code"))).alias("code")).where(~blank(F.col("code"))).distinct()
    return fresh.join(known.select("code"), "code", "left_anti")


def import_counts(codes: DataFrame, known: DataFrame) -> DataFrame:
    """(given, imported, skipped)."""
    given = codes.select(F.upper(strip(F.col("code"))).alias("code")).where(~blank(F.col("code")))
    marked = given.groupBy("code").agg(F.count("*").alias("n")).join(known.select("code", F.lit(1).alias("old")), "code", "left")
    return marked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("given"), F.count_if(F.col("old").isNull()).alias("imported"), (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(F.col("old").isNull())).alias("skipped"))


def code_stats(codes: DataFrame) -> DataFrame:
    """(total, active, used)."""
    return codes.agg(F.count("*").alias("total"), F.count_if(F.col("active")).alias("active"), F.count_if(~blank(F.col("used_by"))).alias("used"))


def use_code(codes: DataFrame, code: str, user: str, now: int) -> DataFrame:
    """The codes with one used up, if it is active and unused."""
    hit = (F.col("code") == code) & F.col("active") & blank(F.col("used_by"))
    return codes.withColumns({"active": F.col("active") & ~hit, "used_by": F.when(hit, user).otherwise(F.col("used_by")), "used_at": F.when(hit, F.lit(now)).otherwise(F.col("used_at"))})


def active_sessions(touches: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """(user_id, last_access, touches): users whose last access is not older than the time to live."""
    got = touches.groupBy("user_id").agg(F.max("ts").alias("last_access"), F.count("*").alias("touches"))
    return got.where(F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("last_access").cast("timestamp")) <= ttl_seconds)


def latest_state(events: DataFrame, key: list[str], at: str) -> DataFrame:
    """Event-sourced rows: the last event of each key; keys whose last event is a deletion go. Needs ``deleted``."""
    rest = [c for c in events.columns if c not in (*key, at)]
    got = events.groupBy(*key).agg(F.max(F.col(at)).alias(at), F.max_by(F.struct(*rest), F.col(at)).alias("_row"))
    return got.select(*key, at, "_row.*").where(~F.coalesce("deleted", F.lit(False)))


def project_lives(log: DataFrame) -> DataFrame:
    """(project_id, user_id, name, created_at, born, dead) of every project that the log creates: its owner and the places in the log at which it begins and, unless null, ends.

    The log has (seq, at, kind, user_id, project_id, talk_id, text), where seq is the order. A project is created once; only its owner deletes it."""
    made = log.where("kind = 'create_project' and project_id is not null").groupBy("project_id").agg(F.min_by(F.struct("user_id", strip(F.col("text")).alias("name"), F.col("at").alias("created_at"), F.col("seq").alias("born")), "seq").alias("p")).select("project_id", "p.*")
    gone = log.where("kind = 'delete_project'").join(made, ["project_id", "user_id"]).where("seq > born").groupBy("project_id").agg(F.min("seq").alias("dead"))
    return made.join(gone, "project_id", "left")


def _alive(log: DataFrame, lives: DataFrame) -> DataFrame:
    """The events that name a project of the same user's which is there at the time."""
    return log.join(lives.select("project_id", "user_id", "born", "dead"), ["project_id", "user_id"]).where("seq > born and (dead is null or seq < dead)")


def talk_spans(log: DataFrame, lives: DataFrame) -> DataFrame:
    """(user_id, talk_id, project_id, source, seq, at, until, dead, title): where a conversation stands from one place in the log to another; ``source`` is the project it comes from, null when it is made.

    A conversation is made once, in a living project, and moves to living projects of the same user; it ends with the project that it stands in, and nothing brings it back.
    All of this is running values over one sort by conversation, so a long history is streamed and never held."""
    order = Window.partitionBy("user_id", "talk_id").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = _alive(log.where("kind in ('create_talk', 'move_talk') and talk_id is not null"), lives).withColumn("makes", F.col("kind") == "create_talk")
    made = steps.withColumn("n", F.count_if("makes").over(so_far)).where("n >= 1 and (not makes or n = 1)")
    held = made.withColumns({"source": F.lag("project_id").over(order), "broken": F.coalesce(F.lag("dead").over(order) < F.col("seq"), F.lit(False))})
    kept = held.withColumn("broken", F.max("broken").over(so_far)).where("not broken and (makes or source <> project_id)")
    return kept.select("user_id", "talk_id", "project_id", "source", "seq", "at", F.least(F.lead("seq").over(order), "dead").alias("until"), "dead", F.when(F.col("makes"), strip(F.col("text"))).alias("title"))


def talk_messages(log: DataFrame, spans: DataFrame) -> DataFrame:
    """(user_id, talk_id, project_id, seq, at, text): the messages appended to a conversation through the project in which it stands at the time; the others are refused."""
    places = spans.select("user_id", "talk_id", "project_id", F.col("seq").alias("_from"), "until")
    got = log.where("kind = 'append'").join(places, ["user_id", "talk_id", "project_id"]).where("seq > _from and (until is null or seq < until)")
    return got.select("user_id", "talk_id", "project_id", "seq", "at", strip(F.col("text")).alias("text"))


def talks(spans: DataFrame, messages: DataFrame) -> DataFrame:
    """(user_id, talk_id, project_id, title, created_at, updated_at, n_messages): the conversations that are left. Moves and messages change updated_at."""
    spans = spans.select("user_id", "talk_id", "project_id", "seq", "at", "dead", "title", F.lit(0).alias("said"))
    said = messages.select("user_id", "talk_id", *(F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in ("project_id", "seq")), "at", *(F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in ("dead", "title")), F.lit(1).alias("said"))
    got = spans.unionByName(said).groupBy("user_id", "talk_id").agg(
        F.max_by(F.struct("project_id", "dead"), "seq").alias("_last"), F.max("title").alias("title"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.sum("said").alias("n_messages"),
    )
    return got.where("_last.dead is null").select("user_id", "talk_id", "_last.project_id", "title", "created_at", "updated_at", "n_messages")


def projects(log: DataFrame, lives: DataFrame, spans: DataFrame, messages: DataFrame) -> DataFrame:
    """(user_id, project_id, name, created_at, updated_at): the projects that are left. Renaming, conversations made or moved (in both projects) and messages change updated_at."""
    renamed = _alive(log.where("kind = 'update_project'"), lives).select("project_id", "at", "seq", strip(F.col("text")).alias("name"))
    none = [F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("name")]
    touched = renamed.unionByName(spans.select("project_id", "at", *none)).unionByName(spans.where("source is not null").select(F.col("source").alias("project_id"), "at", *none)).unionByName(messages.select("project_id", "at", *none))
    last = touched.groupBy("project_id").agg(F.max("at").alias("_at"), F.max_by("name", "seq").alias("_name"))
    return lives.where("dead is null").join(last, "project_id", "left").select("user_id", "project_id", F.coalesce("_name", "name").alias("name"), "created_at", F.greatest("created_at", "_at").alias("updated_at"))


def pinned_order(projects: DataFrame, pinned: Column) -> DataFrame:
    """The projects with ``rank``: a user's pinned ones first, then those changed last, ties by number."""
    order = Window.partitionBy("user_id").orderBy(F.desc(F.coalesce(pinned, F.lit(False))), F.desc("updated_at"), "project_id")
    return projects.withColumn("rank", F.row_number().over(order))


def upsert(table: DataFrame, changes: DataFrame, key: list[str], at: str | None = None) -> DataFrame:
    """The table with the changed rows in place of those with the same key. Of several changes of one key the last by ``at`` counts, or without it the greatest by all columns in order."""
    rest = [c for c in changes.columns if c not in key]
    order = F.struct(*([at] if at else []), *rest)
    one = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*") if rest else changes.distinct()
    return table.join(one.select(*key), key, "left_anti").unionByName(one)


def owned(projects: DataFrame, users: DataFrame) -> DataFrame:
    """Projects with their owner's name; those without an owner stay."""
    return projects.join(users.select(F.col("id").alias("owner_user_id"), "username"), "owner_user_id", "left")


def legacy_hash(password: Column) -> Column:
    return F.sha2(filled(password), 256)
