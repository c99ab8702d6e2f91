"""The workspace's log against a plain fold."""

import random

from veinwork.operators import workspace as W

LOG = "seq bigint, at bigint, kind string, user_id bigint, project_id bigint, talk_id bigint, text string"


def folded(log):
    """One event after the other."""
    projects, talks, ever, made = {}, {}, set(), set()
    for seq, at, kind, user, project, talk, text in sorted(log):
        p = projects.get(project)
        if kind == "create_project":
            if project is not None and project not in made:
                made.add(project)
                projects[project] = {"user": user, "name": (text or "").strip(), "created": at, "updated": at}
            continue
        if p is None or p["user"] != user:
            continue
        key = user, talk
        t = talks.get(key)
        if kind == "update_project":
            p.update(name=(text or "").strip(), updated=at)
        elif kind == "delete_project":
            del projects[project]
            talks = {k: v for k, v in talks.items() if v["project"] != project}
        elif talk is None:
            continue
        elif kind == "create_talk" and key not in ever:
            ever.add(key)
            talks[key] = {"project": project, "title": (text or "").strip(), "created": at, "updated": at, "n": 0}
            p["updated"] = at
        elif kind == "move_talk" and t and t["project"] != project:
            projects[t["project"]]["updated"] = p["updated"] = t["updated"] = at
            t["project"] = project
        elif kind == "append" and t and t["project"] == project:
            t["n"] += 1
            p["updated"] = t["updated"] = at
    return projects, talks


def test_workspace_log(spark):
    rng = random.Random(3)
    kinds = ["create_project"] * 3 + ["update_project", "delete_project"] + ["create_talk"] * 3 + ["move_talk"] * 5 + ["append"] * 8
    log = []
    for seq in range(4000):  # many small workspaces, some events of another user's, some without ids
        user = rng.randrange(60)
        log.append((seq, seq * 10, rng.choice(kinds), user + (rng.random() < 0.05), rng.choice([None, *[user * 10 + k for k in range(3)] * 9]), rng.choice([None, *[user * 10 + k for k in range(3)] * 9]), rng.choice([None, "", " a ", "b"])))
    shuffled = log[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, LOG)
    lives = W.project_lives(df)
    spans = W.talk_spans(df, lives)
    messages = W.talk_messages(df, spans)
    projects, talks = folded(log)
    assert len(projects) > 40 and len(talks) > 40 and sum(t["n"] for t in talks.values()) > 60
    got = {(r["user_id"], r["talk_id"]): {"project": r["project_id"], "title": r["title"], "created": r["created_at"], "updated": r["updated_at"], "n": r["n_messages"]} for r in W.talks(spans, messages).collect()}
    assert got == talks
    got = {r["project_id"]: {"user": r["user_id"], "name": r["name"], "created": r["created_at"], "updated": r["updated_at"]} for r in W.projects(df, lives, spans, messages).collect()}
    assert got == projects


def test_empty_log(spark):
    df = spark.createDataFrame([], LOG)
    lives = W.project_lives(df)
    spans = W.talk_spans(df, lives)
    messages = W.talk_messages(df, spans)
    assert W.talks(spans, messages).collect() == W.projects(df, lives, spans, messages).collect() == []


def test_pinned_first(spark):
    rows = [(1, 10, 5), (1, 11, 9), (1, 12, 5), (2, 20, 1)]
    from pyspark.sql import functions as F

    got = W.pinned_order(spark.createDataFrame(rows, "user_id bigint, project_id bigint, updated_at bigint"), F.col("project_id") == 12).collect()
    assert {r["project_id"]: r["rank"] for r in got} == {12: 1, 11: 2, 10: 3, 20: 1}
