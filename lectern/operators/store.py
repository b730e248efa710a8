"""Versioned store: latest rows, hashes, optimistic saves, checkpoints, differences, cascades."""

from __future__ import annotations

import difflib
import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.runtime import folded


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key; equal times go to the greatest row. One aggregation, no sort."""
    rest = [c for c in rows.columns if c not in (key, at)]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("x")).select(key, "x.*").select(*rows.columns)


def canonical_hash(*columns: str) -> Column:
    """sha256 of the JSON of the columns in name order, without blanks and NULLs."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def next_version(versions: DataFrame, key: str, version: str) -> DataFrame:
    return versions.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def changed_versions(rows: DataFrame, key: str, order: list[str], content: str) -> DataFrame:
    """Rows whose content differs from the row before, numbered from 1: equal successive contents make one version."""
    own = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_h", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256))
    kept = marked.withColumn("_p", F.lag("_h").over(own)).where("_p is null or _p <> _h")
    return kept.withColumn("version", F.row_number().over(own)).withColumnRenamed("_h", "content_hash").drop("_p")


def history(actions: DataFrame, minutes: int = 5) -> DataFrame:
    """(document_id, at, action, outcome, revision, head_hash, version, source, version_hash, version_revision): what each action does to a
    document's head, and a row for each version that it writes; without one, version is NULL.

    actions(document_id, at, action, content, base_revision, number): save writes a new head if its base is the current revision (or forced:
    base_revision NULL) and its content another; before it does, the old head becomes a checkpoint version if the last version is older
    than `minutes`. replace (source in content's place is generated) and restore (of version `number`) snapshot the head, write a new one
    and snapshot that. snapshot writes a version of the head. A checkpoint, pre_render or pre_restore version of unchanged content is not
    written again. Everything depends on what was accepted before, so each document is folded in time order.
    """
    quiet = ("checkpoint", "pre_render", "pre_restore")
    start = lambda: {"revision": 0, "head": None, "versions": [], "last": None}

    def version(s: dict, at: object, source: str) -> list[tuple]:
        if s["versions"] and s["versions"][-1] == s["head"] and source in quiet:
            return []
        s["versions"].append(s["head"])
        s["last"] = at
        return [(len(s["versions"]), source, s["head"], s["revision"])]

    def write(s: dict, content: str) -> None:
        s["revision"], s["head"] = s["revision"] + 1, content

    def step(s: dict, r: tuple) -> list[tuple]:
        made: list[tuple] = []
        outcome, base = "done", r.base_revision
        if r.action == "save":
            if s["head"] is None:
                write(s, r.content)
            elif base is not None and base == base and base != s["revision"]:
                outcome = "conflict"
            elif r.content == s["head"]:
                outcome = "unchanged"
            else:
                if s["last"] is None or r.at - s["last"] > pd.Timedelta(minutes=minutes):
                    made = version(s, r.at, "checkpoint")
                write(s, r.content)
        elif r.action == "snapshot":
            outcome = "done" if s["head"] is not None else "no content"
            made = version(s, r.at, "pre_render") if s["head"] is not None else []
        else:
            back = r.action == "restore"
            known = not back or r.number == r.number and r.number is not None and 1 <= r.number <= len(s["versions"])
            if not known:
                outcome = "not found"
            else:
                content = s["versions"][int(r.number) - 1] if back else r.content
                made = version(s, r.at, "pre_restore" if back else "checkpoint") if s["head"] is not None else []
                write(s, content)
                made += version(s, r.at, "restored" if back else "generated")
        sha = lambda x: None if x is None else hashlib.sha256(x.encode()).hexdigest()
        head = (r.document_id, r.at, r.action, outcome, s["revision"], sha(s["head"]))
        return [(*head, n, source, sha(c), float(rev)) for n, source, c, rev in made] or [(*head, None, None, None, None)]

    kind, at = dict(actions.dtypes)["document_id"], dict(actions.dtypes)["at"]
    schema = f"document_id {kind}, at {at}, action string, outcome string, revision long, head_hash string, version double, source string, version_hash string, version_revision double"
    rows = actions.select("document_id", "at", "action", "content", F.col("base_revision").cast("double").alias("base_revision"), F.col("number").cast("double").alias("number"))
    out = folded(rows, "document_id", ["at", "action", "content"], start, step, schema)
    return out.withColumn("version", F.col("version").cast("long")).withColumn("version_revision", F.col("version_revision").cast("long"))


def saves(attempts: DataFrame) -> DataFrame:
    """attempts(document_id, at, base_revision, content, force) with `outcome` (saved, unchanged, conflict) and `revision` after it.

    A save is accepted if its base is the current revision or it is forced; equal content raises no revision. The outcome depends on
    all accepted saves before it, so each document is folded in time order.
    """

    def step(s: dict, r: tuple) -> list[tuple]:
        if not r.force and r.base_revision != s["revision"]:
            outcome = "conflict"
        elif r.content != s["held"]:
            s["revision"], s["held"], outcome = s["revision"] + 1, r.content, "saved"
        else:
            outcome = "unchanged"
        return [(*r, outcome, s["revision"])]

    fields = ", ".join(f"{n} {t}" for n, t in attempts.dtypes)
    return folded(attempts, "document_id", ["at", "base_revision", "content"], lambda: {"revision": 0, "held": None}, step, f"{fields}, outcome string, revision long")


def checkpoints(changes: DataFrame, key: str, at: str, minutes: int = 5, content: str | None = None) -> DataFrame:
    """(key, at) of the changes that become checkpoints: the first of a key, then each that comes more than `minutes` after the last checkpoint
    and, where a content column is named, differs from the content before it. Rows of one time count once."""
    kind = dict(changes.dtypes)[key]
    rows = changes.where(F.col(at).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(at).alias("us"), (F.col(content) if content else F.lit("")).alias("c"))

    def step(s: dict, r: tuple) -> list[tuple]:
        same, s["c"] = bool(content) and r.c == s["c"], r.c
        if same or s["us"] is not None and r.us - s["us"] <= minutes * 60_000_000:
            return []
        s["us"] = r.us
        return [(r.k, r.us)]

    out = folded(rows, "k", ["us", "c"], lambda: {"us": None, "c": object()}, step, f"k {kind}, us long")
    return out.select(F.col("k").alias(key), F.timestamp_micros("us").alias(at))


def versions_of(versions: DataFrame, key: str, number: str) -> DataFrame:
    """All versions, newest first within their document."""
    return versions.orderBy(key, F.desc(number))


def version_at(versions: DataFrame, wanted: DataFrame, key: str, number: str) -> DataFrame:
    """wanted(key, number) with the version's columns; an unknown one has found = false."""
    return wanted.join(versions.withColumn("found", F.lit(True)), [key, number], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def head_versions(versions: DataFrame, heads: DataFrame, key: str, number: str, content_hash: str) -> DataFrame:
    """(key, number, is_head): the newest version of each head's document and whether it holds the head's content; a document without
    versions has number NULL."""
    last = versions.groupBy(key).agg(F.max(F.struct(number, content_hash)).alias("x")).select(key, F.col(f"x.{number}").alias(number), F.col(f"x.{content_hash}").alias("_h"))
    return heads.join(last, key, "left").select(key, number, F.coalesce(F.col("_h") == F.col(content_hash), F.lit(False)).alias("is_head"))


def render_states(renders: DataFrame, heads: DataFrame) -> DataFrame:
    """(document_id, state, render_id): NO_RENDER without a succeeded final rendering, STALE_RENDER if the newest one is not of the head's
    content, else ok. renders(document_id, render_id, kind, status, content_hash, created_at)."""
    final = renders.where("kind = 'final' and status = 'succeeded'")
    last = final.groupBy("document_id").agg(F.max(F.struct("created_at", "render_id", "content_hash")).alias("x"))
    state = F.when(F.col("x").isNull(), "NO_RENDER").when(F.col("x.content_hash") != F.col("content_hash"), "STALE_RENDER").otherwise("ok")
    return heads.select("document_id", "content_hash").join(last, "document_id", "left").select("document_id", state.alias("state"), F.col("x.render_id").alias("render_id"))


def uncached(requests: DataFrame, renders: DataFrame) -> DataFrame:
    """Requests for which no succeeded preview of the same content and settings is kept."""
    kept = renders.where("kind = 'preview' and status = 'succeeded'").select("document_id", "content_hash", "settings_hash").distinct()
    return requests.join(kept, ["document_id", "content_hash", "settings_hash"], "left_anti")


# States of a job in order, and the progress each stands for.
STATES = {"queued": 0.0, "running": 0.05, "succeeded": 1.0, "failed": None}


def job_states(log: DataFrame) -> DataFrame:
    """(job_id, status, progress, valid): the newest state of each job; valid if its states came as queued, running, then succeeded or failed.
    log(job_id, at, status). A failed job keeps the progress it had."""
    from itertools import chain

    own = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "status"))).alias("l"))
    s = F.transform("l", lambda x: x["status"])
    path, last = F.array_join(s, ">"), F.element_at(s, -1)
    known = F.create_map(*chain(*((F.lit(k), F.lit(v)) for k, v in STATES.items() if v is not None)))
    reached = F.array_max(F.filter(F.transform(s, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()))
    return own.select("job_id", last.alias("status"), reached.alias("progress"), path.rlike(r"^queued(>running(>(succeeded|failed))?)?$").alias("valid"))


def upserted(vectors: DataFrame, added: DataFrame) -> DataFrame:
    """The vector table with added rows (document_id, id, ...): a row of the same document and id is replaced."""
    return vectors.join(added.select("document_id", "id").distinct(), ["document_id", "id"], "left_anti").unionByName(added)


def without_documents(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of all documents but those in gone(document_id)."""
    return rows.join(gone.select("document_id").distinct(), "document_id", "left_anti")


def cascade(parents: DataFrame, children: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is gone: what a deletion of the parents takes along."""
    return children.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def token_diff(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, added, removed, ratio): words that an edit put in and took out, by the longest-matching-blocks rule, and the similarity."""

    def diff(batches):
        for pdf in batches:
            rows = []
            for k, a, b in zip(pdf[key], pdf[old], pdf[new]):
                x, y = (a or "").split(), (b or "").split()
                m = difflib.SequenceMatcher(None, x, y, autojunk=False)
                ops = [o for o in m.get_opcodes() if o[0] != "equal"]
                rows.append((k, sum(o[4] - o[3] for o in ops), sum(o[2] - o[1] for o in ops), round(m.ratio(), 6)))
            yield pd.DataFrame(rows, columns=[key, "added", "removed", "ratio"])

    kind = dict(pairs.dtypes)[key]
    return pairs.select(key, old, new).mapInPandas(diff, f"{key} {kind}, added long, removed long, ratio double")
