"""Projects and the work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN = ("pending", "processing")
#: Seconds to wait before the first, second and third retry.
BACK_OFF = (60, 300, 900)


def fold_states(events: DataFrame, key: str, order: list[str], event: str, retries: int = 3) -> DataFrame:
    """The state of each request after its ordered events (start, done, fail, cancel).

    pending to processing to done; a failure goes back to pending until ``retries`` are used up, then failed; only open
    requests can be cancelled; done, failed and cancelled absorb everything after them. The events of one request, a start and
    an end for each try, are sorted as one list.
    """
    seq = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(event).alias("e")))).alias("x"))

    def step(s: Column, x: Column) -> Column:
        state, n, e = s["state"], s["n"], x["e"]
        done = state.isin("done", "failed", "cancelled")
        new = (
            F.when(done, state).when(e == "cancel", "cancelled").when((e == "start") & (state == "pending"), "processing").when((e == "done") & (state == "processing"), "done")
            .when((e == "fail") & (state == "processing"), F.when(n + 1 > retries, "failed").otherwise("pending")).otherwise(state)
        )
        return F.struct(new.alias("state"), F.when(~done & (e == "fail") & (state == "processing"), n + 1).otherwise(n).alias("n"))

    start = F.struct(F.lit("pending").alias("state"), F.lit(0).alias("n"))
    out = seq.select(key, F.aggregate("x", start, step).alias("s"), F.size("x").alias("n_events"))
    wait = F.when((F.col("s.state") == "pending") & (F.col("s.n") > 0), F.get(F.array(*[F.lit(b) for b in BACK_OFF]), F.least(F.col("s.n"), F.lit(len(BACK_OFF))) - 1))
    return out.select(key, F.col("s.state").alias("state"), F.col("s.n").alias("retries"), wait.alias("wait_s"), "n_events")


def enqueue(queue: DataFrame, requests: DataFrame, project: str = "project_id", url: str = "url", order: str = "created_at") -> DataFrame:
    """Requests to add: the first of each (project, url) that has no open item."""
    taken = queue.filter(F.col("status").isin(*OPEN)).select(project, url).distinct()
    w = W.partitionBy(project, url).orderBy(order)
    return requests.join(taken, [project, url], "left_anti").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def list_queue(queue: DataFrame, by: list[str], limit: int = 50) -> DataFrame:
    """The first ``limit`` by priority (high first), then the given columns, with the number of all that match."""
    total = queue.agg(F.count("*").alias("total_matching"))
    return queue.orderBy(F.desc("priority"), *by).limit(limit).crossJoin(F.broadcast(total))  # one row


def list_projects(projects: DataFrame, *counted: tuple[DataFrame, str], archived: bool = False) -> DataFrame:
    """Projects with live counts of their rows in each of ``counted`` (table, name); archived ones on demand."""
    out = projects if archived else projects.filter("archived_at is null")
    for df, name in counted:
        out = out.join(df.groupBy("project_id").agg(F.count("*").alias(name)), "project_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def projects_seen(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("project_id")), ",").alias("projects_seen"))
