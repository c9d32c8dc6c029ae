"""Pod status as one column expression.

Pods carry ``phase, reason, message, deleted, conditions`` (array of type, status,
changed_at) and ``init_containers`` / ``containers`` (array of running, ready, waiting,
exit_code, exit_reason, last_exit_code, last_exit_reason; a null exit code means not ended).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exit codes of SIGKILL, SIGTERM, SIGINT, SIGHUP.
KILL_CODES = [137, 143, 130, 129]
# Waiting reasons, the exit reason and the eviction message that decide a state.
IMAGE_ERRORS = ["ErrImagePull", "ImagePullBackOff", "RegistryUnavailable"]
CREATING_REASONS = ["ContainerCreating", "PodInitializing"]
OOM_REASON = "OOMKilled"
EVICTED_FOR_MEMORY = r"(?i)low\W+on\W+resource\W+memory"
STALL_SECONDS = 15 * 60

CONTAINER = (
    "running boolean, ready boolean, waiting string, exit_code int, exit_reason string, "
    "last_exit_code int, last_exit_reason string"
)
POD_SCHEMA = (
    "pod_id long, phase string, reason string, message string, deleted boolean, "
    "conditions array<struct<type string, status string, changed_at timestamp_ntz>>, "
    f"init_containers array<struct<{CONTAINER}>>, containers array<struct<{CONTAINER}>>"
)


def _ended(code: Column, reason: Column) -> Column:
    return (
        F.when(reason == OOM_REASON, "oom")
        .when(code == 0, "succeeded")
        .when(code.isin(KILL_CODES), "killed")
        .otherwise("failed")
    )


def container_state(c: Column) -> Column:
    """One word per container; the first applicable test decides."""
    reason = F.coalesce(c["exit_reason"], F.lit(""))
    last_reason = F.coalesce(c["last_exit_reason"], F.lit(""))
    running = F.coalesce(c["running"], F.lit(False))
    return (
        F.when(running & F.coalesce(c["ready"], F.lit(False)), "ready")
        .when(running, "not_ready")
        .when(c["exit_code"].isNotNull(), _ended(c["exit_code"], reason))
        .when(c["last_exit_code"].isNotNull(), _ended(c["last_exit_code"], last_reason))
        .when(c["waiting"].isin(IMAGE_ERRORS), "image_error")
        .when(c["waiting"].isin(CREATING_REASONS), "creating")
        .otherwise("waiting")
    )


def containers_status(containers: Column) -> Column:
    """Status of a set of containers: the worst state wins; none at all means Pending."""
    states = F.transform(containers, container_state)

    def any_(state: str) -> Column:
        return F.array_contains(states, state)

    return (
        F.when(F.size(containers) == 0, "Pending")
        .when(any_("image_error"), "ErrImagePull")
        .when(any_("oom"), "KilledOOM")
        .when(any_("killed"), "Killed")
        .when(any_("failed"), "Failed")
        .when(any_("waiting"), "Pending")
        .when(F.forall(states, lambda s: s == "succeeded"), "Succeeded")
        .when(any_("creating"), "Creating")
        .when(any_("not_ready"), "NotReady")
        .otherwise("Ready")
    )


def _condition(kind: str, status: str) -> Column:
    return F.coalesce(F.exists("conditions", lambda c: (c["type"] == kind) & (c["status"] == status)), F.lit(False))


def _containers(name: str) -> Column:
    """The list of containers; a pod without one has none."""
    return F.coalesce(F.col(name), F.array().cast(f"array<struct<{CONTAINER}>>"))


def pod_status(now: Column) -> Column:
    """The 12-state classification of a pod at ``now``."""
    stalled = F.exists(
        "conditions",
        lambda c: (c["type"] == "PodScheduled")
        & (c["status"] == "False")
        & c["changed_at"].isNotNull()
        & (now >= c["changed_at"] + F.make_dt_interval(secs=F.lit(STALL_SECONDS))),
    )

    def exit_of(c: Column) -> tuple[Column, Column]:
        last = c["last_exit_code"].isNotNull()
        code = F.when(last, c["last_exit_code"]).otherwise(c["exit_code"])
        reason = F.when(last, c["last_exit_reason"]).otherwise(c["exit_reason"])
        return code, F.coalesce(reason, F.lit(""))

    def death(c: Column) -> Column:
        code, reason = exit_of(c)
        return F.when(reason == OOM_REASON, "KilledOOM").when(code.isin(KILL_CODES), "Killed")

    # The first container with a telling exit decides.
    deaths = F.array_compact(F.transform(_containers("containers"), death))
    evicted = (F.col("reason") == "Evicted") & F.col("message").rlike(EVICTED_FOR_MEMORY)
    running = containers_status(_containers("containers"))
    every = F.concat(_containers("init_containers"), _containers("containers"))
    return (
        F.when(
            F.col("phase") == "Pending",
            F.when(stalled, "Stalled").otherwise(containers_status(every)),
        )
        .when(F.col("phase") == "Succeeded", "Succeeded")
        .when(
            F.col("phase") == "Failed",
            F.when(evicted, "KilledOOM").when(F.size(deaths) > 0, F.get(deaths, F.lit(0))).otherwise("Failed"),
        )
        .when(
            F.col("phase") == "Running",
            F.when(F.coalesce(F.col("deleted"), F.lit(False)), "Terminating")
            .when(_condition("Ready", "True"), "Ready")
            .when(running == "Ready", "NotReady")
            .otherwise(running),
        )
        .otherwise("Unknown")
    )


def ready_condition() -> Column:
    return _condition("Ready", "True")


def was_oom_killed() -> Column:
    """Evicted for memory, or any container that last ended out of memory."""

    def ended_oom(c: Column) -> Column:
        last = c["last_exit_code"].isNotNull()
        reason = F.when(last, c["last_exit_reason"]).when(c["exit_code"].isNotNull(), c["exit_reason"])
        return F.coalesce(reason, F.lit("")) == OOM_REASON

    evicted = (F.col("reason") == "Evicted") & F.col("message").rlike(EVICTED_FOR_MEMORY)
    return F.coalesce(evicted, F.lit(False)) | F.exists(_containers("containers"), ended_oom)
