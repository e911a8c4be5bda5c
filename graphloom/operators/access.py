"""Permissions, roles and the audit trail, as filters and joins over tables of requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions by role; an admin has all, of all namespaces.
READS = ("query.find", "query.traverse", "query.explain", "node.get", "edge.list", "schema.get", "watch.subscribe")


def path_pattern(path: str) -> str:
    """A resource path as a regular expression: ``*`` is one segment, ``+`` one or more."""
    parts = {"*": "[^/]+", "+": ".+"}
    return "^" + "/".join(parts.get(p, re.escape(p)) for p in path.split("/")) + "$"


def path_matches(pattern: Column, path: Column) -> Column:
    """The same where patterns are a column: each is made an expression, literals quoted."""
    parts = F.transform(F.split(pattern, "/", -1), lambda p: F.when(p == "*", "[^/]+").when(p == "+", ".+").otherwise(F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))))
    return F.regexp_like(path, F.concat(F.lit("^"), F.array_join(parts, "/"), F.lit("$")))


def permitted(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """The requests (principal, resource, action, ...) with ``allowed``: whether a policy of the principal
    (principal, resource, actions array) covers them. A principal's policies are pre-aggregated into one row."""
    own = policies.groupBy("principal").agg(F.collect_set(F.struct("resource", "actions")).alias("__rules"))
    covers = F.exists("__rules", lambda r: path_matches(r["resource"], F.col("resource")) & F.exists(r["actions"], lambda a: (a == "*") | (a == F.col("action"))))
    return requests.join(own, "principal", "left").withColumn("allowed", F.coalesce(covers, F.lit(False))).drop("__rules")


def by_role(requests: DataFrame) -> DataFrame:
    """The requests (roles array, database, namespace, action, ...) with ``allowed``.

    ``admin`` may all; ``namespace-admin`` all in any, ``namespace-admin:db:ns`` all
    in one namespace; ``read-only`` the actions of READS.
    """
    own = F.concat_ws(":", F.lit("namespace-admin"), "database", "namespace")
    ok = F.exists("roles", lambda r: r.isin("admin", "namespace-admin") | (r == own) | ((r == "read-only") & F.col("action").isin(*READS)))
    return requests.withColumn("allowed", F.coalesce(ok, F.lit(False)))


def audit(records: DataFrame, principal: str | None = None, action: str | None = None, since=None, until=None, limit: int | None = None, ts: str = "ts") -> DataFrame:
    """Records of a principal and an action between two times, both included, by time; the limit comes last."""
    out = records
    for name, value in (("principal", principal), ("action", action)):
        out = out.where(F.col(name) == value) if value is not None else out
    out = out.where(F.col(ts) >= F.lit(since)) if since is not None else out
    out = out.where(F.col(ts) <= F.lit(until)) if until is not None else out
    return out if limit is None else out.orderBy(ts).limit(limit)


def schema_owner_allows(owners: DataFrame, requests: DataFrame) -> DataFrame:
    """Registrations (database, namespace, site, ...) with ``allowed``: the namespace has no owner, or that site."""
    own = owners.select("database", "namespace", F.col("site").alias("__owner"))
    return requests.join(own, ["database", "namespace"], "left").withColumn("allowed", F.col("__owner").isNull() | (F.col("__owner") == F.col("site"))).drop("__owner")


class NotOwner(PermissionError):
    code = "ERR_NOT_SCHEMA_OWNER"


def set_schema_owner(owners: dict[tuple[str, str], int], database: str, namespace: str, site: int, actor: int) -> dict[tuple[str, str], int]:
    """The owners with one set: of a namespace without one by anybody, else by its owner only."""
    now = owners.get((database, namespace))
    if now is not None and now != actor:
        raise NotOwner(f"{database}/{namespace} is of site {now}")
    return owners | {(database, namespace): site}


def lease(holder: str | None, epoch: int, expires: int, who: str, now: int, ttl: int) -> tuple[bool, str | None, int, int]:
    """(granted, holder, epoch, expires): the holder renews; another takes over when it has run out, one epoch on."""
    if holder == who and now <= expires:
        return True, who, epoch, now + ttl
    if holder is None or now > expires:
        return True, who, epoch + 1, now + ttl
    return False, holder, epoch, expires
