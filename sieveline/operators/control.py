"""Gates of the control plane as joins, windows and folds: policy, roles, rate limits, quotas, credits, metrics, path sandbox."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Policy packs (name, severities that fail, most risk).
PACKS = [("default", "CRITICAL", 100), ("strict", "CRITICAL,HIGH", 40), ("soc2", "CRITICAL,HIGH", 50), ("pci", "CRITICAL,HIGH", 25)]
#: Roles in ascending order, and the tools of each; a role has its own tools and those of the roles before it.
ROLES = [
    ("viewer", ["enterprise_health", "enterprise_policy_status", "export_sarif", "generate_sbom"]),
    ("scanner", ["audit_cloud_cost", "audit_code_safety", "audit_container_config", "audit_infra_security", "engine_status", "evaluate_policy", "full_pipeline", "list_plugins", "scan_dependencies", "scan_git_diff", "scan_history", "scan_repository", "security_score", "suggest_fixes"]),
    ("operator", ["compliance_report", "list_audit_events"]),
    ("admin", ["issue_access_token", "manage_tenant", "reload_enterprise_config"]),
]
#: A role that is not known counts as this one; the last role may call tools that no list names.
USUAL_ROLE = "scanner"
#: Tools that read paths, and tools that use up quota.
PATH_TOOLS = ("scan_repository", "scan_git_diff", "scan_dependencies")
QUOTA_TOOLS = ("audit_code_safety", "audit_infra_security", "full_pipeline", *PATH_TOOLS)
TOOL_OF_EVENT = {"click": "audit_code_safety", "view": "scan_history", "purchase": "scan_repository", "signup": "manage_tenant", "error": "list_audit_events"}


def packs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PACKS, "pack string, fail_on string, max_risk int")


def evaluate_policy(scored: DataFrame, counts: DataFrame, gates: DataFrame) -> DataFrame:
    """One decision per file and pack. scored: file_id, risk_score; counts: file_id, severity, n. DENY if a failing severity occurs or the risk is over the limit."""
    by_file = counts.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("severity", "n"))).alias("n_by"))
    rows = scored.join(by_file, "file_id", "left").join(F.broadcast(gates))
    hits = F.aggregate(F.split("fail_on", ","), F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(F.element_at("n_by", s), F.lit(0).cast("long")))
    rows = rows.withColumn("blocking", hits).withColumn("over", F.col("risk_score") > F.col("max_risk"))
    return rows.select("file_id", "pack", "risk_score", "blocking", F.when((F.col("blocking") > 0) | F.col("over"), "DENY").otherwise("ALLOW").alias("decision"))


def overridden(asked: DataFrame, tenants: DataFrame, gates: DataFrame) -> DataFrame:
    """asked(tenant_id, ..) with pack, fail_on and max_risk: a tenant's own limits count before those of its pack, which are there for what the tenant leaves open.

    tenants(tenant_id, pack, fail_on, max_risk), as small as the list of tenants, may hold nulls; a tenant that is not listed has the pack default, and a pack that is not
    known fails on CRITICAL alone, at any risk.
    """
    own = tenants.select("tenant_id", F.col("pack").alias("_pack"), F.col("fail_on").alias("_fail"), F.col("max_risk").alias("_risk"))
    rows = asked.join(F.broadcast(own), "tenant_id", "left").withColumn("pack", F.coalesce("_pack", F.lit("default")))
    rows = rows.join(F.broadcast(gates), "pack", "left")
    limits = {"fail_on": F.coalesce("_fail", "fail_on", F.lit("CRITICAL")), "max_risk": F.coalesce("_risk", "max_risk", F.lit(10**9))}
    return rows.withColumns(limits).drop("_pack", "_fail", "_risk")


def gated(scored: DataFrame, counts: DataFrame) -> DataFrame:
    """scored(file_id, risk_score, upstream, fail_on, max_risk, ..) with blocking, decision and reasons, in the order in which they are found.

    counts(file_id, severity, n) has the findings. Upstream's REJECTED counts only where nothing else speaks against the file. Unknown severities block nothing; a file without findings
    or a null score has none of either.
    """
    by_file = counts.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct(F.upper("severity").alias("severity"), "n"))).alias("_n"))
    fail = F.array_sort(F.array_distinct(F.transform(F.split("fail_on", ","), lambda x: F.upper(F.trim(x)))))
    rows = scored.join(by_file, "file_id", "left").withColumn("_fail", fail)
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("blocking", F.aggregate("_fail", zero, lambda acc, s: acc + F.coalesce(F.element_at("_n", s), zero)))
    risk = F.coalesce("risk_score", F.lit(0))
    listed = F.concat(F.lit("['"), F.array_join("_fail", "', '"), F.lit("']"))
    said = F.array_compact(F.array(
        F.when(F.col("blocking") > 0, F.concat(F.col("blocking").cast("string"), F.lit(" issue(s) at fail severity "), listed)),
        F.when(risk > F.col("max_risk"), F.concat(F.lit("risk_score "), risk.cast("string"), F.lit(" exceeds max_risk_score "), F.col("max_risk").cast("string"))),
    ))
    upstream = F.array(F.lit("upstream security_verdict=REJECTED"))
    reasons = F.when((F.size(said) == 0) & F.coalesce(F.upper("upstream") == "REJECTED", F.lit(False)), upstream).otherwise(said)
    return rows.withColumn("reasons", reasons).withColumn("decision", F.when(F.size("reasons") > 0, "DENY").otherwise("ALLOW")).drop("_n", "_fail")


def newest(rows: DataFrame, keys: list[str], order: list[Column], most: int, spread: int = 64) -> DataFrame:
    """The first most rows of each key by order, which must tell all rows apart. A key's rows are cut to most in each of spread parts first, so a key that has
    a third of all rows is no single group; at most spread times most rows of a key meet in one task."""
    part = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in keys)), F.lit(spread))
    some = rows.withColumn("_part", part)
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_n") <= most)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n", "_part")


def evidence(decisions: DataFrame, most: int = 100) -> DataFrame:
    """tenant_id, allows, denies among the last most decisions(tenant_id, ts, event_id, decision) of each tenant, by ts, then event_id."""
    last = newest(decisions.select("tenant_id", "ts", "event_id", "decision"), ["tenant_id"], [F.desc_nulls_last("ts"), F.desc("event_id")], most)
    return last.groupBy("tenant_id").agg(F.count_if(F.col("decision") == "ALLOW").alias("allows"), F.count_if(F.col("decision") == "DENY").alias("denies"))


def role_tools(spark: SparkSession) -> DataFrame:
    """role, tool: each role has its own tools and those of all roles before it."""
    rows, held = [], []
    for role, tools in ROLES:
        held = held + tools
        rows += [(role, t) for t in held]
    return spark.createDataFrame(rows, "role string, tool string")


def requests(events: DataFrame) -> DataFrame:
    """Events as requests: tenant and subject from the user, role by user, tool by event type."""
    tool = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in TOOL_OF_EVENT.items()))
    role = F.element_at(F.array(*(F.lit(r) for r, _ in ROLES)), (F.col("user_id") % len(ROLES) + 1).cast("int"))
    return events.select("event_id", "ts", "user_id", (F.col("user_id") % 10).alias("tenant_id"), tool.alias("tool"), role.alias("role"), "value")


def authenticated(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """asked with known: whether the SHA-256 of column api_key is an active key of keys(key_sha256, active). A null key is not known."""
    known = keys.where("active").select("key_sha256", F.lit(True).alias("known")).distinct()
    rows = asked.withColumn("key_sha256", F.sha2(F.encode(F.col("api_key"), "UTF-8"), 256)).join(F.broadcast(known), "key_sha256", "left")
    return rows.drop("key_sha256").withColumn("known", F.coalesce("known", F.lit(False)))


def principals(asked: DataFrame, tenants: DataFrame) -> DataFrame:
    """asked with known, tenant_id and role of its api_key, by tenants(tenant_id, place, api_keys array, roles map).

    A key is the first tenant's, by place, that lists it; its role is the one named for the key, else for the first 16 hexadecimal digits of its SHA-256, else USUAL_ROLE. A null or unlisted
    key is not known and has no tenant. Keys meet by their hashes, in a join; none is broadcast.
    """
    listed = tenants.select("tenant_id", "place", "roles", F.explode("api_keys").alias("_key"))
    hashed = lambda k: F.sha2(F.encode(k, "UTF-8"), 256)
    role = F.coalesce(F.element_at("roles", F.col("_key")), F.element_at("roles", F.left(hashed(F.col("_key")), F.lit(16))), F.lit(USUAL_ROLE))
    owners = listed.withColumn("_role", role).groupBy(hashed(F.col("_key")).alias("_sha")).agg(F.min_by(F.struct("tenant_id", F.col("_role").alias("role")), F.struct("place", "tenant_id")).alias("_own"))
    rows = asked.drop("tenant_id", "role").withColumn("_sha", hashed(F.col("api_key"))).join(owners, "_sha", "left")
    return rows.withColumns({"known": F.col("_own").isNotNull(), "tenant_id": F.col("_own.tenant_id"), "role": F.coalesce("_own.role", F.lit(USUAL_ROLE))}).drop("_sha", "_own")


def authorised(asked: DataFrame, blocked: tuple[str, ...] = (), tenants: DataFrame | None = None) -> DataFrame:
    """asked with granted and reason (null where granted), the first that holds of: blocked for all, denied to the tenant, not on the tenant's list, not of the role.

    tenants(tenant_id, allowed, denied) holds arrays of tools, null or empty for none; it is as small as the list of tenants, and is broadcast.
    """
    names = [r for r, _ in ROLES]
    role = F.when(F.lower("role").isin(*names), F.lower("role")).otherwise(USUAL_ROLE)
    allowed = role_tools(asked.sparkSession).select(F.col("role").alias("_role"), F.col("tool").alias("_tool"), F.lit(True).alias("_of_role"))
    rows = asked.withColumn("_as", role)
    rows = rows.join(F.broadcast(allowed), (F.col("_as") == F.col("_role")) & (F.col("tool") == F.col("_tool")), "left")
    if tenants is None:
        none = F.array().cast("array<string>")
        rows = rows.withColumns({"allowed": none, "denied": none})
    else:
        rows = rows.join(F.broadcast(tenants.select("tenant_id", "allowed", "denied")), "tenant_id", "left")
    listed = F.coalesce(F.size("allowed"), F.lit(0)) > 0
    reason = (
        F.when(F.col("tool").isin(*blocked) if blocked else F.lit(False), "blocked")
        .when(F.coalesce(F.array_contains("denied", F.col("tool")), F.lit(False)), "denied")
        .when(listed & ~F.array_contains("allowed", F.col("tool")), "not listed")
        .when(F.col("_of_role").isNull() & (F.col("_as") != names[-1]), "role")
    )
    return rows.withColumn("reason", reason).withColumn("granted", F.col("reason").isNull()).drop("_as", "_role", "_tool", "_of_role", "allowed", "denied")


def micros(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {ts})")


def token_bucket(asked: DataFrame, keys: str | list[str], capacity: float, per_day: float) -> DataFrame:
    """keys, event_id, admitted and retry_after (seconds, 0 where admitted): a bucket per key, refilled in proportion to time, one token per request.

    Refused requests refill too. A request without a time comes first and refills nothing; a capacity of 0 or less admits all. Each step needs the
    one before it, so a key's requests pass through one task in order of time; they stream through it, and only a bucket is held in memory,
    whatever the key's size. Repeated rows are requests of their own; a null key is a key.
    """
    keys = [keys] if isinstance(keys, str) else keys
    rows = asked.select(*keys, "event_id", (micros() / 86_400_000_000).alias("t"))
    if capacity <= 0:
        return rows.select(*keys, "event_id", F.lit(True).alias("admitted"), F.lit(0.0).alias("retry_after"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    n = len(keys)

    def each(batches):
        owner, tokens, last = object(), 0.0, None
        for batch in batches:
            admitted, retry = [], []
            for *k, t in zip(*(batch.column(i).to_pylist() for i in range(n)), batch.column(n + 1).to_pylist(), strict=True):
                if k != owner:
                    owner, tokens, last = k, float(capacity), t
                if t is not None:
                    tokens, last = min(float(capacity), tokens + (t - (t if last is None else last)) * float(per_day)), t
                ok = tokens >= 1.0
                admitted.append(ok)
                retry.append(0.0 if ok else max(0.1, (1.0 - tokens) / float(per_day) * 86400.0))
                tokens -= ok
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n + 1)), pa.array(admitted, pa.bool_()), pa.array(retry, pa.float64())], names=[*keys, "event_id", "admitted", "retry_after"])

    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("t").asc_nulls_first(), "event_id")
    return ordered.mapInArrow(each, f"{kinds}, event_id long, admitted boolean, retry_after double")


def sum_before(asked: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """asked with before: the sum of amount over the earlier requests (ts, then event_id) of the same keys.

    In two levels, so that a key with much of the data is many groups: sums by hour, running totals over the few hours, and
    a window inside each hour.
    """
    rows = asked.withColumn("_hour", F.date_trunc("hour", "ts")).withColumn("_amount", amount)
    hours = rows.groupBy(*keys, "_hour").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_hour").alias("_h"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    same = F.col("_hour").eqNullSafe(F.col("_h"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = Window.partitionBy(*keys, "_hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(hours, same).withColumn("before", F.col("_base") + F.coalesce(F.sum("_amount").over(own), F.lit(0)))
    return out.select(*asked.columns, "before")


def running_quota(asked: DataFrame, limit: int) -> DataFrame:
    """used before each request of a tenant, and whether the quota still admits it. Use is never taken back; a limit of 0 or less is none."""
    rows = sum_before(asked, ["tenant_id"], F.lit(1).cast("long"))
    return rows.select("event_id", "tenant_id", F.col("before").alias("used"), (F.lit(limit <= 0) | (F.col("before") < limit)).alias("admitted"))


def clamped(asked: DataFrame, tenants: DataFrame) -> DataFrame:
    """asked with max_files and workers no larger than the tenant's limits (most_files, most_workers); null or 0 stays."""
    rows = asked.join(F.broadcast(tenants.select("tenant_id", "most_files", "most_workers")), "tenant_id", "left")
    least = lambda c, most: F.when(F.coalesce(F.col(c), F.lit(0)) == 0, F.col(c)).otherwise(F.least(c, most))
    return rows.withColumns({"max_files": least("max_files", "most_files"), "workers": least("workers", "most_workers")}).drop("most_files", "most_workers")


def ledger(asked: DataFrame, credits: float) -> DataFrame:
    """Running balance of each tenant: purchases charge their value, other requests one hundredth; in integer hundredths."""
    charge = F.when(F.col("tool") == "scan_repository", F.floor(F.col("value") * 100)).otherwise(F.lit(1)).cast("long")
    rows = sum_before(asked.withColumn("charge", charge), ["tenant_id"], charge)
    return rows.select("event_id", "tenant_id", "charge", (F.lit(int(credits * 100)) - F.col("before") - F.col("charge")).alias("balance"))


#: Statuses that count as errors of a call.
ERRORS = ("ERROR", "AUTH_FAILED", "FORBIDDEN", "RATE_LIMITED", "QUOTA_EXCEEDED", "SANDBOX_DENIED", "ACCESS_DENIED")
#: Statuses of requests that are refused before their tool is called.
REFUSED = ("AUTH_FAILED", "FORBIDDEN", "RATE_LIMITED", "QUOTA_EXCEEDED", "SANDBOX_DENIED")


def snapshot(answered: DataFrame) -> DataFrame:
    """One row of counts over answered(tool, status, latency_ms, denied): calls that reached their tool, their errors and mean latency, the rest by what refused them, policy denials, calls by tool.

    Calls without a latency count in no mean; the mean is 0 where there is none. by_tool is as long as the list of tools.
    """
    called = ~F.col("status").isin(*REFUSED)
    by_tool = answered.where(called).groupBy("tool").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("by_tool"))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    total = answered.agg(
        count(called).alias("tool_calls"), count(called & F.col("status").isin(*ERRORS)).alias("tool_errors"), count(F.col("status") == "AUTH_FAILED").alias("auth_failures"), count(F.col("status") == "RATE_LIMITED").alias("rate_limited"),
        count(F.col("denied")).alias("policy_denies"), F.round(F.coalesce(F.avg(F.when(called, F.col("latency_ms"))), F.lit(0.0)), 2).alias("avg_latency_ms"),
    )
    return total.join(F.broadcast(by_tool))


def metrics(asked: DataFrame) -> DataFrame:
    return asked.groupBy("tool").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("subjects"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(~F.col("granted")).alias("denied"))


def merged_roots(common: list[str], own: list[str]) -> list[str]:
    """A tenant's roots where they lie under the common ones; a common root where it lies under a tenant's. The common ones if there are none of either; if one list is empty, the other.

    So a tenant's roots only ever restrict. Paths are resolved as text.
    """
    common, own = ([posixpath.normpath(r.strip()) for r in some if r and r.strip()] for some in (common, own))
    if not common or not own:
        return own or common
    under = lambda a, b: a == b or a.startswith(b.rstrip("/") + "/")
    out = []
    for t in own:
        out += next(([t] if under(t, c) else [c] for c in common if under(t, c) or under(c, t)), [])
    return out or common


def resolved(path) -> Column:
    """A path with . and .. taken out; one that climbs above its start keeps what is above."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda acc, p: F.when(p != "..", F.concat(acc, F.array(p))).when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array(F.lit("..")))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def inside(path, roots: list[str]):
    """Whether a path, resolved, is one of the roots or under one. A path that climbs above its start is not."""
    whole, found = resolved(path), F.lit(False)
    for r in roots:
        found = found | (whole == r) | F.startswith(whole, F.lit(r.rstrip("/") + "/"))
    return found


def sandboxed(files: DataFrame, roots: list[str]) -> DataFrame:
    return files.select("file_id", "path", inside(F.col("path"), roots).alias("inside"))


def in_sandbox(asked: DataFrame, common: list[str], tenants: DataFrame) -> DataFrame:
    """asked(tenant_id, path, ..) with in_sandbox, by the roots that merged_roots() leaves each tenant of tenants(tenant_id, roots array).

    Where neither list has a root, all paths are. tenants is as small as the list of tenants; what is left of the roots is made there and broadcast.
    """
    merged = [(r["tenant_id"], merged_roots(common, list(r["roots"] or []))) for r in tenants.select("tenant_id", "roots").toLocalIterator()]
    kind = tenants.schema["tenant_id"].dataType.simpleString()
    own = asked.sparkSession.createDataFrame(merged, f"tenant_id {kind}, _roots array<string>")
    rows = asked.join(F.broadcast(own), "tenant_id", "left").withColumn("_roots", F.coalesce("_roots", F.array(*map(F.lit, merged_roots(common, []))).cast("array<string>")))
    rows = rows.withColumn("_whole", resolved(F.col("path")))
    found = F.exists("_roots", lambda r: (F.col("_whole") == r) | F.startswith(F.col("_whole"), F.concat(F.rtrim(r, F.lit("/")), F.lit("/"))))
    return rows.withColumn("in_sandbox", (F.size("_roots") == 0) | F.coalesce(found, F.lit(False))).drop("_roots", "_whole")


def statuses(known: str, granted: str, in_rate: str, in_quota: str, in_sandbox: str):
    """One status per request: the first gate that refuses it. Quota counts for QUOTA_TOOLS, the sandbox for PATH_TOOLS."""
    return (
        F.when(~F.col(known), "AUTH_FAILED")
        .when(~F.col(granted), "FORBIDDEN")
        .when(~F.col(in_rate), "RATE_LIMITED")
        .when(~F.col(in_quota) & F.col("tool").isin(*QUOTA_TOOLS), "QUOTA_EXCEEDED")
        .when(~F.col(in_sandbox) & F.col("tool").isin(*PATH_TOOLS), "SANDBOX_DENIED")
        .otherwise("OK")
    )
