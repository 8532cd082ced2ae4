"""Governed access: column grants, previews, the SQL gate and its decision.

The gate takes one read-only SELECT. Comments are found by our own scan, as Spark's parser drops them; the parsed plan must be
made of allowed nodes and functions only, name only tables with grants, and is then analysed over views that hold just the
granted columns, so stars expand to them and a locked column does not exist in any scope. In the analysed plan every relation
must lie under one of those views: a name that is a common table expression in one scope and a table in another is no way in.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions import security

MAX_SQL, ROW_CAP, CONFIRM_ROWS, MAX_GRANT_HOURS = 8000, 1000, 10_000, 720
#: Plan nodes and functions that a governed query may use.
_NODES = frozenset("Project Filter Aggregate Join Sort GlobalLimit LocalLimit LimitAll Distinct SubqueryAlias UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedSubqueryColumnAliases WithWindowDefinition Offset OneRowRelation".split())
_FUNCTIONS = frozenset(
    "abs avg between ceil ceiling coalesce concat concat_ws count count_if date_format date_trunc datediff day dense_rank exp extract first floor greatest if ifnull lag last lead least length ln log lower lpad ltrim max mean median min "
    "mod month now nullif nvl percentile_approx power pow quarter rank replace round row_number rpad rtrim sign sqrt stddev substr substring sum trim try_cast try_divide upper variance weekofyear year current_date current_timestamp add_months last_day contains startswith endswith".split()
)
#: Expressions of the parsed plan besides functions.
_EXPRESSIONS = frozenset(
    "Add Alias And CaseWhen Cast Concat CurrentRow$ Divide EqualNullSafe EqualTo Exists GreaterThan GreaterThanOrEqual ILike In InSubquery IntegralDivide IsNotNull IsNull LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal "
    "MultiAlias Multiply Not NotLikeAll Or OuterReference RLike Remainder ScalarSubquery SortOrder SpecifiedWindowFrame StringTrim StringTrimLeft StringTrimRight Substring Subtract UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ "
    "UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedOrdinal UnresolvedStar UnresolvedWindowExpression UnspecifiedFrame$ WindowExpression WindowSpecDefinition Between UnresolvedSubqueryColumnAliases".split()
)
#: Functions that need no brackets and tell something other than data; a column of that name is a column.
_BARE = frozenset("current_user user session_user current_catalog current_database current_schema current_timezone localtimestamp current_time grouping__id input_file_name version".split())


@dataclass
class Verdict:
    """The gate's answer: whether the text may run, why not, what will run, and what it touches."""

    ok: bool
    reason: str = ""
    sql: str = ""
    tables: list[str] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    joins: int = 0
    aggregated: bool = False
    limit: int = ROW_CAP


def has_comment(sql: str) -> bool:
    """Whether `--`, `/*` or `#` starts outside quotes."""
    quote, i = "", 0
    while i < len(sql):
        c = sql[i]
        if quote:
            if c == "\\" and quote != "`":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "'\"`":
            quote = c
        elif sql.startswith(("--", "/*"), i) or c == "#":
            return True
        i += 1
    return bool(quote)


def unlocked_columns(catalog: DataFrame, role_grants: DataFrame, user_grants: DataFrame, role: str, user: str, now: str) -> DataFrame:
    """(table_name, column_name) of current columns that the role or a live grant of the user opens; nothing by default."""
    live = user_grants.filter((F.col("user_id") == user) & (F.col("status") == "approved") & (F.col("valid_until") > F.lit(now).cast("timestamp"))).select("table_name", F.explode("columns").alias("column_name"))
    mine = role_grants.filter(F.col("role") == role).select("table_name", "column_name").unionByName(live).distinct()
    return catalog.join(mine, ["table_name", "column_name"], "left_semi")


def preview(df: DataFrame, allowed: list[str], key: str, tenant: tuple[str, str] | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a table: locked columns are null and never read, other tenants' rows never leave the scan; one extra row tells of more."""
    if tenant:
        df = df.filter(F.col(tenant[0]) == tenant[1])
    page = df.orderBy(key).offset(offset).limit(limit + 1)
    return page.select(*(F.col(f.name) if f.name in allowed else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields))


def visible_documents(sources: DataFrame, grants: DataFrame, user: str, tenant: str, admin: bool = False) -> DataFrame:
    """Accepted documents of the tenant that are public or granted to the user; admins see all."""
    if admin:
        return sources
    mine = grants.filter((F.col("user_id") == user) & (F.col("tenant_id") == tenant) & (F.col("status") == "approved")).select("source_id").distinct().withColumn("granted", F.lit(True))
    return sources.filter((F.col("status") == "accepted") & (F.col("tenant_id") == tenant)).join(mine, "source_id", "left").filter((F.col("visibility") == "public") | F.coalesce("granted", F.lit(False))).drop("granted")


def all_visible(wanted: DataFrame, visible: DataFrame) -> bool:
    return wanted.join(visible, "source_id", "left_anti").isEmpty()


def _walk(plan):
    """Nodes of a parsed plan with those of subqueries and common table expressions."""
    todo = [plan]
    while todo:
        p = todo.pop()
        yield p
        for group in (p.children(), p.innerChildren()):
            for i in range(group.size()):
                x = group.apply(i)
                if "plans.logical" in x.getClass().getName() or "catalyst.analysis" in x.getClass().getName():
                    todo.append(x)
        subs = p.subqueries()
        for i in range(subs.size()):
            todo.append(subs.apply(i))


def _listed(group) -> list:
    return [group.apply(i) for i in range(group.size())]


def _odd_expression(plan, columns: set[str]) -> str | None:
    """What an allow-list does not hold among the expressions of one node of a parsed plan, named as the text names it: quoting a function's name or leaving out its brackets makes no difference here."""
    todo = _listed(plan.expressions())
    if plan.nodeName() == "WithWindowDefinition":
        todo += _listed(plan.windowDefinitions().values().toSeq())
    while todo:
        e = todo.pop()
        kind = e.getClass().getName().rsplit(".", 1)[1]
        if kind not in _EXPRESSIONS:
            return f"not allowed: {kind}"
        if kind == "UnresolvedFunction":
            parts = _listed(e.nameParts())
            if len(parts) != 1 or parts[0].lower() not in _FUNCTIONS:
                return f"function not allowed: {'.'.join(parts)}"
        if kind == "UnresolvedAttribute":
            parts = [p.lower() for p in _listed(e.nameParts())]
            if len(parts) == 1 and parts[0] in _BARE and parts[0] not in columns:
                return f"function not allowed: {parts[0]}"
        todo += _listed(e.children())
    return None


def _stray(analysed, views: set[str]) -> str | None:
    """A relation of an analysed plan that is not read through one of the private views."""
    todo = [analysed]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name == "SubqueryAlias" and p.identifier().name() in views:
            continue
        below = [group.apply(i) for group in (p.children(), p.subqueries()) for i in range(group.size())]
        if not below and name not in ("OneRowRelation", "CTERelationRef"):
            return name
        todo += below
    return None


def gate(spark: SparkSession, sql: str, grants: dict[str, list[str]], cap: int = ROW_CAP) -> tuple[Verdict, DataFrame | None]:
    """Judges `sql` for a user with `grants` (table -> columns; tables are temp views of the session) and returns the governed frame."""
    bad = lambda why: (Verdict(False, why), None)
    text = sql.strip().rstrip(";").strip()
    if not text:
        return bad("empty")
    if len(text) > MAX_SQL:
        return bad("too long")
    if has_comment(text):
        return bad("comments are not allowed")
    if ";" in re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "''", text):
        return bad("one statement only")
    if not re.match(r"(?is)^(?:select|with)\b", text):
        return bad("only SELECT")
    masked = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", text)
    if m := re.search(r"(?i)\b(union|intersect|except|minus|tablesample|transform|lateral|values|into|for\s+update|pivot|unpivot|reflect|java_method|insert|update|delete|merge|create|drop|alter|set|identifier)\b", masked):
        return bad(f"not allowed: {m[1].lower()}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException:
        return bad("cannot be parsed")
    except Exception as e:  # Py4J wraps the parser's own exception
        return bad("cannot be parsed") if "ParseException" in str(e) else bad(str(e).splitlines()[0])
    tables, nodes = set(), []
    ctes = {m.lower() for m in re.findall(r"(?i)(?:\bwith\b|,)\s*([a-z_]\w*)\s+as\s*\(", masked)}
    for p in _walk(plan):
        name = p.nodeName().lstrip("'")
        nodes.append(name)
        if name not in _NODES:
            return bad(f"not allowed: {name}")
        if name == "UnresolvedRelation":
            ident = p.tableName()
            if "." in ident or "`" in ident:
                return bad("qualified or path tables are not allowed")
            if ident.lower() not in ctes:
                tables.add(ident.lower())
        if odd := _odd_expression(p, {c.lower() for held in grants.values() for c in held}):
            return bad(odd)
    if not tables:
        return bad("no table")
    if locked := sorted(t for t in tables if t not in grants):
        return bad(f"table not allowed: {locked[0]}")
    # Each table is a view of its granted columns in a session of its own.
    session, views = spark.newSession(), {f"v{uuid.uuid4().hex}": t for t in tables}
    try:
        for view, t in views.items():
            spark.table(t).select(*grants[t]).createOrReplaceGlobalTempView(view)
            session.sql(f"CREATE OR REPLACE TEMPORARY VIEW {t} AS SELECT * FROM global_temp.{view}")
        df = session.sql(text)
        if stray := _stray(df._jdf.queryExecution().analyzed(), set(views)):
            return bad(f"table not allowed: {stray}")
    except AnalysisException as e:
        for t in tables:
            for c in spark.table(t).columns:
                if c not in grants[t] and re.search(rf"(?i)\b{re.escape(c)}\b", masked):
                    return bad(f"column is locked: {t}.{c}")
        return bad(str(e).split(".")[0][:120])
    finally:
        # The analysed plan holds what it needs.
        for view in views:
            spark.catalog.dropGlobalTempView(view)
    asked = re.search(r"(?is)\blimit\s+(\d+)\s*$", masked)
    limit = min(int(asked[1]), cap) if asked else cap
    used = sorted({f"{t}.{c}" for t in tables for c in grants[t] if re.search(rf"(?i)\b{re.escape(c)}\b", masked) or re.search(r"\*", re.sub(r"(?i)count\(\s*\*\s*\)", "", masked))})
    return Verdict(True, "", text, sorted(tables), used, nodes.count("Join"), any(n in ("Aggregate", "UnresolvedHaving", "Distinct") for n in nodes), limit), df.limit(limit)


def decide(verdict: Verdict, estimate: int | None, sensitive: set[str], threshold: int = CONFIRM_ROWS) -> str:
    """BLOCK what the gate refused, CONFIRM sensitive columns or a large estimate, ALLOW the rest."""
    if not verdict.ok:
        return "BLOCK"
    touched = {c for c in verdict.columns if c in sensitive or c.split(".")[1] in sensitive}
    return "CONFIRM" if touched or (estimate is not None and estimate > threshold) else "ALLOW"


def judged(requests: DataFrame, grants: dict[str, list[str]], sensitive: set[str], threshold: int = CONFIRM_ROWS) -> DataFrame:
    """Requests (sql, estimate, ...) with a decision and the reason of a refusal. Each distinct text passes the gate once, one after another on the driver; the verdicts are joined back."""
    spark = requests.sparkSession
    rows = []
    for r in requests.select("sql").distinct().toLocalIterator():
        verdict = gate(spark, r.sql or "", grants)[0]
        rows.append((r.sql, verdict.ok, verdict.reason, decide(verdict, None, sensitive)))
    verdicts = spark.createDataFrame(rows, "_sql string, ok boolean, reason string, decision string")
    d = requests.join(verdicts, F.col("sql").eqNullSafe(F.col("_sql"))).drop("_sql")
    return d.withColumn("decision", F.when(F.col("ok") & (F.col("estimate") > threshold), "CONFIRM").otherwise(F.col("decision"))).drop("ok")


def estimated_rows(df: DataFrame) -> int | None:
    """Catalyst's row estimate, None where it has none."""
    n = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
    return int(str(n.get())) if n.isDefined() else None


def run_capped(df: DataFrame, cap: int = ROW_CAP, timeout_s: float = 15.0) -> tuple[list, bool]:
    """At most `cap` rows and whether there were more; the job group is cancelled at the timeout."""
    import threading

    sc, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "governed query", interruptOnCancel=True)
    timer = threading.Timer(timeout_s, sc.cancelJobGroup, [group])
    timer.start()
    try:
        rows = df.limit(cap + 1).collect()
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)
    return rows[:cap], len(rows) > cap


def grounded(answer_numbers: DataFrame) -> DataFrame:
    """Whether every number of an answer is among the allowed ones: (answer array, allowed array)."""
    return answer_numbers.withColumn("grounded", F.size(F.array_except("answer", "allowed")) == 0)


def schema_flags(catalog: DataFrame, unlocked: DataFrame) -> DataFrame:
    """The catalog (table_name, column_name, ...) with `locked` for a user whose unlocked columns are given: the user's schema."""
    mine = unlocked.select("table_name", "column_name").distinct().withColumn("open", F.lit(True))
    return catalog.join(mine, ["table_name", "column_name"], "left").withColumn("locked", F.col("open").isNull()).drop("open")


def new_requests(requests: DataFrame, pending: DataFrame) -> DataFrame:
    """Access requests (request_id, user_id, table_name, columns) with an outcome: empty ones and those that overlap a pending one of the user are refused."""
    have = pending.select("user_id", "table_name", F.explode("columns").alias("column")).distinct()
    asked = requests.select("request_id", "user_id", "table_name", F.explode("columns").alias("column"))
    clash = asked.join(have, ["user_id", "table_name", "column"], "left_semi").select("request_id").distinct().withColumn("clash", F.lit(True))
    outcome = F.when(F.size(F.coalesce("columns", F.array().cast("array<string>"))) == 0, "empty").when(F.coalesce("clash", F.lit(False)), "already_pending").otherwise("pending")
    return requests.join(clash, "request_id", "left").withColumn("outcome", outcome).drop("clash")


def listed_requests(requests: DataFrame, user: str, admin: bool, most: int | None = 500) -> DataFrame:
    """Requests newest first: all for an admin, else one's own; `most` is the list's own length, None gives all."""
    own = requests if admin else requests.filter(F.col("user_id") == user)
    listed = own.orderBy(F.desc("created_at"), "request_id")
    return listed if most is None else listed.limit(most)


def document_requests(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Document requests (request_id, user_id, tenant_id, source_id) with an outcome: the document is missing (other tenants' look so too), public already, or the request is pending."""
    s = sources.filter("status = 'accepted'").select("tenant_id", "source_id", "visibility")
    d = requests.join(s, ["tenant_id", "source_id"], "left")
    return d.withColumn("outcome", F.when(F.col("visibility").isNull(), "not_found").when(F.col("visibility") == "public", "already_public").otherwise("pending")).drop("visibility")


def stored_items(wanted: DataFrame, stored: DataFrame, tenant: str) -> DataFrame:
    """(item_id, found): items of an export that are stored for the tenant; those of other tenants look missing."""
    mine = stored.filter(F.col("tenant_id") == tenant).select("item_id").distinct().withColumn("found", F.lit(True))
    return wanted.select("item_id").distinct().join(mine, "item_id", "left").select("item_id", F.coalesce("found", F.lit(False)).alias("found"))


def citations(df: DataFrame, lineage: list[str]) -> DataFrame:
    return df.withColumn("citations", F.array_distinct(F.array_compact(F.array(*lineage))))


def expiring(grants: DataFrame, now: str) -> DataFrame:
    """Grants with their status after the sweep: approved ones past their end become expired."""
    due = (F.col("status") == "approved") & (F.col("valid_until") <= F.lit(now).cast("timestamp"))
    return grants.withColumn("swept", due).withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def _first_that_counts(decisions: DataFrame, outcome: Column, counts: tuple[str, ...] = ("approved", "rejected")) -> DataFrame:
    """Decisions with `outcome`: what comes after the first of a request that counts, in the order of (decided_at, decider), is already_decided."""
    before = Window.partitionBy("request_id").orderBy("decided_at", "decider").rowsBetween(Window.unboundedPreceding, -1)
    d = decisions.withColumn("_alone", outcome)
    valid = F.col("_alone").isin(*counts)
    taken = F.coalesce(F.max(valid.cast("int")).over(before), F.lit(0)) == 1
    # Who may not decide at all learns nothing of the request's state.
    hidden = F.col("_alone").isin("self_decision", "not_admin", "not_found")
    return d.withColumn("outcome", F.when(taken & ~hidden, "already_decided").otherwise(F.col("_alone"))).drop("_alone")


def _or(df: DataFrame, column: str, default: Column) -> Column:
    return F.col(column) if column in df.columns else default


def decided_requests(requests: DataFrame, now: str) -> DataFrame:
    """Outcome of each decision on an access request: own requests, those of others than admins, rejections without notes, and ended, endless or too long grants are refused.

    So is each decision after the first that counts; a refused one decides nothing. `decision` (approve or reject; approve where
    the column is absent) and `notes` are optional columns.
    """
    until, t = F.col("valid_until"), F.lit(now).cast("timestamp")
    verb, notes = _or(requests, "decision", F.lit("approve")), _or(requests, "notes", F.lit(None).cast("string"))
    outcome = (
        F.when(F.col("decider") == F.col("user_id"), "self_decision")
        .when(~F.coalesce("decider_admin", F.lit(False)), "not_admin")
        .when(~F.coalesce(verb.isin("approve", "reject"), F.lit(False)), "unknown_decision")
        .when((verb == "reject") & (F.trim(F.coalesce(notes, F.lit(""))) == ""), "notes_missing")
        .when(verb == "reject", "rejected")
        .when(until.isNull(), "no_end")
        .when(until <= t, "ends_in_the_past")
        .when(until > t + F.expr(f"INTERVAL {MAX_GRANT_HOURS} HOURS"), "too_long")
        .otherwise("approved")
    )
    return _first_that_counts(requests, outcome)


def _grant_text() -> Column:
    until = F.date_format("valid_until", "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat_ws("|", F.col("request_id").cast("string"), "user_id", "table_name", F.array_join(F.array_sort("columns"), ","), until, "decider")


def signed_grants(decided: DataFrame, key: bytes) -> DataFrame:
    """A grant for each approved decision: request, user, table, columns, end and decider, and a signature over them."""
    d = decided.filter("outcome = 'approved'").select("request_id", "user_id", "table_name", "columns", "valid_until", "decider")
    return d.withColumn("signature", security.signed(_grant_text(), key))


def grant_states(grants: DataFrame, key: bytes, now: str) -> DataFrame:
    """Grants with what they are worth at `now`: forged (any signed part was changed), revoked (where that column is given), expired or valid."""
    state = (
        F.when(~F.col("signature").eqNullSafe(security.signed(_grant_text(), key)), "forged")
        .when(F.coalesce(_or(grants, "revoked", F.lit(False)), F.lit(False)), "revoked")
        .when(F.coalesce(F.col("valid_until") <= F.lit(now).cast("timestamp"), F.lit(True)), "expired")
        .otherwise("valid")
    )
    return grants.withColumn("state", state)


def decided_document_requests(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """Outcome of each decision (request_id, tenant_id, decider, decider_admin, decision, decided_at) on document requests (request_id, tenant_id, user_id, source_id, status).

    A request of another tenant looks missing; one that isn't pending, or that an earlier decision ended, is already decided.
    """
    mine = requests.select("request_id", "tenant_id", "user_id", "source_id", "status")
    d = decisions.join(mine, ["request_id", "tenant_id"], "left")
    verb = F.col("decision")
    outcome = (
        F.when(~F.coalesce("decider_admin", F.lit(False)), "not_admin")
        .when(~F.coalesce(verb.isin("approve", "reject"), F.lit(False)), "unknown_decision")
        .when(F.col("status").isNull(), "not_found")
        .when(F.col("status") != "pending", "already_decided")
        .otherwise(F.when(verb == "approve", "approved").otherwise("rejected"))
    )
    return _first_that_counts(d, outcome).drop("status")


def listed_documents(sources: DataFrame, grants: DataFrame, user: str, tenant: str, admin: bool) -> DataFrame:
    """The tenant's accepted documents, newest first, with `has_access`: public, held by a grant of the user, or all for an admin. Documents without access are listed, so that they can be asked for."""
    held = grants.filter((F.col("user_id") == user) & (F.col("tenant_id") == tenant)).select("source_id").distinct().withColumn("_held", F.lit(True))
    s = sources.filter((F.col("tenant_id") == tenant) & (F.col("status") == "accepted"))
    access = F.lit(True) if admin else (F.coalesce(F.col("visibility") == "public", F.lit(False)) | F.coalesce("_held", F.lit(False)))
    return s.join(held, "source_id", "left").select("source_id", "filename", "created_at", "visibility", access.alias("has_access")).orderBy(F.desc("created_at"), F.lower("filename").desc(), "source_id")
