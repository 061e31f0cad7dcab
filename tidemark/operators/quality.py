"""Normalised records, validators that list violations, and tri-state gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.joins import null_safe_join, param_grid

_PASS, _FAIL, _UNKNOWN = "pass", "fail", "unknown"
#: Statuses of an area of a review, and of the review.
AREA_STATUSES, OVERALL_STATUSES = ("verified", "partially_verified", "not_verified"), ("verified", "partial", "not_verified")


def _reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules whose condition holds; a null condition does not hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


# --- canonical records ------------------------------------------------------
def normalize_trade(raw: DataFrame, schema_version: int = 1) -> DataFrame:
    """Venue trades (symbol, id, time_us, price, quantity, buyer_is_maker) as canonical records with a reject reason."""
    price, qty = F.expr("try_cast(price as double)"), F.expr("try_cast(quantity as bigint)")
    out = raw.select(
        S.normalize_instrument(F.col("symbol")).alias("instrument"), F.timestamp_micros("time_us").alias("ts"), F.col("id").cast("bigint").alias("seq"),
        price.alias("price"), qty.alias("qty"), F.when(F.col("buyer_is_maker"), "SELL").otherwise("BUY").alias("side"), F.lit(schema_version).alias("schema_version"),
    )
    reject = F.when(F.col("instrument").isNull(), "instrument").when(F.col("ts").isNull(), "time").when(F.col("price").isNull() | (F.col("price") <= 0), "price").when(F.col("qty").isNull() | (F.col("qty") <= 0), "quantity")
    return out.withColumn("reject", reject)


def normalize_book_ticker(raw: DataFrame, schema_version: int = 1) -> DataFrame:
    """Top-of-book rows (symbol, time_us, bid, ask, bid_size, ask_size) as canonical records with a reject reason."""
    out = raw.select(
        S.normalize_instrument(F.col("symbol")).alias("instrument"), F.timestamp_micros("time_us").alias("ts"),
        *(F.expr(f"try_cast({c} as double)").alias(c) for c in ("bid", "ask", "bid_size", "ask_size")), F.lit(schema_version).alias("schema_version"),
    )
    numbers = F.col("bid").isNull() | F.col("ask").isNull() | F.col("bid_size").isNull() | F.col("ask_size").isNull()
    return out.withColumn("reject", F.when(F.col("instrument").isNull(), "instrument").when(numbers, "number").when(F.col("bid") >= F.col("ask"), "crossed"))


#: What `flatten_record` reads unless told: name of the fact -> (path in the record, kind).
RECORD_SPEC = {"k": ("facts.k", "bigint"), "body": ("body", "body"), "names": ("names", "names"), "digest": ("digest", "digest")}


def flatten_record(df: DataFrame, json_col: str, spec: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Nested JSON to flat facts by a spec {fact: (dotted path, kind)}.

    The kind is a SQL type, read as it is, null if the value is of another; `digest`, null
    unless it is one; `names`, a list of texts, sorted, items of a wrong type dropped; or
    `body`, replaced by `<fact>_sha256` and `<fact>_length`. A record that is no JSON has
    null facts. The record is parsed once, as a variant.
    """
    spec = RECORD_SPEC if spec is None else spec
    doc = F.try_parse_json(json_col)

    def read(path: str, kind: str) -> Column:
        return F.try_variant_get(doc, "$." + path, kind)

    def text(path: str) -> Column:
        value = read(path, "variant")
        return F.when(F.schema_of_variant(value) == "STRING", read(path, "string"))

    out: list[Column] = []
    for fact, (path, kind) in spec.items():
        if kind == "body":
            out += [F.sha2(text(path), 256).alias(f"{fact}_sha256"), F.length(text(path)).alias(f"{fact}_length")]
        elif kind == "digest":
            out.append(F.when(S.is_digest(text(path)), text(path)).alias(fact))
        elif kind == "names":
            items = F.filter(read(path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
            out.append(F.array_sort(F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))).alias(fact))
        else:
            out.append((text(path) if kind == "string" else F.when(F.schema_of_variant(read(path, "variant")) != "STRING", read(path, kind))).alias(fact))
    return df.select(*df.columns, *out)


def parse_refs(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """K5: `digest<TAB>name` lines as rows (key, line, digest, name); malformed lines are skipped, the last line of a name wins."""
    lines = df.select(key, F.posexplode(F.split(text_col, "\n")).alias("line", "raw"))
    parts = lines.select(key, "line", F.split_part("raw", F.lit("\t"), F.lit(1)).alias("digest"), F.split_part("raw", F.lit("\t"), F.lit(2)).alias("name"))
    good = parts.where(S.is_digest(F.col("digest")) & (F.col("name") != ""))
    return good.groupBy(key, "name").agg(F.max("line").alias("line"), F.max_by("digest", "line").alias("digest"))


# --- validators ----------------------------------------------------------------
def validate_bars(df: DataFrame) -> DataFrame:
    """V1: OHLCV rows with the list of broken rules; zero and negative prices are allowed."""
    prices = ["open", "high", "low", "close"]
    infinite = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in [*prices, "volume"]))
    o, h, lo, c = (F.col(x) for x in prices)
    return df.withColumn("violations", _reasons({
        "finite": infinite, "high": ~infinite & (h < F.greatest(o, lo, c)), "low": ~infinite & (lo > F.least(o, h, c)),
        "volume": F.col("volume") < 0, "range": ~S.valid_range(F.col("start"), F.col("end")),
    }))


def validate_records(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """V2: rules for each column (required, min, max, allowed, type, unique) to a list `column:rule`; a missing column is a violation of every row."""
    checks: dict[str, Column] = {}
    out, helpers = df, []
    for name, rule in rules.items():
        if name not in df.columns:
            checks[f"{name}:missing"] = F.lit(True)
            continue
        c = F.col(name)
        if "type" in rule and df.schema[name].dataType.simpleString() != rule["type"]:
            checks[f"{name}:type"] = F.lit(True)
        if rule.get("required"):
            checks[f"{name}:null"] = c.isNull()
        if "min" in rule or "max" in rule:
            checks[f"{name}:range"] = (c < rule.get("min", float("-inf"))) | (c > rule.get("max", float("inf")))
        if "allowed" in rule:
            checks[f"{name}:allowed"] = ~c.isin(*rule["allowed"])
        if rule.get("unique"):
            out = out.withColumn(f"_n_{name}", F.count("*").over(Window.partitionBy(name)))
            helpers.append(f"_n_{name}")
            checks[f"{name}:unique"] = F.col(f"_n_{name}") > 1
    return out.withColumn("violations", _reasons(checks)).drop(*helpers)


def split_valid(df: DataFrame, col: str = "violations") -> tuple[DataFrame, DataFrame]:
    """V3: accepted rows without the list, and quarantined rows with it. Nothing is repaired."""
    return df.where(F.size(col) == 0).drop(col), df.where(F.size(col) > 0)


def validate_artifact(df: DataFrame) -> DataFrame:
    """V4: nested reviews (areas array<struct<name,status,files,evidence,remaining_risk>>, overall) with all violations `name:rule`."""
    statuses, overalls = AREA_STATUSES, OVERALL_STATUSES

    def area(a: Column) -> Column:
        bad_risk = a["status"].isin(*statuses[1:]) & (F.trim(F.coalesce(a["remaining_risk"], F.lit(""))) == "")
        rules = {
            "name": a["name"].isNull(), "status": ~F.coalesce(a["status"].isin(*statuses), F.lit(False)), "risk": bad_risk,
            "no-evidence": (a["status"] == "verified") & (F.coalesce(F.size(a["evidence"]), F.lit(0)) <= 0), "files": F.coalesce(F.size(a["files"]), F.lit(0)) <= 0,
        }
        return F.transform(_reasons(rules), lambda r: F.concat(F.coalesce(a["name"], F.lit("?")), F.lit(":"), r))

    own = F.flatten(F.transform("areas", area))
    top = _reasons({
        "areas:empty": F.coalesce(F.size("areas"), F.lit(0)) <= 0,
        "overall:invalid": ~F.coalesce(F.col("overall").isin(*overalls), F.lit(False)),
        "overall:areas": (F.col("overall") == "verified") & ~F.forall("areas", lambda a: F.coalesce(a["status"] == "verified", F.lit(False))),
    })
    return df.withColumn("violations", F.concat(top, F.coalesce(own, F.array().cast("array<string>"))))


# --- gates -------------------------------------------------------------------
def known_status(col: Column) -> Column:
    """A status as pass, fail or unknown; null and unrecognised ones are unknown, never pass."""
    return F.when(col.isin(_PASS, _FAIL), col).otherwise(_UNKNOWN)


def state_rollup(df: DataFrame, by: list[str], *states: str) -> DataFrame:
    """A3: counts by category; `all_success` is null where nothing was counted."""
    c = S.categorize_state(*(F.col(s) for s in states))
    out = df.withColumn("_c", c).groupBy(*by).agg(
        F.count("_c").alias("count"), F.count_if(F.col("_c") == "success").alias("success"), F.count_if(F.col("_c") == "pending").alias("pending"),
        F.count_if(F.col("_c") == "failed").alias("failed"), F.count_if(F.col("_c") == "skipped-or-unknown").alias("skipped_or_unknown"),
    )
    return out.withColumn("all_success", F.when(F.col("count") > 0, F.col("success") == F.col("count")))


def gate_summary(gates: DataFrame, by: list[str]) -> DataFrame:
    """A4: counts of (name, status) rows by group, and the sorted failing and unknown names."""
    s = known_status(F.col("status"))
    return gates.groupBy(*by).agg(
        F.count_if(s == _PASS).alias("pass"), F.count_if(s == _FAIL).alias("fail"), F.count_if(s == _UNKNOWN).alias("unknown"),
        F.array_sort(F.collect_list(F.when(s == _FAIL, F.col("name")))).alias("failed_gates"), F.array_sort(F.collect_list(F.when(s == _UNKNOWN, F.col("name")))).alias("unknown_gates"),
    )


def overall_status(fail: Column, unknown: Column, warnings: Column, truncated: Column) -> Column:
    """A5: fail, else partial with anything unknown, warned of or cut, else pass."""
    return F.when(fail > 0, _FAIL).when((unknown > 0) | (F.coalesce(warnings, F.lit(0)) > 0) | F.coalesce(truncated, F.lit(False)), "partial").otherwise(_PASS)


def disposition(gates: DataFrame, by: list[str], identity: tuple[str, ...] = (), lifecycle: str | None = None) -> DataFrame:
    """Proceed only if every gate passes. Failing gates with reasons; identity and lifecycle failures are listed again under a prefix. Repair is never automatic."""
    s, name = known_status(F.col("status")), F.col("name").cast("string")
    reason = F.coalesce(F.col("detail"), F.lit("no detail")) if "detail" in gates.columns else F.lit("no detail")
    failing = F.when(s == _FAIL, F.struct(name.alias("gate"), reason.alias("reason")))
    again = F.when((s == _FAIL) & name.isin(*identity), F.struct(F.concat(F.lit("identity:"), name).alias("gate"), reason.alias("reason"))) if identity else F.lit(None)
    more = F.when((s == _FAIL) & (name == lifecycle), F.struct(F.lit("lifecycle_consistency").alias("gate"), reason.alias("reason"))) if lifecycle else F.lit(None)
    lists = [F.array_sort(F.collect_list(c)) for c in (failing, more, again) if c is not None and c._jc.toString() != "NULL"]
    out = gates.groupBy(*by).agg(F.count_if(s == _PASS).alias("pass"), F.count_if(s == _FAIL).alias("fail"), F.count_if(s == _UNKNOWN).alias("unknown"), F.concat(*lists).alias("failed_gates"))
    status = F.when(F.col("fail") > 0, _FAIL).when(F.col("unknown") > 0, "partial").otherwise(_PASS)
    out = out.withColumn("status", status).withColumn("disposition", F.when(status == _PASS, "proceed").otherwise("stop"))
    return out.withColumn("auto_remediation_allowed", F.lit(False))


def dependency_gate(edges: DataFrame, by: list[str], state: str = "state", declared: str | None = None, truncated: str | None = None) -> DataFrame:
    """Any open dependency fails; a cut list, another count than declared or an unknown state is unknown; else pass."""
    st = F.upper(F.col(state))
    extra = [F.max(declared).alias("_declared")] if declared else [F.count("*").alias("_declared")]
    extra.append((F.bool_or(truncated) if truncated else F.bool_or(F.lit(False))).alias("_truncated"))
    out = edges.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(st == "OPEN").alias("unresolved"), F.count_if(st == "CLOSED").alias("resolved"),
        F.count_if(~F.coalesce(st.isin("OPEN", "CLOSED"), F.lit(False))).alias("unknown_state"), *extra,
    )
    gate = F.when(F.col("unresolved") > 0, _FAIL).when(F.col("_truncated") | (F.col("_declared") != F.col("total")) | (F.col("unknown_state") > 0), _UNKNOWN).otherwise(_PASS)
    return out.withColumn("gate", gate).drop("_declared", "_truncated")


def set_digest(df: DataFrame, by: list[str], item: str, digits: int = 3) -> DataFrame:
    """A digest of each group's members that does not depend on their order; null members are none.

    Members are dealt to blocks by the first `digits` of their own digests; a block's
    digest is that of its sorted members, the group's that of its blocks in order. So a
    group of any size is gathered as one line for each of at most 16**digits blocks.
    """
    member = df.select(*by, F.sha2(F.col(item).cast("string"), 256).alias("_h"))
    block = member.groupBy(*by, F.substring("_h", 1, digits).alias("_k")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"), F.count("_h").alias("_n"))
    lines = F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.concat("_k", F.lit(":"), "_d"))))
    return block.groupBy(*by).agg(F.sha2(F.array_join(lines, ","), 256).alias("digest"), F.sum("_n").alias("members"))


def run_rollup(df: DataFrame, by: list[str], expected: int | Column, name: str = "name", seq: str = "seq", ok: str = "ok") -> DataFrame:
    """Commands run, passed and failed, and the first failure in order; a run passes if all that were expected ran and passed."""
    out = df.groupBy(*by).agg(F.count("*").alias("ran"), F.count_if(ok).alias("passed"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("failed"), F.min_by(name, F.when(~F.coalesce(F.col(ok), F.lit(False)), F.col(seq))).alias("first_failure"))
    return out.withColumn("first_failure", F.when(F.col("failed") > 0, F.col("first_failure"))).withColumn("status", F.when((F.col("ran") == expected) & (F.col("failed") == 0), _PASS).otherwise(_FAIL))


def require_all(gates: DataFrame, subjects: DataFrame, names: DataFrame, by: str, if_present: bool = False) -> DataFrame:
    """Every named gate of every subject passes; a missing one fails, or is skipped in the if-present form. `names` is a small fixed list, whose size is checked."""
    wanted = subjects.select(by).distinct().transform(lambda subject: param_grid(subject, names.select("name")))
    ok = F.coalesce(F.col("status") == _PASS, F.lit(if_present))
    return wanted.join(gates.select(by, "name", known_status(F.col("status")).alias("status")), [by, "name"], "left").groupBy(by).agg(F.bool_and(ok).alias("satisfied"))


def decide(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """A decision table: reasons of the rules that hold, distinct in order; eligible only without any."""
    reasons = F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in rules))))
    return df.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


# --- comparisons of recorded and current facts ----------------------------------
def uncovered(required: DataFrame, areas: DataFrame, item: str, files: str = "files") -> DataFrame:
    """Items that no area's list covers."""
    covered = areas.select(F.explode(files).alias(item)).distinct()
    return required.join(covered, item, "left_anti")


def required_satisfied(required: DataFrame, observed: DataFrame, by: str, name: str = "name", category: str = "category", configured_empty: bool = False) -> DataFrame:
    """Any failed, pending or unknown check is false; else every required name is a success. A subject that requires nothing needs all to be
    successes and at least one, or may have none if that is how it is configured."""
    totals = observed.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(category) == "success", F.lit(False))).alias("other"))
    wins = observed.where(F.col(category) == "success").select(by, name).distinct().withColumn("won", F.lit(True))
    needs = required.join(wins, [by, name], "left").groupBy(by).agg(F.bool_and(F.coalesce("won", F.lit(False))).alias("met"))
    both = totals.join(needs, by, "full_outer")
    n, other = F.coalesce("n", F.lit(0)), F.coalesce("other", F.lit(0))
    return both.select(by, F.when(other > 0, False).when(F.col("met").isNotNull(), F.col("met")).otherwise(F.lit(configured_empty) | (n > 0)).alias("satisfied"))


def exact_set_gate(df: DataFrame, observed: str, expected: str, count: str, truncated: str) -> DataFrame:
    """Pass only if the list is whole, its count is right and it equals the expected set; malformed facts are unknown."""
    malformed = F.col(observed).isNull() | F.exists(observed, lambda x: x.isNull()) | F.col(count).isNull() | (F.col(count) < 0) | F.col(truncated).isNull()
    exact = ~F.col(truncated) & (F.col(count) == F.size(expected)) & (F.array_sort(observed) == F.array_sort(expected))
    return df.withColumn("gate", F.when(malformed, _UNKNOWN).when(exact, _PASS).otherwise(_FAIL))


def snapshot_drift(before: DataFrame, after: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """By key, whether it is stable, the sorted names of changed columns, and both fingerprints; null equals null."""
    b = before.select(F.col(key), *(F.col(c).alias(f"b_{c}") for c in cols), F.lit(True).alias("_b"))
    a = after.select(F.col(key), *(F.col(c).alias(f"a_{c}") for c in cols), F.lit(True).alias("_a"))
    j = null_safe_join(b, a, [key], "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in sorted(cols))))
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    prints = [F.when(F.col(f"_{s}"), F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(f"{s}_{c}").cast("string"), F.lit("\x00")) for c in sorted(cols))), 256)).alias(f"{n}_fingerprint") for s, n in (("b", "before"), ("a", "after"))]
    return j.select(key, (there & (F.size(changed) == 0)).alias("stable"), changed.alias("changed"), *prints)


def is_fresh(artifacts: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Recorded (head, digest) against current ones: fresh, and the reason if not; an unknown current digest is not compared."""
    c = current.select(F.col(key), F.col("head").alias("now_head"), F.col("digest").alias("now_digest"))
    j = artifacts.join(c, key, "left")
    reason = F.when(~F.col("head").eqNullSafe(F.col("now_head")) | F.col("head").isNull(), "head-changed").when(F.col("now_digest").isNotNull() & ~F.col("digest").eqNullSafe(F.col("now_digest")), "digest-changed").otherwise("fresh")
    return j.select(*artifacts.columns, (reason == "fresh").alias("fresh"), reason.alias("reason"))


def source_agreement(a: DataFrame, b: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """One fact from two sources: differing columns fail, a source that is absent gives at most partial."""
    x = a.select(F.col(key), *(F.col(c).alias(f"x_{c}") for c in cols), F.lit(True).alias("_x"))
    y = b.select(F.col(key), *(F.col(c).alias(f"y_{c}") for c in cols), F.lit(True).alias("_y"))
    j = null_safe_join(x, y, [key], "full_outer")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    conflicts = F.array_compact(F.array(*(F.when(both & ~F.col(f"x_{c}").eqNullSafe(F.col(f"y_{c}")), F.lit(c)) for c in cols)))
    return j.select(key, conflicts.alias("conflicts"), F.when(F.size(conflicts) > 0, _FAIL).when(~both, "partial").otherwise(_PASS).alias("status"))


def latest_effective(events: DataFrame, key: str, ts: str, kind: str, seq: str, opened: str = "open", closed: str = "close", reopened: str = "reopen", truncated: str | None = None) -> DataFrame:
    """The last close that no later reopen cancels; a cut history is unknown."""
    at = F.struct(F.col(ts), F.col(seq))
    out = events.groupBy(key).agg(F.max(F.when(F.col(kind) == closed, at)).alias("_c"), F.max(F.when(F.col(kind) == reopened, at)).alias("_r"), (F.bool_or(truncated) if truncated else F.bool_or(F.lit(False))).alias("_t"))
    effective = F.col("_c").isNotNull() & (F.col("_r").isNull() | (F.col("_c") > F.col("_r")))
    return out.select(key, F.when(F.col("_t"), "unknown").when(effective, "closed").otherwise("open").alias("state"), F.when(~F.col("_t") & effective, F.col("_c")[ts]).alias("closed_at"))
