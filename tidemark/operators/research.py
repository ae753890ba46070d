"""A whole modelling run in time order, the recomputation of what it reports, and the findings of its audit."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import modelling as L
from tidemark.operators.asof import global_row_numbers
from tidemark.session import stored

# fixed values: families from the simplest on, tolerances of the choice, gaps that count as overfitting
BINARY, REGRESSION = ("historical_frequency", "logistic", "boosted_stumps"), ("historical_mean", "ridge", "boosted_stumps")
TOLERANCE, GAP = {"binary": 0.005, "regression": 0.05}, {"binary": 0.03, "regression": 0.50}
STUMP_RATE = 0.12


@dataclass(frozen=True)
class Target:
    """A label column; binary or regression. Rows whose label is null don't count for it."""

    name: str
    kind: str = "binary"


@dataclass(frozen=True)
class Plan:
    """train_end and the closed ranges after it, in microseconds; folds by position within the training rows."""

    train_end: int
    calibration: tuple[int, int]
    final: tuple[int, int]
    minimum: int
    validation: int
    step: int


class EmbargoError(ValueError):
    """Outcomes of one range became known only after the next had begun."""


def _fit(train: DataFrame, features: list[str], target: Target, family: str):
    """A function from rows to the column of predictions, and the features' effects; fitted on train alone."""
    if family.startswith("historical"):
        s = train.filter(F.col(target.name).isNotNull()).agg(F.sum(F.col(target.name).cast("double")), F.count("*")).first()
        value = (s[0] or 0.0) + 1, s[1] + 2
        p = value[0] / value[1] if target.kind == "binary" else (s[0] or 0.0) / max(s[1], 1)
        return lambda rows: rows.withColumn("p", F.lit(float(p))), {}
    stats = L.feature_statistics(train, features)
    z, names = L.standardised(train, stats, features)
    cells = L.Cells(z.withColumns({n: F.round(n, 12) for n in names}), names, target.name)
    if family == "boosted_stumps":
        base, stumps = L.fit_stumps(cells, binary=target.kind == "binary")
        steps = [F.when(F.col(names[j]) <= t, a).otherwise(b) * STUMP_RATE for j, t, a, b, _ in stumps]
        raw = reduce(lambda x, y: x + y, steps, F.lit(float(base)))
        gain = sum(g for *_, g in stumps) or 1.0
        effects = {n: sum(g for j, *_, g in stumps if names[j] == n) / gain for n in names}
    else:
        w = (L.fit_logistic if target.kind == "binary" else L.fit_ridge)(cells)
        raw = reduce(lambda x, y: x + y, [F.col(n) * float(k) for n, k in zip(names, w[1:])], F.lit(float(w[0])))
        effects = dict(zip(names, map(float, w[1:])))
    p = _sigmoid(raw) if target.kind == "binary" else _signed(raw, target)
    return lambda rows: L.standardised(rows, stats, features)[0].withColumn("p", p), effects


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))


def _signed(x: Column, target: Target) -> Column:
    """Favourable excursions are never below 0, adverse ones never above."""
    if target.name.startswith("mfe"):
        return F.greatest(F.lit(0.0), x)
    return F.least(F.lit(0.0), x) if target.name.startswith("mae") else x


def _loss(scored: DataFrame, target: Target) -> float:
    e = F.col("p") - F.col(target.name)
    v = scored.filter(F.col(target.name).isNotNull()).agg(F.avg(e * e if target.kind == "binary" else F.abs(e))).first()[0]
    return float("nan") if v is None else v


def split_rows(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows with split and pos, the position among the training rows in (as_of_us, id); raises on outcomes over a border."""
    labelled = rows.withColumn("split", L.split_label(F.col("as_of_us"), plan.train_end, plan.calibration, plan.final))
    if not L.embargo_breaches(labelled, plan.calibration[0], plan.final[0]).isEmpty():
        raise EmbargoError("outcomes become known after the next range has begun")
    train = global_row_numbers(labelled.filter("split = 'train'"), ["as_of_us", "id"]).withColumn("pos", F.col("position") - 1).drop("position")
    return stored(train.unionByName(labelled.filter("split <> 'train'"), allowMissingColumns=True), "split")


def run(rows: DataFrame, features: list[str], targets: list[Target], plan: Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, predictions, effects) of every family for every target.

    rows: id, as_of_us, outcome_us, the features and the targets' columns. report: target, kind, model, rank, cv, train,
    final, selected, flags. predictions: target, model, id, p over the final test rows. effects: target, model, fold,
    feature, effect. Families are fitted on purged expanding folds (their losses rounded to six digits before the mean),
    the simplest within the tolerance of the best is selected, all are fitted again on the whole training range; binary
    ones but the frequency are calibrated on the calibration range. Each fit is passes over the rows or over their
    distinct feature rows; what returns are sums, so the rows may be any number.
    """
    spark = rows.sparkSession
    data = split_rows(rows, plan)
    train, held, final = (data.filter(F.col("split") == s) for s in ("train", "calibration", "final_test"))
    folds = L.walk_forward_folds(train, plan.minimum, plan.validation, plan.step, ["as_of_us", "id"]).orderBy("fold").collect()
    if len(folds) < 2:
        raise ValueError("walk-forward selection needs two folds")
    scores, effects, predictions = [], [], []
    for t in targets:
        for rank, family in enumerate(BINARY if t.kind == "binary" else REGRESSION):
            losses = []
            for f in folds:
                part = train.filter((F.col("pos") < f["start_position"]) & (F.col("outcome_us") < f["first_us"]))
                predict, found = _fit(part, features, t, family)
                check = train.filter((F.col("pos") >= f["start_position"]) & (F.col("pos") < f["start_position"] + plan.validation))
                losses.append(round(_loss(predict(check), t), 6))
                effects += [(t.name, family, f["fold"], k, float(v)) for k, v in found.items()]
            predict, _ = _fit(train, features, t, family)
            fitted, out = _loss(predict(train), t), predict(final)
            if t.kind == "binary" and family != BINARY[0]:
                q = lambda p: F.least(F.greatest(p, F.lit(1e-8)), F.lit(1 - 1e-8))
                logit = F.log(q(F.col("p")) / (1 - q(F.col("p"))))
                a, b = L.fit_platt(L.Cells(predict(held).withColumn("logit", F.round(logit, 12)), ["logit"], t.name))
                out = out.withColumn("p", _sigmoid(F.lit(float(a)) + F.lit(float(b)) * logit))
            predictions.append(out.select(F.lit(t.name).alias("target"), F.lit(family).alias("model"), "id", "p", F.col(t.name).cast("double").alias("y")))
            scores.append((t.name, t.kind, family, rank, sum(losses) / len(losses), fitted))
    scored = stored(reduce(DataFrame.unionByName, predictions), "predictions")
    e = F.col("p") - F.col("y")
    last = scored.filter("y is not null").groupBy("target", "model").agg(F.avg(e * e).alias("_b"), F.avg(F.abs(e)).alias("_a"))
    report = spark.createDataFrame(scores, "target string, kind string, model string, rank int, cv double, train double").join(last, ["target", "model"], "left")
    report = report.withColumn("final", F.when(F.col("kind") == "binary", F.col("_b")).otherwise(F.col("_a"))).drop("_a", "_b")
    chosen = [L.select_simplest(report.filter(F.col("kind") == k).withColumnRenamed("cv", "score"), x) for k, x in TOLERANCE.items()]
    chosen = reduce(DataFrame.unionByName, chosen).withColumn("selected", F.lit(True))
    report = report.join(chosen, ["target", "model"], "left").fillna(False, ["selected"])
    gap = F.when(F.col("kind") == "binary", GAP["binary"]).otherwise(GAP["regression"])
    flags = F.array(F.when(F.col("cv") - F.col("train") > gap, "TRAIN_TO_WALK_FORWARD_GAP"), F.when(F.col("final") - F.col("cv") > gap, "FINAL_TEST_DEGRADATION"))
    return report.withColumn("flags", F.array_compact(flags)), scored, spark.createDataFrame(effects, "target string, model string, fold int, feature string, effect double")


def reversal(predictions: DataFrame) -> DataFrame:
    """Predictions of continuation as those of its reversal; rows without a label stay out."""
    return predictions.filter("y is not null").withColumns({"target": F.lit("reversal"), "p": 1 - F.col("p"), "y": 1 - F.col("y")})


def reproduce(report: DataFrame, predictions: DataFrame, rows: DataFrame, labels: dict[str, str], tolerance: float = 1.1e-6) -> DataFrame:
    """(target, model, reported, recomputed, matches): the report's final losses against a second way to them, SQL over the
    predictions joined to the rows' own labels. labels: target to SQL expression over rows. A model without a counterpart
    on either side doesn't match."""
    spark = report.sparkSession
    cases = " ".join(f"when '{t}' then cast({x} as double)" for t, x in labels.items())
    sums = spark.sql(
        f"""select target, model, sum((p - l) * (p - l)) / count(1) squared, sum(abs(p - l)) / count(1) absolute
        from (select p.target, p.model, p.p, case p.target {cases} end l from {{predictions}} p join {{rows}} r on p.id = r.id) where l is not null group by target, model""",
        predictions=predictions, rows=rows,
    )
    both = report.select("target", "model", "kind", F.col("final").alias("reported")).join(sums, ["target", "model"], "full")
    again = F.when(F.col("kind") == "binary", F.col("squared")).otherwise(F.col("absolute"))
    return both.select("target", "model", "reported", again.alias("recomputed"), F.coalesce(F.abs(F.col("reported") - again) <= tolerance, F.lit(False)).alias("matches"))


def leakage_probes(rows: DataFrame, trained_through_us: int | None = None) -> DataFrame:
    """(probe, n): rows whose features became available after their prediction, whose outcome was known at it, and
    (with trained_through_us) final test rows predicted before the model's training data ended."""
    late = [F.count_if(F.col("features_available_us") > F.col("as_of_us")).alias("feature"), F.count_if(F.col("outcome_us") <= F.col("as_of_us")).alias("outcome")]
    if trained_through_us is not None:
        late.append(F.count_if((F.col("split") == "final_test") & (F.col("as_of_us") <= trained_through_us)).alias("trained_through"))
    one = rows.agg(*late)
    return one.select(F.explode(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in one.columns]))).alias("probe", "n"))


FINDING = "check_id string, status string, severity string, detail string"


def findings(rows: DataFrame, report: DataFrame, predictions: DataFrame, reproduction: DataFrame, best: DataFrame, survivorship_safe: bool, most_share: float = 0.30) -> DataFrame:
    """(check_id, status, severity, detail): what the audit found, a row per check; see blockers.

    rows: as for run, with split, features_available_us, net, gross and cost; best: the top rows of a selected model with
    security, gross, cost (see metrics.top_rows).
    """
    r = reproduction.agg(F.count("*"), F.count_if("matches")).first()
    probes = {x["probe"]: x["n"] for x in leakage_probes(rows).collect()}
    costs = rows.filter(F.abs(F.col("net") - F.col("gross") + F.col("cost")) > 1e-8).count()
    stress = {x["factor"]: x["expectancy"] for x in M.cost_stress(best).collect()}
    share = best.groupBy("security").count().agg(F.max("count") / F.sum("count")).first()[0] or 0.0
    flagged = report.filter(F.size("flags") > 0).count()
    unlabelled = predictions.filter("p is null").count()
    checks = [
        ("INDEPENDENT_REPRODUCTION", r[0] == r[1] and r[0] > 0, "blocker", f"{r[1]} of {r[0]} values match"),
        ("FEATURE_LEAKAGE", probes["feature"] == 0, "blocker", f"{probes['feature']} rows"),
        ("OUTCOME_LEAKAGE", probes["outcome"] == 0, "blocker", f"{probes['outcome']} rows"),
        ("COST_RECONCILIATION", costs == 0, "blocker", f"{costs} rows"),
        ("COST_STRESS", all(v is not None and v > 0 for v in stress.values()), "major", ", ".join(f"{k:g}x {v:.6f}" for k, v in sorted(stress.items()) if v is not None)),
        ("SECURITY_CONCENTRATION", share <= most_share, "major", f"largest share {share:.6f}"),
        ("OVERFITTING", flagged == 0, "major", f"{flagged} models flagged"),
        ("PREDICTIONS_COMPLETE", unlabelled == 0, "blocker", f"{unlabelled} without value"),
        ("SURVIVORSHIP", survivorship_safe, "blocker", "universe is" + ("" if survivorship_safe else " not") + " survivorship safe"),
    ]
    return rows.sparkSession.createDataFrame([(c, "pass" if ok else "fail", sev, d) for c, ok, sev, d in checks], FINDING)


def blockers(found: DataFrame) -> DataFrame:
    """Findings that block: of severity blocker and not passed."""
    return found.filter("severity = 'blocker' and status <> 'pass'")


def markdown(found: DataFrame) -> str:
    """The findings as a Markdown table, the failed ones first: a row per check."""
    rows = sorted(found.collect(), key=lambda r: (r["status"] == "pass", r["check_id"]))
    lines = [f"| {r['check_id']} | {r['status'].upper()} | {r['severity'].upper()} | {r['detail'].replace('|', '/')} |" for r in rows]
    return "\n".join(["| check | status | severity | detail |", "| --- | --- | --- | --- |", *lines, ""])
