"""Scores of predictions (C9: A1-A6, D3-D8, D11-D14, D16, D19, A10-A12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import norm_label
from .common import global_rank
from .split import stratified_sample

#: Blocks of which a running accuracy takes the sum before it adds up groups.
GROUP = 10_000


def equal(gold: Column, pred: Column, rule: str = "normalised") -> Column:
    """Three rules of equality: normalised (scorer), raw with null as empty (composer), raw (log)."""
    if rule == "normalised":
        return norm_label(gold) == norm_label(pred)
    if rule == "empty":
        return gold == F.coalesce(pred, F.lit(""))
    return F.coalesce(gold == pred, F.lit(False))


def confusion(df: DataFrame, gold: str = "gold", pred: str = "predicted") -> DataFrame:
    return df.groupBy(norm_label(F.col(gold)).alias("gold"), norm_label(F.col(pred)).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, gold: str = "gold", pred: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support of gold classes, from the confusion counts alone."""
    c = confusion(df, gold, pred)
    g = c.groupBy("gold").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy("predicted").agg(F.sum("n").alias("said"))
    j = g.join(p, g["gold"] == p["predicted"], "left").withColumn("said", F.coalesce("said", F.lit(0)))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    prec, rec = div(F.col("tp"), F.col("said")), div(F.col("tp"), F.col("support"))
    return j.select(F.col("gold").alias("label"), prec.alias("precision"), rec.alias("recall"), F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("f1"), "support")


def summary(df: DataFrame, gold: str = "gold", pred: str = "predicted") -> DataFrame:
    """accuracy, macro_f1 (mean over gold classes), n, classes, hallucinated."""
    c = confusion(df, gold, pred)
    acc = c.agg((F.sum(F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    mac = per_class(df, gold, pred).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("classes"))
    hal = hallucinated(df, gold, pred).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hallucinated"))
    return acc.crossJoin(mac).crossJoin(hal).select("accuracy", "macro_f1", "n", "classes", "hallucinated")


def hallucinated(df: DataFrame, gold: str = "gold", pred: str = "predicted") -> DataFrame:
    """Labels that are predicted but never gold, with counts."""
    c = confusion(df, gold, pred)
    return c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n")).join(c.select(F.col("gold").alias("label")).distinct(), "label", "left_anti")


def distribution(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("t"))).select("label", "n", (F.col("n") / F.col("t")).alias("share"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two annotators over all and by class of the first, Cohen's kappa over all."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    same = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0))
    per = c.groupBy(F.col("a").cast("string").alias("label")).agg(F.sum("n").alias("n"), (same / F.sum("n")).alias("agreement")).withColumn("kappa", F.lit(None).cast("double"))
    ra, rb = c.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na")), c.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb"))
    chance = ra.join(rb, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("m"))
    total = c.agg(F.sum("n").alias("n"), (same / F.sum("n")).alias("agreement")).crossJoin(chance)
    pe = F.col("m") / (F.col("n") * F.col("n"))
    total = total.select(F.lit("_all").alias("label"), "n", "agreement", F.when(pe < 1, (F.col("agreement") - pe) / (1 - pe)).alias("kappa"))
    return per.unionByName(total)


def confused_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """The unordered pair of labels that two annotators confuse most (ties: first by name)."""
    lo, hi = F.least(F.col(a).cast("string"), F.col(b).cast("string")), F.greatest(F.col(a).cast("string"), F.col(b).cast("string"))
    return df.filter(F.col(a) != F.col(b)).groupBy(lo.alias("label_1"), hi.alias("label_2")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label_1", "label_2").limit(1)


def ensemble(df: DataFrame, gold: str, a: str, b: str) -> DataFrame:
    """both, only_a, only_b, neither: what an oracle over two predictors could reach."""
    ra, rb = F.col(gold) == F.col(a), F.col(gold) == F.col(b)
    return df.groupBy(F.when(ra & rb, "both").when(ra, "only_a").when(rb, "only_b").otherwise("neither").alias("outcome")).agg(F.count("*").alias("n"))


def threshold_sweep(df: DataFrame, conf: str, correct: Column, hard: Column | None = None, steps: int = 40) -> DataFrame:
    """coverage, accuracy and false_cheap at thresholds i / steps. Rows are first counted by the
    number of thresholds that they reach, so the work on thresholds doesn't grow with the rows."""
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    k = F.size(F.filter(grid, lambda t: t <= F.col(conf)))
    hard = F.lit(False) if hard is None else hard
    cells = df.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(correct.cast("long")).alias("c"), F.sum(hard.cast("long")).alias("h"))
    points = df.sparkSession.range(steps + 1).select(F.col("id").alias("i"))
    above = points.join(F.broadcast(cells), F.col("k") > F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("covered"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.sum("h"), F.lit(0)).alias("false_cheap"))
    total = cells.agg(F.sum("n").alias("total"))
    return above.crossJoin(total).select((F.col("i") / steps).alias("threshold"), "covered", (F.col("covered") / F.col("total")).alias("coverage"), F.when(F.col("covered") > 0, F.col("c") / F.col("covered")).alias("accuracy"), "false_cheap")


def quantiles(df: DataFrame, value: str, qs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Linear interpolation."""
    return df.agg(*[F.expr(f"percentile({value}, {q}D)").alias(f"p{int(q * 100)}") for q in qs], F.median(value).alias("median"))


def running_accuracy(df: DataFrame, pos: str, correct: Column, every: int = 50) -> DataFrame:
    """Accuracy so far at each ``every``-th row. Rows are ranked by range partitions and counted in
    blocks; sums of blocks so far are sums within groups of ``GROUP`` blocks and of the groups before, so
    a window over all rows runs over one row for each group."""
    ranked = global_rank(df.withColumn("_c", correct.cast("long")).select(pos, "_c"), pos, name="_r")
    blocks = ranked.groupBy(F.floor((F.col("_r") - 1) / every).alias("block")).agg(F.count("*").alias("n"), F.sum("_c").alias("c")).withColumn("g", F.floor(F.col("block") / GROUP))
    whole = W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    groups = blocks.groupBy("g").agg(F.sum("n").alias("gn"), F.sum("c").alias("gc"))
    groups = groups.select("g", *[F.coalesce(F.sum(x).over(whole), F.lit(0)).alias(x) for x in ("gn", "gc")])
    own = W.partitionBy("g").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    n, c = (F.sum(x).over(own) for x in "nc")
    out = blocks.select("g", n.alias("n"), c.alias("c")).join(groups, "g")
    return out.select((F.col("n") + F.col("gn")).alias("n_seen"), ((F.col("c") + F.col("gc")) / (F.col("n") + F.col("gn"))).alias("accuracy"))


def uncertainty_queue(df: DataFrame, conf: str, key: str, k: int = 100) -> DataFrame:
    return df.orderBy(F.col(conf).asc_nulls_last(), key).limit(k)


def routing_cost(df: DataFrame, chars: Column, cheap: Column, price_cheap: float, price_dear: float, out_tokens: int = 300) -> DataFrame:
    """Cost of all events when cheap ones are routed and when none is: chars/4 input and a fixed
    number of output tokens, prices by million tokens."""
    tokens = F.floor(chars / 4).cast("long") + out_tokens
    return df.agg(F.count("*").alias("events"), F.sum(cheap.cast("long")).alias("cheap"), F.sum(tokens).alias("tokens"), F.sum(F.when(cheap, tokens).otherwise(0)).alias("cheap_tokens")).select("events", "cheap", (F.col("tokens") * F.lit(price_dear) / 1e6).alias("cost_all_dear"), ((F.col("cheap_tokens") * F.lit(price_cheap) + (F.col("tokens") - F.col("cheap_tokens")) * F.lit(price_dear)) / 1e6).alias("cost_routed"))


def scoring_gap(a: DataFrame, b: DataFrame, gold: str = "gold", pred: str = "predicted") -> DataFrame:
    acc = lambda d, n: d.agg(F.avg(equal(F.col(gold), F.col(pred)).cast("double")).alias(n))
    return acc(a, "accuracy_a").crossJoin(acc(b, "accuracy_b")).withColumn("gap", F.col("accuracy_a") - F.col("accuracy_b"))


def training_log(df: DataFrame, step: str, loss: str) -> DataFrame:
    """Best validation loss, its step, and the first step from which the loss only rises to the
    end (onset of overfitting; null if the last step is the best)."""
    best = df.agg(F.min(loss).alias("best_loss"), F.min_by(step, F.struct(loss, step)).alias("best_step"), F.max(step).alias("last_step"))
    up = df.withColumn("_next", F.lead(loss).over(W.orderBy(step)))
    last_drop = up.filter(F.col("_next") <= F.col(loss)).agg(F.max(step).alias("d"))
    onset = up.crossJoin(last_drop).filter((F.col(step) > F.coalesce("d", F.lit(-1))) & F.col("_next").isNotNull()).agg(F.min(step).alias("onset_step"))
    return best.crossJoin(onset)


def output_guardrails(df: DataFrame, output: str, source: str, latency: str, escalated: Column) -> DataFrame:
    """JSON validity, mean lengths, latency quantiles and escalation rate."""
    return df.agg(F.avg(F.expr(f"try_parse_json({output}) is not null").cast("double")).alias("json_rate"), F.avg(F.length(output)).alias("mean_output"), F.avg(F.length(source)).alias("mean_source"), F.expr(f"percentile({latency}, 0.5D)").alias("p50"), F.expr(f"percentile({latency}, 0.95D)").alias("p95"), F.avg(escalated.cast("double")).alias("escalation"))


def sizing(df: DataFrame, label: str, minimum: int = 50) -> DataFrame:
    """Classes against the least number of rows that they should have."""
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= minimum)


def confusion_matrix(df: DataFrame, gold: str = "gold", pred: str = "predicted", most: int = 200) -> DataFrame:
    """One row for each label, gold or predicted, and a column of counts for each. Refuses more than
    ``most`` labels, since each is a column."""
    c = confusion(df, gold, pred)
    both = c.select(F.col("gold").alias("label")).union(c.select(F.col("predicted").alias("label"))).filter("label is not null").distinct()
    labels = sorted(r.label for r in both.limit(most + 1).collect())
    if len(labels) > most:
        raise ValueError(f"more than {most} labels")
    counts = [F.sum(F.when(F.col("predicted") == x, F.col("n")).otherwise(0)).alias(x) for x in labels]
    return both.join(c, both["label"] == c["gold"], "left").groupBy("label").agg(*counts).fillna(0, labels)


def headroom(df: DataFrame, key: str, gold: str, floor: str, ceiling: str, per_class: int = 30, seed: int = 42) -> DataFrame:
    """One row: accuracy of a cheap and of a strong predictor on a stratified sample, and what lies between."""
    sample = stratified_sample(df, key, gold, per_class, seed)
    ok = lambda c: F.avg((norm_label(F.col(gold)) == norm_label(F.col(c))).cast("double"))
    return sample.agg(F.count("*").alias("n"), ok(floor).alias("floor"), ok(ceiling).alias("ceiling")).withColumn("headroom", F.col("ceiling") - F.col("floor"))


def drift_check(fresh: DataFrame, shipped: float, tolerance: float = 0.02, gold: str = "gold", pred: str = "predicted") -> DataFrame:
    """One row: accuracy of a fresh sample against the number that was shipped."""
    a = summary(fresh, gold, pred).select("accuracy", "n")
    return a.withColumn("shipped", F.lit(float(shipped))).withColumn("change", F.col("accuracy") - F.col("shipped")).withColumn("drifted", F.col("change") < -F.lit(float(tolerance)))


def receipts(events: DataFrame, decisions: DataFrame, key: str, correct: Column) -> DataFrame:
    """One row: accuracy over all events of a stream and over its distinct keys; ``decisions`` has each key once."""
    joined = events.join(decisions, key)
    once = decisions.join(events.select(key).distinct(), key)
    return joined.agg(F.count("*").alias("events"), F.avg(correct.cast("double")).alias("by_volume")).crossJoin(once.agg(F.count("*").alias("distinct_keys"), F.avg(correct.cast("double")).alias("by_key")))


def evaluation_report(df: DataFrame, gold: str = "gold", pred: str = "predicted", most: int = 20) -> str:
    """Markdown: scores, classes and the ``most`` frequent confusions."""
    s = summary(df, gold, pred).first()
    out = [f"accuracy {s.accuracy:.4f}, macro F1 {s.macro_f1:.4f}, {s.n} rows, {s.classes} classes, {s.hallucinated} predictions outside of them", "", "| label | precision | recall | f1 | support |", "|---|---|---|---|---|"]
    out += [f"| {r.label} | {r.precision:.4f} | {r.recall:.4f} | {r.f1:.4f} | {r.support} |" for r in per_class(df, gold, pred).orderBy("label").collect()]
    worst = confusion(df, gold, pred).filter("gold <> predicted").orderBy(F.desc("n"), "gold", "predicted").limit(most).collect()
    return "\n".join([*out, "", "| gold | predicted | n |", "|---|---|---|", *(f"| {r.gold} | {r.predicted} | {r.n} |" for r in worst)]) + "\n"
