"""The production feedback loop."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import input_hash

#: The prediction log. ``pos`` is the order of the log.
LOG = T.StructType([T.StructField(n, t) for n, t in (("pos", T.LongType()), ("ts", T.TimestampType()), ("input_hash", T.StringType()), ("text", T.StringType()), ("tier", T.StringType()), ("prediction", T.StringType()), ("confidence", T.DoubleType()), ("latency_ms", T.DoubleType()), ("cost_usd", T.DoubleType()), ("feedback", T.StringType()), ("feedback_source", T.StringType()), ("model_version", T.StringType()))])


def conform(df: DataFrame) -> DataFrame:
    """The columns of LOG: absent ones are null, but an absent input_hash is computed."""
    cols = []
    for f in LOG.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "input_hash":
            cols.append(input_hash(F.col("text")).alias("input_hash"))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def tier_coverage(log: DataFrame) -> DataFrame:
    n = log.groupBy(F.col("tier").cast("string").alias("tier")).agg(F.count("*").alias("n"))
    return n.crossJoin(n.agg(F.sum("n").alias("t"))).select("tier", "n", (F.col("n") / F.col("t")).alias("share"))


def feedback_accuracy(log: DataFrame) -> DataFrame:
    """Accuracy over all feedback, the uniform audit slice and the rest (null source included)."""
    ok = (F.col("feedback") == F.col("prediction")).cast("double")
    audit = F.col("feedback_source").eqNullSafe("audit")
    return log.filter("feedback is not null").agg(F.count("*").alias("n_feedback"), F.avg(ok).alias("accuracy"), F.sum(audit.cast("long")).alias("n_audit"), F.avg(F.when(audit, ok)).alias("audit_accuracy"), F.avg(F.when(~audit, ok)).alias("biased_accuracy"))


def _bin(c: Column) -> Column:
    """Bin 0..9 of a value in [0, 1] by comparison with edges i / 10; values outside are clamped."""
    x = F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.size(F.filter(F.array(*[F.lit(i / 10) for i in range(1, 10)]), lambda e: x >= e))


def drift(log: DataFrame, window: int = 200) -> DataFrame:
    """PSI of the last ``window`` non-null confidences against all before; 0 with fewer than twice
    as many. Where the window begins is found from the log's last rows, by a bounded top-k."""
    conf = log.filter("confidence is not null").select("pos", "confidence")
    cut = conf.orderBy(F.desc("pos")).limit(window).agg(F.min("pos").alias("cut"), F.count("*").alias("m"))
    split = conf.crossJoin(F.broadcast(cut)).withColumn("now", F.col("pos") >= F.col("cut"))
    counts = split.groupBy(_bin(F.col("confidence")).alias("bin")).agg(F.sum((~F.col("now")).cast("long")).alias("r"), F.sum(F.col("now").cast("long")).alias("c"))
    every = log.sparkSession.range(10).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"))
    total = every.agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    share = lambda x, t: F.greatest(x / F.greatest(t, F.lit(1)), F.lit(1e-6))
    r, c = share(F.col("r"), F.col("tr")), share(F.col("c"), F.col("tc"))
    return every.crossJoin(total).groupBy("tr", "tc").agg(F.sum((c - r) * F.ln(c / r)).alias("raw")).select(F.col("tr").alias("n_before"), F.col("tc").alias("n_window"), F.when((F.col("tr") >= window) & (F.col("tc") >= window), F.col("raw")).otherwise(F.lit(0.0)).alias("psi"))


def status(log: DataFrame, window: int = 200, min_labels: int = 200, accuracy_floor: float = 0.9, max_psi: float = 0.2) -> DataFrame:
    """Numbers and triggers of a retraining decision; a trigger given as 0 is disabled. The floor
    looks at audit accuracy if there is any."""
    s = feedback_accuracy(log).crossJoin(drift(log, window).select("psi"))
    acc = F.coalesce("audit_accuracy", "accuracy")
    on = lambda setting, test: F.coalesce(test, F.lit(False)) if setting else F.lit(False)
    s = s.withColumn("fire_labels", on(min_labels, F.col("n_feedback") >= min_labels)).withColumn("fire_accuracy", on(accuracy_floor, acc < accuracy_floor)).withColumn("fire_drift", on(max_psi, F.col("psi") >= max_psi))
    return s.withColumn("retrain", F.col("fire_labels") | F.col("fire_accuracy") | F.col("fire_drift"))


def curate(log: DataFrame, holdout: DataFrame, key: str = "id") -> DataFrame:
    """text, label, input_hash (as stored) of labelled rows outside the holdout: the last feedback
    of each text wins, in the order in which texts first appeared. ``holdout`` has one column of
    strings, input hashes or ids. Rows whose stored hash is null group by the computed one."""
    h = holdout.select(F.col(holdout.columns[0]).cast("string").alias("h")).distinct()
    rows = log.filter("feedback is not null").withColumn("_g", F.coalesce("input_hash", input_hash(F.col("text"))))
    rows = rows.join(h, F.col("_g") == F.col("h"), "left_anti")
    if key in log.columns and dict(log.dtypes)[key] == "string":
        rows = rows.join(h, F.col(key) == F.col("h"), "left_anti")
    out = rows.groupBy("_g").agg(F.max_by(F.struct("text", F.col("feedback").alias("label"), "input_hash"), "pos").alias("r"), F.min("pos").alias("first_pos"))
    return out.select("r.text", "r.label", "r.input_hash", "first_pos")


def curation_counts(log: DataFrame, holdout: DataFrame) -> DataFrame:
    """One row: curated texts, feedback rows excluded by the holdout, feedback rows."""
    h = holdout.select(F.col(holdout.columns[0]).cast("string").alias("h")).distinct()
    fed = log.filter("feedback is not null").withColumn("_g", F.coalesce("input_hash", input_hash(F.col("text"))))
    flag = fed.join(h.withColumn("held", F.lit(True)), F.col("_g") == F.col("h"), "left")
    return flag.agg(F.countDistinct(F.when(F.col("held").isNull(), F.col("_g"))).alias("curated"), F.sum(F.col("held").isNotNull().cast("long")).alias("excluded"), F.count("*").alias("labelled"))


def manifest(log: DataFrame, holdout: DataFrame, number: int, bar: float, tiers: tuple[str, ...] = ("tier1",)) -> DataFrame:
    """One row that plans a round of retraining: what was curated and left out, how many curated labels are
    structural (a later tier's answers), the tiers that learn, and the bar of the promotion."""
    h = holdout.select(F.col(holdout.columns[0]).cast("string").alias("h")).distinct()
    rows = log.filter("feedback is not null").withColumn("_g", F.coalesce("input_hash", input_hash(F.col("text")))).join(h, F.col("_g") == F.col("h"), "left_anti")
    last = rows.groupBy("_g").agg(F.max_by("feedback_source", "pos").alias("source"))
    structural = last.agg(F.coalesce(F.sum(F.col("source").eqNullSafe("structural").cast("long")), F.lit(0)).alias("structural_labels"))
    counts = curation_counts(log, holdout)
    return counts.crossJoin(structural).select(F.lit(number).cast("long").alias("round"), F.col("curated").alias("curated_records"), F.coalesce("excluded", F.lit(0)).alias("excluded_holdout"), "structural_labels", F.lit(",".join(tiers)).alias("target_tiers"), F.lit(float(bar)).alias("promotion_bar"))


def resume(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id isn't done; a null id counts as done if a null was done."""
    d = done.select(F.col(key).alias("_done")).distinct()
    return df.join(d, F.col(key).eqNullSafe(F.col("_done")), "left_anti")


def promote(champion: float, challenger: float, bar: float, min_margin: float = 0.0, slice_id: str | None = None, ledger: set[str] = frozenset(), versions: tuple[int, int] = (0, 0)) -> dict:
    """Promotes if the challenger reaches the bar and beats the champion by the margin, never on a
    tie. A slice can be used once, whatever the outcome."""
    if slice_id is not None and slice_id in ledger:
        raise ValueError(f"slice {slice_id} has been used")
    gain = challenger - champion
    won = challenger >= bar and gain >= min_margin and gain > 0
    return {"decision": "PROMOTE" if won else "RETAIN", "margin": gain, "version": max(versions) + 1 if won else versions[0], "ledger": set(ledger) | ({slice_id} if slice_id is not None else set())}


def promote_frame(champion: DataFrame, challenger: DataFrame, bar: float, min_margin: float = 0.0) -> DataFrame:
    """The same decision over one-row frames with the column ``accuracy``."""
    j = champion.select(F.col("accuracy").alias("champion")).crossJoin(challenger.select(F.col("accuracy").alias("challenger"))).withColumn("margin", F.col("challenger") - F.col("champion"))
    return j.withColumn("decision", F.when((F.col("challenger") >= bar) & (F.col("margin") >= min_margin) & (F.col("margin") > 0), "PROMOTE").otherwise("RETAIN"))


def slice_used(ledger: DataFrame, slice_id: str) -> bool:
    return ledger.filter(F.col(ledger.columns[0]) == slice_id).limit(1).count() > 0


def adjudicate(champion: DataFrame, challenger: DataFrame, bar: float, slice_id: str, ledger_path: str, versions_path: str, min_margin: float = 0.0) -> dict:
    """``promote`` over one-row frames (accuracy, version), with its two records: the slice is appended to the
    ledger whatever the outcome, and a promotion appends a version that names the slice and the score.
    A slice that the ledger has is refused."""
    spark = champion.sparkSession
    try:
        used = slice_used(spark.read.schema("slice string").parquet(ledger_path), slice_id)
    except AnalysisException:
        used = False
    if used:
        raise ValueError(f"slice {slice_id} has been used")
    old, new = champion.first(), challenger.first()
    out = promote(old.accuracy, new.accuracy, bar, min_margin, slice_id, frozenset(), (old.version, new.version))
    spark.createDataFrame([(slice_id,)], "slice string").write.mode("append").parquet(ledger_path)
    if out["decision"] == "PROMOTE":
        spark.createDataFrame([(out["version"], slice_id, float(new.accuracy))], "version long, promoted_from_slice string, accuracy double").write.mode("append").parquet(versions_path)
    return out


def with_records(log: DataFrame, records: DataFrame) -> DataFrame:
    """The log and further records, which need not have all of its columns."""
    return log.unionByName(conform(records), allowMissingColumns=True)
