"""Point-in-time features, sequences of snapshots and leak-free splits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import age, finite, industry_features, log_count, window_days
from ..schemas import FEATURE_SCHEMA, SOURCES, TARGET
from ..session import shared_folder
from ..sources.sinks import write_snapshot
from .evidence import valid_edges
from .metrics import split_problems
from .relational import bitemporal, count_targets, guarded, known_links, reached, recent_or_referenced

VISION, NEWS = ["satellite", "viirs"], ["news"]
MOST_STEPS, MOST_COMPANIES = 366, 10_000
STATS = ["value", "count", "present", "age"]


#: What measurements read of a signal's JSON. A number's field takes JSON numbers alone; a text's takes any value as text.
READING = "origin string, provenance string, eligible_for_scoring string, surface_change double, relative_radiance_decrease double, vessel_activity_ratio double"
#: Texts of values that say nothing, as a string would too.
SILENT = ["null", "false", "0", "-0", "0.0", "-0.0", "[]", "{}"]


def said(reading: Column, name: str) -> Column:
    """Whether a JSON value says something: not null, false, zero or empty; null if the key is not there.

    The text settles it, but where a string has the text of a silent value, or null and absence
    look alike: only such rows are parsed again, as a variant.
    """
    text, raw = reading["typed"][name], reading["text"]
    v = F.try_variant_get(F.coalesce(F.try_parse_json(raw), F.parse_json(F.lit("{}"))), f"$.{name}", "variant")
    exact = F.when(v.isNotNull(), ~F.to_json(F.struct(v.alias("v"))).isin(*[f'{{"v":{x}}}' for x in [*SILENT, '""']]))
    return F.when(text.isNull() & ~F.contains(raw, F.lit(f'"{name}"')) & ~F.contains(raw, F.lit("\\u")), None).when(text.isNull() | text.isin(*SILENT), exact).otherwise(text != "")


def eligible(reading: Column) -> Column:
    """News counts unless it says otherwise; null and empty count as saying so, absence does not."""
    return F.coalesce(said(reading, "eligible_for_scoring"), F.lit(True))


def measurement(reading: Column) -> Column:
    """A signal's value: severity of eligible news, or the squashed metric of a located, documented sensor reading; else null."""
    typed = reading["typed"]
    located = F.coalesce(typed["origin"] == "location_observation", F.lit(False)) & F.coalesce(said(reading, "provenance"), F.lit(False))
    return finite(
        F.when(F.col("source_type") == "news", F.when(eligible(reading), F.col("severity")))
        .when(~located, None)
        .when(F.col("source_type") == "satellite", F.tanh(finite(typed["surface_change"])))
        .when(F.col("source_type") == "viirs", F.tanh(finite(typed["relative_radiance_decrease"])))
        .when(F.col("source_type") == "ais", F.tanh(finite(typed["vessel_activity_ratio"]) - 1))
    )


def readings() -> Column:
    """An array with the reading of the column `extracted`: its text and what it says, parsed once. Anything but a JSON object says nothing."""
    text = F.coalesce(F.col("extracted"), F.lit(""))
    text = F.when(F.ltrim(text).startswith("{"), text).otherwise("{}")
    return F.transform(F.array(text), lambda t: F.struct(F.from_json(t, READING).alias("typed"), t.alias("text")))


def parsed_once(make) -> Column:
    """make(reading) of the column `extracted`. Inside a lambda the reading is one value; as a column it would be parsed anew for every mention."""
    return F.get(F.transform(readings(), make), F.lit(0))


def visible_measurements(signals: DataFrame, as_of: Column) -> DataFrame:
    """Signals known at as_of, inside the window of their source, with a value.

    The values leave a generator, which gives no row without one: a filter on the value would be
    pushed down and work it out a second time.
    """
    known = bitemporal(signals, as_of).where(F.col("source_type").isin(SOURCES))
    fresh = known.where(F.col("observed_at") >= as_of - F.make_interval(days=window_days(F.col("source_type"))))
    return fresh.select(*signals.columns, F.explode(F.filter(F.transform(readings(), measurement), lambda v: v.isNotNull())).alias("value"))


def source_features(measured: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """(company_id, source_type): value (largest for news, else newest), log count, presence and age.

    A signal counts for its own company, or for those of its location. Signals are summed up for
    each company and each location first, and only a location's sums go to its companies.
    """
    known = known_links(links, as_of).select("location_id", F.col("company_id").alias("target"))
    newest = F.max(F.struct("observed_at", "id", "value")).alias("_newest")
    sums = lambda rows, by: rows.groupBy(F.col(by).alias("target"), "source_type").agg(F.max("value").alias("_most"), newest, F.count("*").alias("n"))
    own = sums(measured.where(F.col("company_id").isNotNull()), "company_id")
    located = sums(measured.where(F.col("company_id").isNull() & F.col("location_id").isNotNull()), "location_id").withColumnRenamed("target", "location_id")
    met = own.unionByName(located.join(known.hint("merge"), "location_id").drop("location_id"))
    # A signal has one company or one location, so that nothing is counted twice.
    sums = met.groupBy(F.col("target").alias("company_id"), "source_type").agg(F.max("_most").alias("_most"), F.max("_newest").alias("_newest"), F.sum("n").alias("n"))
    sums = sums.withColumns({"_last": F.col("_newest.value"), "_at": F.col("_newest.observed_at")})
    seconds = (F.unix_micros(as_of) - F.unix_micros("_at")) / 1e6
    return sums.select(
        "company_id",
        "source_type",
        F.when(F.col("source_type") == "news", F.col("_most")).otherwise(F.col("_last")).alias("value"),
        log_count(F.col("n")).alias("count"),
        F.lit(1.0).alias("present"),
        age(seconds, window_days(F.col("source_type"))).alias("age"),
        "n",
    )


def assemble(companies: DataFrame, signals: DataFrame, relationships: DataFrame, links: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """nodes (22 features), edges and evidence as they could be known at as_of.

    evidence has a row for each signal of a company and grows with companies times signals of a
    location; covered (company_id, source_type) and counts (company_id, evidence_count) do not.
    """
    universe = companies.where(~F.col("is_synthetic") & (F.col("created_at") <= as_of))
    ids = universe.select(F.col("id").alias("company_id"))
    measured = visible_measurements(signals, as_of)
    features = source_features(measured, links, as_of).join(ids, "company_id", "left_semi")
    # One row for each company: conditional maxima instead of a pivot, which would first look for the values.
    wide = features.groupBy("company_id").agg(*[F.max(F.when(F.col("source_type") == s, F.col(t))).alias(f"{s}_{t}") for s in SOURCES for t in STATS])
    absent = {f"{s}_{t}": 1.0 if t == "age" else 0.0 for s in SOURCES for t in STATS}
    nodes = universe.select("id", *industry_features(F.col("industry"))).join(wide.withColumnRenamed("company_id", "id"), "id", "left").na.fill(absent).withColumn("as_of", as_of)
    named = measured.where(F.col("id").isNotNull())
    owned = named.select("company_id", F.when(F.col("company_id").isNull(), F.col("location_id")).alias("location_id"), "source_type", F.col("id").alias("signal_id"))
    known = known_links(links, as_of)
    return {
        "nodes": nodes,
        "edges": valid_edges(relationships, companies, signals, as_of),
        "evidence": reached(owned.distinct(), known).select("company_id", "source_type", "signal_id").join(ids, "company_id", "left_semi"),
        "covered": reached(owned.drop("signal_id").distinct(), known).select("company_id", "source_type").distinct().join(ids, "company_id", "left_semi"),
        "counts": count_targets(named, links, as_of).select("company_id", F.col("signals").alias("evidence_count")).join(ids, "company_id", "left_semi"),
    }


def evidence_count(evidence: DataFrame) -> DataFrame:
    """Distinct signals of each company; companies without any are not scored. `counts` of `assemble` gives the same without the pairs."""
    return evidence.groupBy("company_id").agg(F.count_distinct("signal_id").alias("evidence_count")).where("evidence_count > 0")


def feature_coverage(evidence: DataFrame) -> DataFrame:
    """Companies of each source, from evidence or covered of `assemble`."""
    return evidence.groupBy("source_type").agg(F.count_distinct("company_id").alias("companies"))


def max_severity(signals: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Largest severity of scoreable news in the last days, with the signals' ids."""
    fresh = signals.where((F.col("source_type") == "news") & F.col("severity").isNotNull() & (F.col("observed_at") >= now - F.make_interval(days=F.lit(days))) & parsed_once(eligible))
    return fresh.where(F.col("company_id").isNotNull()).groupBy("company_id").agg(F.max("severity").alias("severity"), F.array_sort(F.collect_list("id")).alias("signal_ids"))


def last_of_day(snapshots: DataFrame) -> DataFrame:
    """The last snapshot (snapshot_id, as_of) of each UTC day."""
    return snapshots.groupBy(F.to_date("as_of").alias("day")).agg(F.max_by(F.struct("snapshot_id", "as_of"), F.struct("as_of", "snapshot_id")).alias("_r")).select("day", "_r.*")


def sequences(days: DataFrame, steps: int) -> DataFrame:
    """For each day (day, snapshot_id, as_of) with steps - 1 consecutive days before it: the ordered snapshots. A row for each day only, so one window is small."""
    order = Window.orderBy("day")
    island = F.date_sub("day", F.row_number().over(order))
    run = Window.partitionBy("_run").orderBy("day").rowsBetween(-(steps - 1), 0)
    listed = days.withColumn("_run", island).withColumn("frames", F.collect_list("snapshot_id").over(run)).withColumn("start", F.min("as_of").over(run))
    return listed.where(F.size("frames") == steps).select("day", "snapshot_id", "as_of", "start", "frames")


def increasing(frames: DataFrame) -> DataFrame:
    """(step, as_of) of steps that are not later than the step before. A row for each step only."""
    times = frames.groupBy("step").agg(F.min("as_of").alias("as_of"))
    return times.withColumn("_last", F.lag("as_of").over(Window.orderBy("step"))).where(F.col("as_of") <= F.col("_last")).drop("_last")


def temporal_frames(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Frames (step, as_of, id, columns) aligned to the last universe; times must increase with the steps."""
    if increasing(frames).limit(1).count():
        raise ValueError("snapshots must be ordered by time")
    return align(frames, columns)


def align(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (step, id, columns): every step gets the ids of the last step; unknown ones are absent with zeros."""
    steps = sorted(r["step"] for r in guarded(frames.select("step").distinct(), MOST_STEPS, "steps").collect())
    universe = frames.where(F.col("step") == steps[-1]) if steps else frames
    whole = universe.select("id", F.explode(F.array(*map(F.lit, steps)) if steps else F.array().cast(f"array<{frames.schema['step'].dataType.simpleString()}>")).alias("step"))
    met = whole.join(frames.withColumn("present", F.lit(True)).hint("merge"), ["step", "id"], "left")
    return met.select("step", "id", F.coalesce("present", F.lit(False)).alias("present"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def label_problem(now: Column) -> Column:
    """The first rule that an outcome label breaks; null for a valid one (duplicates are found over the table).

    A label is the whole number 0 or 1, as a number or as its JSON text: 0.0 and true are none.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    week = F.unix_micros("outcome_end") - F.unix_micros("as_of") == 7 * 86_400_000_000
    rules = [
        (~F.coalesce(F.col("label").cast("string").isin("0", "1"), F.lit(False)), "label"),
        (~F.coalesce((F.col("as_of") < F.col("outcome_end")) & (F.col("outcome_end") <= F.col("available_at")) & (F.col("available_at") <= now), F.lit(False)), "times"),
        (blank("reviewed_by") | blank("rationale"), "review"),
        (F.coalesce(F.col("target") != TARGET, F.lit(True)), "target"),
        (~F.coalesce(F.col("source_url").rlike(r"^https://[^/\s]+"), F.lit(False)), "source"),
        (~F.coalesce(week, F.lit(False)), "horizon"),
    ]
    return F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules])


def checked_labels(labels: DataFrame, now: Column) -> DataFrame:
    """labels with whole numbers as labels; refused where any row breaks a rule or repeats another."""
    broken = labels.withColumn("problem", label_problem(now)).where(F.col("problem").isNotNull()).limit(1).collect()
    if broken:
        raise ValueError(f"a label breaks the rule of {broken[0]['problem']}")
    if duplicate_labels(labels).limit(1).count():
        raise ValueError("labels repeat a snapshot and company")
    return labels.withColumn("label", F.col("label").cast("int"))


def duplicate_labels(labels: DataFrame) -> DataFrame:
    return labels.groupBy("snapshot_id", "company_id").agg(F.count("*").alias("n")).where("n > 1")


def examples(days: DataFrame, labels: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """(examples, labels that meet no sequence). An example is a labelled snapshot's sequence with the times that splits need."""
    seqs = sequences(days, steps)
    met = labels.join(seqs, ["snapshot_id", "as_of"])
    made = met.groupBy("snapshot_id", "as_of", "start", "frames").agg(F.max("outcome_end").alias("label_end"), F.max("available_at").alias("label_available"), F.array_sort(F.collect_list(F.struct("company_id", "label"))).alias("labels"))
    return made, labels.join(seqs, ["snapshot_id", "as_of"], "left_anti")


def gated(split: DataFrame, least: int = 20) -> DataFrame:
    """A split of examples with `labels`, refused where a part is empty, has fewer than `least` labels or one class."""
    rows = split.select("split", F.explode("labels.label").alias("y"))
    if bad := [r["split"] for r in split_problems(rows, least).collect()]:  # three rows at most
        raise ValueError(f"too few labels or one class in {sorted(bad)}")
    return split


def split_snapshots(split: DataFrame) -> DataFrame:
    """The distinct snapshots of each part of a split."""
    return split.select("split", F.explode("frames").alias("snapshot_id")).distinct()


def record_snapshot(companies: DataFrame, signals: DataFrame, relationships: DataFrame, links: DataFrame, as_of: Column, path: str, schema: str = FEATURE_SCHEMA, most: int = MOST_COMPANIES) -> DataFrame:
    """The features as of now, assembled from recent or referenced signals, refused without companies or with over `most`, appended under their content id."""
    used = recent_or_referenced(bitemporal(signals, as_of), relationships.where("status = 'approved'"), as_of)
    spark, landed = signals.sparkSession, shared_folder(signals.sparkSession, "used")
    used.write.parquet(landed)  # own and located signals are summed apart
    nodes = assemble(companies, spark.read.schema(used.schema).parquet(landed), relationships, links, as_of)["nodes"]
    if not guarded(nodes, most, "companies").limit(1).count():
        raise ValueError("no real companies")
    return write_snapshot(nodes, path, schema)


def temporal_split(rows: DataFrame, least: int = 12) -> DataFrame:
    """Examples (example_id, start, as_of, label_end, label_available) with a chronological 60/20/20 split.

    Rows of train and validation whose outcome ends or is known only once the next split's features
    begin are dropped. One row for each example (days), so the ranking window is small.
    """
    n = rows.count()
    if n < least:
        raise ValueError(f"at least {least} examples are needed")
    rank = F.row_number().over(Window.orderBy("as_of", "example_id")) - 1
    marked = rows.withColumn("_r", rank).withColumn("split", F.when(F.col("_r") < int(0.6 * n), "train").when(F.col("_r") < int(0.8 * n), "validation").otherwise("test"))
    starts = marked.groupBy("split").agg(F.min("start").alias("_next"))
    before = starts.select(F.when(F.col("split") == "validation", "train").when(F.col("split") == "test", "validation").alias("split"), "_next").where(F.col("split").isNotNull())
    met = marked.join(F.broadcast(before), "split", "left")  # two rows
    return met.where(F.col("_next").isNull() | (F.greatest("label_end", "label_available") < F.col("_next"))).drop("_r", "_next")


def ablate(nodes: DataFrame, name: str) -> DataFrame:
    """nodes without the columns' information: zeros for the four columns of each removed source, presence included, and for what `history` and neighbours' means made of them.

    no_temporal leaves of `history` what it makes of the last frame alone (see last_frame_only).
    """
    gone = {"no_vision": VISION, "no_news": NEWS, "full": [], "no_temporal": []}[name]
    base = [f"{s}_{t}" for s in gone for t in STATS]
    of_source = lambda c: any(re.fullmatch(rf"(mean_)?{p}(_lag\d+|_trend)?", c) for p in base)
    past = lambda c: name == "no_temporal" and re.search(r"_lag[1-9]\d*$|_trend$", c)
    zeros = {c: F.lit(0.0) for c in [*base, *(c for c in nodes.columns if of_source(c) or past(c))]}
    return nodes.withColumns(zeros) if zeros else nodes


def last_frame_only(frames: DataFrame) -> DataFrame:
    return frames.join(frames.agg(F.max("step").alias("step")), "step", "left_semi")
