"""Leakage-safe splits on distributed ranks, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haggle.functions.scalar import sha256_hex
from haggle.operators.rank import global_rank, global_running
from haggle.session import written

REGIONS = ["train", "development", "hidden"]


def _ends(n: Column, train: float, development: float) -> tuple[Column, Column]:
    train_end = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
    dev_end = F.greatest(train_end, F.floor(n * F.lit(train + development)))
    return train_end, F.when(n >= 3, F.least(dev_end, n - 1)).otherwise(dev_end)


def region_of(rank: Column, n: Column, train: float = 0.6, development: float = 0.2) -> Column:
    """Region of a 1-based rank among n rows: floors, at least one training row,
    and at least one hidden row when there are three."""
    train_end, dev_end = _ends(n, train, development)
    return F.when(rank <= train_end, "train").when(rank <= dev_end, "development").otherwise("hidden")


def region_borders(df: DataFrame, part: list[str], first: str, rest: list[str], train: float = 0.6, development: float = 0.2) -> DataFrame | None:
    """Per value of `part` the last keys of train and development, as `train_last` and `dev_last`:
    structs of `first` and `rest`, by which rows are ordered, nulls first. Rows are counted by `first` and only
    those that share it with a border are ranked, so the rows themselves are neither sorted nor
    written. None where rows of one key would lie on both sides of a border. `part` should have
    few values."""
    counts = df.groupBy(*part, first).agg(F.count(F.lit(1)).alias("_c"))
    run = global_running(counts, [*part, first], {"_upto": F.col("_c")})
    per = run.groupBy(*part).agg(F.min(F.col("_upto") - F.col("_c")).alias("_off"), F.sum("_c").alias("_n"))
    ends = F.explode(F.array(*[F.struct(F.lit(b).alias("border"), e.cast("long").alias("end")) for b, e in zip(("train", "dev"), _ends(F.col("_n"), train, development))]))
    # one row per part
    placed = run.join(F.broadcast(per), part).withColumn("_upto", F.col("_upto") - F.col("_off")).withColumn("_e", ends)
    inside = (F.col("_upto") - F.col("_c") < F.col("_e.end")) & (F.col("_e.end") <= F.col("_upto"))
    hits = placed.filter(inside).select(*part, F.col(first).alias("_first"), F.col("_e.border").alias("border"), (F.col("_e.end") - F.col("_upto") + F.col("_c")).alias("_need"))
    # two rows per part
    near = df.select(*part, first, *rest).join(F.broadcast(hits), part).filter(F.col(first).eqNullSafe(F.col("_first"))).drop("_first")
    ranked = rank_within(near.groupBy(*part, "border", "_need", first, *rest).agg(F.count(F.lit(1)).alias("_c")), [*part, "border"], [first, *rest], weight="_c")
    last = ranked.filter((F.col("rank") - F.col("_c") < F.col("_need")) & (F.col("_need") <= F.col("rank")))
    found = last.select(*part, "border", (F.col("rank") > F.col("_need")).alias("_cut"), F.struct(first, *rest).alias("_key"))
    both = found.groupBy(*part).agg(*[F.max(F.when(F.col("border") == b, F.col("_key"))).alias(f"{b}_last") for b in ("train", "dev")], F.bool_or("_cut").alias("_cut"))
    kept = written(both, "borders")  # one row per part
    return None if kept.filter("_cut").head(1) else kept.drop("_cut")


def region_by(key: Column) -> Column:
    """Region of a key beside its part's borders."""
    return F.when(key <= F.col("train_last"), "train").when(key <= F.col("dev_last"), "development").otherwise("hidden")


def rank_within(df: DataFrame, part: list[str], order: list, weight: str | None = None) -> DataFrame:
    """`rank` and `n` inside each value of `part` from one global rank: the
    ranks of a part are consecutive, so its first rank is its offset. `part`
    should have few values (targets, splits). With `weight` a row stands for so many
    rows, and has the last rank of those."""
    if weight:
        ranked, size = global_running(df, [*part, *order], {"_g": F.col(weight)}).drop("rank"), F.col(weight)
    else:
        ranked, size = global_rank(df, [*part, *order], "_g"), F.lit(1)
    per = ranked.groupBy(*part).agg(F.min(F.col("_g") - size).alias("_off"), F.sum(size).cast("long").alias("n"))
    return ranked.join(per, part).withColumn("rank", F.col("_g") - F.col("_off")).drop("_g", "_off")


def time_key(c: str) -> list[Column]:
    """Sort key of a time text: parseable times first, then the others as text."""
    parsed = F.try_to_timestamp(F.trim(F.col(c)))
    return [F.when(parsed.isNotNull(), 0).otherwise(1), parsed, F.when(parsed.isNull(), F.trim(F.col(c)))]


def chronological_split(df: DataFrame, ts: str, row_id: str, train: float = 0.6, development: float = 0.2) -> DataFrame:
    text = df.schema[ts].dataType.simpleString() == "string"
    order = [*time_key(ts), F.col(row_id)] if text else [F.col(ts).asc_nulls_last(), F.col(row_id)]
    ranked = global_rank(df, order, "rank", total="n")
    return ranked.withColumn("region", region_of(F.col("rank"), F.col("n"), train, development)).drop("n")


def group_value(group: str, row: list[str]) -> Column:
    """A missing group is a group of its own, named by the row's hash."""
    own = F.concat(F.lit("__missing__:"), F.sha2(F.to_json(F.struct(*row)), 256))
    return F.when(F.coalesce(F.col(group).cast("string"), F.lit("")) == "", own).otherwise(F.col(group).cast("string"))


def purge_crossing(df: DataFrame, group: str, part: list[str] | None = None) -> DataFrame:
    """Drop every group whose rows lie in more than one region. The groups are
    found by an aggregate, so a hot group costs a few rows in the shuffle."""
    keys = [*(part or []), group]
    crossing = df.groupBy(*keys).agg(F.min("region").alias("a"), F.max("region").alias("b")).filter("a <> b").select(*keys)
    return df.join(crossing, keys, "left_anti")


def purged_split(df: DataFrame, ts: str, group: str, row_id: str, train: float = 0.6, development: float = 0.2) -> DataFrame:
    placed = chronological_split(df, ts, row_id, train, development)
    placed = placed.withColumn("_group", group_value(group, df.columns))
    return purge_crossing(placed, "_group").drop("_group")


def _group_split(df: DataFrame, group_col: str, order: list[Column], train: float, development: float) -> DataFrame:
    groups = df.select(group_col).distinct()
    ranked = global_rank(groups, order, "_r", total="_tot")
    regions = ranked.select(group_col, region_of(F.col("_r"), F.col("_tot"), train, development).alias("region"))
    return df.join(regions, group_col)


def group_split(df: DataFrame, group: str, train: float = 0.6, development: float = 0.2) -> DataFrame:
    """Group-disjoint split, groups in key order."""
    keyed = df.withColumn("_group", group_value(group, df.columns))
    return _group_split(keyed, "_group", [F.col("_group")], train, development).drop("_group")


def hash_group_split(df: DataFrame, group: str, missing: str = "error", train: float = 0.6, development: float = 0.2) -> DataFrame:
    """Group-disjoint split, groups in hash order. Rows without a group are an
    error or are left out."""
    empty = F.coalesce(F.col(group).cast("string"), F.lit("")) == ""
    if missing == "error":
        df = df.withColumn(group, F.when(empty, F.raise_error(F.lit(f"missing {group} in a required split")))
                           .otherwise(F.col(group)))
    elif missing == "exclude":
        df = df.filter(~empty)
    else:
        raise ValueError(f"unknown missing policy {missing!r}")
    digest = sha256_hex(F.concat_ws("|", F.lit(group), F.col(group)))
    return _group_split(df, group, [digest, F.col(group)], train, development)


def campaign_sizes(n: int, train: float, development: float, hidden: float, prospective: float) -> dict[str, int]:
    """Region sizes from one row count; what floors leave over goes to hidden."""
    if n == 0:
        return {"training": 0, "development": 0, "hidden": 0, "prospective": 0}
    size = {"training": max(1, int(n * train)), "development": int(n * development),
            "hidden": int(n * hidden), "prospective": int(n * prospective)}
    least = {"prospective": 0, "hidden": 0, "development": 0}
    if n >= 2 and development > 0:
        size["development"] = max(1, size["development"])
    if n >= 3 and hidden > 0:
        size["hidden"] = max(1, size["hidden"])
    least["development"] = 1 if n >= 2 else 0
    least["hidden"] = 1 if n >= 3 else 0
    over = sum(size.values()) - n
    for name in ["prospective", "hidden", "development"]:
        if over > 0:
            cut = min(over, max(0, size[name] - least[name]))
            size[name] -= cut
            over -= cut
    if over > 0:
        size["training"] = max(1, size["training"] - over)
    elif over < 0:
        size["hidden"] -= over
    return size


def campaign_split(df: DataFrame, ts: str, case_id: str, train: float = 0.6, development: float = 0.2,
                   hidden: float = 0.2, prospective: float = 0.0) -> DataFrame:
    """Chronological campaign manifest; prospective is empty unless asked for."""
    fractions = [train, development, hidden, prospective]
    if min(fractions) < 0 or not 0 < sum(fractions) <= 1 + 1e-9:
        raise ValueError("split fractions must be non-negative and sum to a value in (0, 1]")
    ranked = global_rank(df, [F.col(ts), F.col(case_id)], "rank")
    size = campaign_sizes(ranked.count(), *fractions)
    split, end = None, 0
    for name in ["training", "development", "hidden", "prospective"]:
        end += size[name]
        split = F.when(F.col("rank") <= end, name) if split is None else split.when(F.col("rank") <= end, name)
    return ranked.withColumn("split", split)


def split_assignments(df: DataFrame, campaign: str, case_id: str, split: str) -> DataFrame:
    """Violations of a campaign's assignments: unknown split, missing id, or a
    case assigned twice. Empty when the manifest is sound."""
    known = ["training", "development", "hidden", "prospective", "staging"]
    bad = df.filter(F.col(case_id).isNull() | F.col(split).isNull() | ~F.col(split).isin(known)).select(
        F.col(campaign), F.col(case_id), F.lit("malformed_split_assignment").alias("violation"), F.lit(1).cast("long").alias("rows"))
    twice = df.filter(F.col(case_id).isNotNull()).groupBy(campaign, case_id).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return bad.unionByName(twice.select(campaign, case_id, F.lit("multiple_split_assignments").alias("violation"), "rows"))


def classify_post_freeze(rows: DataFrame, freezes: DataFrame) -> DataFrame:
    """New rows are staging; after a freeze they are prospective only when the
    decision is later than the data cutoff and the record later than the
    freeze. The latest freeze of the campaign decides."""
    latest = freezes.groupBy("campaign_id").agg(
        F.max_by(F.struct("freeze_id", "data_cutoff_time", "frozen_at"), F.struct("frozen_at", "freeze_id")).alias("f"))
    j = rows.join(latest, "campaign_id", "left")
    after = (F.col("decision_time") > F.col("f.data_cutoff_time")) & (F.col("recorded_at") > F.col("f.frozen_at"))
    return j.withColumns({
        "split": F.when(after, "prospective").otherwise("staging"),
        "policy": F.when(F.col("f").isNull(), "pre_freeze_staging").when(after, "post_freeze_prospective")
        .otherwise("post_freeze_backfill_staging"),
        "freeze_id": F.when(after, F.col("f.freeze_id")),
    }).drop("f")


# The five splits, their group and what a missing group does.
SPLITS = {
    "chronological_listing_purged": ("listing_id", "purge"),
    "seller_disjoint": ("seller_id", "error"),
    "buyer_disjoint": ("buyer_id", "exclude"),
    "category_disjoint_diagnostic": ("category", "error"),
    "thread_safe_nested_development": ("thread_id", "error"),
}


def _group_digest(key: Column, group: Column) -> Column:
    return sha256_hex(F.concat_ws("|", key, group))


def split_table(cases: DataFrame) -> DataFrame:
    """All five splits of all targets as (split, target, region, row_id). Regions are told by
    the keys at their borders: cases are counted by time, groups by the head of their
    hash, and no case is moved but to purge the listings that cross a border."""
    return timed_split(cases).unionByName(grouped_splits(cases))


def timed_split(cases: DataFrame) -> DataFrame:
    base = cases.select("target", "row_id", "timestamp", "listing_id")
    borders = region_borders(base, ["target"], "timestamp", ["row_id"])
    if borders is None:
        timed = rank_within(base, ["target"], ["timestamp", "row_id"]).withColumn("region", region_of(F.col("rank"), F.col("n")))
    else:
        # one row per target
        timed = base.join(F.broadcast(borders), "target").withColumn("region", region_by(F.struct("timestamp", "row_id")))
    timed = timed.select("target", "row_id", F.coalesce(F.col("listing_id").cast("string"), F.lit("")).alias("listing_id"), "region")
    return purge_crossing(timed, "listing_id", ["target"]).select(F.lit("chronological_listing_purged").alias("split"), "target", "region", "row_id")


def grouped_splits(cases: DataFrame) -> DataFrame:
    """The four group-disjoint splits, from one pass over the cases and one over the distinct groups."""
    grouped = [(s, g, how) for s, (g, how) in SPLITS.items() if how != "purge"]
    long = cases.select("target", "row_id", F.explode(F.array(*[
        F.struct(F.lit(s).alias("split"), F.lit(g).alias("key"), F.col(g).cast("string").alias("group")) for s, g, _ in grouped
    ])).alias("e")).select("target", "row_id", "e.*")
    gone = F.coalesce("group", F.lit("")) == ""
    must = [s for s, _, how in grouped if how == "error"]
    long = long.withColumn("group", F.when(gone & F.col("split").isin(must), F.raise_error(F.lit("missing group in a required split")))
                           .otherwise(F.col("group"))).filter(~gone)
    groups = written(long.select("split", "target", "key", "group").distinct(), "groups")
    digest = sha256_hex(F.concat_ws("|", F.col("key"), F.col("group")))
    # the head of a hash parts the groups evenly, whatever they are
    headed = groups.select("split", "target", "group", digest.alias("_d")).withColumn("_head", F.substring("_d", 1, 3))
    borders = region_borders(headed, ["split", "target"], "_head", ["_d", "group"])
    # one row per split and target
    placed = long.withColumn("_d", digest).join(F.broadcast(borders), ["split", "target"])
    return placed.select("split", "target", region_by(F.struct(F.substring("_d", 1, 3), "_d", "group")).alias("region"), "row_id")


def id_set_hash(c: Column) -> Column:
    """A sum of 60-bit numbers of the ids: it does not depend on order, and
    repeated ids add up instead of cancelling."""
    return F.sum(F.conv(F.substring(sha256_hex(c), 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")


def split_manifests(table: DataFrame) -> DataFrame:
    """Row counts and an order-free fingerprint per split, target and region."""
    return table.groupBy("split", "target", "region").agg(
        F.count(F.lit(1)).alias("rows"), id_set_hash(F.col("row_id")).alias("case_set_hash"))


def split_groups(cases: DataFrame, table: DataFrame) -> DataFrame:
    """What became of every group of a split: (split, target, group, kept, purged, repeated, stray,
    first_region, last_region). Cases and assignments meet in one aggregate on the row, its rows
    in one on the group, so a hot group is a few partial rows. A missing identifier is the
    group ''; assigned rows that are no case have a null group and count as stray."""
    ids = [F.struct(F.lit(s).alias("split"), F.coalesce(F.col(g).cast("string"), F.lit("")).alias("group")) for s, (g, _) in SPLITS.items()]
    wanted = cases.select("target", "row_id", F.explode(F.array(*ids)).alias("e")).select("e.split", "target", "row_id", "e.group", F.lit(None).cast("string").alias("region"))
    given = table.select("split", "target", "row_id", F.lit(None).cast("string").alias("group"), "region")
    rows = wanted.unionByName(given).groupBy("split", "target", "row_id").agg(
        F.max("group").alias("group"), F.count("region").alias("n"), F.min("region").alias("a"), F.max("region").alias("b"))
    known = F.col("group").isNotNull()
    return rows.groupBy("split", "target", "group").agg(
        F.count_if(known & (F.col("n") > 0)).alias("kept"), F.count_if(known & (F.col("n") == 0)).alias("purged"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(~known).alias("stray"), F.min("a").alias("first_region"), F.max("b").alias("last_region"))


def split_audit(groups: DataFrame) -> DataFrame:
    """Per split and target, from `split_groups`: kept and purged rows, groups that lost all their
    rows, rows without an identifier, and whether the split is sound: no case twice, no group in
    two regions, no row that is no case."""
    empty, timed = F.col("group") == "", F.col("split") == "chronological_listing_purged"
    out = groups.groupBy("split", "target").agg(
        F.sum("kept").alias("rows"), F.sum("purged").alias("purged_rows"), F.count_if((F.col("purged") > 0) & (F.col("kept") == 0) & (timed | ~empty)).alias("purged_groups"),
        F.sum(F.when(empty & ~timed, F.col("kept") + F.col("purged")).otherwise(0)).alias("missing_identifier_rows"),
        (F.sum("repeated") == 0).alias("no_duplicate_cases"), (F.count_if((F.col("first_region") != F.col("last_region")) & F.col("group").isNotNull()) == 0).alias("group_disjoint"),
        F.sum("stray").alias("stray_rows"))
    return out.withColumn("passed", F.col("no_duplicate_cases") & F.col("group_disjoint") & (F.col("stray_rows") == 0))


def assert_disjoint(df: DataFrame, group: str, region: str = "region") -> DataFrame:
    """Groups (or ids) seen in more than one region; empty when disjoint."""
    return df.groupBy(group).agg(F.min(region).alias("a"), F.max(region).alias("b")).filter("a <> b").select(
        F.col(group), F.col("a").alias("first_region"), F.col("b").alias("last_region"))


def publish_cases(cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Public cases without labels, and the protected labels in a table of their own."""
    labels = cases.filter(F.col("outcome_state") == "supervised").select("target", "row_id", "label", "value")
    return cases.drop("label", "value"), labels


def read_public(public: DataFrame, table: DataFrame, split: str, region: str | None = None) -> DataFrame:
    """Public rows of a split (one region, or all), hidden rows marked."""
    rows = table.filter(F.col("split") == split).select("target", "row_id", "region")
    if region:
        return public.join(rows.filter(F.col("region") == region), ["target", "row_id"]).withColumn(
            "label_redacted", F.col("region") == "hidden")
    return public.join(rows, ["target", "row_id"], "left").withColumn(
        "label_redacted", F.coalesce(F.col("region") == "hidden", F.lit(False)))


def supervised_union(episodes: DataFrame, trials: DataFrame) -> DataFrame:
    """Decision episodes and randomised trials in one table."""
    return episodes.withColumn("origin", F.lit("episode")).unionByName(
        trials.withColumn("origin", F.lit("trial")), allowMissingColumns=True)


def supervised_rows(episodes: DataFrame, target: str, through: str | None = None) -> DataFrame:
    """Episodes with a known outcome, decided and cut off by `through`."""
    df = episodes
    if through is not None:
        t = F.lit(through).cast("timestamp")
        df = df.filter((F.col("decision_time") <= t) & (F.col("observation_cutoff") <= t))
    known = df.filter(F.map_contains_key("later_outcomes", F.lit(target)))
    return known.select("case_id", "decision_time", "observation_cutoff", "features",
                        (F.element_at("later_outcomes", target) > 0).cast("int").alias("target"))
