"""Reviews, coverage and mining: aggregates over names, their reviews and their sources.

Empty tables give empty results. Null scores take part in no mean; null keys form a group of their own where a result is
grouped by them, and match nothing in joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut

# Ways a review ended that keep it out of a quorum.
DISQUALIFIED = ("retry_item", "max_cycles_reached")
QUORUM, ESCALATED = "quorum_consensus", "authoritative_escalation"
#: Examples kept for a gap.
EXAMPLES = 5


def review_aggregates(names: DataFrame, reviews: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(id, n, mean, disagree): reviews of each name, their mean score, and whether several differ by the threshold or more."""
    each = reviews.groupBy("id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"))
    out = names.select("id").join(each, "id", "left")
    return out.select("id", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.coalesce((F.col("n") > 1) & (F.col("spread") >= threshold), F.lit(False)).alias("disagree"))


def canonical_reviews(reviews: DataFrame) -> DataFrame:
    """(id, score, source): the review that counts for each name, from its latest group.

    ``reviews`` has id, grp, at, cycle, method, score; of a cycle seen twice the later row counts. The escalator's
    cycle 2 comes first, then the mean of cycles 0 and 1 if either is a quorum and none is disqualified, then cycle 0. Names
    whose group has none of these get no row.
    """
    latest = reviews.groupBy("id").agg(F.max_by("grp", F.struct("at", "grp")).alias("grp"))
    own = reviews.join(latest, ["id", "grp"]).where(F.col("cycle").isin(0, 1, 2))
    row = F.struct("method", "score")
    at = lambda c: F.max_by(F.when(F.col("cycle") == c, row), F.when(F.col("cycle") == c, F.struct("at", "method", "score"))).alias(f"c{c}")
    wide = own.groupBy("id").agg(*[at(c) for c in (0, 1, 2)])
    method = lambda c: F.coalesce(F.col(f"c{c}.method"), F.lit(""))
    both = F.col("c0").isNotNull() & F.col("c1").isNotNull()
    quorum = both & ~method(0).isin(*DISQUALIFIED) & ~method(1).isin(*DISQUALIFIED) & ((method(0) == QUORUM) | (method(1) == QUORUM))
    source = F.when(F.col("c2").isNotNull() & (method(2) == ESCALATED), "escalator").when(quorum, "quorum_mean").when(F.col("c0").isNotNull(), "single")
    mean = F.coalesce((F.col("c0.score") + F.col("c1.score")) / 2, F.col("c0.score"), F.col("c1.score"))
    score = F.when(source == "escalator", F.col("c2.score")).when(source == "quorum_mean", mean).otherwise(F.col("c0.score"))
    return wide.select("id", score.alias("score"), source.alias("source")).where("source is not null")


def distinct_values(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """For each group the distinct values of several columns in order; empty texts count as null and are left out."""
    own = lambda c: F.sort_array(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(c)
    return df.groupBy(by).agg(F.count("*").alias("n"), *[own(c) for c in columns])


def saturated_tokens(names: DataFrame, token: str, score: str, domain: str, least_uses: int, least_score: float, known: DataFrame | None = None) -> DataFrame:
    """(token, uses, min_score, domains): tokens of enough well-scored names, without those already known."""
    good = names.where(F.col(token).isNotNull() & (F.col(score) >= least_score)).select(F.col(token).alias("token"), "id", F.col(score).alias("s"), F.coalesce(domain, F.lit("unknown")).alias("d"))
    if known is not None:
        good = good.join(known.select("token").distinct(), "token", "left_anti")
    out = good.groupBy("token").agg(F.count_distinct("id").alias("uses"), F.min("s").alias("min_score"), F.sort_array(F.collect_set("d")).alias("domains"))
    return out.where(F.col("uses") >= least_uses)


def gap_examples(gaps: DataFrame, links: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """(gap, occurrences, reasons): how often each gap occurs, and its first ``most`` different reasons.

    Reasons are made distinct and ranked before they are collected.
    """
    counted = links.groupBy("gap").agg(F.count("*").alias("occurrences"))
    reasons = links.where("reason is not null and reason <> ''").select("gap", "reason").distinct()
    ranked = reasons.withColumn("place", F.row_number().over(Window.partitionBy("gap").orderBy("reason"))).where(F.col("place") <= most)
    listed = ranked.groupBy("gap").agg(F.sort_array(F.collect_list("reason")).alias("reasons"))
    out = gaps.select("gap").distinct().join(counted, "gap", "left").join(listed, "gap", "left")
    return out.select("gap", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def coverage_report(nodes: DataFrame, covered: DataFrame, categories: Sequence[str], runs: DataFrame) -> DataFrame:
    """One row: eligible nodes, those covered and not, error siblings to come, and what covering the rest will cost.

    ``runs`` has cost and names; with no names the costs are null.
    """
    marked = nodes.where(F.col("category").isin(*categories)).join(covered.select("id").distinct().withColumn("has", F.lit(True)), "id", "left")
    own = marked.agg(
        F.count("*").alias("eligible"),
        F.count_if("has").alias("covered"),
        F.count_if(F.col("has").isNull()).alias("to_compose"),
        F.count_if(F.col("has").isNull() & F.col("with_errors")).alias("to_compose_with_errors"),
        F.count_distinct("domain").alias("n_domains"),
    )
    spent = runs.agg(F.sum("cost").alias("cost"), F.sum("names").alias("names"))
    each = F.when(F.col("names") > 0, F.col("cost") / F.col("names"))
    out = own.crossJoin(F.broadcast(spent))  # one row each
    return out.select(
        "eligible", "covered", "to_compose", "to_compose_with_errors", "n_domains",
        (3 * F.col("to_compose_with_errors")).alias("expected_siblings"), each.alias("cost_per_name"),
        F.when(F.col("to_compose") > 0, each * F.col("to_compose")).alias("estimated_cost"),
    )


def eligible_leaves(nodes: DataFrame, categories: Sequence[str], without_groups: Sequence[str] = ()) -> DataFrame:
    """Nodes that can be named: of a category, described, no structure (nor of unknown type), and of no group left out."""
    leaf = F.col("category").isin(*categories) & (F.col("doc") != "") & ~F.col("dtype").isin("STRUCTURE", "STRUCT_ARRAY") & F.col("grp").isNotNull()
    return nodes.where(leaf & ~F.col("grp").isin(*without_groups))


def coverage_counts(leaves: DataFrame, with_errors: DataFrame, covered: DataFrame, names: DataFrame, by_rule: str) -> DataFrame:
    """(measure, bucket, n): leaves in all and by category, domain and kind, names in all and by status and validation, and what is left.

    ``leaves`` has id, category, domain and kind, ``names`` status, validation and model; ``with_errors`` and ``covered`` have ids, repeated
    or not. Names of the model ``by_rule`` are siblings for errors. A total is there even if it is 0; a bucket that is null is ``none``.
    Leaves and names are counted by their groups first, so that each row is shuffled once at most.
    """
    marks = with_errors.select("id", F.lit(True).alias("errors"), F.lit(False).alias("named")).unionAll(covered.select("id", F.lit(False), F.lit(True)))
    marks = marks.where("id IS NOT NULL").groupBy("id").agg(F.max("errors").alias("errors"), F.max("named").alias("named"))
    open_ = ~F.coalesce("named", F.lit(False))
    own = leaves.select("id", "category", "domain", "kind").join(marks, "id", "left").groupBy("category", "domain", "kind")
    own = own.agg(F.count("*").alias("n"), F.count_if("errors").alias("errors"), F.count_if(open_).alias("open"), F.count_if(open_ & F.col("errors")).alias("open_errors"))
    minted = names.groupBy("status", "validation", "model").agg(F.count("*").alias("n"))

    def rows(df: DataFrame, totals: Mapping[str, Column], buckets: Mapping[str, str]) -> DataFrame:
        each = [(m, F.lit(""), n) for m, n in totals.items()] + [(m, F.coalesce(F.col(c).cast("string"), F.lit("none")), F.col("n")) for m, c in buckets.items()]
        return df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), b.alias("bucket"), n.cast("long").alias("n")) for m, b, n in each])))

    of_leaves = {"eligible": F.col("n"), "eligible_with_errors": F.col("errors"), "to_compose": F.col("open"), "to_compose_with_errors": F.col("open_errors"), "expected_siblings": 3 * F.col("open_errors")}
    of_names = {"names": F.col("n"), "error_siblings": F.when(F.col("model") == by_rule, F.col("n")).otherwise(0)}
    parts = rows(own, of_leaves, {"eligible_by_category": "category", "eligible_by_domain": "domain", "eligible_by_kind": "kind"})
    parts = parts.unionAll(rows(minted, of_names, {"names_by_status": "status", "names_by_validation": "validation"}))
    parts = parts.unionAll(rows(marks.agg(F.count_if("named").alias("n")), {"covered": F.col("n")}, {}))
    zeros = rows(leaves.sparkSession.range(1), {m: F.lit(0) for m in (*of_leaves, *of_names)}, {})
    return parts.unionAll(zeros).groupBy("measure", "bucket").agg(F.sum("n").alias("n"))


def source_coverage(sources: DataFrame, mappings: DataFrame, by: str) -> DataFrame:
    """By group: sources, those mapped, those with several targets, and the share mapped in percent; a source counts once."""
    targets = mappings.groupBy("source").agg(F.count_distinct("target").alias("t"))
    joined = sources.select("source", by).distinct().join(targets, "source", "left")
    out = joined.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("t") > 0).alias("mapped"), F.count_if(F.col("t") > 1).alias("multi"))
    return out.withColumn("percentage", F.round(100 * F.col("mapped") / F.col("n"), 2))


def graded(percentage: Column, warning: float, error: float) -> Column:
    """error, warning or null for a share in percent."""
    return F.when(percentage < error, "error").when(percentage < warning, "warning")


def structure_summary(nodes: DataFrame) -> DataFrame:
    """By group: nodes, leaves, structures, deepest path, units, nodes without unit, mean depth."""
    depth = F.size(F.split("id", "/"))
    is_structure = F.col("dtype").isin("STRUCTURE", "STRUCT_ARRAY")
    return nodes.groupBy("grp").agg(
        F.count("*").alias("n"), F.count_if(~is_structure).alias("leaves"), F.count_if(is_structure).alias("structures"), F.max(depth).alias("deepest"),
        F.count_distinct("unit").alias("units"), F.count_if(F.col("unit").isNull()).alias("without_unit"), F.round(F.avg(depth), 4).alias("mean_depth"),
    )


def complexity(total: Column, depth: Column, branching: Column) -> Column:
    """Weighted shares of nodes (of 1,000), depth (of 10) and branching (of 10), to three places."""
    part = lambda x, full: F.least(x / full, F.lit(1.0))
    return F.round(0.4 * part(total, 1000) + 0.3 * part(depth, 10) + 0.3 * part(branching, 10), 3)


def tree_pattern(nodes: Column, depth: Column, branching: Column, arrays: Column, clustering: Column) -> Column:
    """The formula for patterns across groups."""
    return 0.3 * nodes + 10 * depth + 5 * branching + 2 * arrays + 20 * (1 - clustering)


def benchmark(candidates: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """By group: overlap, precision and recall of candidate names against reference names."""
    c, r = candidates.select(by, "name").distinct().withColumn("c", F.lit(1)), reference.select(by, "name").distinct().withColumn("r", F.lit(1))
    both = c.join(r, [by, "name"], "full_outer").groupBy(by).agg(F.count("c").alias("n_candidates"), F.count("r").alias("n_reference"), F.count_if(F.col("c").isNotNull() & F.col("r").isNotNull()).alias("overlap"))
    share = lambda n: F.when(F.col(n) > 0, F.col("overlap") / F.col(n)).otherwise(F.lit(0.0))
    return both.select("*", share("n_candidates").alias("precision"), share("n_reference").alias("recall"))


def cost_per_item(runs: DataFrame, by: str) -> DataFrame:
    """Mean cost of an item by group, over runs that have any items and cost."""
    return runs.where("n > 0 and cost > 0").groupBy(by).agg(F.avg(F.col("cost") / F.col("n")).alias("cpi"))


def expected_gaps(counts: DataFrame, expected: DataFrame, by: str) -> DataFrame:
    """Expected values of a column that no row has."""
    return expected.select(by).distinct().join(counts.select(by), by, "left_anti")


def quartile_samples(df: DataFrame, score: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows of each quarter of the score's range 0 to 1, drawn by a hash of key and seed, so a draw can be repeated."""
    quarter = F.least(F.floor(F.col(score) * 4), F.lit(3)).cast("int")
    drawn = df.where(F.col(score).between(0, 1)).withColumn("quartile", quarter).withColumn("draw", F.md5(F.concat_ws("|", F.lit(seed), key)))
    return drawn.withColumn("place", F.row_number().over(Window.partitionBy("quartile").orderBy("draw", key))).where(F.col("place") <= k).drop("draw", "place")


def top_per_dimension(df: DataFrame, dimensions: Sequence[str], key: str, k: int, own: Column, least: float = 0.6) -> DataFrame:
    """(dimension, place, key, score): the best rows of each dimension at ``least`` or over, own ones first among the best 2 k."""
    each = df.select(key, own.alias("own"), F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in dimensions])).alias("x")).select(key, "own", "x.*")
    w = Window.partitionBy("dimension")
    best = each.where(F.col("score") >= least).withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), key))).where(F.col("place") <= 2 * k)
    picked = best.withColumn("place", F.row_number().over(w.orderBy(F.desc("own"), F.desc("score"), key))).where(F.col("place") <= k)
    return picked.select("dimension", "place", key, "score")


def token_batches(items: DataFrame, budget: int) -> DataFrame:
    """Batches (batch, at, tokens) halved again and again until each is within the budget or one item: adds ``part``.

    A round splits every batch that is too large in the middle of its rows, so there are as many rounds as halvings, and
    no batch is collected. The first half of an odd number is the smaller one.
    """
    parts = cut(items.withColumn("part", F.lit("")))
    while True:
        whole = Window.partitionBy("batch", "part")
        place = F.row_number().over(whole.orderBy("at"))
        counted = parts.withColumns({"_n": F.count("*").over(whole), "_sum": F.sum("tokens").over(whole), "_place": place})
        over = (F.col("_sum") > budget) & (F.col("_n") > 1)
        half = F.when(F.col("_place") <= F.floor(F.col("_n") / 2), "0").otherwise("1")
        parts = cut(counted.withColumn("part", F.when(over, F.concat("part", half)).otherwise(F.col("part"))).withColumn("_over", over).drop("_n", "_sum", "_place"))
        if parts.where("_over").isEmpty():
            return parts.drop("_over")
        parts = parts.drop("_over")


def by_label(df: DataFrame, rules: Mapping[str, str], text: Column, key: str) -> DataFrame:
    """(label, key): rows in the clusters whose pattern their text matches; a row can be in several."""
    hits = F.array_compact(F.array(*[F.when(F.regexp_like(text, F.lit(p)), label) for label, p in rules.items()]))
    return df.select(F.explode(hits).alias("label"), key)


def content_clusters(members: DataFrame) -> DataFrame:
    """(id, label, n): clusters named after a hash of their sorted members, so equal ones have one id."""
    listed = members.groupBy("label").agg(F.sort_array(F.collect_set("member")).alias("m"))
    return listed.select(F.substring(F.sha2(F.array_join("m", "|"), 256), 1, 16).alias("id"), "label", F.size("m").alias("n"))


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the old table whose key the new one lacks."""
    return old.join(new.select(key), key, "left_anti")
