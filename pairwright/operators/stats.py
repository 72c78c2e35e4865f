"""Statistics over samples, verification logs and comparison logs.

Each function is one or two hash aggregations. Histograms come as long rows
(dimension, value, n), so many of them share one scan and one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.functions import formula as fx
from pairwright.functions.rules import token_cost, training_cost
from pairwright.functions.text import cut, word_count
from pairwright.operators.ranking import upper_half_median




def _n() -> Column:
    return F.count(F.lit(1))


def _mean(x: Column) -> Column:
    """Mean as sum / count: exact up to the division for integer and decimal input."""
    return F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0))


def _rate(hits: Column, total: Column) -> Column:
    return F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(0.0))


def _or_zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def _with_name(cell, name: str):
    return lambda x: cell(name, x)


def histograms(
    df: DataFrame,
    single: dict[str, Column],
    arrays: dict[str, Column] | None = None,
    missing: str | None = "unknown",
) -> DataFrame:
    """Long histogram rows (dimension, value, n) of many columns in one pass.

    Null single values count as ``missing`` (or are left out when it is None);
    array columns count each element.
    """

    def cell(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))

    arrays = arrays or {}
    # all values first, in one projection, where common parts are computed once
    values = df.select(
        *[v.cast("string").alias(f"s_{k}") for k, v in single.items()], *[v.alias(f"a_{k}") for k, v in arrays.items()]
    )
    one = [cell(k, F.coalesce(f"s_{k}", F.lit(missing)) if missing else F.col(f"s_{k}")) for k in single]
    parts = [F.array(*one)] if one else []
    empty = F.array().cast("array<struct<dimension:string,value:string>>")
    for k in arrays:
        parts.append(F.coalesce(F.transform(f"a_{k}", _with_name(cell, k)), empty))
    cells = F.concat(*parts) if len(parts) > 1 else parts[0]
    long = values.select(F.explode(cells).alias("c")).select("c.*")
    if not missing:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("dimension", "value").agg(_n().alias("n"))


def distinct_counts(hist: DataFrame) -> DataFrame:
    """(dimension, distinct_values) from long histogram rows."""
    return hist.groupBy("dimension").agg(_n().alias("distinct_values"))


def store_histograms(samples: DataFrame) -> DataFrame:
    return histograms(
        samples,
        {"domain": F.col("domain"), "source_file": F.col("source_file")},
        {"operator": F.col("operators"), "agent": F.col("agents"), "atom": F.col("atoms")},
    )


def store_stats(samples: DataFrame) -> DataFrame:
    """One row: sizes, verified and valid counts, distinct agents and atoms, mean complexity."""
    kinds = _distinct(store_histograms(samples))
    score = fx.complexity(F.col("operators"), F.col("atoms"), F.col("atl_formula"))
    main = samples.agg(
        _n().alias("total_samples"),
        F.count_if("semantic_verified").alias("verified_count"),
        F.count_if("syntax_valid").alias("syntax_valid_count"),
        F.bround(_or_zero(_mean(score)), 2).alias("avg_complexity"),
    )
    return main.select("*", *kinds)


def _distinct(hist: DataFrame) -> list[Column]:
    """Distinct domains, agents and atoms as columns from one scalar subquery."""
    names = {"unique_domains": "domain", "unique_agents": "agent", "unique_atoms": "atom"}
    found = [F.max(F.when(F.col("dimension") == d, F.col("distinct_values"))).alias(k) for k, d in names.items()]
    row = distinct_counts(hist).agg(*found).select(F.struct(*names)).scalar()
    return [F.coalesce(row[k], F.lit(0)).alias(k) for k in names]


def dataset_stats(rows: DataFrame) -> DataFrame:
    """One row: validity and lengths. rows: nl, atl, profile."""
    words, chars = word_count(F.col("nl")), F.length("atl")
    valid = F.count_if(F.col("profile.valid"))
    return rows.select(words.alias("w"), chars.alias("c"), "profile").agg(
        _n().alias("total_pairs"),
        valid.alias("valid_atl_count"),
        (_n() - valid).alias("invalid_atl_count"),
        _rate(valid, _n()).alias("validity_rate"),
        _mean(F.col("w")).alias("avg_nl_length"),
        _mean(F.col("c")).alias("avg_atl_length"),
        _or_zero(F.stddev_samp("w")).alias("nl_length_std"),
        _or_zero(F.stddev_samp("c")).alias("atl_length_std"),
        F.min("w").alias("min_nl_length"),
        F.max("w").alias("max_nl_length"),
        F.min("c").alias("min_atl_length"),
        F.max("c").alias("max_atl_length"),
    )


def dataset_histograms(rows: DataFrame) -> DataFrame:
    """Depth, symbol, coalition, coalition size and atom of valid rows; source and template of all rows."""
    p = F.col("profile")
    ok = F.when(p["valid"], p)
    sizes = F.transform(ok["coalitions"], lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, ","))))
    depth = F.array_compact(F.array(ok["depth"]))
    template = F.array_compact(F.array(F.nullif(F.col("template_id"), F.lit(""))))
    return histograms(
        rows,
        {"source": F.col("source")},
        {
            "template": template, "depth": depth, "symbol": ok["symbols"], "coalition": ok["coalitions"],
            "coalition_size": sizes, "atom": ok["atoms"],
        },
    )


def dataset_scores(hist: DataFrame) -> DataFrame:
    """One row of scores from the histogram rows alone.

    Each row has one source and each valid row one depth, so these counts are
    the numbers of rows and of valid rows.
    """
    d, n = F.col("dimension"), F.col("n")

    def kinds(*names: str) -> Column:
        return F.count_if(d.isin(*names))

    symbols = F.sum(F.when(d == "symbol", n))
    depths = F.sum(F.when(d == "depth", n))
    depth_sum = F.sum(F.when(d == "depth", n * F.try_to_number(F.col("value"), F.lit("999"))))
    covered = F.count_if((d == "symbol") & F.col("value").isin(vocab.EXPECTED_SYMBOLS))
    agg = hist.agg(
        F.least(F.lit(1.0), kinds("template", "source", "depth", "symbol") / 40.0).alias("diversity_score"),
        (covered / float(len(vocab.EXPECTED_SYMBOLS))).alias("coverage_score"),
        (depth_sum.cast("double") / depths).alias("mean_depth"),
        F.coalesce(symbols, F.lit(0)).alias("symbols"),
        kinds("atom").alias("unique_atoms"),
        kinds("coalition").alias("unique_coalitions"),
        F.coalesce(F.sum(F.when(d == "source", n)), F.lit(0)).alias("total"),
        F.coalesce(depths, F.lit(0)).alias("valid"),
    )
    total, valid = F.col("total"), F.col("valid")
    per_valid = F.col("symbols") / F.greatest(valid, F.lit(1))
    return agg.select(
        "diversity_score",
        _rate(valid, total).alias("validity_rate"),
        "coverage_score",
        F.coalesce((F.col("mean_depth") + per_valid) / 2, F.lit(0.0)).alias("avg_formula_complexity"),
        "unique_atoms",
        "unique_coalitions",
    )


def verification_quality(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates of a verification log; confidence figures over values above 0."""
    total = _n()
    valid = F.count_if("syntax_valid")
    good, bad = F.count_if("semantic_verified"), F.count_if(~F.col("semantic_verified"))
    agree = F.count_if("cross_model_agreement")
    c = F.when(F.col("confidence") > 0, F.col("confidence"))
    return log.groupBy(*(by or [])).agg(
        total.alias("total_samples"),
        valid.alias("syntax_valid_count"),
        _rate(valid, total).alias("syntax_valid_rate"),
        good.alias("semantic_verified_count"),
        _rate(good, total).alias("semantic_verified_rate"),
        bad.alias("semantic_rejected_count"),
        (total - good - bad).alias("needs_review_count"),
        agree.alias("cross_model_agreement_count"),
        _rate(agree, total).alias("cross_model_agreement_rate"),
        _or_zero(_mean(c)).alias("avg_confidence"),
        _or_zero(F.min(c)).alias("min_confidence"),
        _or_zero(F.max(c)).alias("max_confidence"),
        _or_zero(F.stddev_samp(c)).alias("confidence_std"),
    )


def diversity(log: DataFrame) -> DataFrame:
    """Distinct domains, Shannon entropy of the domain shares, mean complexity and its buckets."""
    bucket = fx.complexity_bucket(F.col("complexity"))
    levels = ["low", "medium", "high"]
    per_domain = log.groupBy("domain").agg(
        _n().alias("n"), F.sum("complexity").alias("c"), *[F.count_if(bucket == b).alias(b) for b in levels]
    )
    n, total = F.col("n"), F.sum("n")
    # -sum(p log2 p) = log2(N) - sum(n log2 n) / N: no second pass for the shares
    entropy = F.log2(total) - F.sum(n * F.log2(n)) / total
    return per_domain.agg(
        _n().alias("unique_domains"),
        F.bround(_or_zero(entropy), 3).alias("domain_entropy"),
        F.bround(_or_zero(F.sum("c") / total), 2).alias("avg_complexity"),
        *[F.coalesce(F.sum(b), F.lit(0)).alias(b) for b in levels],
    )


def performance(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Latency, tokens, cost and throughput of a verification log."""
    ms = F.sum("latency_ms").cast("double")
    prompt = F.coalesce(F.sum("prompt_tokens"), F.lit(0))
    completion = F.coalesce(F.sum("completion_tokens"), F.lit(0))
    per_minute = F.when(ms > 0, _n() / (ms / 60000.0)).otherwise(0.0)
    return log.groupBy(*(by or [])).agg(
        _or_zero(ms).alias("total_time_ms"),
        _or_zero(_mean(F.col("latency_ms"))).alias("avg_time_per_sample_ms"),
        _or_zero(F.min("latency_ms")).alias("min_time_ms"),
        _or_zero(F.max("latency_ms")).alias("max_time_ms"),
        prompt.alias("total_prompt_tokens"),
        completion.alias("total_completion_tokens"),
        _rate(prompt + completion, _n()).alias("avg_tokens_per_sample"),
        F.bround(token_cost(prompt, completion), 4).alias("estimated_cost_usd"),
        F.bround(per_minute, 2).alias("samples_per_minute"),
    )


def run_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by outcome of a verification run; a null agreement counts on neither side."""
    s = F.col("status")
    return results.groupBy(*(by or [])).agg(
        _n().alias("total_samples"),
        F.count_if("syntax_valid").alias("syntax_valid"),
        F.count_if(~F.col("syntax_valid")).alias("syntax_invalid"),
        F.count_if(s == "verified").alias("semantic_verified"),
        F.count_if(s == "rejected").alias("semantic_rejected"),
        F.count_if(s == "needs_review").alias("needs_review"),
        F.count_if(s == "error").alias("errors"),
        F.count_if("cross_model_agreement").alias("cross_model_agreement"),
        F.count_if(~F.col("cross_model_agreement")).alias("cross_model_disagreement"),
        _or_zero(F.sum("latency_ms")).alias("total_time_ms"),
        _or_zero(_mean(F.col("latency_ms"))).alias("avg_time_per_sample_ms"),
    )


def rollups(rows: DataFrame, keys: list[str], status: str = "verification_status") -> DataFrame:
    """Totals and verified counts by each key and overall, in one GROUPING SETS pass."""
    data = rows.select(
        *[F.coalesce(F.col(k).cast("string"), F.lit("unknown")).alias(k) for k in keys],
        F.coalesce(F.col(status), F.lit("unknown")).alias("_s"),
    )
    sets = [[F.col(k)] for k in keys] + [[]]
    s = F.col("_s")
    agg = data.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        _n().alias("total"),
        F.count_if(s == "verified").alias("verified"),
        F.count_if(s == "rejected").alias("rejected"),
        F.count_if(~s.isin("verified", "rejected")).alias("needs_review"),
    )
    name = reduce(lambda acc, k: F.when(F.col(k).isNotNull(), F.lit(k)).otherwise(acc), keys, F.lit("all"))
    return agg.select(
        name.alias("dimension"), F.coalesce(*[F.col(k) for k in keys], F.lit("all")).alias("value"),
        "total", "verified", "rejected", "needs_review",
    )


def issue_counts(rows: DataFrame, reasons: str, first: int | None = None, width: int = 100) -> DataFrame:
    """Reasons cut to a key width and counted; ``first`` takes only the leading reasons of a row."""
    arr = F.col(reasons) if first is None else F.slice(F.col(reasons), 1, first)
    return rows.select(F.explode(arr).alias("r")).groupBy(cut(F.col("r"), width).alias("reason")).agg(_n().alias("n"))


def top(counts: DataFrame, key: str, k: int, n: str = "n") -> DataFrame:
    """The k most frequent values; ties go by key."""
    return counts.orderBy(F.col(n).desc(), F.col(key)).limit(k)


def experiment_histograms(rows: DataFrame) -> DataFrame:
    names = {"domain": "domain", "pattern": "pattern", "generator": "atl_generator", "verifier": "verifier"}
    return histograms(rows, {k: F.col(v) for k, v in names.items()}, {"operator": F.col("operators")})


def unified_stats(rows: DataFrame) -> DataFrame:
    """One row over a run: like store_stats, complexity = operators + agents."""
    hist = histograms(
        rows, {"domain": F.col("domain")}, {"agent": F.col("agents"), "atom": F.col("atoms")}
    )
    errors = F.coalesce(F.size("syntax_errors"), F.lit(0))
    score = F.size("operators") + F.size("agents")
    return rows.agg(
        _n().alias("total_samples"),
        F.count_if(F.col("verification_status") == "verified").alias("verified_count"),
        F.count_if(errors <= 0).alias("syntax_valid_count"),
        F.bround(_or_zero(_mean(score)), 2).alias("avg_complexity"),
    ).select("*", *_distinct(hist))


def retranslation_stats(rows: DataFrame) -> DataFrame:
    """Outcome counts and rates of a re-translation run."""
    s, v = F.col("status"), F.col("finetuned_verdict")
    accepted, refused = F.count_if(v == "ACCEPT"), F.count_if(v == "REJECT")
    valid = F.count_if("finetuned_syntax_valid")
    sure = F.when((v == "ACCEPT") & (F.col("finetuned_confidence") != 0), F.col("finetuned_confidence"))
    improved = F.count_if(s == "improved")
    return rows.agg(
        _n().alias("total"),
        improved.alias("improved"),
        (_rate(improved, _n()) * 100).alias("improvement_rate"),
        F.count_if(s == "same").alias("same"),
        F.count_if(s == "syntax_error").alias("syntax_errors"),
        F.count_if(s == "error").alias("errors"),
        F.count_if(s == "pending").alias("pending"),
        valid.alias("syntax_valid"),
        (_rate(valid, _n()) * 100).alias("syntax_valid_rate"),
        accepted.alias("accepted"),
        refused.alias("rejected"),
        (_rate(accepted, accepted + refused) * 100).alias("acceptance_rate"),
        _or_zero(_mean(sure)).alias("avg_confidence"),
    )


def model_stats(long: DataFrame) -> DataFrame:
    """Per model: times, tokens and validity of the rows that answered, and the error count.

    long: model, response_time, tokens_used, syntax_valid, error. The median is
    the upper one, element n // 2 of the sorted times.
    """
    ok = F.col("error").isNull()
    t = F.when(ok, F.col("response_time"))
    tokens = F.when(ok, F.col("tokens_used"))
    valid = F.count_if(ok & F.col("syntax_valid"))
    main = long.groupBy("model").agg(
        _n().alias("rows"),
        F.count_if(~ok).alias("error_count"),
        _mean(t).alias("avg_time"),
        F.min(t).cast("double").alias("min_time"),
        F.max(t).cast("double").alias("max_time"),
        _mean(tokens).alias("avg_tokens"),
        F.sum(tokens).alias("total_tokens"),
        valid.alias("syntax_valid_count"),
        (valid / F.nullif(F.count_if(ok), F.lit(0))).alias("syntax_valid_rate"),
        (valid / _n()).alias("syntax_valid_rate_of_all"),
    )
    medians = upper_half_median(
        long.filter(ok).select("model", "response_time"), "response_time", ["model"], "median_time"
    )
    return main.join(medians.withColumn("median_time", F.col("median_time").cast("double")), "model", "left")


def review_accuracy(reviews: DataFrame, exclude_errors: bool = False) -> DataFrame:
    """Per model: correct, incorrect, not reviewed, accuracy, valid count and mean response time.

    reviews: model, correct, response_time, syntax_valid, error. Rows with an
    error count with time 0 unless they are excluded.
    """
    yes, no = F.count_if("correct"), F.count_if(~F.col("correct"))
    t = F.coalesce(F.col("response_time"), F.lit(0))
    if exclude_errors:
        t = F.when(F.col("error").isNull(), F.col("response_time"))
    return reviews.groupBy("model").agg(
        _n().alias("rows"),
        yes.alias("correct"),
        no.alias("incorrect"),
        F.count_if(F.col("correct").isNull()).alias("not_reviewed"),
        (yes + no).alias("total_reviewed"),
        (yes / F.nullif(yes + no, F.lit(0))).alias("accuracy"),
        F.count_if("syntax_valid").alias("syntax_valid_count"),
        _mean(t).alias("avg_response_time"),
        F.count_if(F.col("error").isNull()).alias("answered"),
    )


def best_models(accuracy: DataFrame) -> DataFrame:
    """One row: most accurate and fastest model; models without an answered row are out."""
    m = F.col("model")
    able = F.col("answered") > 0
    return accuracy.agg(
        F.min_by(m, F.when(F.col("accuracy").isNotNull(), F.struct(-F.col("accuracy"), m))).alias("most_accurate"),
        F.max("accuracy").alias("best_accuracy"),
        F.min_by(m, F.when(able, F.struct("avg_response_time", "model"))).alias("fastest"),
        F.min(F.when(able, F.col("avg_response_time"))).alias("fastest_time"),
    )


def syntax_error_rates(accuracy: DataFrame) -> DataFrame:
    wrong = F.col("rows") - F.col("syntax_valid_count")
    return accuracy.select("model", wrong.alias("syntax_errors"), (wrong / F.col("rows")).alias("syntax_error_rate"))


def training_stats(rows: DataFrame, fraction: float) -> DataFrame:
    """One row from columns failed_filter and field_error, in one pass.

    How many rows train and validate follows from the number of valid ones, as
    ``split_exact`` takes exactly so many.
    """
    passed = F.col("failed_filter").isNull()
    ok = passed & F.col("field_error").isNull()
    f = F.col("failed_filter")
    counts = rows.agg(
        _n().alias("total_samples"),
        F.count_if(f == "filtered_confidence").alias("filtered_confidence"),
        F.count_if(f == "filtered_status").alias("filtered_status"),
        F.count_if(f == "filtered_domain").alias("filtered_domain"),
        F.count_if(passed).alias("passed"),
        F.count_if(ok).alias("valid_samples"),
        F.count_if(passed & ~ok).alias("invalid_samples"),
    )
    valid = F.col("valid_samples")
    validation = F.least(valid, F.greatest(F.lit(1), F.floor(valid * F.lit(fraction))))
    return counts.select(
        "*", (valid - validation).alias("training_samples"), validation.alias("validation_samples"), training_cost(valid).alias("training_cost_usd")
    )


def retry_stats(retried: DataFrame) -> DataFrame:
    """One row; a retry that failed again counts as still rejected and as an error."""
    good = F.col("verification_status") == "verified"
    return retried.agg(
        _n().alias("total_retried"),
        F.count_if(good).alias("newly_verified"),
        F.count_if(~good).alias("still_rejected"),
        F.count_if(F.col("verification_verdict") == "ERROR").alias("retry_errors"),
    )


def funnel(rows: DataFrame, stages: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """(stage, n): rows that meet each condition, and distinct texts, in one pass.

    Texts are told apart by their 128-bit digest, so that no text is shuffled.
    """
    counts = [F.count_if(c).alias(k) for k, c in stages.items()]
    counts += [F.count_distinct(F.unhex(F.md5(c))).alias(k) for k, c in (distinct or {}).items()]
    return rows.agg(*counts).unpivot([], [*stages, *(distinct or {})], "stage", "n")


def success_summary(rows: DataFrame, ok: Column) -> DataFrame:
    good = F.count_if(ok)
    return rows.agg(good.alias("successes"), _n().alias("total"), _rate(good, _n()).alias("success_rate"))


def coverage_report(rows: DataFrame, key: str) -> DataFrame:
    """Histogram with percent of the total."""
    counts = rows.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(_n().alias("n"))
    total = rows.agg(_n()).scalar()
    return counts.withColumn("percent", F.col("n") * 100.0 / total)


def trend(log: DataFrame, bucket: Column) -> DataFrame:
    """Cumulative series per time bucket: verification rate, mean confidence, throughput.

    The window runs over one row per bucket.
    """
    c = F.when(F.col("confidence") > 0, F.col("confidence"))
    per = log.groupBy(bucket.alias("bucket")).agg(
        _n().alias("n"),
        F.count_if("semantic_verified").alias("v"),
        F.sum(c).alias("c"),
        F.count(c).alias("cn"),
        F.sum("latency_ms").alias("ms"),
    )
    upto = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    run = {k: F.sum(k).over(upto) for k in ["n", "v", "c", "cn", "ms"]}
    ms = run["ms"].cast("double")
    return per.select(
        "bucket",
        run["n"].alias("samples_processed"),
        (run["v"] / run["n"]).alias("verification_rate"),
        _or_zero(run["c"].cast("double") / F.nullif(run["cn"], F.lit(0))).alias("avg_confidence"),
        F.when(ms > 0, run["n"] / (ms / 60000.0)).otherwise(0.0).alias("throughput"),
    )
