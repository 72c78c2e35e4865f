"""Sinks. A run writes to a directory of its own and never rewrites another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairwright.operators.ranking import measured, with_columns_of

CSV_COLUMNS = [
    "id", "nl_statement", "atl_formula", "atl_unicode", "domain", "template_id", "agents", "operators", "atoms",
    "syntax_valid", "confidence",
]
METRIC_COLUMNS = [
    "sample_id", "domain", "syntax_valid", "semantic_verified", "confidence", "cross_model_agreement", "complexity",
    "latency_ms", "prompt_tokens", "completion_tokens", "timestamp",
]


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line; null fields are left out."""
    df.write.option("ignoreNullFields", True).json(path)


def csv_rows(df: DataFrame) -> DataFrame:
    """The fixed columns, arrays comma-joined."""
    arrays = {"agents", "operators", "atoms"}
    return df.select(*[F.concat_ws(",", c).alias(c) if c in arrays else F.col(c) for c in CSV_COLUMNS])


def write_dataset(df: DataFrame, path: str, fmt: str = "jsonl") -> None:
    if fmt == "jsonl":
        write_jsonl(df, path)
    elif fmt == "csv":
        csv_rows(df).write.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"Unknown format: {fmt}. Use 'jsonl' or 'csv'.")


def write_metrics_csv(log: DataFrame, path: str) -> None:
    log.select(*METRIC_COLUMNS).write.option("header", True).csv(path)


def write_run(samples: DataFrame, stats: dict[str, DataFrame], root: str, run_id: str) -> dict[str, str]:
    """Data and each statistics table of a run, side by side under one run directory."""
    base = f"{root}/run_id={run_id}"
    out = {"samples": f"{base}/samples", **{k: f"{base}/stats/{k}" for k in stats}}
    samples.write.parquet(out["samples"])
    for k, df in stats.items():
        df.write.json(out[k])
    return out


ROUTES = ("verified", "rejected", "needs_review")


def observed_routes(rows: DataFrame, by: str, routes: tuple[str, ...], measures: dict[str, Column]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """Rows that are counted per route while something else is done with them, and what gives the counts after that.

    The counts are route, n, and of each measure its sum and the number of values;
    they add up over batches. Rows of no named route are those of route null.
    """
    seen = Observation()
    route = F.col(by)
    tests = [*[(name, route.eqNullSafe(name)) for name in routes], (None, ~F.coalesce(route.isin(*routes), F.lit(False)))]
    parts = []
    for k, (_, test) in enumerate(tests):
        parts.append(F.count_if(test).alias(f"{k}_n"))
        for m, value in measures.items():
            parts += [F.sum(F.when(test, value)).cast("double").alias(f"{k}_{m}_sum"), F.count(F.when(test, value)).alias(f"{k}_{m}_count")]
    names = ["n", *[f"{m}_{x}" for m in measures for x in ("sum", "count")]]
    kinds = ", ".join(f"`{n}` {'double' if n.endswith('_sum') else 'long'}" for n in names)

    def counts() -> DataFrame:
        got = seen.get
        found = [(name, *[got[f"{k}_{n}"] for n in names]) for k, (name, _) in enumerate(tests)]
        return rows.sparkSession.createDataFrame([f for f in found if f[0] is not None or f[1]], f"route string, {kinds}")

    return rows.observe(seen, *parts), counts


def write_routed(
    rows: DataFrame, path: str, by: str = "verification_status", stats: str | None = None, routes: tuple[str, ...] = ROUTES, measures: dict[str, Column] | None = None
) -> None:
    """One sub-directory per status, so later jobs read only the side they need.

    With ``stats`` the statistics of each side are written there; they are taken
    while the rows are written and cost no further scan.
    """
    if stats is None:
        rows.write.partitionBy(by).parquet(path)
        return
    watched, counts = observed_routes(rows, by, routes, measures or {})
    watched.write.partitionBy(by).parquet(path)
    counts().write.json(stats)


def by_domain(statements: DataFrame) -> DataFrame:
    """Statements with the size of their domain, range-partitioned and sorted by domain and text.

    The nested report of a domain is a run of neighbouring rows; no domain is
    ever collected into one value. Statements without a domain are one domain.
    """
    sizes = measured(statements.groupBy("domain").agg(F.count(F.lit(1)).alias("domain_count")))
    return (
        with_columns_of(statements, sizes, ["domain"])
        .repartitionByRange("domain", "nl_statement")
        .sortWithinPartitions("domain", "nl_statement")
    )


def write_split(rows: DataFrame, path: str) -> None:
    """Training and validation records in directories of their own."""
    rows.select("split", "messages").write.partitionBy("split").json(path)


def write_comparison(long: DataFrame, review: DataFrame, stats: DataFrame, path: str) -> None:
    long.write.parquet(f"{path}/raw")
    review.write.json(f"{path}/review")
    stats.write.json(f"{path}/stats")
