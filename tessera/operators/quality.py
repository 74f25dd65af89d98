"""Data quality: rule gates, validation reports, confidence summaries, corpus statistics, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def gate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, checked, passed): all rules in one pass over the rows (Q1)."""
    one = df.agg(F.count("*").alias("_n"), *[F.sum((~F.coalesce(c, F.lit(False))).cast("long")).alias(k) for k, c in rules.items()])
    rows = one.select(F.col("_n"), F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(F.col(k), F.lit(0)).alias("violations")) for k in rules])).alias("x"))
    return rows.select("x.rule", "x.violations", F.col("_n").alias("checked"), (F.col("x.violations") == 0).alias("passed"))


def validated(df: DataFrame, keys: list[str], confidence: str, low: float = 0.6, warn: float = 0.1, fail: float = 0.3, compat: str | None = None) -> DataFrame:
    """Count, confidence range, low share and PASS, WARN or FAIL per exam (A11). compat="reference" turns WARN to PASS."""
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(confidence), 6).alias("mean"), F.min(confidence).alias("lowest"), F.max(confidence).alias("highest"), F.sum((F.col(confidence) < low).cast("long")).alias("low")
    )
    share = F.col("low") / F.col("n")
    status = F.when(share > fail, "FAIL").when(share > warn, "PASS" if compat == "reference" else "WARN").otherwise("PASS")
    return out.withColumn("status", status)


def confidence_summary(df: DataFrame, confidence: str, edges: tuple[float, ...] = (0.92, 0.94, 0.96, 0.98)) -> DataFrame:
    """Mean, rows below the first edge, and rows per bucket, in one row."""
    c = F.col(confidence)
    steps = [(None, edges[0]), *zip(edges, edges[1:]), (edges[-1], None)]
    inside = [F.sum(((F.lit(True) if a is None else c >= a) & (F.lit(True) if b is None else c < b)).cast("long")).alias(f"bucket_{i}") for i, (a, b) in enumerate(steps)]
    return df.agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), *inside)


def combined_confidence(parts: dict[str, tuple[Column, float]], strict: bool = False) -> Column:
    """Weighted mean, missing parts counting as 0.5, or the least of them."""
    given = [(F.coalesce(c, F.lit(0.5)), w) for c, w in parts.values()]
    return F.least(*[c for c, _ in given]) if strict else reduce(lambda a, b: a + b, [c * w for c, w in given]) / sum(w for _, w in given)


def corpus_statistics(df: DataFrame, text: str, label: str, group: str) -> DataFrame:
    """One row of corpus metrics in one pass."""
    n = F.length(text)
    return df.agg(
        F.count("*").alias("n"),
        F.sum(F.col(text).isNull().cast("long")).alias("without_text"),
        F.sum((n < 50).cast("long")).alias("short"),
        F.sum(n).alias("chars"),
        F.min(n).alias("shortest"),
        F.max(n).alias("longest"),
        F.countDistinct(label).alias("labels"),
        F.countDistinct(group).alias("groups"),
    )


def system_score(parts: dict[str, tuple[float, float]]) -> float:
    """Weighted mean of component scores (Q3)."""
    return sum(s * w for s, w in parts.values()) / sum(w for _, w in parts.values())


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as dotted names, arrays joined by semicolons (IO12, M11)."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            at = (*path, f.name)
            c = F.col(".".join(f"`{p}`" for p in at))
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, at)
            elif isinstance(f.dataType, T.ArrayType):
                out.append(F.array_join(c.cast("array<string>"), "; ").alias(".".join(at)))
            else:
                out.append(c.alias(".".join(at)))
        return out

    return df.select(*leaves(df.schema, ()))


def training_rows(df: DataFrame, key: str, text: str, features: list[str], label: str, split: Column) -> DataFrame:
    """One JSON line per row: id, split, text, features, label (IO13, Q4)."""
    return df.select(F.to_json(F.struct(F.col(key).alias("id"), split.alias("split"), F.col(text).alias("text"), F.struct(*features).alias("features"), F.col(label).alias("label"))).alias("value"))


def qa_rows(df: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """A row per question that the record can answer (Q4)."""
    given = F.filter(F.array(*[F.struct(F.lit(q).alias("question"), a.cast("string").alias("answer")) for q, a in parts.items()]), lambda x: x["answer"].isNotNull() & (x["answer"] != ""))
    return df.select(key, F.explode(given).alias("x")).select(key, "x.*")
