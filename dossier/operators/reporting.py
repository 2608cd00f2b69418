"""Counts, trends, histories and the dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import as_date
from dossier.functions.ranking import ranged_position, top_per_key


def entity_counts(df: DataFrame, as_of: str, key: str = "user_id", created: str = "created_at") -> DataFrame:
    """Rows per key and how many of them are from ``as_of`` on."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(created) >= as_date(as_of).cast("timestamp")).alias("today")
    )


INDEX_STATUSES = ["indexed", "processed", "failed", "pending"]


def status_counts(index: DataFrame, as_of: str) -> DataFrame:
    """Documents per user by status, overall and from ``as_of`` on, in one pass."""
    fresh = F.col("created_at") >= as_date(as_of).cast("timestamp")
    totals = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in INDEX_STATUSES]
    today = [F.count_if((F.col("status") == s) & fresh).alias(f"{s}_today") for s in INDEX_STATUSES]
    return index.groupBy("user_id").agg(*totals, *today)


def last_updated(*sources: DataFrame) -> DataFrame:
    """Latest update per user over several ``(user_id, updated_at)`` tables; nulls are ignored."""
    latest = [s.groupBy("user_id").agg(F.max("updated_at").alias("updated_at")) for s in sources]
    return reduce(DataFrame.unionByName, latest).groupBy("user_id").agg(F.max("updated_at").alias("last_updated_at"))


def company_child_counts(companies: DataFrame, **children: DataFrame) -> DataFrame:
    """Children per company and kind, zero-filled; one aggregation over the union of all children."""
    rows = reduce(DataFrame.unionByName, [c.select("company_id", F.lit(k).alias("kind")) for k, c in children.items()])
    counts = rows.groupBy("company_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in children])
    names = [f"{k}_count" for k in children]
    return companies.select(F.col("id").alias("company_id"), "user_id").join(counts, "company_id", "left").fillna(0, names)


def distinct_values(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Different values per key in order; ``position`` numbers them from zero."""
    return ranged_position(df.select(*keys, column).distinct(), keys, [F.asc(column)]).orderBy(*keys, "position")


def latest(df: DataFrame, *columns: str) -> DataFrame:
    """Newest first; rows without a value come last. ``position`` numbers them from zero."""
    return ranged_position(df, [], [F.desc_nulls_last(c) for c in columns]).orderBy("position")


def recent_history(events: DataFrame, n: int = 12) -> DataFrame:
    """The newest ``n`` events of every entity."""
    return top_per_key(events, ["entity_type", "entity_id"], [F.desc("id")], n, rank="recency")


def cap_history(df: DataFrame, keys: list[str], order: str, n: int = 50) -> DataFrame:
    """The last ``n`` rows of a history per key."""
    return top_per_key(df, keys, [F.desc(order)], n)


def _owned(children: DataFrame, companies: DataFrame, as_of: str, kind: str, created: Column) -> DataFrame:
    """Per-user counts of a company's children; reduced per company before meeting the companies."""
    fresh = created >= as_date(as_of).cast("timestamp")
    per_company = children.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(fresh).alias("t"))
    owner = companies.select(F.col("id").alias("company_id"), "user_id")
    return per_company.join(owner, "company_id").select("user_id", F.lit(kind).alias("kind"), "n", "t")


def _direct(df: DataFrame, as_of: str, kind: str | Column) -> DataFrame:
    fresh = F.col("created_at") >= as_date(as_of).cast("timestamp")
    label = F.lit(kind) if isinstance(kind, str) else kind
    return df.groupBy("user_id", label.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(fresh).alias("t"))


# Module and metric labels with the counted kinds behind them.
DASHBOARD = [
    ("Resumen", "Documentos", ["acta", "opinion", "regulation"], True),
    ("Resumen", "Procesados", ["index:processed"], True),
    ("Resumen", "Pendientes", ["index:pending"], True),
    ("Modulo 1", "Empresas", ["company"], True),
    ("Modulo 1", "Actas", ["acta"], True),
    ("Modulo 1", "Opiniones", ["opinion"], True),
    ("Modulo 2", "Regulaciones", ["regulation"], True),
    ("Modulo 2", "Indexadas", ["index:indexed"], True),
    ("Modulo 2", "Con error", ["index:failed"], True),
    ("Modulo 3", "Expedientes creados", ["tender"], True),
    ("Modulo 3", "Checklist IA", ["tender"], True),
    ("Modulo 3", "Documentos generados", [], False),
    ("Modulo 4", "Expedientes validados", ["validation:reviewed", "validation:draft", "validation:ready_for_export"], True),
    ("Modulo 4", "Observaciones abiertas", ["light:yellow", "light:red"], False),
    ("Modulo 4", "Expedientes listos", ["validation:ready_for_export"], False),
]


def dashboard(entities: dict[str, DataFrame], as_of: str) -> DataFrame:
    """Module metrics of all users at once: ``(user_id, module, metric, value, today)``.

    Every table is reduced before the union, so the final aggregation sees a handful of rows per user.
    """
    companies = entities["companies"]
    parts = [
        _direct(companies, as_of, "company"),
        _owned(entities["deeds"], companies, as_of, "acta", F.col("created_at")),
        _owned(entities["opinions"], companies, as_of, "opinion", F.col("fecha_emision").cast("timestamp")),
        _direct(entities["regulations"], as_of, "regulation"),
        _direct(entities["tenders"], as_of, "tender"),
        _direct(entities["validations"], as_of, F.concat(F.lit("validation:"), F.col("status"))),
        _direct(entities["validations"], as_of, F.concat(F.lit("light:"), F.col("traffic_light"))),
        _direct(entities["index"], as_of, F.concat(F.lit("index:"), F.col("status"))),
    ]
    rows = reduce(DataFrame.unionByName, parts)

    def total(kinds: list[str], column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(kinds), F.col(column))), F.lit(0)) if kinds else F.lit(0).cast("long")

    measures = []
    for i, (_, _, kinds, trend) in enumerate(DASHBOARD):
        measures += [total(kinds, "n").alias(f"n{i}"), total(kinds if trend else [], "t").alias(f"t{i}")]
    per_user = entities["users"].select(F.col("id").alias("user_id")).join(rows, "user_id", "left").groupBy("user_id").agg(*measures)
    stacked = ", ".join(f"'{m}', '{label}', n{i}, t{i}" for i, (m, label, _, _) in enumerate(DASHBOARD))
    return per_user.selectExpr("user_id", f"stack({len(DASHBOARD)}, {stacked}) as (module, metric, value, today)")
