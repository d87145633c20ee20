"""The given tables in the shape of the operators' input contracts, and the same in SQL."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textvane.scale import spread_out
from textvane.session import use_utc

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


class Catalog(dict):
    """Name -> entry; ``add`` is used as a decorator on the query function."""

    def add(self, sql: str | None = None):
        def register(run: Query) -> Query:
            self[run.__name__] = Entry(run, sql)
            return run

        return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def spread_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents on all cores, for expressions that cost more than moving the text."""
    return spread_out(documents(spark, folder))


def classes(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return table(spark, folder, "labels").select("doc_id", label.alias("label"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents."""
    texts = documents(spark, folder).select("doc_id", "text")
    return texts.join(classes(spark, folder), "doc_id")


LINES_PER_DOCUMENT = 1 << 32  # an array holds fewer


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document as a row of its own."""
    split = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return split.select((F.col("doc_id") * LINES_PER_DOCUMENT + F.col("line")).alias("doc_id"), "text")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A prediction per document: label and confidence follow from its id and length."""
    names = F.array(*[F.lit(x) for x in ("negative", "neutral", "positive", "other")])
    return spread_documents(spark, folder).select(
        "doc_id",
        "text",
        F.get(names, (F.col("n_chars") % 4).cast("int")).alias("label"),
        ((F.col("n_chars") * 7 + F.col("doc_id")) % 101 / 100.0).alias("confidence"),
    )


def judged_labels(spark: SparkSession, folder: str) -> DataFrame:
    """True class and a predicted one that is right for about two rows in three."""
    names = F.array(*[F.lit(x) for x in ("negative", "neutral", "positive")])
    texts = documents(spark, folder).select("doc_id", "n_chars")
    guess = F.get(names, (F.col("n_chars") % 3).cast("int"))
    return classes(spark, folder).join(texts, "doc_id").select(
        "doc_id",
        F.col("label").alias("true_label"),
        F.when(F.col("doc_id") % 3 == 0, guess).otherwise(F.col("label")).alias("pred_label"),
    )


def events(spark: SparkSession, folder: str, key: str = "user_id") -> DataFrame:
    return as_events(table(spark, folder, "events"), key)


def as_events(raw: DataFrame, key: str = "user_id") -> DataFrame:
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr(key).alias("key"),
        F.lit("request").alias("kind"),
        F.col("value").alias("latency_ms"),
        F.col("event_type").alias("label"),
        (F.regexp_extract("props", r"(\d+)", 1).cast("double") / 100).alias("confidence"),
        (F.col("event_type") == "error").alias("error"),
    )


TENANT = "user_id % 7"  # few keys with long logs, for the windows over hundreds of rows


def plain_ts(df: DataFrame, *names: str) -> DataFrame:
    """Event times in the zone-less type of the tables."""
    for name in names or ("ts",):
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


def r6(name: str | Column, alias: str | None = None) -> Column:
    value = F.col(name) if isinstance(name, str) else name
    return F.round(value, 6).alias(alias or name)


def steady(name: str, digits: int = 6, alias: str | None = None) -> Column:
    """A mean, nudged off the rounding ties that sums in another order would break differently."""
    return F.round(F.col(name) + 1e-9, digits).alias(alias or name)


# --- the same shapes for the checking database --------------------------------

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CLS = """cls AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
  ELSE 'neutral' END AS label FROM labels)"""
CORPUS = CLS + """, corpus AS (SELECT d.doc_id, d.text, c.label FROM documents d JOIN cls c USING (doc_id))"""
LINES = """lines AS (SELECT doc_id * 4294967296 + (unnest(generate_series(1, len(string_split(text, chr(10))))) - 1) AS doc_id,
  unnest(string_split(text, chr(10))) AS text FROM documents)"""
PREDICTIONS = """pred AS (SELECT doc_id, text, CASE n_chars % 4 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral'
  WHEN 2 THEN 'positive' ELSE 'other' END AS label, ((n_chars * 7 + doc_id) % 101)::DOUBLE / 100.0::DOUBLE AS confidence
  FROM documents)"""
JUDGED = CLS + """, judged AS (SELECT c.doc_id, c.label AS true_label, CASE WHEN c.doc_id % 3 <> 0 THEN c.label
  ELSE CASE d.n_chars % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END END AS pred_label
  FROM cls c JOIN documents d USING (doc_id))"""


def ev(key: str = "user_id") -> str:
    return f"""ev AS (SELECT event_id, ts, {key} AS key, value AS latency_ms, event_type AS label,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100 AS confidence, event_type = 'error' AS error,
  epoch_us(ts) AS us FROM events)"""


def clean_sql(text: str) -> str:
    """Controls out, spaces collapsed, quotes repaired, trimmed."""
    kept = rf"regexp_replace(coalesce({text}, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
    spaced = rf"trim(regexp_replace({kept}, '{SPACE}+', ' ', 'g'))"
    fixed = f"replace(replace(replace({spaced}, 'â' || chr(128) || chr(153), ''''), 'â' || chr(128) || chr(156), '\"'), 'â' || chr(128) || chr(157), '\"')"
    return f"trim({fixed})"


def redact_steps_sql(source: str) -> str:
    """CTE ``red`` with r0 (raw) to r5 (all patterns applied)."""
    from textvane.config import PII_PATTERNS

    current, ctes = f"(SELECT doc_id, text AS r0 FROM {source})", []
    for i, (kind, pattern) in enumerate(PII_PATTERNS, 1):
        ctes.append(
            f"red{i} AS (SELECT *, regexp_replace(r{i - 1}, '{pattern}', '[REDACTED_{kind.upper()}]', 'g') AS r{i} FROM {current})"
        )
        current = f"red{i}"
    return ", ".join(ctes)


def pii_types_sql() -> str:
    from textvane.config import PII_PATTERNS

    tests = ", ".join(f"CASE WHEN r{i} <> r{i - 1} THEN '{kind}' END" for i, (kind, _) in enumerate(PII_PATTERNS, 1))
    return f"coalesce(array_to_string([x FOR x IN [{tests}] IF x IS NOT NULL], ','), '')"


def greedy_sql(source: str, threshold: float, text: str = "text") -> str:
    """CTEs ending in ``dup(leader_id, member_id, similarity)``: first-come leaders over word-shingle Jaccard."""
    return rf"""
words AS (SELECT doc_id, string_split(trim(regexp_replace(lower({text}), '{SPACE}+', ' ', 'g')), ' ') AS w FROM {source}),
shingle AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM words))),
size_of AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingle a JOIN shingle b USING (s)
  WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
edge AS (SELECT u, v, c::DOUBLE / (x.n + y.n - c) AS similarity FROM common
  JOIN size_of x ON x.doc_id = u JOIN size_of y ON y.doc_id = v WHERE c::DOUBLE / (x.n + y.n - c) >= {threshold}),
starts AS (SELECT u, list(v) AS vs, row_number() OVER (ORDER BY u) AS k FROM edge GROUP BY u),
walk(k, members) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT w.k + 1, CASE WHEN list_contains(w.members, s.u) THEN w.members ELSE list_concat(w.members, s.vs) END
  FROM walk w JOIN starts s ON s.k = w.k + 1),
gone AS (SELECT DISTINCT unnest(members) AS doc_id FROM (SELECT members FROM walk ORDER BY k DESC LIMIT 1)),
dup AS (SELECT arg_min(u, u) AS leader_id, v AS member_id, arg_min(similarity, u) AS similarity FROM edge
  WHERE v IN (SELECT doc_id FROM gone) AND u NOT IN (SELECT doc_id FROM gone) GROUP BY v)"""
