"""Registered queries on texts: cleaning, validation, guardrails, quality, deduplication, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from textvane.catalog.tables import (
    CLS, CORPUS, LINES, PREDICTIONS, Catalog, classes, clean_sql, corpus, documents, greedy_sql, lines, pii_types_sql,
    predictions, r6, redact_steps_sql, spread_documents, table,
)
from textvane.catalog import tables
from textvane.functions.pii import with_redaction
from textvane.functions.scores import encode_label
from textvane.functions.text import clean_basic, clean_text as clean_expr, is_blank, n_bytes, n_chars
from textvane.operators import batching, dedup, guardrails, quality, sampling, validation
from textvane.operators.similarity import Jaccard, MatcherRatio
from textvane.plans.preprocess import preprocess, run_stats as step_counts, stage_stats, timed_preprocess, validated_steps
from textvane.scale import spread_out
from textvane.session import scratch_path
from textvane.sources.corpus import cache_to_disk, load_corpus

CATALOG = Catalog()
NEAR = 0.8  # similarity threshold of the registered near-duplicate queries
GREEDY = greedy_sql("documents", NEAR)


@CATALOG.add("SELECT doc_id, lang, n_chars FROM documents WHERE lang = 'en'")
def load_subset(spark, folder):
    return load_corpus(
        spark, f"{folder}/documents.parquet", agreement="en", agreement_column="lang"
    ).select("doc_id", "lang", "n_chars")


@CATALOG.add(f"WITH {CORPUS} SELECT label, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM corpus GROUP BY label")
def cached_corpus(spark, folder):
    path = cache_to_disk(corpus(spark, folder), scratch_path(spark, "corpus"), partition_by="label")
    back = load_corpus(spark, path)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(n_chars(F.col("text"))).alias("n_chars"))


@CATALOG.add(
    f"WITH {redact_steps_sql('documents')} SELECT doc_id, md5(r5) AS redacted_md5, {pii_types_sql()} AS pii_types FROM red5"
)
def pii_redact(spark, folder):
    redacted = with_redaction(spread_documents(spark, folder).select("doc_id", "text"))
    return redacted.select(
        "doc_id", F.md5("redacted_text").alias("redacted_md5"), F.array_join("pii_detected", ",").alias("pii_types")
    )


@CATALOG.add(
    f"""WITH {redact_steps_sql('documents')}, typed AS (SELECT doc_id, unnest(string_split({pii_types_sql()}, ',')) AS pii_type
  FROM red5) SELECT lang, pii_type, count(*) AS n_rows FROM typed JOIN documents USING (doc_id)
  WHERE pii_type <> '' GROUP BY lang, pii_type"""
)
def pii_type_counts(spark, folder):
    return guardrails.pii_type_counts(spread_documents(spark, folder), ["lang"])


@CATALOG.add(
    f"WITH c AS (SELECT doc_id, {clean_sql('text')} AS t FROM documents) SELECT doc_id, md5(t) AS clean_md5, length(t) AS n_chars, octet_length(encode(t)) AS n_bytes FROM c"
)
def clean_text(spark, folder):
    cleaned = spread_documents(spark, folder).select("doc_id", clean_expr(F.col("text")).alias("t"))
    return cleaned.select(
        "doc_id", F.md5("t").alias("clean_md5"), n_chars(F.col("t")).alias("n_chars"), n_bytes(F.col("t")).alias("n_bytes")
    )


BLANK = f"(text IS NULL OR regexp_full_match(text, '{tables.SPACE}*'))"


@CATALOG.add(f"WITH {LINES} SELECT doc_id FROM lines WHERE {BLANK}")
def blank_rows(spark, folder):
    return validation.blank_rows(lines(spark, folder)).select("doc_id")


@CATALOG.add(f"WITH {LINES} SELECT doc_id FROM lines WHERE {BLANK} ORDER BY doc_id LIMIT 10")
def first_blank_rows(spark, folder):
    return validation.blank_rows(lines(spark, folder)).select("doc_id").orderBy("doc_id").limit(10)


@CATALOG.add(
    f"WITH {LINES} SELECT count(*) FILTER (NOT {BLANK}) AS n_valid, count(*) FILTER ({BLANK}) AS n_failed FROM lines"
)
def validation_counts(spark, folder):
    return validation.validation_counts(lines(spark, folder))


@CATALOG.add(
    """WITH r AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN 0.7::DOUBLE ELSE (doc_id % 13)::DOUBLE / 10 END AS t FROM documents),
  s AS (SELECT doc_id, t, [x FOR x IN [CASE WHEN length(text) < 1 THEN 'text_too_short' END,
    CASE WHEN length(text) > 2048 THEN 'text_too_long' END, CASE WHEN t < 0 OR t > 1 THEN 'threshold_out_of_range' END]
    IF x IS NOT NULL] AS why FROM r)
  SELECT doc_id, t AS confidence_threshold, len(why) = 0 AS valid, coalesce(array_to_string(why, ','), '') AS reasons FROM s"""
)
def request_validation(spark, folder):
    threshold = F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 13 / 10.0)
    requests = documents(spark, folder).select("doc_id", "text", threshold.alias("confidence_threshold"))
    return validation.check_requests(requests).select(
        "doc_id", "confidence_threshold", "valid", F.array_join("reasons", ",").alias("reasons")
    )


LOW = "CASE WHEN confidence < 0.7::DOUBLE THEN printf('LOW_CONFIDENCE: %.3f < 0.7', confidence) END"
BAD = "CASE WHEN label NOT IN ('negative', 'neutral', 'positive') THEN 'INVALID_LABEL: ''' || label || ''' not in [''negative'', ''neutral'', ''positive'']' END"


@CATALOG.add(f"WITH {PREDICTIONS} SELECT doc_id, confidence, coalesce({LOW}, '') AS flag FROM pred")
def confidence_flags(spark, folder):
    flag = guardrails.confidence_flag(F.col("confidence"))
    return predictions(spark, folder).select("doc_id", "confidence", F.coalesce(flag, F.lit("")).alias("flag"))


@CATALOG.add(f"WITH {PREDICTIONS} SELECT doc_id, label, coalesce({BAD}, '') AS flag FROM pred")
def label_validation(spark, folder):
    flag = guardrails.label_flag(F.col("label"))
    return predictions(spark, folder).select("doc_id", "label", F.coalesce(flag, F.lit("")).alias("flag"))


VERDICT_SQL = f"""WITH {PREDICTIONS}, {redact_steps_sql('pred')}, f AS (SELECT p.doc_id, p.label, p.confidence,
    [x FOR x IN [{LOW}, {BAD}] IF x IS NOT NULL] AS flags, md5(r5) AS redacted_md5, {pii_types_sql()} AS pii_types
    FROM pred p JOIN red5 USING (doc_id))
  SELECT doc_id, label, confidence, len(flags) = 0 AS passed, coalesce(array_to_string(flags, '; '), '') AS flags,
    redacted_md5, pii_types FROM f"""


def verdict_columns(judged):
    return judged.select(
        "doc_id",
        "label",
        "confidence",
        "passed",
        F.array_join("flags", "; ").alias("flags"),
        F.md5("redacted_text").alias("redacted_md5"),
        F.array_join("pii_detected", ",").alias("pii_types"),
    )


@CATALOG.add(VERDICT_SQL)
def guardrail_verdicts(spark, folder):
    return verdict_columns(guardrails.apply_guardrails(predictions(spark, folder), stamp=False))


@CATALOG.add(
    f"""WITH {PREDICTIONS} SELECT doc_id, CAST(CASE label WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 WHEN 'positive' THEN 2
  ELSE -1 END AS INTEGER) AS label_id FROM pred"""
)
def label_encode(spark, folder):
    return predictions(spark, folder).select("doc_id", encode_label(F.col("label")).alias("label_id"))


LENGTHS = """len AS (SELECT doc_id, length(text) AS l FROM {0}), srt AS (SELECT list_sort(list(l)) AS s, count(*) AS n FROM len),
  st AS (SELECT n, s[CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1] AS p, s[n // 2 + 1] AS med FROM srt)"""
LENGTH_ROW = """(SELECT n FROM st) AS n_texts, round(avg(l), 6) AS mean_length, min(l) AS min_length,
  max(l) AS max_length, (SELECT med FROM st) AS median_length, (SELECT p FROM st) AS percentile_length,
  count(*) FILTER (l > (SELECT p FROM st)) AS outlier_count"""


@CATALOG.add(f"WITH {LENGTHS.format('documents')} SELECT {LENGTH_ROW} FROM len")
def length_stats(spark, folder):
    stats = quality.length_stats(documents(spark, folder))
    return stats.withColumn("mean_length", F.round("mean_length", 6))


@CATALOG.add(f"WITH {LENGTHS.format('documents')} SELECT doc_id, l AS n FROM len WHERE l > (SELECT p FROM st)")
def length_outliers(spark, folder):
    return quality.length_outliers(documents(spark, folder)).select("doc_id", n_chars(F.col("text")).alias("n"))


BALANCE = """cnt AS (SELECT label, count(*) AS n, min(doc_id) AS first_id FROM {0} GROUP BY label)"""
BALANCE_ROW = """count(*) AS n_labels, CAST(sum(n) AS BIGINT) AS n_rows, round(max(n)::DOUBLE / min(n), 6) AS imbalance_ratio,
  max(n)::DOUBLE / min(n) <= 10 AS is_balanced,
  (SELECT label FROM cnt ORDER BY n DESC, first_id LIMIT 1) AS max_class,
  (SELECT label FROM cnt ORDER BY n, first_id LIMIT 1) AS min_class, string_agg(label || '=' || n, ',' ORDER BY label) AS label_counts"""


def counts_text(counts):
    return F.array_join(F.transform(counts, lambda x: F.concat_ws("=", x["label"], x["n"].cast("string"))), ",").alias("label_counts")


@CATALOG.add(f"WITH {CLS}, {BALANCE.format('cls')} SELECT {BALANCE_ROW} FROM cnt")
def label_distribution(spark, folder):
    found = quality.label_distribution(classes(spark, folder))
    return found.withColumns({"imbalance_ratio": F.round("imbalance_ratio", 6), "label_counts": counts_text("label_counts")})


@CATALOG.add(f"WITH {CLS} SELECT DISTINCT label FROM cls")
def distinct_labels(spark, folder):
    from textvane.operators.evaluation import class_labels

    return class_labels(classes(spark, folder), "label")


@CATALOG.add(
    f"""WITH RECURSIVE {CORPUS}, {greedy_sql('corpus', NEAR)}, {LENGTHS.format('corpus')}, {BALANCE.format('corpus')}
  SELECT (SELECT count(*) FROM corpus) AS total_records, (SELECT count(*) FROM corpus WHERE {BLANK}) AS n_blank,
    (SELECT count(*) FROM dup) AS n_duplicates,
    round((SELECT count(*) FROM dup) * 100.0::DOUBLE / (SELECT count(*) FROM corpus), 6) AS pct_duplicates,
    (SELECT string_agg(leader_id::VARCHAR, ',' ORDER BY leader_id) FROM (SELECT DISTINCT leader_id FROM dup ORDER BY 1 LIMIT 5)) AS sample_leaders,
    l.*, b.* FROM (SELECT {LENGTH_ROW} FROM len) l, (SELECT {BALANCE_ROW} FROM cnt) b"""
)
def quality_report(spark, folder):
    texts = corpus(spark, folder)
    pairs = dedup.leader_pairs(texts, Jaccard(NEAR))
    report = quality.quality_report(texts, dedup.duplicate_groups(pairs))
    length, label = F.col("length_distribution"), F.col("label_distribution")
    return report.select(
        "total_records",
        F.col("empty_or_null.n").alias("n_blank"),
        F.col("duplicates.n").alias("n_duplicates"),
        r6(F.col("duplicates.pct"), "pct_duplicates"),
        F.array_join(F.transform("duplicates.sample_groups", lambda g: g["leader_id"].cast("string")), ",").alias("sample_leaders"),
        length["n_texts"].alias("n_texts"),
        r6(length["mean_length"], "mean_length"),
        *[length[c].alias(c) for c in ("min_length", "max_length", "median_length", "percentile_length", "outlier_count")],
        *[label[c].alias(c) for c in ("n_labels", "n_rows")],
        r6(label["imbalance_ratio"], "imbalance_ratio"),
        *[label[c].alias(c) for c in ("is_balanced", "max_class", "min_class")],
        counts_text(label["label_counts"]),
    )


@CATALOG.add(
    f"""WITH RECURSIVE {CORPUS}, {greedy_sql('corpus', NEAR)} SELECT leader_id, member_id FROM dup
  WHERE leader_id IN (SELECT DISTINCT leader_id FROM dup ORDER BY 1 LIMIT 5)"""
)
def duplicate_sample_groups(spark, folder):
    """All members of the report's first five duplicate groups."""
    pairs = dedup.leader_pairs(corpus(spark, folder), Jaccard(NEAR))
    return quality.first_group_members(dedup.duplicate_groups(pairs))


FORM = rf"lower(regexp_replace(text, '^{tables.SPACE}+|{tables.SPACE}+$', '', 'g'))"


@CATALOG.add(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {FORM}")
def exact_dedup(spark, folder):
    return dedup.drop_exact_copies(spread_documents(spark, folder).select("doc_id", "text")).select("doc_id")


@CATALOG.add(f"WITH RECURSIVE {GREEDY} SELECT leader_id, member_id, round(similarity, 6) AS similarity FROM dup")
def near_dup_pairs(spark, folder):
    pairs = dedup.leader_pairs(documents(spark, folder), Jaccard(NEAR))
    return pairs.select("leader_id", "member_id", r6("similarity"))


@CATALOG.add(
    f"""WITH RECURSIVE {GREEDY} SELECT leader_id, count(*) AS n_members, min(member_id) AS first_member,
  max(member_id) AS last_member FROM dup GROUP BY leader_id"""
)
def near_dup_groups(spark, folder):
    return dedup.group_sizes(dedup.leader_pairs(documents(spark, folder), Jaccard(NEAR)))


@CATALOG.add(f"WITH RECURSIVE {GREEDY} SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT member_id FROM dup)")
def fuzzy_dedup(spark, folder):
    return dedup.fuzzy_dedup(documents(spark, folder), Jaccard(NEAR)).select("doc_id", "n_chars")


@CATALOG.add(f"WITH RECURSIVE {GREEDY} SELECT member_id AS doc_id FROM dup")
def removed_duplicates(spark, folder):
    texts = documents(spark, folder)
    kept = dedup.fuzzy_dedup(texts, Jaccard(NEAR))
    return dedup.removed_rows(texts, kept).select("doc_id")


@CATALOG.add()
def fuzzy_dedup_ratio(spark, folder):
    """Character-matcher deduplication of all document lines (checked by brute force in the tests)."""
    texts = lines(spark, folder)
    pairs = dedup.leader_pairs(texts, MatcherRatio(0.95, later_first=True))
    return dedup.fuzzy_dedup(texts, pairs=pairs).select("doc_id")


@CATALOG.add(
    f"""WITH {CLS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY label) AS n
  FROM cls) SELECT doc_id, label FROM r WHERE k <= greatest(1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT))"""
)
def stratified_head_sample(spark, folder):
    return sampling.stratified_fraction(classes(spark, folder))


SIZE_SQL = f"""{CLS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS k,
    count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS total FROM cls),
  smp AS (SELECT doc_id, label FROM r WHERE total <= 100 OR k <= greatest(1, CAST(floor(100 * (n::DOUBLE / total)) AS BIGINT)))"""


@CATALOG.add(f"WITH {SIZE_SQL} SELECT doc_id, label FROM smp")
def stratified_size_sample(spark, folder):
    return sampling.stratified_size(classes(spark, folder), 100)


@CATALOG.add(
    f"""WITH {SIZE_SQL}, a AS (SELECT label, count(*)::DOUBLE / (SELECT count(*) FROM cls) AS s FROM cls GROUP BY label),
  b AS (SELECT label, count(*)::DOUBLE / (SELECT count(*) FROM smp) AS s FROM smp GROUP BY label)
  SELECT bool_and(coalesce(abs(a.s - b.s) <= 0.1, false)) AS preserved FROM a FULL OUTER JOIN b USING (label)"""
)
def ratio_preserved(spark, folder):
    labelled = classes(spark, folder)
    return sampling.ratio_preserved(labelled, sampling.stratified_size(labelled, 100))


@CATALOG.add("SELECT count(DISTINCT CASE WHEN toxic = 1 THEN 'a' WHEN quality = 1 THEN 'b' ELSE 'c' END) = 3 AS equal FROM labels")
def label_sets_equal(spark, folder):
    known = spark.createDataFrame([(name,) for name in ("negative", "neutral", "positive")], "label string")
    return sampling.label_sets_equal(classes(spark, folder), known)


SPLIT_SQL = f"""{CLS}, k AS (SELECT *, (doc_id * 48271 + 42) % 2147483647 AS key FROM cls),
  sz AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM cls GROUP BY label),
  w AS (SELECT label, n, ceil(total * 0.2::DOUBLE) AS wanted, n * ceil(total * 0.2::DOUBLE) / total AS exact FROM sz),
  q AS (SELECT label, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label)
    <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM w),
  split AS (SELECT k.doc_id, k.label, CASE WHEN row_number() OVER (PARTITION BY k.label ORDER BY key, doc_id) <= quota
    THEN 'test' ELSE 'train' END AS split FROM k JOIN q USING (label))"""


def arithmetic_key():
    return (F.col("doc_id") * 48271 + 42) % 2147483647


@CATALOG.add(f"WITH {SPLIT_SQL} SELECT doc_id, label, split FROM split")
def train_test_split(spark, folder):
    return sampling.train_test_split(classes(spark, folder), key=arithmetic_key())


CLEANED = f"cleaned AS (SELECT doc_id, {clean_sql('text')} AS text, label FROM corpus)"


@CATALOG.add(
    f"""WITH RECURSIVE {CORPUS}, {CLEANED}, {greedy_sql('cleaned', NEAR)},
  kept AS (SELECT * FROM cleaned WHERE doc_id NOT IN (SELECT member_id FROM dup)),
  r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM kept)
  SELECT doc_id, label, md5(text) AS text_md5 FROM r WHERE k <= greatest(1, CAST(floor(n * 0.8::DOUBLE) AS BIGINT))"""
)
def preprocess_corpus(spark, folder):
    out = preprocess(corpus(spark, folder), sample_fraction=0.8, measure=Jaccard(NEAR))
    return out.select("doc_id", "label", F.md5("text").alias("text_md5"))


@CATALOG.add(
    f"""WITH {LINES}, v AS (SELECT * FROM lines WHERE NOT {BLANK}), u AS (SELECT min(doc_id) AS doc_id FROM v GROUP BY {FORM})
  SELECT (SELECT count(*) FROM lines) AS total, (SELECT count(*) FROM lines) - (SELECT count(*) FROM v) AS validation_failures,
    (SELECT count(*) FROM v) AS after_validation, (SELECT count(*) FROM u) AS after_dedup,
    least(500, (SELECT count(*) FROM u)) AS after_sampling, (SELECT count(*) FROM v) - (SELECT count(*) FROM u) AS duplicates_removed,
    (SELECT count(*) FROM u) AS after_cleaning"""
)
def validated_stage_stats(spark, folder):
    return stage_stats(lines(spark, folder), 500)


@CATALOG.add(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents)
  SELECT doc_id, k // 32 AS batch_id, k % 32 AS position FROM r"""
)
def batch_assignment(spark, folder):
    return batching.batch_positions(documents(spark, folder))


@CATALOG.add(
    """SELECT greatest(1, CAST(floor(1e6::DOUBLE * 0.1::DOUBLE / avg(octet_length(encode(text)))) AS BIGINT)) AS batch_size,
  round(avg(octet_length(encode(text))), 6) AS mean_bytes FROM documents"""
)
def batch_size_budget(spark, folder):
    sized = batching.batch_size_for_budget(documents(spark, folder), 1_000_000)
    return sized.withColumn("mean_bytes", F.round("mean_bytes", 6))


@CATALOG.add(
    rf"""WITH {LINES}, c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), '{tables.SPACE}+', ' ', 'g')) AS t FROM lines)
  SELECT doc_id, md5(t) AS clean_md5 FROM c"""
)
def clean_lines(spark, folder):
    """The plain cleaning variant on every document line."""
    return spread_out(lines(spark, folder)).select("doc_id", F.md5(clean_basic(F.col("text"))).alias("clean_md5"))


@CATALOG.add(
    f"""SELECT (SELECT count(*) FROM documents) AS records_processed,
  (SELECT count(*) FROM documents) - (SELECT count(DISTINCT {FORM}) FROM documents) AS records_filtered"""
)
def run_stats(spark, folder):
    texts = documents(spark, folder)
    return step_counts(texts, dedup.drop_exact_copies(texts))


@CATALOG.add(
    f"""SELECT (SELECT count(*) FROM documents) AS records_processed,
  (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents) AS records_filtered, true AS timed"""
)
def timed_run_stats(spark, folder):
    """Cleaning into a table drops no row; the stats say so and how long it took."""
    stats = timed_preprocess(documents(spark, folder), scratch_path(spark, "prepared"), deduplicate=False)
    return stats.select("records_processed", "records_filtered", (F.col("elapsed_seconds") > 0).alias("timed"))


@CATALOG.add(
    rf"""WITH v AS (SELECT doc_id, text FROM documents WHERE NOT {BLANK}), u AS (SELECT min(doc_id) AS doc_id FROM v GROUP BY {FORM}),
  c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), '{tables.SPACE}+', ' ', 'g')) AS t FROM v)
  SELECT doc_id, md5(t) AS clean_md5 FROM c JOIN u USING (doc_id)"""
)
def validated_rows(spark, folder):
    """The rows of the strict chain: no blanks, no exact copies, cleaned."""
    rows = validated_steps(documents(spark, folder))["sampled"]
    return rows.select("doc_id", F.md5("text").alias("clean_md5"))


@CATALOG.add(
    """WITH p AS (SELECT page_id, unnest(string_split(html, chr(10))) AS text FROM pages)
  SELECT page_id, count(*) FILTER ("""
    + BLANK
    + """) AS n_blank, count(*) AS n_lines FROM p GROUP BY page_id"""
)
def blank_page_lines(spark, folder):
    """Blank lines of the raw pages (the documents have none)."""
    split = table(spark, folder, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("text"))
    return split.groupBy("page_id").agg(F.count_if(is_blank(F.col("text"))).alias("n_blank"), F.count(F.lit(1)).alias("n_lines"))


@CATALOG.add("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark, folder):
    return documents(spark, folder).select("doc_id", "n_chars").orderBy("doc_id").limit(100)
