"""Secret scans over an incremental ledger of blobs.

Every text is a blob named by its SHA-256.  The ledger records which (blob, rule, version) pairs
have been scanned and what was found; a run scans each blob that the ledger does not cover once,
with only the rules it lacks, and joins findings back to every path (document) and version (row)
that holds the blob.  Spans count code points, end exclusive.

Nulls are scanned as the empty text.  Rows repeated under one id are versions of that path; each
gets its own row in the result.  Very long texts are scanned whole.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textvane.llm.common import columns_as, joined_spread, marked, stored, text_of, under_plain_names


@dataclass(frozen=True)
class Rule:
    """A pattern of a kind; ``needs`` are lower-case strings one of which every match contains."""

    kind: str
    version: int
    pattern: str
    needs: tuple[str, ...]
    ignore_case: bool = False
    group: int = 0
    least: int = 0  # characters of the group; shorter matches are dropped

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The base kinds in their order, then the kinds added to them.
RULES = (
    Rule(
        "assign",
        1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        ignore_case=True,
        group=2,
        least=6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), least=20),
    Rule("hex", 1, r"[0-9a-f]{24,}", ()),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", ("private key",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("gh",)),
)
BASE = ("assign", "access", "hex")

LEDGER = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SCHEMA = pa.schema([("blob", pa.string()), ("kind", pa.string()), ("version", pa.int32()), ("spans", _SPAN)])


def find_spans(text: str, rule: Rule, pattern: re.Pattern, lowered: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of one rule."""
    if rule.needs and not any(word in lowered for word in rule.needs):
        return []
    matches = pattern.finditer(text)
    return [m.span() for m in matches if len(m.group(rule.group)) >= rule.least]


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(rule, rule.compiled()) for rule in rules]
        for batch in batches:
            rows: list[dict] = []
            for text, known in zip(batch.column("text"), batch.column("known").to_pylist()):
                text = text.as_py()
                blob = hashlib.sha256(text.encode()).hexdigest()
                lowered = text.lower()
                done = set(known or ())
                for rule, pattern in compiled:
                    if f"{rule.kind}:{rule.version}" not in done:
                        spans = find_spans(text, rule, pattern, lowered)
                        found = [{"start": a, "end": b} for a, b in spans]
                        rows.append({"blob": blob, "kind": rule.kind, "version": rule.version, "spans": found})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return scan


def _known_pairs(ledger: DataFrame) -> DataFrame:
    """(blob, known): the kind:version pairs every blob was scanned for."""
    return ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("known"))


def scan_new_blobs(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES):
    """(versions, fresh): (id, blob) of every row, and the ledger rows of the pairs that were not yet in it.

    ``ledger`` has the columns of ``LEDGER``.  One row of each blob carries its text to the rules the
    blob lacks.  Which rows those are is settled on narrow tables; of the texts only the minority is
    moved, the rows that are scanned or those that are not, and the others are scanned, or left, where
    they are read.
    """
    own = docs.select("id", text_of("text").alias("text"))
    blob = F.sha2(F.col("text").cast("binary"), 256)
    versions = stored(own.select("id", blob.alias("blob")), "blob-versions")
    blobs = versions.groupBy("blob").agg(F.min("id").alias("carrier"), F.count(F.lit(1)).alias("n"))
    wanted = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    nothing = F.array().cast("array<string>")
    if ledger is None:
        noted = blobs.where("n > 1").withColumn("known", nothing)
    else:
        noted = blobs.join(_known_pairs(ledger), "blob", "left").where("n > 1 or known is not null")
        noted = noted.withColumn("known", F.coalesce("known", nothing))
    noted = stored(noted, "blob-noted")  # blobs with more than one row, or with something in the ledger
    possible = marked(versions, F.xxhash64("blob"), noted.select(F.xxhash64("blob").alias("h"))).where("_maybe").drop("_maybe")
    lacks = F.size(F.array_except(wanted, F.col("known"))) > 0
    met = joined_spread(possible, noted, "blob", "n", F.xxhash64("id"))
    judged = met.select("id", "blob", "known", (F.col("id").eqNullSafe(F.col("carrier")) & lacks).alias("scan"))
    judged = stored(judged.distinct(), "blob-judged")
    rest = judged.where("not scan or size(known) > 0").count()  # of all other rows the texts go to all rules
    named = own.withColumn("blob", blob)
    mark = F.xxhash64("id", "blob")
    if rest * 2 <= versions.count():
        known = marked(named, mark, judged.where("not scan or size(known) > 0").select(F.xxhash64("id", "blob").alias("h")))
        moved = known.where("_maybe").drop("_maybe")
        told = _same_row(moved, judged, "left").where("scan is null or scan")
        texts = told.select("text", F.coalesce("known", nothing).alias("known"))
        texts = known.where("not _maybe").select("text", nothing.alias("known")).unionByName(texts)
    else:
        alone = versions.join(noted, "blob", "left_anti").select("id", "blob", nothing.alias("known"))
        chosen = stored(judged.where("scan").select("id", "blob", "known").unionByName(alone), "blob-unseen")
        moved = marked(named, mark, chosen.select(F.xxhash64("id", "blob").alias("h"))).where("_maybe").drop("_maybe")
        texts = _same_row(moved, chosen, "inner").select("text", "known")
    fresh = texts.mapInArrow(_scanner(rules), LEDGER)
    if not versions.groupBy("id", "blob").count().where("count > 1").isEmpty():
        fresh = fresh.dropDuplicates(["blob", "kind", "version"])  # a carrier row that stands twice
    return versions, stored(fresh, "blob-ledger")


def _same_row(moved: DataFrame, told: DataFrame, how: str) -> DataFrame:
    """Rows of (id, text, blob) with what ``told`` says of their id and blob; null ids are equal."""
    told = told.withColumnsRenamed({"id": "_id", "blob": "_blob"})
    same = moved["id"].eqNullSafe(told["_id"]) & (moved["blob"] == told["_blob"])
    return moved.join(told, same, how)


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, blob, spans (array of kind, start, end by start)."""
    versions, fresh = scan_new_blobs(columns_as(docs, id=id_col, text=text_col), ledger, rules)
    return joined_back(versions, fresh if ledger is None else ledger.unionByName(fresh), rules)


def spans_in_batches(
    docs: DataFrame, batches: int, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """The same, taking the documents in by ``batches`` (by a hash of their ids) against one growing ledger.

    A batch scans only what the batches before it have not left in the ledger; findings go back to the
    rows of all batches.
    """
    own = columns_as(docs, id=id_col, text=text_col)
    number = F.pmod(F.xxhash64("id"), F.lit(batches))
    versions, ledger = scan_new_blobs(own.where(number == 0), None, rules)
    for batch in range(1, batches):
        more, fresh = scan_new_blobs(own.where(number == batch), ledger, rules)
        versions, ledger = versions.unionByName(more), ledger.unionByName(fresh)
    return joined_back(versions, ledger, rules)


def joined_back(versions: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's findings joined back to every version: doc_id, blob, spans."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    hits = known.where(F.size("spans") > 0).where(F.array_contains(current, F.concat_ws(":", "kind", "version")))
    span = F.struct("span.start", order[F.col("kind")].alias("nth"), "span.end", "kind")
    grouped = (
        hits.select("blob", "kind", F.explode("spans").alias("span"))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(span)).alias("found"))
        .select("blob", F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    grouped = stored(grouped, "blob-findings")
    clean = marked(versions, F.xxhash64("blob"), grouped.select(F.xxhash64("blob").alias("h")))
    possible = stored(clean.where("_maybe").drop("_maybe"), "blob-carriers-of-findings")
    counted = grouped.join(possible.groupBy("blob").agg(F.count(F.lit(1)).alias("n")), "blob")
    told = joined_spread(possible, stored(counted, "blob-findings-counted"), "blob", "n", F.xxhash64("id"), "left")
    rows = clean.where("not _maybe").select("id", "blob", none.alias("spans")).unionByName(told.select("id", "blob", "spans"))
    return rows.select(F.col("id").alias("doc_id"), "blob", F.coalesce("spans", none).alias("spans"))


@under_plain_names
def redact_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars"
) -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET]``; overlapping spans are one.

    A row meets the findings of its own id and blob: versions under one id or a null id stay apart.
    Rows without findings are untouched.  ``length_col``, if present, follows the new text.
    """
    found = secret_spans(docs, id_col, text_col).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_id"), F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
    found = stored(found.dropDuplicates(["_id", "_blob"]), "secret-spans")
    text = F.col(f"`{text_col}`")
    named = docs.withColumn("_own_blob", F.sha2(text_of(text_col).cast("binary"), 256))
    known = marked(named, F.xxhash64(F.col(f"`{id_col}`"), "_own_blob"), found.select(F.xxhash64("_id", "_blob").alias("h")))
    clean = known.where("not _maybe").drop("_maybe", "_own_blob")  # stays where it is read
    doubtful = known.where("_maybe").drop("_maybe")
    same = doubtful[id_col].eqNullSafe(found["_id"]) & (doubtful["_own_blob"] == found["_blob"])
    step = lambda state, s: F.when(
        s["end"] <= state["at"], state
    ).otherwise(
        F.struct(
            F.concat(
                state["out"],
                F.when(
                    s["start"] >= state["at"],
                    F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("[SECRET]")),
                ).otherwise(F.lit("")),
            ).alias("out"),
            s["end"].alias("at"),
        )
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    joined = doubtful.join(found, same, "left")
    applies = F.col("_spans").isNotNull()
    redacted = F.when(applies, F.aggregate("_spans", start, step, rest)).otherwise(text)
    columns = [redacted.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    changed = joined.select(*columns, applies.alias("_changed"))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        new = F.when(F.col("_changed"), F.length(text).cast(kind)).otherwise(F.col(f"`{length_col}`"))
        changed = changed.withColumn(length_col, new)
    return clean.unionByName(changed.drop("_changed"))


def span_text(spans, kinds: tuple[str, ...] | None = None):
    """kind:start:end, comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
