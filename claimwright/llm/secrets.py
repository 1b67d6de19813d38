"""Secrets in texts, with weak candidates linked to the other parts of a credential.

Three kinds of spans are secrets by themselves: ``assign`` (a value assigned to a telling
name), ``access`` (an access identifier) and ``hex`` (a long hexadecimal number). Three more
are weak: ``ident`` (an assigned user, client or account name), ``key`` (a long mixed string)
and ``endpoint`` (a URL). A credential has an identifier (``access``, ``ident``), a secret
(``assign``, ``hex``, ``key``) and often an endpoint. A weak candidate is reported only
if a complementary part stands in the same text with a gap of at most ``SCOPE`` characters: for an
identifier a secret, for a secret an identifier, for an endpoint both.

Only DataFrame functions are used. Matches are taken in row by ``regexp_extract_all`` and
what lies between them by ``split``; only their lengths go on, and running sums of them give
the places. The link is an interval join on text and scope: parts stand in all bins one scope
wide that they cover, the complementary side in the bins beside those too, and a semi-join with
the gap between the two as condition keeps a candidate without listing pairs. A bin cannot hold
more parts of a kind than a scope has characters, however many a text has.

Defined cases: null and empty texts have no spans; repeated rows each get the row's result;
weak spans that overlap one of the three strong kinds are left out; extra columns are
ignored by ``secret_spans`` and kept by ``redact``; an empty table gives an empty result.
Places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimwright.llm.blocks import kept, saved, scratch
from claimwright.llm.registry import query

#: Characters between parts of one credential.
SCOPE = 300
#: Characters of a block when a text is cut between spans.
BLOCK = 2_048
MARK = "[REDACTED]"

# Patterns of the kinds, in the order in which spans of one start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
IDENT = r"""(?i)(?<![A-Za-z0-9])(user_?name|user_?id|client_?id|account_?id|access_?key_?id|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{4,})"""
KEY = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
ENDPOINT = r"""https?://[^\s"'<>|]+"""
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
BASE = KINDS[:3]
LEAST_ASSIGNED = 12


def _row_key(key: str, text: str) -> Column:
    return F.struct(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.length(text).alias("length"))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Matches of one kind in order: the characters before each since the last, its own
    characters, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def counts(match: Column) -> Column:
        if kind == "assign":
            return F.length(F.regexp_extract(match, pattern, 2)) >= LEAST_ASSIGNED
        if kind == "key":
            return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
        return F.lit(True)

    return F.when(
        text.rlike(pattern),
        F.zip_with(gaps, found, lambda gap, match: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(match).alias("size"), counts(match).alias("counts"))),
    )


def parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All candidate spans: ``row``, ``kind``, ``start``, ``end``; equal rows count once."""
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, IDENT, KEY, ENDPOINT), strict=True))
    wide = docs.where(F.length(text) > 0).select(_row_key(key, text).alias("row"), *[_matches(F.col(text), k, p).alias(k) for k, p in patterns.items()])
    # One list of lists: each kind keeps the numbers of its own matches.
    lists = F.array(*[F.coalesce(F.col(k), F.array().cast("array<struct<kind:string,gap:int,size:int,counts:boolean>>")) for k in KINDS])
    each = wide.select("row", F.explode(lists).alias("found")).select("row", F.posexplode("found").alias("at", "m"))
    each = each.select("row", "m.kind", "at", "m.gap", "m.size", "m.counts").distinct()
    so_far = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("size")).over(so_far)
    placed = each.withColumn("end", end).where("counts").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    return placed


def _bins(df: DataFrame, beside: int) -> DataFrame:
    """A row for each ``bin`` that the part covers, and so many on either side."""
    first, last = F.floor(F.col("start") / SCOPE), F.floor(F.col("end") / SCOPE)
    return df.withColumn("bin", F.explode(F.sequence(first - beside, last + beside)))


def _near(weak: DataFrame, others: DataFrame) -> DataFrame:
    """Those of ``weak`` with one of ``others`` at most the scope apart, in the same text."""
    right = _bins(others.select("row", "start", "end").distinct(), 1).select(F.col("row").alias("r"), F.col("bin").alias("b"), F.col("start").alias("s"), F.col("end").alias("e"))
    left = _bins(weak, 0)
    apart = (F.col("s") - F.col("end") <= SCOPE) & (F.col("start") - F.col("e") <= SCOPE)
    return left.join(right, (F.col("row") == F.col("r")) & (F.col("bin") == F.col("b")) & apart, "left_semi").drop("bin").distinct()


def linked(found: DataFrame) -> DataFrame:
    """Strong spans, and the weak ones that belong to a credential."""
    strong = found.where(F.col("kind").isin(*BASE))
    # The longest strong span may reach into any later bin: overlap is found by running ends.
    ahead = Window.partitionBy("row").orderBy("start", F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("row").orderBy("start").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    marked = found.withColumn("rank", F.col("kind").isin(*BASE).cast("int"))
    marked = marked.withColumn("reach", F.max(F.when(F.col("rank") == 1, F.col("end"))).over(ahead))
    marked = marked.withColumn("next", F.min(F.when(F.col("rank") == 1, F.col("start"))).over(behind))
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    weak = saved(marked.where((F.col("rank") == 0) & free).select("row", "kind", "start", "end"), "weak")
    identifiers = weak.where("kind = 'ident'").unionByName(strong.where("kind = 'access'"))
    secrets = weak.where("kind = 'key'").unionByName(strong.where("kind in ('assign', 'hex')"))
    kept = _near(weak.where("kind = 'ident'"), secrets)
    kept = kept.unionByName(_near(weak.where("kind = 'key'"), identifiers))
    kept = kept.unionByName(_near(_near(weak.where("kind = 'endpoint'"), identifiers), secrets))
    return strong.unionByName(kept)


def _listed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """For each row with spans: the strong and all spans, by start and kind."""
    found = linked(saved(parts(docs, key, text), "parts"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    ordered = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    return ordered


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the numbers of strong spans, their digest, and all spans."""
    rows = docs.select(F.col(key).alias("doc_id"), _row_key(key, text).alias("row"))
    listed = _listed(docs, key, text)
    joined = rows.alias("d").join(listed.alias("s"), F.col("d.row").eqNullSafe(F.col("s.row")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>"))
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return joined.select("doc_id", *map(count, BASE), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"))


def _stretches(found: DataFrame) -> DataFrame:
    """``row`` and its ``stretches``: spans that overlap or touch as one, in order."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))
    numbered = found.select("row", "start", "end").withColumn("begins", begins.cast("int")).withColumn("number", F.sum("begins").over(own))
    merged = numbered.groupBy("row", "number").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("stretches"))


def _between(blocks: Column, low: Column, high: Column) -> Column:
    """Characters from ``low`` to ``high``, from a text's blocks of ``BLOCK`` characters."""
    first, last = F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int")
    at, to = (low % BLOCK).cast("int"), (high % BLOCK).cast("int")

    def block(k: Column) -> Column:
        return F.coalesce(F.get(blocks, k), F.lit(""))

    whole = F.when(last - first > 1, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")).otherwise("")
    spread = F.concat(F.substring(block(first), at + 1, F.lit(BLOCK)), whole, F.substring(block(last), F.lit(1), to))
    return F.when(low >= high, "").when(first == last, F.substring(block(first), at + 1, to - at)).otherwise(spread)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span, overlapping ones as one, replaced by ``MARK``.

    Only texts that can hold a span, by the patterns themselves, meet the spans; the others
    pass by. The work on a text grows with its length and its spans and not their product."""
    own = F.col(text)
    strong = own.rlike(ASSIGN) | own.rlike(ACCESS) | own.rlike(HEX)
    holds = F.coalesce(strong | (own.rlike(IDENT) & own.rlike(KEY)), F.lit(False))
    held, rest = docs.where(holds), docs.where(~holds)
    with scratch(docs.sparkSession) as paths:
        stretches = kept(_stretches(linked(saved(parts(held, key, text), "parts"))), "stretches", paths)
    cut = F.regexp_extract_all(own, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    rows = held.select(F.struct("*").alias("_doc"), _row_key(key, text).alias("_row"), cut.alias("_blocks"), F.length(text).cast("long").alias("_length"))
    met = rows.join(stretches, F.col("_row").eqNullSafe(F.col("row")), "left")
    spans, size = F.col("stretches"), F.size("stretches")
    pieces = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: _between(F.col("_blocks"), F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), F.coalesce(F.get(spans, i)["start"], F.col("_length"))),
    )
    marked = F.when(spans.isNull(), F.col(f"_doc.`{text}`")).otherwise(F.array_join(pieces, MARK))
    return met.select(*[(marked.alias(c) if c == text else F.col(f"_doc.`{c}`").alias(c)) for c in docs.columns]).unionByName(rest)


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
