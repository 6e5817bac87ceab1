r"""Secret scan over a content-addressed blob ledger (DataFrame functions only).

Every version of a path is addressed by the SHA-256 of its text. The ledger holds, per
blob, which rule versions were run on it and the spans they found. A scan takes the
distinct blobs of the versions given, runs only those (blob, rule version) pairs that the
ledger does not hold, adds one ledger entry per blob scanned, and joins the findings back to
every path. Copies are scanned once however many paths hold them; a rule's new version runs
again over all blobs, the other rules do not.

A rule is a pattern (leftmost, non-overlapping matches) and a least length of the match or
of one of its groups; matches that fail the length are dropped after matching. Positions are
code points: the pieces between the matches and the matches themselves are measured, and a
running sum over a blob's matches gives the offsets, so no text leaves the scan.

Defined cases: null text is empty and has no spans; a null path is a path like any other;
repeated rows come back as often as given; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import columns, text_of
from eventlens.session import materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    #: A literal without which the pattern cannot match; "" if there is none.
    needs: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in their listed order. A match of [0-9a-f]{24,} is the
# same run as a match of [0-9a-f]+ with 24 or more characters; likewise for AKIA, whose run
# ends where the class ends. The assignment pattern keeps its short values, as a short
# value takes part in leftmost matching before it is dropped.
BASE_RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
)
RULES = BASE_RULES + MORE_RULES

ENTRY = "blob_id string, scanned array<string>, spans array<struct<start:int,ord:int,end:int,rule:string>>"


def _matches(rule: Rule) -> Column:
    """array<struct<gap, len, ok>> of a rule's matches in ``text``: code points before each, its length, kept or not."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    gaps = F.split("text", rule.pattern, -1)
    if rule.group:
        ok = lambda m: F.char_length(F.regexp_extract(m, f"^{rule.pattern}$", rule.group)) >= rule.least
    else:
        ok = lambda m: F.char_length(m) >= rule.least
    each = F.zip_with(
        F.slice(gaps, 1, F.size(found)),
        found,
        lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("len"), ok(m).alias("ok")),
    )
    has = F.col("text").rlike(rule.pattern)
    return F.when((F.col("text").contains(rule.needs) & has) if rule.needs else has, each)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger entries for ``blobs`` (blob_id, text, seen array<string>): each rule runs unless its key is in ``seen``."""
    runs = [~F.array_contains("seen", r.key) for r in rules]
    scanned = blobs.select(
        "blob_id",
        F.filter(F.array(*[F.when(run, F.lit(r.key)) for r, run in zip(rules, runs)]), lambda x: x.isNotNull()).alias("scanned"),
        F.array(
            *[
                F.struct(F.lit(i).alias("ord"), F.lit(r.key).alias("rule"), F.when(run, _matches(r)).alias("hits"))
                for i, (r, run) in enumerate(zip(rules, runs))
            ]
        ).alias("by_rule"),
    ).where(F.size("scanned") > 0)
    raw = materialize(
        scanned.select("blob_id", "scanned", F.filter("by_rule", lambda x: x["hits"].isNotNull()).alias("by_rule")),
        "ledger-raw",
    )
    hits = (
        raw.select("blob_id", F.explode("by_rule").alias("r"))
        .select("blob_id", "r.ord", "r.rule", F.posexplode("r.hits").alias("pos", "m"))
    )
    upto = Window.partitionBy("blob_id", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        hits.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(upto).cast("int"))
        .where("m.ok")
        .select("blob_id", F.struct((F.col("end") - F.col("m.len")).alias("start"), "ord", "end", "rule").alias("s"))
        .groupBy("blob_id")
        .agg(F.sort_array(F.collect_list("s")).alias("spans"))
    )
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,rule:string>>")
    return raw.select("blob_id", "scanned").join(spans, "blob_id", "left").select(
        "blob_id", "scanned", F.coalesce("spans", empty).alias("spans")
    )


def update_ledger(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    text_col: str = "text",
) -> DataFrame:
    """The entries a scan of ``versions`` adds to ``ledger`` (None: nothing scanned yet), as a written table."""
    texts = columns(versions, text=text_col).select(text_of("text").alias("text"))
    blobs = texts.select(F.sha2("text", 256).alias("blob_id"), "text").distinct()
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        blobs = blobs.join(seen, "blob_id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    return materialize(scan_blobs(blobs, rules), "ledger")


def findings(
    versions: DataFrame,
    ledger: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    path_col: str = "path",
    text_col: str = "text",
) -> DataFrame:
    """Every version with the spans of the given rule versions: path, blob_id, spans (by start, then rule order)."""
    keys = [r.key for r in rules]
    order = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    per_blob = (
        ledger.where(F.size("spans") > 0)
        .select("blob_id", F.explode("spans").alias("s"))
        .where(F.col("s.rule").isin(keys))
        .select("blob_id", F.struct("s.start", F.element_at(order, F.col("s.rule")).alias("ord"), "s.end", "s.rule").alias("s"))
        .groupBy("blob_id")
        .agg(F.sort_array(F.collect_set("s")).alias("spans"))
    )
    paths = columns(versions, path=path_col, text=text_col).select("path", F.sha2(text_of("text"), 256).alias("blob_id"))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,rule:string>>")
    return paths.join(per_blob, "blob_id", "left").select("path", "blob_id", F.coalesce("spans", empty).alias("spans"))


def secret_digest(found: DataFrame, id_name: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and span strings per path, in the columns of the query's contract."""
    base = [r.key for r in BASE_RULES]
    show = lambda s: F.concat_ws(":", F.split_part(s["rule"], F.lit("@"), F.lit(1)), s["start"], s["end"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    return found.select(
        F.col("path").alias(id_name),
        *[count(r.key).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(F.concat_ws(",", F.transform(F.filter("spans", lambda s: s["rule"].isin(base)), show)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", show)).alias("spans"),
        "blob_id",
    )
