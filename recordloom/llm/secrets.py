"""Secret scan with corpus-wide ownership frequency, by DataFrame functions alone.

Each text is scanned once. Base kinds (assign, access, hex) follow fixed patterns. Further kinds (vendor tokens,
signed web tokens, private key headers, credentials in addresses) are candidates: the hash of each candidate's value
is counted over distinct owners and repositories, and a value that more than `most_owners` owners hold is a widely
copied example; the others look live and become spans too.

Spans are in code points. Null text is empty. Rows may repeat: each row is scanned and reported on its own. A row
without an owner or repository adds none to a value's count, so a value that only such rows hold is live. An empty table
gives an empty result, and columns other than those named are ignored. A text is scanned whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

#: kind, pattern, group whose length counts, least length. Fixed values for the first three. Access and hex ask for their
#: least length in the pattern: a run too short holds no other match, so the same matches stay as by length afterwards.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Candidates whose ownership decides. Their lengths have no upper bound; of a scheme of over 21 characters the last 21 are in the span.
EXTRA = (
    ("vendor", r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,})", 0, 14),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
    ("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]+:[^\s:/@]{6,}@", 0, 12),
)
#: What a text must hold for a pattern's scan to be worth its time; a quick test before the full one.
_QUICK = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{16}", "vendor": "gh[pousr]_|sk-|xox[abprs]-|AIza", "jwt": "eyJ", "pem": "PRIVATE KEY", "login": "://"}
#: The most values that are joined by broadcast.
FREQUENT = 10_000
KINDS = tuple(k for k, *_ in BASE + EXTRA)


def _scan(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Matches with the length of the gap before each and of the group that counts: the gaps come from splitting
    by the same pattern, so start and end are running sums."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("found"), held.alias("held")), lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.length(m["found"]).alias("size"), m["held"].alias("held")))
    return F.when(text.rlike(_QUICK[kind]), rows).otherwise(F.array().cast("array<struct<gap:int,size:int,held:string>>"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "source", most_owners: int = 2) -> DataFrame:
    """Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live (candidates that no more than
    most_owners owners hold) and n_copied (those that more hold)."""
    text = F.coalesce("text", F.lit(""))
    scanned = stage(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), *(_scan(text, k, p, g).alias(k) for k, p, g, _ in BASE + EXTRA)),
        "secrets",
    )
    least = F.element_at(F.array(*(F.lit(n) for *_, n in BASE + EXTRA)), F.col("kind") + 1)

    def numbered(n: int) -> Column:
        return F.transform(KINDS[n], lambda m, i: F.struct(F.lit(n).alias("kind"), i.alias("place"), m["gap"].alias("gap"), m["size"].alias("size"), m["held"].alias("held")))

    all_kinds = F.flatten(F.array(*map(numbered, range(len(KINDS)))))
    matches = (
        scanned.select("row", "owner", "repository", F.explode(all_kinds).alias("m")).select("row", "owner", "repository", "m.*")
        .withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(W.partitionBy("row", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, 0)))
        .filter(F.length("held") >= least)
        .select("row", "owner", "repository", "kind", (F.col("end") - F.col("size")).alias("start"), "end", F.sha2("held", 256).alias("value"))
    )
    matches = stage(matches, "matches")
    held_by = stage(
        matches.groupBy("value").agg(F.count("*").alias("n"), F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
        .select("value", "n", ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_owners)).alias("live")),
        "held",
    )
    # A value of more than 1 / FREQUENT of all matches would fill one task of a join; there are FREQUENT of those at most,
    # so they are broadcast (a hash each), and only the others' matches are dealt by value.
    share = matches.count() / FREQUENT
    often = F.broadcast(held_by.filter(F.col("n") > share).select("value", "live"))
    seldom = held_by.filter(F.col("n") <= share).select("value", "live")
    judged = matches.join(often, "value").unionByName(matches.join(often, "value", "left_anti").join(seldom, "value"))
    span = F.struct("start", "kind", "end")
    per_row = judged.groupBy("row").agg(
        *(F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, (k, *_) in enumerate(BASE)),
        F.array_sort(F.collect_list(F.when(F.col("kind") < len(BASE), span))).alias("base"),
        F.array_sort(F.collect_list(F.when((F.col("kind") < len(BASE)) | F.col("live"), span))).alias("spans"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_copied"),
    )
    zero = F.lit(0).cast("long")
    return scanned.select("row", "doc_id").join(per_row, "row", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k, *_ in BASE),
        F.sha2(F.coalesce(_joined(F.col("base")), F.lit("")), 256).alias("base_sha256"), F.coalesce(_joined(F.col("spans")), F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
    )
