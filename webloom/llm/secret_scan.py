"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong kinds are reported as they stand: ``assign`` (a named secret with a value of 8 or more characters),
``access`` (access key identifiers) and ``hex`` (32 or more hexadecimal digits). Weak kinds mean little
alone: ``secret`` (a 40-character base64 run without padding, also right after ``=``), ``identifier`` (a client, account or user name assignment) and
``endpoint`` (a URL or service host). An interval join links parts within ``scope`` characters of each
other, and a weak candidate is reported only where complementary parts co-occur: a secret beside an access
key, identifier or endpoint; an identifier beside a secret or a named secret; an endpoint beside an access
key, or beside an identifier that is itself beside a secret.

Positions are code points, ends exclusive; matches are leftmost and do not overlap within a kind. They are
found by marking matches with a private-use character and adding up the lengths of the parts (work grows
with the square of the matches of one text, not of its length). The join's buckets are (text, position /
scope), each of which holds at most a few times ``scope`` candidates, so no group can grow hot.

Cases: null text is empty; empty texts have no spans, an empty span list and the SHA-256 of nothing. Rows
are told apart by (doc_id, hash of the text): repeated rows get equal results, a null doc_id is a value of
its own. Texts holding U+E000 are scanned with U+E001 in its place (in no pattern). Empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in report order. The lengths are part of the pattern where that finds the same matches.
STRONG = {"assign": _ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
WEAK = {
    "secret": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "identifier": r"""(?i:client|account|user|tenant)_?(?i:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    # A host name is tried at the start of its run only: long runs without one cost no more than their length.
    "endpoint": r"""https?://[A-Za-z0-9._:-]+(?:/[A-Za-z0-9._~/%-]*)?|(?<![a-z0-9.-])[a-z0-9.-]+\.amazonaws\.com""",
}
KINDS = (*STRONG, *WEAK)
_MARK, _STAND_IN = "\ue000", "\ue001"


def spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, rank, end>> of a kind's matches in text."""
    parts = F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)
    rank = F.lit(KINDS.index(kind))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), empty.alias("out"))

    def step(acc, part):
        end = acc["at"] + F.char_length(part)
        good = acc["i"] % 2 == 1
        if kind == "assign":
            good = good & (F.char_length(F.regexp_extract(part, pattern, 1)) >= 8)
        own = F.array(F.struct(acc["at"].alias("start"), rank.alias("rank"), end.alias("end")))
        return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), F.when(good, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(parts) > 1, F.aggregate(parts, start, step)["out"]).otherwise(empty)


def _candidates(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), strong and weak spans of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.xxhash64("t", F.lit("text")).alias("th"), F.translate("t", _MARK, _STAND_IN).alias("t"))
    strong = F.array_sort(F.concat(*[spans(F.col("t"), k, p) for k, p in STRONG.items()]))
    weak = F.array_sort(F.concat(*[spans(F.col("t"), k, p) for k, p in WEAK.items()]))
    return rows.select("doc_id", "th", strong.alias("strong"), weak.alias("weak"))


def _near(left: DataFrame, right: DataFrame, scope: int) -> DataFrame:
    """Rows of left (doc_id, th, s) with a row of right whose span starts or ends within scope characters."""
    bin_of = lambda c: (F.col(c) / scope).cast("long")
    a = left.withColumn("bin", F.explode(F.sequence(bin_of("s.start") - 1, bin_of("s.end") + 1)))
    b = right.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("s").alias("o"), F.explode(F.sequence(bin_of("s.start"), bin_of("s.end"))).alias("bin2"))
    met = a.join(b, (F.col("th") == F.col("h")) & (F.col("bin") == F.col("bin2")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("o.start") - F.col("s.end") <= scope) & (F.col("s.start") - F.col("o.end") <= scope))
    return met.select("doc_id", "th", "s").distinct()


def linked(found: DataFrame, scope: int = 240) -> DataFrame:
    """doc_id, th, s: weak spans beside their complementary parts."""
    weak_rows = found.filter(F.size("weak") > 0)
    weak = weak_rows.select("doc_id", "th", F.explode("weak").alias("s")).distinct()
    strong = weak_rows.select("doc_id", "th", F.explode("strong").alias("s")).distinct()
    kind = lambda df, *names: df.filter(F.col("s.rank").isin([KINDS.index(n) for n in names]))
    keys = kind(strong, "access")
    secrets = _near(kind(weak, "secret"), keys.unionByName(kind(weak, "identifier", "endpoint")), scope)
    identifiers = _near(kind(weak, "identifier"), kind(weak, "secret").unionByName(kind(strong, "assign")), scope)
    proven = _near(kind(weak, "identifier"), kind(weak, "secret"), scope)
    endpoints = _near(kind(weak, "endpoint"), keys.unionByName(proven), scope)
    return secrets.unionByName(identifiers).unionByName(endpoints)


def joined(list_of: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(list_of, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _all_spans(docs: DataFrame, scope: int) -> DataFrame:
    """doc_id, th, strong, all (both in report order), one row per distinct (doc_id, th)."""
    found = shared.materialize(_candidates(docs), "candidates")
    extra = linked(found, scope).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("s")).alias("extra")).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "extra")
    both = found.join(extra, (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    whole = F.when(F.col("extra").isNull(), F.col("strong")).otherwise(F.array_sort(F.concat("strong", F.col("extra"))))
    return both.select("doc_id", "th", "strong", whole.alias("all"))


def scan(docs: DataFrame, scope: int = 240) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs(doc_id, text)."""
    count = lambda k: F.size(F.filter("strong", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return _all_spans(docs, scope).select("doc_id", *[count(k) for k in STRONG], F.sha2(joined(F.col("strong")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, scope: int = 240, mask: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by mask; n_chars, where present, counts the new text."""
    marks = _all_spans(docs, scope).filter(F.size("all") > 0).dropDuplicates(["doc_id", "th"]).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "all")
    # The rows travel as one struct, so that none of their names can clash with these.
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(whole, F.lit("text")).alias("th"), F.col("text").cast("string").alias("t"))
    both = rows.join(marks, (F.col("th") == F.col("h")) & F.col("doc").eqNullSafe(F.col("d")), "left")

    def step(acc, s):
        gap = F.substring(F.col("t"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        inside = s["end"] <= acc["at"]
        return F.struct(F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(F.lit("")))).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("all", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    out = both.withColumn("new", F.when(F.col("all").isNotNull(), F.concat(done["out"], F.substring("t", done["at"] + 1, F.lit(2147483647)))))
    kinds = dict(docs.dtypes)
    own = {"text": F.coalesce("new", F.col("row").getField("text").cast("string")), "n_chars": F.when(F.col("new").isNull(), F.col("row").getField("n_chars") if "n_chars" in kinds else F.lit(None)).otherwise(F.char_length("new").cast(kinds.get("n_chars", "long")))}
    return out.select(*[(own[c] if c in own else F.col("row").getField(c)).alias(c) for c in docs.columns])
