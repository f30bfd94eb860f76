"""Secret scans with multipart credential linking, as native expressions.

Strong patterns (``assign``, ``access``, ``hex``) are reported wherever they match. Weak candidates are parts that mean
nothing alone: an account name (``id``), a random-looking token (``token``), an address (``endpoint``). Parts fall into
the classes identifier (access, id), secret (assign, hex, token) and endpoint; an interval join within a scope of
``scope`` code points between starts finds what else lies near, and a weak candidate is reported only if the parts that
complete it do: a secret for an identifier, an identifier for a secret, both for an endpoint.

The join is on bins as wide as the scope and keeps the first and last start of each class per bin, which decides
existence exactly; no pairs are made. A null text is empty; repeated rows are scanned as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.session import stored

_NAMES = "|".join("".join(f"[{c}{c.upper()}]" for c in name) for name in ("password", "passwd", "secret", "token"))
_ACCOUNTS = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("username", "user", "login", "account", "client_id"))
#: kind: pattern, least code points of a match, least of its last group; in the order that ties follow.
KINDS = {
    "assign": (rf"""({_NAMES}|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 0, 8),
    "access": (r"AKIA[A-Z0-9]+", 16, 0),
    "hex": (r"[0-9a-f]{32,}", 32, 0),
    "id": (rf"""({_ACCOUNTS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]+)""", 0, 3),
    "token": (r"[A-Za-z0-9+/_=-]{24,}", 24, 0),
    "endpoint": (r"""[a-z][a-z0-9+]+://[^\x00-\x20"'<>]+""", 0, 0),
}
STRONG = ("assign", "access", "hex")
CLASS = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "token": "secret", "endpoint": "endpoint"}
SCOPE = 300


def _parts(text: Column, kind: str, order: int) -> Column:
    """All matches of a kind in reading order: code points between a match and the one before, and of the match."""
    pattern, least, group = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    last = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if group else found

    def part(match: Column, i: Column) -> Column:
        keep = (F.length(match) >= least) & (F.length(F.get(last, i)) >= group)
        if kind == "token":  # random-looking: letters of both cases and digits
            keep = keep & match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]")
        return F.struct(
            F.lit(order).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).cast("long").alias("gap"),
            F.length(match).cast("long").alias("len"), keep.alias("keep"))

    nothing = F.array().cast("array<struct<kind:int,i:int,gap:bigint,len:bigint,keep:boolean>>")
    return F.when(text.rlike(pattern), F.transform(found, part)).otherwise(nothing)


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id and ``spans``, the array of (start, kind, end, strong) by start, then kind; code
    points, end exclusive."""
    text = F.coalesce("text", F.lit(""))
    names = list(KINDS)
    parts = F.concat(*[_parts(F.col("_t"), k, i) for i, k in enumerate(names)])
    rows = stored(
        docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), text.alias("_t")).select("doc_id", "_row", parts.alias("_p")), "parts")
    before = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.select("_row", F.inline("_p")).withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)) \
        .where("keep").select("_row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    classes = F.array(*[F.lit(CLASS[k]) for k in names])
    spans = stored(spans.withColumns({"class": F.get(classes, F.col("kind")), "bin": F.floor(F.col("start") / scope)}), "spans")
    strong = F.col("kind") < len(STRONG)
    near = spans.groupBy("_row", F.col("class").alias("other"), F.col("bin").alias("at")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = spans.where(~strong).withColumn("at", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    inside = (F.col("last") >= F.col("start") - scope) & (F.col("first") <= F.col("start") + scope)
    linked = weak.join(near, ["_row", "at"]).where(inside & (F.col("class") != F.col("other"))) \
        .groupBy("_row", "kind", "start", "end", "class").agg(
            F.bool_or(F.col("other") == "id").alias("id"), F.bool_or(F.col("other") == "secret").alias("secret")) \
        .where(F.when(F.col("class") == "id", F.col("secret")).when(F.col("class") == "secret", F.col("id")).otherwise(F.col("id") & F.col("secret")))
    reported = spans.where(strong).select("_row", "kind", "start", "end").unionByName(linked.select("_row", "kind", "start", "end"))
    kinds = F.array(*[F.lit(k) for k in names])
    lists = reported.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s")).select(
        "_row", F.transform("s", lambda x: F.struct(x["start"].alias("start"), F.get(kinds, x["kind"]).alias("kind"), x["end"].alias("end"), (x["kind"] < len(STRONG)).alias("strong"))).alias("spans"))
    empty = F.array().cast(lists.schema["spans"].dataType)
    return rows.select("doc_id", "_row").join(lists, "_row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and the canonical text of the spans."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", *[count(k) for k in STRONG], F.sha2(joined(F.filter("spans", lambda s: s["strong"])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    quoted = {k: p.replace("'", "''") for k, (p, _, _) in KINDS.items()}
    keep = {k: " AND ".join([f"length(m) >= {least}", *([f"length(regexp_extract(m, '^(?:{quoted[k]})$', 2)) >= {group}"] if group else [])]) for k, (_, least, group) in KINDS.items()}
    keep["token"] += " AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{k}' AS kind, '{CLASS[k]}' AS class, start, start + length(m) AS stop FROM ("
        f"SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS start FROM ("
        f"SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gs[:len(ms)]) AS g FROM ("
        f"SELECT doc_id, regexp_extract_all(t, '{quoted[k]}') AS ms, string_split_regex(t, '{quoted[k]}') AS gs FROM docs WHERE regexp_matches(t, '{quoted[k]}')))) WHERE {keep[k]}"
        for i, k in enumerate(KINDS))
    near = "EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.class = '{}' AND abs(o.start - p.start) <= {})"
    has_id, has_secret = near.format("id", SCOPE), near.format("secret", SCOPE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), parts AS MATERIALIZED ({parts}),
spans AS (SELECT * FROM parts p WHERE k < 3 OR (class = 'id' AND {has_secret}) OR (class = 'secret' AND {has_id}) OR (class = 'endpoint' AND {has_id} AND {has_secret})),
lists AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k) FILTER (k < 3) AS base,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(l.spans, '') AS spans FROM docs LEFT JOIN lists l USING (doc_id)
"""


SQL = _sql()
