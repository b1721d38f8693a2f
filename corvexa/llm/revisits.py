"""Resolution of not-modified revisit records: an as-of join by canonical URL, with DataFrame functions only.

A revisit belongs to the latest response of its canonical URL with an earlier time. Records of one URL and time are
one point: its response is the one of the largest id. To keep a hot URL out of one task the time line is cut into
ranges of about equal numbers of records: within a (URL, range) a running last response is taken, each range's last
response is carried to the ranges after it over one row a range, and the carried one serves where a range has none
before. Only ids travel until the response is fetched by its id; records without one are kept apart from that join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a not-modified answer that replace those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Ranges of the time line at most.
RANGES = 64


def canonical_url(url: Column) -> Column:
    """Lower-case host without www., no scheme, default port, fragment, tracking parameter or closing slash."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", "")
    rest = F.regexp_replace(u, "^[^/?]*", "")
    path, query = F.regexp_replace(rest, "\\?.*$", ""), F.regexp_extract(rest, "\\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]*|ref)(=|$)")))
    path = F.regexp_replace(path, "/+$", "")
    return F.when(F.size(kept) > 0, F.concat(host, path, F.lit("?"), F.array_join(kept, "&"))).otherwise(F.concat(host, path))


def _tag(etag: Column) -> Column:
    """Weak comparison ignores the weakness mark."""
    return F.regexp_replace(etag, "^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with PERMITTED ones replaced by the fresh answer's; names meet without regard to case."""
    empty = F.create_map().cast("map<string,string>")
    permitted = F.array(*map(F.lit, PERMITTED))
    new = F.map_filter(F.coalesce(fresh, empty), lambda k, v: F.array_contains(permitted, F.lower(k)))
    names = F.transform(F.map_keys(new), lambda k: F.lower(k))
    return F.map_concat(F.map_filter(F.coalesce(stored, empty), lambda k, v: ~F.array_contains(names, F.lower(k))), new)


def resolve_revisits(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Each revisit row once, with ``ref_id`` (record id of its response), ``state`` and ``merged`` headers.

    ``records``: rec_id long, url, ts long, kind ('response' or 'revisit'), etag, last_modified, headers map. State:
    'matched' where the entity tags agree, or, if one side has none, the dates of modification do; 'mismatch' where
    they disagree or nothing can be compared; 'unresolved' without an earlier response. Only matched revisits have
    merged headers (``merge_headers``). Null URLs and times are unresolved; of responses at one time the largest id
    counts. Repeated revisit rows stay repeated; of response rows that repeat an id the one with the largest entity
    tag (then date, then headers as text) counts. Other columns aren't carried.
    """
    records = records.select("rec_id", "url", "ts", "kind", "etag", "last_modified", "headers").withColumn("curl", F.when(F.col("ts").isNotNull(), canonical_url(F.col("url"))))
    cuts = records.where("ts IS NOT NULL").agg(F.percentile_approx("ts", F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(1000))).first()[0] or []
    span = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col("ts"))) if cuts else F.lit(0)
    # One row for each URL and time: copies of a record are combined before the shuffle.
    points = records.where("curl IS NOT NULL").groupBy("curl", "ts").agg(F.max(F.when(F.col("kind") == "response", F.col("rec_id"))).alias("here"), F.bool_or(F.col("kind") == "revisit").alias("asked"))
    points = points.withColumn("span", span)
    earlier = Window.partitionBy("curl", "span").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    within = points.withColumn("near", F.last("here", ignorenulls=True).over(earlier)).where("asked").select("curl", "span", "ts", "near")
    lasts = points.groupBy("curl", "span").agg(F.max_by("here", F.when(F.col("here").isNotNull(), F.col("ts"))).alias("end"))
    before = Window.partitionBy("curl").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("curl", "span", F.last("end", ignorenulls=True).over(before).alias("far"))
    found = within.join(carried, ["curl", "span"]).select("curl", "ts", F.coalesce("near", "far").alias("ref_id")).where("ref_id IS NOT NULL")
    best = F.struct("etag", "last_modified", F.to_json("headers"))
    stored = records.where("kind = 'response'").groupBy(F.col("rec_id").alias("ref_id")).agg(F.max_by(F.struct("etag", "last_modified", "headers"), best).alias("r"))
    revisits = records.where("kind = 'revisit'")
    placed = revisits.where("curl IS NOT NULL").join(found, ["curl", "ts"], "left").unionByName(revisits.where("curl IS NULL").withColumn("ref_id", F.lit(None).cast("long")))
    known = placed.where("ref_id IS NOT NULL").join(stored, "ref_id")
    tags, dates = _tag(F.col("etag")) == _tag(F.col("r.etag")), F.col("last_modified") == F.col("r.last_modified")
    known = known.withColumn("state", F.when(F.coalesce(tags, dates, F.lit(False)), "matched").otherwise("mismatch"))
    known = known.withColumn("merged", F.when(F.col("state") == "matched", merge_headers(F.col("r.headers"), F.col("headers"))))
    open_ = placed.where("ref_id IS NULL").withColumns({"state": F.lit("unresolved"), "merged": F.lit(None).cast("map<string,string>")})
    names = ["rec_id", "url", "ts", "ref_id", "state", "merged"]
    return known.select(*names).unionByName(open_.select(*names))
