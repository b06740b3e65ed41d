"""Releases: parsing a list of them and choosing the newest by semantic version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryscan.functions import versions as V

SCHEMA = "array<struct<tag_name:string,draft:boolean,prerelease:boolean,body:string,published_at:string,assets:array<struct<name:string,browser_download_url:string,size:bigint>>>>"


def parse(lists: DataFrame, allowed: str = r"(?i)\Ahttps://[^/]+/") -> DataFrame:
    """From a column `releases` (JSON): tag, prerelease, published, assets; without drafts and tags that are no version.

    Assets whose address doesn't match `allowed` are left out.
    """
    rows = lists.select(F.explode(F.from_json("releases", SCHEMA)).alias("r")).select("r.*").where(~F.coalesce("draft", F.lit(False)))
    assets = F.filter("assets", lambda a: a["browser_download_url"].rlike(allowed))
    key = V.semver_key(F.col("tag_name"))
    pre = F.coalesce("prerelease", F.lit(False)) | ~key["is_release"]
    return rows.where(key.isNotNull()).select(F.col("tag_name").alias("tag"), pre.alias("prerelease"), F.try_to_timestamp("published_at").alias("published"), assets.alias("assets"))


def newest(releases: DataFrame, current: str | None = None, prereleases: bool = False) -> DataFrame:
    """The newest release above `current`, pre-releases only for those who use them: no row if there is none."""
    rows = releases.withColumn("_key", V.semver_key(F.col("tag"))).where("_key is not null")
    if not prereleases:
        rows = rows.where("_key.is_release").where(~F.coalesce("prerelease", F.lit(False)) if "prerelease" in releases.columns else F.lit(True))
    if current is not None:
        rows = rows.where(F.col("_key") > V.semver_key(F.lit(current)))
    whole = F.struct(*releases.columns)
    return rows.agg(F.max_by(whole, F.struct("_key", "tag")).alias("r")).where("r is not null").select("r.*")
