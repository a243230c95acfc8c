"""SQL stub files for the clusters that matter most."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rewrite_params, stub_slug


def stubs(clusters: DataFrame, *, top: int = 10, min_calls: int = 0) -> DataFrame:
    """rank, slug, path and content of the first ``top`` stubs by ``pos``.

    Clusters without a fingerprint or with at most ``min_calls`` calls are left
    out before ranking; ``top`` 0 gives none. The number of members is
    ``n_members``, or the length of ``members``.
    """
    n = F.col("n_members") if "n_members" in clusters.columns else F.size("members")
    rows = clusters.where((F.col("fingerprint") != "") & (F.col("total_calls") > min_calls)).orderBy("pos").limit(max(top, 0))
    # at most ``top`` rows get here
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy("pos")))
    rows = rows.withColumns({"slug": stub_slug(F.col("rank"), F.col("fingerprint")), "sql": rewrite_params(F.col("canonical"))})
    content = F.concat(
        F.lit("-- name: "),
        F.col("slug"),
        F.lit("\n-- Generated from workload_lens cluster "),
        F.col("fingerprint"),
        F.lit("\n-- Total calls (prod): "),
        F.col("total_calls").cast("string"),
        F.lit(" across "),
        n.cast("string"),
        F.lit(" member variants\n-- TODO: rename this slug, review canonical SQL, replace :paramN with meaningful names\n"),
        F.col("sql"),
        F.when(F.col("sql").endswith("\n"), "").otherwise("\n"),
    )
    return rows.select("rank", "slug", F.concat(F.lit("sql/"), F.col("slug"), F.lit(".sql")).alias("path"), content.alias("content"))


def write_stubs(found: DataFrame, folder: str) -> int:
    """Write the files below ``folder``; returns how many. There are at most ``top``."""
    (Path(folder) / "sql").mkdir(parents=True, exist_ok=True)
    rows = found.select("path", "content").collect()
    for r in rows:
        (Path(folder) / r["path"]).write_text(r["content"], encoding="utf-8")
    return len(rows)
