"""From a folder of images to a split without leaks: scan, quarantine, deduplicate, cluster, split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.paths import label_manifest
from foliant.operators import manifest, neardup, split
from foliant.plans.workspace import store
from foliant.sources.files import probe_image, scan_images
from foliant.sources.pixels import with_hashes


def preprocess(spark: SparkSession, root: str, dataset: str, mode: str = "flat", cluster: bool = True, probe: Callable[[bytes], dict] | None = None, hashes: Callable[[DataFrame], DataFrame] | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(split, quarantine) of the images under root.

    split: dataset, label, path, md5, size_bytes, ahash, width, height, cluster, split of one file for each checksum. quarantine: path, reason
    (corrupt, unsupported or duplicate).
    hashes adds the column ahash (256 bits) to rows with a path, and is where another image library is plugged in; without it the average hash
    is computed from the pictures, and a kept file that cannot be decoded for it is an error. cluster=False makes every file a cluster of its own.
    """
    own = cluster and hashes is None
    files = scan_images(spark, root, probe or probe_image, hashed=own).withColumn("label", label_manifest("rel", mode))
    files = store(files.select(F.lit(dataset).alias("dataset"), "label", F.col("rel").alias("path"), "md5", "size_bytes", "width", "height", "status", (F.col("status") == "ok").alias("ok"), *(["ahash"] if own else [])), "files")
    moved = manifest.quarantine(files, "path", "label", "ok", "md5", ["label", "path"]).select("path", "reason")
    other = files.filter("status = 'unsupported'").select(F.col("path").alias("p"), "status")
    moved = moved.join(other, F.col("path") == F.col("p"), "left").select("path", F.coalesce("status", "reason").alias("reason"))
    kept = manifest.keep_first(files.filter("ok"), "md5", ["label", "path"])
    if own:
        if not kept.filter("ahash IS NULL").isEmpty():
            kept = store(with_hashes(kept, root), "hashes")
            if lacking := kept.filter("ahash IS NULL").select("path").limit(5).collect():
                raise ValueError(f"no hash, so no clusters, for files such as {[r.path for r in lacking]}: give hashes or leave clustering out")
    else:
        kept = hashes(kept) if hashes else kept.withColumn("ahash", F.lit(None).cast("binary"))
    kept = store(manifest.row_ids(kept, ["label", "path"], "row"), "manifest")
    if cluster:
        roots = neardup.clusters(kept, "row", "label", "ahash", "size_bytes").select(F.col("row").alias("r"), "root")
        kept = store(manifest.dense_ids(kept.join(roots, F.col("row") == F.col("r")).drop("r"), "root", ["row"]), "clusters")
    else:
        kept = kept.withColumn("cluster", F.col("row"))
    given = split.assign(split.cluster_rollup(kept, ["cluster"], "label"), ["cluster"], seed=seed).select(F.col("cluster").alias("c"), "split")
    out = kept.join(given, F.col("cluster") == F.col("c"))
    return out.select("dataset", "label", "path", "md5", "size_bytes", "ahash", "width", "height", F.col("cluster").cast("int").alias("cluster"), "split"), moved
