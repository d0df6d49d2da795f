"""Joins of panels, samples, scaffolds and maps to the sites and samples of the likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["chr", "pos", "ref", "alt"]


class PanelError(ValueError):
    """A panel, sample list or map that doesn't fit the likelihoods."""


def duplicate_sites(sites: DataFrame) -> DataFrame:
    """(chr, pos, ref, alt, n) of sites that occur more than once; empty for a valid list."""
    return sites.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def unordered_sites(sites: DataFrame, strictly: bool = False) -> DataFrame:
    """(site_idx, pos, before) of sites that lie before the one above them in the list (or at it)."""
    before = F.lag("pos").over(Window.partitionBy("chr").orderBy("site_idx"))
    bad = F.col("pos") <= F.col("before") if strictly else F.col("pos") < F.col("before")
    return sites.withColumn("before", before).where(bad).select("site_idx", "pos", "before")


def first_sites(sites: DataFrame, limit: int, drop_ok: float = 0.05) -> DataFrame:
    """(chr, n_kept, n_dropped, fits) under a limit on a chromosome's sites; fits: what is dropped is at most the share drop_ok of the limit."""
    n = F.count("*")
    dropped = F.greatest(n - limit, F.lit(0))
    return sites.groupBy("chr").agg(F.least(n, F.lit(limit)).alias("n_kept"), dropped.alias("n_dropped"), (dropped <= drop_ok * limit).alias("fits"))


class LoadedOnce:
    """A guard over a run's panels: each kind may be loaded once."""

    def __init__(self):
        self.seen: set[str] = set()

    def __call__(self, kind: str) -> None:
        if kind in self.seen:
            raise PanelError(f"the {kind} panel was loaded before")
        self.seen.add(kind)


def repeated_panels(loads: DataFrame) -> DataFrame:
    """(run, kind, n) of the panels that loads(run, kind) would load again, which LoadedOnce refuses; empty for a valid plan."""
    return loads.groupBy("run", "kind").agg(F.count("*").alias("n")).where("n > 1")


def filter_sites(panel: DataFrame, sites: DataFrame) -> DataFrame:
    """The panel's rows, of sites or of cells, at the likelihoods' sites, with their site_idx; all four parts of a site must agree."""
    return panel.join(sites.select("site_idx", *KEY).hint("merge"), KEY)


def check_sites(panel_sites: DataFrame, sites: DataFrame, scaffold: bool) -> None:
    """A reference panel must have every site, a scaffold at least one; neither may have one twice."""
    found = panel_sites.join(sites.select(*KEY).hint("merge"), KEY, "left_semi")
    n, distinct, all_ = found.count(), found.select(*KEY).distinct().count(), sites.count()
    if n != distinct or n == 0 or (not scaffold and n != all_):
        raise PanelError(f"{n} of {all_} sites matched")


def subset_samples(haps: DataFrame, panel_samples: DataFrame, samples: DataFrame) -> DataFrame:
    """The haplotypes of the panel's samples that are also in samples; haplotypes 2 i and 2 i + 1 are sample i's."""
    kept = panel_samples.join(samples.select("sample_id"), "sample_id", "left_semi")
    return haps.join(F.broadcast(kept.select(F.col("sample_idx").alias("of"))), F.expr("hap_id div 2") == F.col("of"), "left_semi")


def order_samples(haps: DataFrame, panel_samples: DataFrame, samples: DataFrame) -> DataFrame:
    """haps with ids in the order of samples. What is sent to all tasks is a row a sample: Spark, which can't tell how many rows haps has, would send those."""
    place = panel_samples.select(F.col("sample_idx").alias("old"), "sample_id").join(samples.select("sample_id", F.col("sample_idx").alias("new")), "sample_id").select("old", "new")
    moved = haps.join(F.broadcast(place), F.expr("hap_id div 2") == F.col("old"))
    return moved.withColumn("hap_id", (2 * F.col("new") + F.col("hap_id") % 2).cast("long")).drop("old", "new")


def mismatched_samples(a: DataFrame, b: DataFrame) -> DataFrame:
    """(sample_idx, a, b) where two lists differ; empty if they are the same."""
    x = a.select("sample_idx", F.col("sample_id").alias("a"))
    return x.join(b.select("sample_idx", F.col("sample_id").alias("b")), "sample_idx", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def swap_matches(panel: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose chromosome, position and joined alleles agree, however the alleles are split."""
    key = F.concat("ref", "alt")
    return panel.withColumn("alleles", key).join(other.select("chr", "pos", key.alias("alleles")).distinct(), ["chr", "pos", "alleles"], "left_semi").drop("alleles")


def overlay_scaffold(alleles: DataFrame, scaffold: DataFrame) -> DataFrame:
    """alleles(hap_id, site_idx, allele), those at the scaffold's sites taken from it. Cells are joined by shuffle, whatever Spark makes of their number."""
    over = scaffold.select("hap_id", "site_idx", F.col("allele").alias("over"))
    return alleles.join(over.hint("merge"), ["hap_id", "site_idx"], "left").select("hap_id", "site_idx", F.coalesce("over", "allele").alias("allele"))


def append_reference(alleles: DataFrame, reference: DataFrame, n_samples: int) -> DataFrame:
    """Samples' haplotypes and then the reference's, whose ids follow on."""
    return alleles.unionByName(reference.withColumn("hap_id", F.col("hap_id") + 2 * n_samples))


def map_location(sites: DataFrame, gmap: DataFrame, strict: bool = False, stretch: int = 1 << 20) -> DataFrame:
    """sites with cm, interpolated between the neighbouring points of gmap([chr, ]pos, cm) on their chromosome.

    A site outside the map has none, or with strict is an error when the row is computed. A map without chr is that of one chromosome, and
    sites on several are an error. Points become intervals, which are joined by the stretches of a chromosome they reach into.
    """
    if "chr" not in gmap.columns:
        if sites.select("chr").distinct().limit(2).count() > 1:
            raise PanelError("a map without chromosomes, but sites on more than one")
        gmap, on = gmap.withColumn("chr", F.lit("")), F.lit("")
    else:
        on = F.col("chr")
    order = Window.partitionBy("chr").orderBy("pos")
    spans = gmap.select(F.col("chr").alias("of"), F.col("pos").alias("a"), F.col("cm").alias("ca"), F.lead("pos").over(order).alias("b"), F.lead("cm").over(order).alias("cb"))
    spans = spans.select("of", "a", "ca", F.coalesce("b", F.col("a") + 1).alias("b"), F.coalesce("cb", "ca").alias("cb"))
    spans = spans.select("*", F.explode(F.sequence(F.expr(f"a div {stretch}"), F.expr(f"(b - 1) div {stretch}"))).alias("stretch"))
    inside = (on == F.col("of")) & (F.expr(f"pos div {stretch}") == F.col("stretch")) & (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b"))
    cm = F.col("ca") + (F.col("pos") - F.col("a")) * (F.col("cb") - F.col("ca")) / (F.col("b") - F.col("a"))
    if strict:
        cm = F.coalesce(cm, F.raise_error(F.concat(F.lit("outside the map: "), "chr", F.lit(":"), F.col("pos").cast("string"))).cast("double"))
    return sites.join(spans, inside, "left").select(*sites.columns, cm.alias("cm"))


def look_up(asked: DataFrame, sites: DataFrame, strict: bool = True) -> DataFrame:
    """asked(chr, pos, ref, alt and others) with the site_idx of the site that has all four; with strict, an absent site is an error when its row is computed."""
    found = asked.join(sites.select("site_idx", *KEY), KEY, "left")
    if not strict:
        return found
    name = F.concat_ws(":", "chr", F.col("pos").cast("string"), "ref", "alt")
    return found.withColumn("site_idx", F.coalesce("site_idx", F.raise_error(F.concat(F.lit("no such site: "), name)).cast("long")))


def map_distance(located: DataFrame) -> DataFrame:
    """located sites with the distance in Morgans to the site before, null for a chromosome's first."""
    return located.withColumn("morgans", (F.col("cm") - F.lag("cm").over(Window.partitionBy("chr").orderBy("site_idx"))) / 100)


def reorder(records: DataFrame, ranked: DataFrame) -> DataFrame:
    """records in the order of ranked(chr, pos, ref, alt, rank): by the first rank of their position, then by their own; a record without one is an error."""
    if not records.join(ranked, KEY, "left_anti").isEmpty():
        raise PanelError("a record has no rank")
    first = F.min("rank").over(Window.partitionBy("chr", "pos", "ref"))
    return records.join(ranked.withColumn("group_rank", first), KEY).orderBy("group_rank", "rank")


def keep_samples(samples: DataFrame, names: list[str]) -> DataFrame:
    """The samples of the given names in their own order; no names keep all."""
    return samples.where(F.col("sample_id").isin(names)) if names else samples


def unique_by(df: DataFrame, column: Column, message: str) -> None:
    if df.groupBy(column).count().where("count > 1").limit(1).count():
        raise PanelError(message)
