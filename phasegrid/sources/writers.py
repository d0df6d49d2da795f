"""Results and likelihoods as text: VCF, bin, relationship tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import genotype_posterior, phased_call, prob2phred


def three_digits(x: Column) -> Column:
    """A non-negative number with three significant digits, zeros at the end left out."""
    plain = F.format_string("%.6f", x)
    for power in range(-3, 3):
        plain = F.when(x >= 10.0**power, F.format_string(f"%.{2 - power}f", x)).otherwise(plain)
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    tiny = F.regexp_replace(F.format_string("%.2e", x), r"\.?0*e", "e")
    return F.when(x == 0, "0").when(x < 1e-4, tiny).otherwise(short)


def vcf_cells(posterior: DataFrame) -> DataFrame:
    """(sample_idx, site_idx, cell): GT:GP:APP from (p_a, p_b), the probabilities as phreds."""
    a, b = F.col("p_a"), F.col("p_b")
    p = posterior.select("sample_idx", "site_idx", phased_call(a, b).alias("gt"), genotype_posterior(a, b).alias("g"), "p_a", "p_b")
    text = lambda c: three_digits(F.abs(prob2phred(F.col(c))))
    gp = F.concat_ws(",", *[text(f"g.{n}") for n in ("rr", "het", "aa")])
    return p.select("sample_idx", "site_idx", F.concat_ws(":", "gt", gp, F.concat_ws(",", text("p_a"), text("p_b"))).alias("cell"))


def plain_cells(posterior: DataFrame) -> DataFrame:
    """(sample_idx, site_idx, cell): GT:AP with three decimals."""
    a, b = F.col("p_a"), F.col("p_b")
    return posterior.select("sample_idx", "site_idx", F.concat(phased_call(a, b), F.format_string(":%.3f,%.3f", a, b)).alias("cell"))


def site_lines(cells: DataFrame, sites: DataFrame, fmt: str, qual: str = "100", passed: str = "PASS") -> DataFrame:
    """(site_idx, line): a record's text, samples in order."""
    by_site = cells.groupBy("site_idx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "cell"))).alias("x")).join(sites, "site_idx")
    fixed = [F.col("chr"), F.col("pos").cast("string"), F.lit("."), F.col("ref"), F.col("alt"), F.lit(qual), F.lit(passed), F.lit("."), F.lit(fmt)]
    return by_site.select("site_idx", F.concat_ws("\t", *fixed, F.array_join(F.transform("x", lambda v: v["cell"]), "\t")).alias("line"))


def vcf_header(samples: list[str], chrom: str, fmt: str, command: str = "") -> list[str]:
    kinds = {
        "GT": ("1", "String", "Phased genotype"),
        "GP": ("3", "Float", "Posterior probabilities of the genotypes, as phreds"),
        "APP": ("2", "Float", "Posterior probabilities of allele 1 on each haplotype, as phreds"),
        "AP": ("2", "Float", "Posterior probabilities of allele 1 on each haplotype"),
        "GL": ("G", "Float", "Genotype likelihoods, as log10"),
    }
    lines = ["##fileformat=VCFv4.2", "##source=phasegrid", f"##contig=<ID={chrom}>"] + ([f"##command={command}"] if command else [])
    lines += [f'##FORMAT=<ID={k},Number={kinds[k][0]},Type={kinds[k][1]},Description="{kinds[k][2]}">' for k in fmt.split(":")]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def write_lines(lines: DataFrame, header: list[str], path: str) -> None:
    """A folder of gzipped parts: the header, then lines by site_idx. In order of their names the parts are one file: gzipped files may follow each other in one.

    Lines are dealt out by ranges of sites, so parts are written side by side; Spark's commit protocol keeps those of lost tasks out.
    """
    spark = lines.sparkSession
    top = spark.createDataFrame([(i - len(header), x) for i, x in enumerate(header)], "site_idx long, line string")
    both = top.unionByName(lines.select(F.col("site_idx").cast("long").alias("site_idx"), "line"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_dealt(both.repartitionByRange(n, "site_idx").sortWithinPartitions("site_idx"), path)


def write_dealt(lines: DataFrame, path: str) -> None:
    """The same for lines without a header whose partitions are in order already: none is shuffled."""
    lines.select("line").write.option("compression", "gzip").text(path)


def write_vcf(posterior: DataFrame, sites: DataFrame, samples: list[str], path: str, command: str = "", plain: bool = False) -> None:
    fmt = "GT:AP" if plain else "GT:GP:APP"
    cells = plain_cells(posterior) if plain else vcf_cells(posterior)
    write_lines(site_lines(cells, sites, fmt), vcf_header(samples, sites.first().chr, fmt, command), path)


def gl_vcf_lines(gl: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_idx, line): likelihoods as log10, -999 for zero."""
    log = lambda c: F.when(F.col(c) == 0, "-999").otherwise(F.regexp_replace(F.format_string("%.5f", F.log10(F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)))), r"\.?0+$", ""))
    cells = gl.select("sample_idx", "site_idx", F.concat_ws(",", log("rr"), log("het"), log("aa")).alias("cell"))
    return site_lines(cells, sites, "GL", ".", ".")


def pl_to_pair(pl: Column) -> Column:
    """`het hom` with five decimals from a text of three phreds, scaled so that the least is 0."""
    v = F.transform(F.split(pl, ","), lambda x: x.cast("double"))
    p = F.transform(v, lambda x: F.pow(F.lit(10.0), -(x - F.array_min(v)) / 10))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.format_string("%.5f %.5f", p[1] / total, p[2] / total)


def bin_lines(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """(site_idx, line) of the bin format from (sample_idx, site_idx, cell); longer alleles are two words."""
    by_site = cells.groupBy("site_idx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "cell"))).alias("x")).join(sites, "site_idx")
    short = (F.length("ref") == 1) & (F.length("alt") == 1)
    alleles = F.when(short, F.concat("ref", "alt")).otherwise(F.concat_ws(" ", "ref", "alt"))
    return by_site.select("site_idx", F.concat_ws("\t", "chr", F.col("pos").cast("string"), alleles, F.array_join(F.transform("x", lambda v: v["cell"]), "\t")).alias("line"))


def graph_table(graph: DataFrame) -> DataFrame:
    """(sample_idx, col, num, den, ratio)."""
    return graph.select("sample_idx", "col", "num", "den", (F.col("num") / F.col("den")).alias("ratio"))


