"""Record and genotype rewrites: subsets, trims, splits and joins of alleles, tags from tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import variants as V


def sample_subset(gt: DataFrame, names: list[str], exclude: bool = False) -> DataFrame:
    hit = F.col("sample").isin(*names)
    return gt.where(~hit if exclude else hit)


def drop_genotypes(sites: DataFrame) -> DataFrame:
    """Frames read from VCF without their samples."""
    return sites.withColumn("samples", F.slice("samples", 1, 0)).withColumn("format", F.slice("format", 1, 0))


def rename_contigs(sites: DataFrame, names: DataFrame) -> DataFrame:
    """``names`` (old, new); contigs that aren't in it keep their name."""
    return sites.join(names.select(F.col("old").alias("chrom"), F.col("new").alias("_new")), "chrom", "left").withColumn("chrom", F.coalesce("_new", "chrom")).drop("_new")


def remove_annotations(sites: DataFrame, *what: str, keep: bool = False) -> DataFrame:
    """``ID``, ``QUAL``, ``FILTER``, ``FILTER/x``, ``INFO/x``: taken out, or with ``keep`` all other FILTERs and INFO columns.

    FILTER emptied by removal is PASS; by keeping it is missing (an empty array).
    """
    out, fixed = sites, {"site_id", "chrom", "contig_rank", "pos", "id", "ref", "alts", "qual", "filters"}
    named = {w.partition("/")[0]: [x.partition("/")[2] for x in what if x.partition("/")[0] == w.partition("/")[0]] for w in what}
    for kind, tags in named.items():
        if kind == "ID":
            out = out.withColumn("id", F.lit(None).cast("string"))
        elif kind == "QUAL":
            out = out.withColumn("qual", F.lit(None).cast("double"))
        elif kind == "FILTER":
            given = F.array(*map(F.lit, [t for t in tags if t])) if any(tags) else F.col("filters")
            left = F.array_intersect("filters", given) if keep else F.array_except("filters", given)
            out = out.withColumn("filters", left if keep else F.when(F.size(left) == 0, F.array(F.lit("PASS"))).otherwise(left))
        elif kind == "INFO":
            names = {t.lower() for t in tags}
            out = out.select(*(c for c in out.columns if c in fixed or (c in names) == keep))
    return out


def _rewritten(a: Column, to: Column) -> Column:
    return F.transform(a, lambda x: F.coalesce(x, to))


def major_alleles(gt: DataFrame) -> DataFrame:
    """(site_id, major, minor): most common called allele (the lowest index of equal ones), and the next."""
    n = gt.select("site_id", F.explode("alleles").alias("a")).where("a is not null").groupBy("site_id", "a").agg(F.count("*").alias("n"))
    s = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("a").alias("a"))))
    return n.groupBy("site_id").agg(s.alias("s")).select("site_id", F.get("s", F.lit(0))["a"].alias("major"), F.get("s", F.lit(1))["a"].alias("minor"))


def missing_to_ref(gt: DataFrame, major: bool = False) -> DataFrame:
    """Missing alleles become 0, or the site's most common allele."""
    if not major:
        return gt.withColumn("alleles", _rewritten(F.col("alleles"), F.lit(0)))
    out = gt.join(major_alleles(gt).select("site_id", "major"), "site_id", "left")
    return out.withColumn("alleles", _rewritten(F.col("alleles"), F.coalesce("major", F.lit(0)))).drop("major")


def set_genotypes(gt: DataFrame, target: str | Column, new: str) -> DataFrame:
    """``target``: ``.`` any missing, ``./.`` all missing, ``./x`` some but not all, ``a`` all rows, or a condition.
    ``new``: ``.``, ``0``, ``M`` major, ``m`` minor (missing if there's none), ``p`` phased, ``u`` unphased and sorted, ``i`` inverted, ``c:GT`` the given one."""
    a = F.col("alleles")
    hits = {".": G.any_missing(a), "./.": G.all_missing(a), "./x": G.any_missing(a) & ~G.all_missing(a), "a": F.lit(True)}
    hit = hits[target] if isinstance(target, str) else target
    out = gt.join(major_alleles(gt), "site_id", "left") if new in ("M", "m") else gt
    all_of = lambda v: F.transform(a, lambda _: v)
    phase = F.col("phased")
    if new in ("p", "u"):
        made, phase = (a if new == "p" else F.array_sort(a)), F.when(hit, F.lit(new == "p")).otherwise(F.col("phased"))
    elif new.startswith("c:"):
        made = F.array(*(F.lit(None if x == "." else int(x)).cast("int") for x in new[2:].replace("|", "/").split("/")))
        phase = F.when(hit, F.lit("|" in new)).otherwise(F.col("phased"))
    else:
        made = {".": lambda: all_of(F.lit(None).cast("int")), "0": lambda: all_of(F.lit(0)), "M": lambda: all_of(F.col("major")), "m": lambda: all_of(F.col("minor")), "i": lambda: F.reverse(a)}[new]()
    out = out.withColumn("phased", phase).withColumn("alleles", F.when(hit, made).otherwise(a))
    return out.select(*gt.columns)


def set_failed_genotypes(gt: DataFrame, passes: Column, to: int | None) -> DataFrame:
    """Genotypes of samples that fail become ``to`` in every allele."""
    return gt.withColumn("alleles", F.when(passes, F.col("alleles")).otherwise(F.transform("alleles", lambda _: F.lit(to).cast("int"))))


def fix_ploidy(gt: DataFrame, ploidy: Column) -> DataFrame:
    """Genotypes at the given ploidy: longer by repeating the last allele, shorter by cutting; 0 is one missing allele."""
    a, n = F.col("alleles"), F.size("alleles")
    longer = F.concat(a, F.array_repeat(F.get(a, n - 1), F.greatest(ploidy - n, F.lit(0)).cast("int")))
    fixed = F.when(ploidy == 0, F.array(F.lit(None).cast("int"))).otherwise(F.slice(longer, F.lit(1), F.greatest(ploidy, F.lit(1)).cast("int")))
    return gt.withColumn("alleles", fixed)


def split_multiallelic(sites: DataFrame) -> DataFrame:
    """A row for each ALT, numbered from 1 in ``alt_index``; sites without ALT stay."""
    return sites.select(*(c for c in sites.columns if c != "alts"), F.posexplode_outer("alts").alias("_i", "_a")).select(
        *(c for c in sites.columns if c != "alts"), F.when(F.col("_a").isNull(), F.array().cast("array<string>")).otherwise(F.array("_a")).alias("alts"), F.coalesce(F.col("_i") + 1, F.lit(0)).alias("alt_index")
    )


def split_genotype(a: Column, alt_index: Column, other_missing: bool = False) -> Column:
    """Alleles for one of several ALTs: it is 1, other ALTs 0 or missing."""
    return F.transform(a, lambda x: F.when(x == alt_index, 1).when(x > 0, F.lit(None).cast("int") if other_missing else F.lit(0)).otherwise(x))


def join_multiallelic(rows: DataFrame) -> DataFrame:
    """Inverse of the split: rows equal in position, REF, kind, QUAL and FILTER become one with their ALTs in order."""
    kind = V.key_class(F.col("ref"), F.col("alts"))
    key = ["chrom", "pos", "ref", "kind", "qual", "filters"]
    return rows.withColumn("kind", kind).groupBy(*key).agg(
        F.min("site_id").alias("site_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("site_id", "alt_index", "alts"))), lambda x: x["alts"])).alias("alts"), F.count("*").alias("n_rows")
    )


def trim_unused_alts(sites: DataFrame, gt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ALTs that some genotype has, with ``an`` and ``ac`` counted anew, and genotypes in their new indices."""
    used = gt.select("site_id", F.explode("alleles").alias("a")).where("a is not null").groupBy("site_id").agg(F.collect_set("a").alias("used"), F.count("*").alias("an"))
    joined = sites.join(used, "site_id", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    kept = joined.withColumn("kept", F.filter(F.sequence(F.lit(0), F.size("alts")), lambda i: (i == 0) | F.array_contains("used", i)))
    new_gt = gt.join(kept.select("site_id", "kept"), "site_id")
    new_gt = new_gt.withColumn("alleles", F.transform("alleles", lambda x: F.when(x.isNotNull(), F.nullif(F.array_position("kept", x), F.lit(0)).cast("int") - 1))).drop("kept")
    ac = new_gt.select("site_id", F.explode("alleles").alias("a")).where("a > 0").groupBy("site_id", "a").agg(F.count("*").alias("n")).groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "n"))).alias("_ac"))
    out = kept.join(ac, "site_id", "left").withColumn("alts", F.transform(F.filter("kept", lambda i: i > 0), lambda i: F.get("alts", i - 1)))
    out = out.withColumn("ac", F.transform("alts", lambda _, i: F.coalesce(F.try_element_at("_ac", i + 1), F.lit(0)))).withColumn("an", F.coalesce("an", F.lit(0)))
    return out.drop("_ac", "used", "kept"), new_gt


def trim_symbolic(sites: DataFrame, always: bool = False) -> DataFrame:
    """Drops ``<*>`` and ``<NON_REF>`` ALTs; a site's only ALT stays unless ``always``."""
    left = F.filter("alts", lambda a: ~a.isin("<*>", "<NON_REF>"))
    return sites.withColumn("alts", left if always else F.when(F.size("alts") == 1, F.col("alts")).otherwise(left))


def pick_by_number(values: Column, kept: Column, number: str) -> Column:
    """Slots of an A, R or G vector for the kept alleles (0 = REF): per ALT, per allele, per unordered genotype."""
    alts = F.filter(kept, lambda i: i > 0)
    if number == "A":
        return F.transform(alts, lambda i: F.get(values, i - 1))
    if number == "R":
        return F.transform(kept, lambda i: F.get(values, i))
    pairs = F.flatten(F.transform(kept, lambda b, j: F.transform(F.slice(kept, F.lit(1), j + 1), lambda a: F.get(values, V.genotype_index(a, b)))))
    return pairs


def orient_to_reference(sites: DataFrame, gt: DataFrame, base: Column) -> tuple[DataFrame, DataFrame]:
    """Biallelic SNPs against the reference ``base``: ``none`` if REF is it, ``swap`` if ALT is, ``flip`` or ``flip,swap`` if the complement is, else ``skip``."""
    ref, alt = F.col("ref"), F.get("alts", F.lit(0))
    snp = (F.size("alts") == 1) & (F.length("ref") == 1) & (F.length(alt) == 1)
    fix = F.when(~snp, "skip").when(ref == base, "none").when(alt == base, "swap").when(V.complement(ref) == base, "flip").when(V.complement(alt) == base, "flip,swap").otherwise("skip")
    out = sites.withColumn("fix", fix)
    flip = lambda c: F.when(F.col("fix").startswith("flip"), V.complement(c)).otherwise(c)
    swap = F.col("fix").endswith("swap")
    new_ref, new_alts = F.when(swap, flip(alt)).otherwise(flip(ref)), F.when(swap, F.array(flip(ref))).when(F.col("fix") == "flip", F.array(flip(alt))).otherwise(F.col("alts"))
    fixed = out.withColumn("_r", new_ref).withColumn("alts", new_alts).withColumn("ref", F.col("_r")).drop("_r")
    g = gt.join(out.select("site_id", swap.alias("_swap")), "site_id")
    g = g.withColumn("alleles", F.when(F.col("_swap"), F.transform("alleles", lambda x: 1 - x)).otherwise(F.col("alleles"))).drop("_swap")
    return fixed, g


def gl_to_pl(gl: Column) -> Column:
    return F.transform(gl, lambda x: F.round(-10 * x).cast("int"))


def gl_to_gp(gl: Column) -> Column:
    p = F.transform(gl, lambda x: F.pow(F.lit(10.0), x).cast("float"))
    total = F.aggregate(p, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))
    return F.when(total > 0, F.transform(p, lambda x: (x / total).cast("float"))).otherwise(p)


def gp_to_gt(gp: Column, threshold: float) -> Column:
    """The likeliest genotype if its share is 1 - threshold at least, else missing: diploid for triangular lengths above one, haploid otherwise."""
    total = F.aggregate(gp, F.lit(0.0), lambda s, x: s + x)
    at = F.array_position(gp, F.array_max(gp)).cast("int") - 1
    sure = F.array_max(gp) / total >= 1 - threshold
    b = F.floor((F.sqrt(8 * at + 1) - 1) / 2).cast("int")
    a = at - (b * (b + 1) / 2).cast("int")
    n = F.size(gp)
    diploid = n.isin(*(k * (k + 1) // 2 for k in range(2, 40)))
    none = F.lit(None).cast("int")
    return F.when(diploid, F.when(sure, F.array(a, b)).otherwise(F.array(none, none))).otherwise(F.when(sure, F.array(at)).otherwise(F.array(none)))


def gt_to_prob3(a: Column) -> Column:
    """Three genotype probabilities of a call; 0.33 each where it's missing."""
    n = F.size(F.filter(a, lambda x: x > 0)) + F.when(F.size(a) == 1, F.size(F.filter(a, lambda x: x > 0))).otherwise(0)
    return F.when(G.any_missing(a), F.array(*[F.lit(0.33)] * 3)).otherwise(F.array(*(F.when(n == i, 1.0).otherwise(0.0) for i in range(3))))


def variantkey(chrom_code: Column, pos0: Column, ref: Column, alt: Column) -> Column:
    """64-bit key of short alleles (together at most 11 bases of ACGT): 5 bits contig, 28 bits position, 31 bits alleles."""
    code = lambda c, i: F.instr(F.lit("ACGT"), F.substring(c, i, F.lit(1))).cast("long") - 1
    bases = F.concat(ref, alt)
    allele = F.aggregate(F.sequence(F.lit(1), F.length(bases)), F.lit(0).cast("long"), lambda s, i: F.shiftleft(s, 2).bitwiseOR(code(bases, i)))
    used = F.length(bases)
    packed = F.expr("0L") + F.shiftleft(F.length(ref).cast("long"), 27).bitwiseOR(F.shiftleft(F.length(alt).cast("long"), 23)).bitwiseOR(F.call_function("shiftleft", allele, (22 - 2 * used + 1).cast("int")))
    return F.when((used <= 11) & bases.rlike("^[ACGT]*$"), F.shiftleft(chrom_code.cast("long"), 59).bitwiseOR(F.shiftleft(pos0.cast("long"), 31)).bitwiseOR(packed))


# Consequence terms from the least to the most severe.
SEVERITY = (
    "intergenic_variant feature_truncation feature_elongation regulatory_region_variant regulatory_region_amplification regulatory_region_ablation TF_binding_site_variant "
    "TFBS_amplification TFBS_ablation downstream_gene_variant upstream_gene_variant non_coding_transcript_variant intron_variant NMD_transcript_variant "
    "non_coding_transcript_exon_variant 5_prime_UTR_variant 3_prime_UTR_variant coding_sequence_variant mature_miRNA_variant stop_retained_variant start_retained_variant "
    "synonymous_variant incomplete_terminal_codon_variant splice_region_variant missense_variant inframe_deletion inframe_insertion protein_altering_variant "
    "transcript_amplification exon_loss_variant disruptive start_lost stop_lost stop_gained frameshift_variant splice_acceptor_variant splice_donor_variant transcript_ablation"
).split()


def split_consequences(rows: DataFrame, column: str, fields: list[str], keep: tuple[str, ...]) -> DataFrame:
    """A row for each transcript of a ``|``- and ``,``-separated annotation, with its fields, ``nth`` and ``severity`` (the worst of ``&``-joined terms; unknown ones above all)."""
    out = rows.select(*keep, F.posexplode(F.split(column, ",")).alias("nth", "_t")).withColumn("_f", F.split("_t", r"\|"))
    out = out.select(*keep, "nth", *(F.get("_f", F.lit(i)).alias(f) for i, f in enumerate(fields)))
    scale = F.map_from_arrays(F.array(*map(F.lit, SEVERITY)), F.array(*(F.lit(i) for i in range(len(SEVERITY)))))
    worst = F.array_max(F.transform(F.split("Consequence", "&"), lambda t: F.coalesce(F.try_element_at(scale, t), F.lit(len(SEVERITY)))))
    return out.withColumn("severity", worst)


def worst_consequence(rows: DataFrame, column: str, fields: list[str], keep: tuple[str, ...]) -> DataFrame:
    """The most severe transcript of each row, the first of equal ones."""
    each = split_consequences(rows, column, fields, keep)
    best = F.max_by(F.struct(*fields, "severity"), F.struct("severity", -F.col("nth")))
    return each.groupBy(*keep).agg(best.alias("_b")).select(*keep, "_b.*")


def select_consequences(rows: DataFrame, column: str, fields: list[str], keep: tuple[str, ...], select: str = "all", severity: str | None = None) -> DataFrame:
    """The transcripts that are asked for: ``all``, ``worst``, ``primary`` (CANONICAL is YES), ``pick`` (PICK is 1), ``mane`` (MANE_SELECT isn't empty), or ``FIELD=value``; and
    of those the ones at a ``severity``: a term, or a term with ``+`` (it or worse) or ``-`` (it or milder). A transcript is as severe as its worst term."""
    each = split_consequences(rows, column, fields, keep)
    if severity:
        term = severity.rstrip("+-")
        limit = SEVERITY.index(term) if term in SEVERITY else len(SEVERITY)
        at = F.col("severity")
        each = each.where(at >= limit if severity.endswith("+") else at <= limit if severity.endswith("-") else at == limit)
    if select == "worst":
        best = F.max_by(F.struct("nth", *fields, "severity"), F.struct("severity", -F.col("nth")))
        return each.groupBy(*keep).agg(best.alias("_sl_b")).select(*keep, "_sl_b.*")
    if select == "all":
        return each
    field, _, value = {"primary": "CANONICAL=YES", "pick": "PICK=1", "mane": "MANE_SELECT="}.get(select, select).partition("=")
    return each.where(F.col(field) != "" if select == "mane" else F.col(field) == value)


def join_transcripts(each: DataFrame, template: str, keep: tuple[str, ...], sep: str = ",") -> DataFrame:
    """``line``: the template (``%Field``, ``.`` where empty) of each transcript in order, joined."""
    parts, at = [], 0
    for m in re.finditer(r"%(\w+)", template):
        parts += [F.lit(template[at : m.start()]), F.when(F.col(m[1]) != "", F.col(m[1])).otherwise(".")]
        at = m.end()
    text = F.concat(*parts, F.lit(template[at:]))
    lines = F.array_sort(F.collect_list(F.struct("nth", text.alias("x"))))
    return each.groupBy(*keep).agg(F.array_join(F.transform(lines, lambda r: r["x"]), sep).alias("line"))


def expand_blocks(blocks: DataFrame) -> DataFrame:
    """Reference blocks (chrom, pos, end) to a row for each base."""
    return blocks.withColumn("pos", F.explode(F.sequence(F.col("pos"), F.col("end"))))


def rename_annotations(sites: DataFrame, names: dict[str, str]) -> DataFrame:
    """``INFO/a`` to ``b``, ``FILTER/a`` to ``b``, ``FORMAT/a`` to ``b`` on frames read from VCF."""
    kinds = {k: {o.partition("/")[2]: n for o, n in names.items() if o.startswith(k + "/")} for k in ("INFO", "FILTER", "FORMAT")}

    def renamed(c: Column, pairs: dict[str, str]) -> Column:
        for old, new in pairs.items():
            c = F.when(c == old, new).otherwise(c)
        return c

    out = sites
    if kinds["INFO"]:
        out = out.withColumn("info", F.transform_keys("info", lambda k, _: renamed(k, kinds["INFO"])))
    if kinds["FILTER"]:
        out = out.withColumn("filters", F.transform("filters", lambda x: renamed(x, kinds["FILTER"])))
    if kinds["FORMAT"]:
        out = out.withColumn("format", F.transform("format", lambda x: renamed(x, kinds["FORMAT"])))
        out = out.withColumn("samples", F.transform("samples", lambda s: s.withField("fmt", F.transform_keys(s["fmt"], lambda k, _: renamed(k, kinds["FORMAT"])))))
    return out


def keep_tags(sites: DataFrame, info: list[str] | None = None, fmt: list[str] | None = None) -> DataFrame:
    """Only the listed INFO and FORMAT tags, on frames read from VCF."""
    out = sites
    if info is not None:
        out = out.withColumn("info", F.map_filter("info", lambda k, _: k.isin(*info)))
    if fmt is not None:
        out = out.withColumn("format", F.filter("format", lambda k: k.isin(*fmt))).withColumn("samples", F.transform("samples", lambda s: s.withField("fmt", F.map_filter(s["fmt"], lambda k, _: k.isin(*fmt)))))
    return out


def rename_samples(gt: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = gt.sparkSession.createDataFrame(list(names.items()), "sample string, _new string")
    return gt.join(F.broadcast(pairs), "sample", "left").withColumn("sample", F.coalesce("_new", "sample")).select(*gt.columns)  # as large as the list given


def local_alleles(pl: Column, n_alt: Column, most: int) -> Column:
    """The ``most`` ALTs of highest probability in a sample's phred-scaled likelihoods, in order of index; the lower of equal ones."""
    p = F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10))

    def weight(i: Column) -> Column:
        with_i = F.transform(F.sequence(F.lit(0), n_alt), lambda j: F.coalesce(F.get(p, V.genotype_index(i, j)), F.lit(0.0)))
        return F.aggregate(with_i, F.lit(0.0), lambda s, x: s + x)

    scored = F.transform(F.sequence(F.lit(1), n_alt), lambda i: F.struct((-weight(i)).alias("w"), i.alias("i")))
    best = F.slice(F.array_sort(scored), 1, most)
    return F.when(n_alt > 0, F.array_sort(F.transform(best, lambda x: x["i"]))).otherwise(F.array().cast("array<int>"))


def trim_record(sites: DataFrame, numbers: dict[str, str]) -> DataFrame:
    """ALTs that some sample has, on frames read from VCF; genotypes take their new indices, and vectors of declared Number A, R or G their slots.

    ``numbers``: ``INFO/X`` or ``FORMAT/X`` to its Number. AC and AN are written anew.
    """
    used = F.array_distinct(F.flatten(F.transform("samples", lambda s: s["alleles"])))
    kept = F.filter(F.sequence(F.lit(0), F.size("alts")), lambda i: (i == 0) | F.array_contains("_used", i))
    d = sites.withColumn("_used", used).withColumn("_kept", kept)
    index = lambda a: F.when(F.array_contains("_kept", a), F.array_position("_kept", a).cast("int") - 1)

    def vector(kind: str, k: Column, v: Column) -> Column:
        out = v
        for tag, number in numbers.items():
            where, _, name = tag.partition("/")
            if where == kind and number in ("A", "R", "G"):
                out = F.when(k == name, F.transform(pick_by_number(v, F.col("_kept"), number), lambda x: F.coalesce(x, F.lit(".")))).otherwise(out)
        return out

    d = d.withColumn("samples", F.transform("samples", lambda s: s.withField("alleles", F.transform(s["alleles"], index)).withField("fmt", F.transform_values(s["fmt"], lambda k, v: vector("FORMAT", k, v)))))
    d = d.withColumn("info", F.transform_values("info", lambda k, v: vector("INFO", k, v)))
    d = d.withColumn("alts", F.transform(F.filter("_kept", lambda i: i > 0), lambda i: F.get("alts", i - 1)))
    all_called = F.filter(F.flatten(F.transform("samples", lambda s: s["alleles"])), lambda a: a.isNotNull())
    d = d.withColumn("_all", all_called)
    ac = F.transform("alts", lambda _, i: F.size(F.filter("_all", lambda a: a == i + 1)).cast("string"))
    fresh = F.map_from_arrays(F.array(F.lit("AC"), F.lit("AN")), F.array(ac, F.array(F.size("_all").cast("string"))))
    return d.withColumn("info", F.map_concat(F.map_filter("info", lambda k, _: ~k.isin("AC", "AN")), fresh)).drop("_used", "_kept", "_all")
