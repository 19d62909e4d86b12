"""Combinations of inputs: intersection, merge, pairwise comparison, trios, pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import genotypes as G
from siteloom.functions import prob
from siteloom.functions import variants as V


def collapse_key(mode: str = "none") -> list[Column]:
    """Key under which sites of different inputs are the same: ``none`` exact alleles, ``any`` position, ``snps``/``indels``/``both`` by class, ``id`` ID unless missing."""
    alleles = F.concat(F.col("ref"), F.lit(">"), F.array_join("alts", ","))
    kind = V.key_class(F.col("ref"), F.col("alts"))
    if mode == "any":
        what = F.lit("")
    elif mode in ("snps", "indels", "both"):
        merged = {"snps": ("snp",), "indels": ("indel",), "both": ("snp", "indel")}[mode]
        what = F.when(kind.isin(*merged), kind).otherwise(alleles)
    elif mode == "id":
        what = F.coalesce("id", alleles)
    else:
        what = alleles
    return [F.col("chrom").alias("chrom"), F.col("pos").alias("pos"), what.alias("what")]


def groups(inputs: list[DataFrame], mode: str = "none") -> DataFrame:
    """(chrom, pos, what, mask, n, sites): one shuffle for all inputs. Bit i of ``mask``: input i has it (null with more than 63 inputs); ``sites``: input to its first site_id."""
    rows = reduce(DataFrame.unionByName, [d.select(*collapse_key(mode), F.lit(i).alias("input"), "site_id") for i, d in enumerate(inputs)])
    per = rows.groupBy("chrom", "pos", "what", "input").agg(F.min("site_id").alias("site_id"))
    return per.groupBy("chrom", "pos", "what").agg(
        F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("input")) if len(inputs) <= 63 else F.lit(None).cast("long")).alias("mask"), F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("input", "site_id"))).alias("sites")
    )


def in_exactly(g: DataFrame, n: int) -> DataFrame:
    return g.where(F.col("n") == n)


def in_at_least(g: DataFrame, n: int) -> DataFrame:
    return g.where(F.col("n") >= n)


def with_mask(g: DataFrame, bits: str) -> DataFrame:
    """``bits``: one character for each input, from the first; any number of them."""
    wanted = [i for i, b in enumerate(bits) if b == "1"]
    return g.where((F.col("n") == len(wanted)) & F.forall(F.array(*map(F.lit, wanted)).cast("array<int>"), lambda i: F.map_contains_key("sites", i)))


def only_first(first: DataFrame, others: list[DataFrame], mode: str = "none") -> DataFrame:
    """Sites of the first input that no other has."""
    keyed = first.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(collapse_key(mode))))
    seen = reduce(DataFrame.union, [d.select(*(k.alias(f"_k{i}") for i, k in enumerate(collapse_key(mode)))) for d in others])
    return keyed.join(seen, ["_k0", "_k1", "_k2"], "left_anti").drop("_k0", "_k1", "_k2")


def write_input(g: DataFrame, inputs: list[DataFrame], which: int) -> DataFrame:
    """Sites of one input that are in the chosen groups."""
    ids = g.select(F.try_element_at("sites", F.lit(which)).alias("site_id")).where("site_id is not null")
    return inputs[which].join(ids, "site_id", "left_semi")


def records_in(g: DataFrame, inputs: list[DataFrame], which: int, mode: str = "none") -> DataFrame:
    """All records of one input in the chosen groups, those that are equal within it too."""
    keys = collapse_key(mode)
    keyed = inputs[which].select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    wanted = g.where(F.map_contains_key("sites", F.lit(which))).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(("chrom", "pos", "what"))))
    return keyed.join(wanted, ["_k0", "_k1", "_k2"], "left_semi").select(*inputs[which].columns)


def merge_exact(inputs: list[DataFrame]) -> DataFrame:
    """Sites of all inputs by exact alleles: ID union, highest QUAL, FILTER union without PASS, DP sum, number of inputs."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("input", F.lit(i)) for i, d in enumerate(inputs)])
    rows = rows.withColumn("alt", F.array_join("alts", ","))
    out = rows.groupBy("chrom", "pos", "ref", "alt").agg(
        F.array_join(F.array_sort(F.collect_set("id")), ";").alias("id"), F.max("qual").alias("qual"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("filters")))).alias("f"), F.sum("dp").alias("dp"), F.countDistinct("input").alias("n_inputs"),
    )
    left = F.array_except("f", F.array(F.lit("PASS")))
    return out.withColumn("filter", F.when(F.size(left) > 0, F.array_join(left, ";")).otherwise("PASS")).drop("f")


def merge_samples(sites: DataFrame, gts: list[DataFrame], missing_to_ref: bool = False) -> DataFrame:
    """Genotypes of several inputs over all ``sites``: absent ones are missing, or REF."""
    rows = reduce(DataFrame.unionByName, [g.select("site_id", "sample", "alleles", F.lit(i).alias("input")) for i, g in enumerate(gts)])
    samples = rows.select("input", "sample").distinct()
    ploidy = rows.groupBy("input", "sample").agg(F.max(F.size("alleles")).alias("ploidy"))
    grid = sites.select("site_id").join(F.broadcast(samples.join(ploidy, ["input", "sample"])) if samples.count() <= 10_000 else samples.join(ploidy, ["input", "sample"]), how="cross")
    fill = F.transform(F.sequence(F.lit(1), F.col("ploidy")), lambda _: F.lit(0 if missing_to_ref else None).cast("int"))
    return grid.join(rows, ["site_id", "input", "sample"], "left").select("site_id", "input", "sample", F.coalesce("alleles", fill).alias("alleles"))


def merged_ref(refs: Column) -> Column:
    """The longest REF if all others are its beginnings, else null."""
    longest = F.array_max(F.transform(refs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]
    return F.when(F.forall(refs, lambda r: F.startswith(longest, r)), longest)


def merge_alleles(inputs: list[DataFrame]) -> DataFrame:
    """Sites of all inputs at one position with compatible REFs as one: longest REF, other ALTs padded, ALTs in first-seen order.

    Symbolic ALTs and ``*`` aren't padded. ``maps`` gives for each input the new index of each of its alleles. Incompatible REFs stay apart.
    """
    rows = reduce(DataFrame.unionByName, [d.select("chrom", "pos", "ref", "alts", F.lit(i).alias("input"), "site_id") for i, d in enumerate(inputs)])
    at = rows.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("input", "site_id", "ref", "alts"))).alias("rs"))
    ref = merged_ref(F.transform("rs", lambda r: r["ref"]))
    one = at.withColumn("ref", ref).where("ref is not null")
    apart = at.withColumn("ref", ref).where("ref is null").select("chrom", "pos", F.explode("rs").alias("r")).select("chrom", "pos", F.array("r").alias("rs"), F.col("r")["ref"].alias("ref"))
    both = one.select("chrom", "pos", "rs", "ref").union(apart)
    pad = lambda r, a: F.when(a.startswith("<") | (a == "*"), a).otherwise(F.concat(a, F.substring(F.col("ref"), F.length(r) + 1, F.length("ref"))))
    both = both.withColumn("_p", F.transform("rs", lambda x: F.transform(x["alts"], lambda a: pad(x["ref"], a))))
    both = both.withColumn("alts", F.array_distinct(F.flatten("_p")))
    maps = F.transform("_p", lambda p: F.concat(F.array(F.lit(0)), F.transform(p, lambda a: F.array_position("alts", a).cast("int"))))
    return both.select("chrom", "pos", "ref", "alts", F.arrays_zip(F.transform("rs", lambda r: r["input"]).alias("input"), F.transform("rs", lambda r: r["site_id"]).alias("site_id"), maps.alias("map")).alias("maps"))


def pairwise(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset comparison: records in both, left only, right only, by exact alleles."""
    key = ["chrom", "pos", "what"]
    n = lambda d, c: d.select(*collapse_key()).groupBy(*key).agg(F.count("*").alias(c))
    d = n(left, "l").join(n(right, "r"), key, "full").na.fill(0, ["l", "r"])
    return d.agg(F.sum(F.least("l", "r")).alias("both"), F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("left_only"), F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("right_only"))


def isec_gt(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genotypes of ``a``, missing where ``b`` has another for the same site and sample; as they are where it has none."""
    other = b.select("site_id", "sample", F.col("alleles").alias("_b"))
    d = a.join(other, ["site_id", "sample"], "left")
    same = F.col("_b").isNull() | (F.array_sort("alleles") == F.array_sort("_b"))
    return d.withColumn("alleles", F.when(same, F.col("alleles")).otherwise(F.transform("alleles", lambda _: F.lit(None).cast("int")))).drop("_b")


def trio_rows(gt: DataFrame, trios: list[tuple[str, str, str]]) -> DataFrame:
    """(site_id, trio, child, father, mother): genotypes by role, by one pivot over (site, trio)."""
    roles = gt.sparkSession.createDataFrame([(s, i, r) for i, t in enumerate(trios) for s, r in zip(t, ("child", "father", "mother"), strict=True)], "sample string, trio int, role string")
    d = gt.join(F.broadcast(roles), "sample")  # as large as the pedigree given
    pick = lambda r: F.first(F.when(F.col("role") == r, F.col("alleles")), ignorenulls=True).alias(r)
    out = d.groupBy("site_id", "trio").agg(pick("child"), pick("father"), pick("mother"))
    return out.where("child is not null and father is not null and mother is not null")


def mendel(trios: DataFrame) -> DataFrame:
    """Adds ``state``: ``miss`` if any allele is missing, ``err`` if no allele of each parent explains the child, else ``good`` or ``good_alt``."""
    c, f, m = F.col("child"), F.col("father"), F.col("mother")
    x, y = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    has = lambda p, v: F.exists(p, lambda z: z == v)
    dip = (has(f, x) & has(m, y)) | (has(f, y) & has(m, x))
    ok = F.when(F.size(c) == 1, has(m, x)).otherwise(dip)
    miss = G.any_missing(c) | G.any_missing(f) | G.any_missing(m)
    alt = G.is_class(c, "alt") | G.is_class(f, "alt") | G.is_class(m, "alt")
    return trios.withColumn("state", F.when(miss, "miss").when(~ok, "err").when(alt, "good_alt").otherwise("good"))


def mendel_counts(trios: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return mendel(trios).groupBy("trio").agg(n("good"), n("good_alt"), n("err"), n("miss"))


def trio_stats(trios: DataFrame, sites: DataFrame) -> DataFrame:
    """By trio: called sites, non-REF ones, Mendelian errors, novel child alleles, ts and tv of called non-REF SNPs."""
    alt = F.get("alts", F.lit(0))
    d = mendel(trios).join(sites.select("site_id", V.transition(F.col("ref"), alt).alias("ts"), V.transversion(F.col("ref"), alt).alias("tv")), "site_id")
    ok, nonref = F.col("state") != "miss", F.col("state").isin("good_alt", "err") & (G.is_class(F.col("child"), "alt") | G.is_class(F.col("father"), "alt") | G.is_class(F.col("mother"), "alt"))
    novel = F.exists("child", lambda a: (a > 0) & ~F.array_contains("father", a) & ~F.array_contains("mother", a))
    return d.groupBy("trio").agg(
        F.count_if(ok).alias("n_pass"), F.count_if(nonref).alias("nonref"), F.count_if(F.col("state") == "err").alias("errors"), F.count_if(ok & F.coalesce(novel, F.lit(False))).alias("novel"),
        F.count_if(nonref & F.col("ts")).alias("ts"), F.count_if(nonref & F.col("tv")).alias("tv"),
    )


def de_novo_naive(trios: DataFrame) -> DataFrame:
    """Trios' sites whose diploid child genotype no allele from each parent explains."""
    return mendel(trios).where((F.col("state") == "err") & (F.size("child") == 2))


def switch_rate(trios: DataFrame, sites: DataFrame, phased: DataFrame) -> DataFrame:
    """By trio: informative phased heterozygous child sites, and switches against the previous one of the contig."""
    from siteloom.operators.windows import running

    c = F.col("child")
    x, y = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    fx, fy = F.array_contains("father", x) & F.array_contains("mother", y), F.array_contains("father", y) & F.array_contains("mother", x)
    d = trios.join(phased, "site_id").where((F.size(c) == 2) & (x != y)).withColumn("phase", F.when(fx & ~fy, 1).when(fy & ~fx, 0)).where("phase is not null")
    d = d.join(sites.select("site_id", "chrom", "pos"), "site_id")
    d = running(d, "was", F.col("phase"), "last", ("trio", "chrom"), inclusive=False)
    return d.groupBy("trio").agg(F.count("*").alias("informative"), F.count_if(F.col("phase") != F.col("was")).alias("switches"))


def pair_bias(gt: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(site_id, pair, p): Fisher's P that two samples' reads of REF and ALT have one ratio."""
    who = gt.sparkSession.createDataFrame([(s, i, r) for i, p in enumerate(pairs) for s, r in zip(p, ("a", "b"), strict=True)], "sample string, pair int, role string")
    d = gt.join(F.broadcast(who), "sample")  # as large as the list given
    n = lambda r, i: F.sum(F.when(F.col("role") == r, F.get("ad", F.lit(i)))).alias(f"{r}{i}")
    t = d.groupBy("site_id", "pair").agg(n("a", 0), n("a", 1), n("b", 0), n("b", 1)).dropna()
    return t.select("site_id", "pair", prob.fisher_two_sided(*(F.col(c) for c in ("a0", "a1", "b0", "b1"))).alias("p"))


def split_at_breaks(blocks: DataFrame) -> DataFrame:
    """Blocks (input, chrom, pos, end) of several inputs, cut at each other's starts and ends: (chrom, start, end, inputs)."""
    from siteloom.operators.windows import following, running

    ends = blocks.select("chrom", F.explode(F.array(F.col("pos"), F.col("end") + 1)).alias("pos")).distinct().withColumn("site_id", F.lit(0))
    d = F.when(F.col("s") == 1, 1).otherwise(-1)
    moves = blocks.select("chrom", F.explode(F.array(F.struct(F.col("pos").alias("pos"), F.lit(1).alias("s")), F.struct((F.col("end") + 1).alias("pos"), F.lit(0).alias("s")))).alias("m")).select("chrom", "m.pos", "m.s")
    net = moves.groupBy("chrom", "pos").agg(F.sum(d).alias("d")).withColumn("site_id", F.lit(0))
    depth = running(net, "depth", F.col("d"), "sum", order=("pos",)).select("chrom", "pos", "depth")
    d = following(ends.drop("site_id"), "_next").join(depth, ["chrom", "pos"])
    return d.select("chrom", F.col("pos").alias("start"), (F.col("_next") - 1).alias("end"), "depth").where("depth > 0")


def ld_r2(gt: DataFrame, sites: DataFrame, window: int) -> DataFrame:
    """(a, b, r2) of sites of a contig at most ``window`` bases apart, from called ALT copies of shared samples.

    A site carries its calls as bits by ``sample_id`` (from 1), 64 to a word: who is called, and the binary digits of their copies. Sums over the samples of a pair
    are counts of common bits, so a pair is made in the join and goes to no further shuffle.
    """
    copies = F.size(F.filter("alleles", lambda x: x > 0))
    calls = gt.where(~G.any_missing(F.col("alleles"))).select("site_id", (F.col("sample_id") - 1).alias("_at"), copies.alias("_x"))
    most = calls.agg(F.max("_at").alias("at"), F.max("_x").alias("x")).first()
    words, digits = (most["at"] or 0) // 64 + 1, max(1, int(most["x"] or 0).bit_length())
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % 64).cast("int"))
    mask = lambda w, hit: F.coalesce(F.bit_or(F.when((F.floor(F.col("_at") / 64) == w) & hit, bit)), F.lit(0).cast("long"))
    digit = lambda j: F.call_function("shiftright", F.col("_x"), F.lit(j)).bitwiseAND(1) == 1
    names = ["c", *(f"d{j}" for j in range(digits))]
    per = calls.groupBy("site_id").agg(*(F.array(*(mask(w, F.lit(True) if k == "c" else digit(int(k[1:]))) for w in range(words))).alias(k) for k in names))
    # a pair meets in the first one's bin of the window's length; the second is in that bin or the next
    at = F.floor(F.col("pos") / window)
    called = sites.select("site_id", "chrom", "pos").join(per, "site_id")
    mine = called.select(F.col("site_id").alias("a"), "chrom", at.alias("_bin"), F.col("pos").alias("pa"), *(F.col(k).alias(f"a{k}") for k in names))
    theirs = called.select(F.col("site_id").alias("b"), "chrom", F.explode(F.array(at, at - 1)).alias("_bin"), F.col("pos").alias("pb"), *(F.col(k).alias(f"b{k}") for k in names))
    pairs = mine.join(theirs, ["chrom", "_bin"]).where("(pb > pa or (pb = pa and b > a)) and pb - pa <= %d" % window)

    def common(*columns: str) -> Column:
        both = lambda w: reduce(Column.bitwiseAND, [F.get(c, F.lit(w)) for c in columns])
        return reduce(Column.__add__, [F.bit_count(both(w)).cast("long") for w in range(words)])

    each = range(digits)
    total = lambda terms: reduce(Column.__add__, [t * (1 << k) for k, t in terms])
    m = pairs.select(
        "a", "b", common("ac", "bc").alias("n"), total([(j, common(f"ad{j}", "bc")) for j in each]).alias("sx"), total([(j, common(f"bd{j}", "ac")) for j in each]).alias("sy"),
        total([(j + k, common(f"ad{j}", f"ad{k}", "bc")) for j in each for k in each]).alias("sxx"), total([(j + k, common(f"bd{j}", f"bd{k}", "ac")) for j in each for k in each]).alias("syy"),
        total([(j + k, common(f"ad{j}", f"bd{k}")) for j in each for k in each]).alias("sxy"),
    )
    c = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    vx, vy = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    return m.where((vx > 0) & (vy > 0)).select("a", "b", ((c * c) / (vx * vy)).alias("r2"))


def overlap_min_qual(sites: DataFrame) -> DataFrame:
    """Sites left after the lowest QUAL of overlapping ones is taken out, again and again (of equal ones the later).

    When a site's turn comes, all that rank above it are still there. So it goes if any of them overlaps it, and what else goes doesn't matter: an interval join.
    """
    from siteloom.operators.intervals import overlaps

    rank = F.struct(F.coalesce("qual", F.lit(0.0)).alias("q"), (-F.col("pos")).alias("p"), (-F.col("site_id")).alias("s"))
    # sites of one span count once, by the highest of them
    ranked = sites.withColumn("_sl_to", V.end(F.col("pos"), F.col("ref"), F.lit(None))).withColumn("_sl_rank", rank)
    spans = ranked.groupBy("chrom", "pos", "_sl_to").agg(F.max("_sl_rank").alias("_sl_best"))
    other = spans.select("chrom", F.col("pos").alias("_sl_from"), F.col("_sl_to").alias("_sl_until"), F.col("_sl_best").alias("_sl_other"))
    met = overlaps(spans.select("chrom", "pos", "_sl_to"), other, F.col("pos"), F.col("_sl_to"), "_sl_from", "_sl_until")
    top = met.groupBy("chrom", "pos", "_sl_to").agg(F.max("_sl_other").alias("_sl_other"))
    out = ranked.join(top, ["chrom", "pos", "_sl_to"], "left")
    return out.where("_sl_other is null or _sl_rank >= _sl_other").select(*sites.columns)


def concat(inputs: list[DataFrame], drop: str | None = None) -> DataFrame:
    """Inputs one after another; with ``drop`` (exact, all, snps, indels, both) the first of sites equal by that mode stays."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("input", F.lit(i)) for i, d in enumerate(inputs)])
    if drop is None:
        return rows
    key = collapse_key({"exact": "none", "all": "any"}.get(drop, drop))
    w = Window.partitionBy(*key).orderBy("input", "site_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overlapping_inputs(inputs: list[DataFrame]) -> DataFrame:
    """(chrom, first, second): neighbouring inputs in the order given whose positions on a contig overlap, so that one after another they aren't sorted."""
    rows = reduce(DataFrame.union, [d.select("chrom", "pos", F.lit(i).alias("input")) for i, d in enumerate(inputs)])
    spans = rows.groupBy("chrom", "input").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))  # a row for each contig and input
    w = Window.partitionBy("chrom").orderBy("input")
    met = spans.withColumn("second", F.lead("input").over(w)).withColumn("next", F.lead("lo").over(w))
    return met.where("next <= hi").select("chrom", F.col("input").alias("first"), "second")


def sort_sites(sites: DataFrame, names: bool = False) -> DataFrame:
    """Contig order (or by name, with ``names``), position, REF and ALT without case, input order."""
    return sites.orderBy("chrom" if names else "contig_rank", "pos", F.lower("ref"), F.lower(F.array_join("alts", ",")), "site_id")


def numbered(ordered: DataFrame, path: str) -> DataFrame:
    """Adds ``nth``, from 1, to a frame that was sorted as a whole: its partitions are written to ``path`` once, and what came before each is summed over partitions."""
    ordered.withColumn("_sl_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = ordered.sparkSession.read.parquet(path).withColumn("_sl_part", F.call_function("shiftright", F.col("_sl_at"), F.lit(33)))
    n = rows.groupBy("_sl_part").agg(F.count("*").alias("_sl_n"))
    before = F.coalesce(F.sum("_sl_n").over(Window.orderBy("_sl_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition
    out = rows.join(F.broadcast(n.select("_sl_part", before.alias("_sl_before"))), "_sl_part")
    return out.withColumn("nth", F.col("_sl_before") + F.col("_sl_at").bitwiseAND((1 << 33) - 1) + 1).drop("_sl_part", "_sl_before", "_sl_at")


def top_local_alleles(probabilities: DataFrame, k: int) -> DataFrame:
    """The ``k`` likeliest ALTs (site_id, sample, allele, p) of each sample; the lower index of equal ones."""
    w = Window.partitionBy("site_id", "sample").orderBy(F.desc("p"), "allele")
    return probabilities.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
