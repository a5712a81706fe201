"""Reads against transcripts: candidates, events, assignment types, penalties and classes.

Everything is column expressions and windows. Differing introns of a read and an isoform are gathered into clusters of
overlapping introns by a fold; each cluster is described once by a struct of features, and named by the first row of a
table of conditions over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import intervals as I
from ..params import MATCHING, Matching
from . import profiles as Q

# Cost of each event in the penalty of a match; events that are not listed cost nothing.
EVENT_COST = {
    "intron_shift": 0.1, "exon_misalignment": 0.1, "terminal_exon_misalignment_right": 0.1, "terminal_exon_misalignment_left": 0.1,
    "fake_terminal_exon_left": 0.2, "fake_terminal_exon_right": 0.2, "exon_elongation_left": 0.1, "exon_elongation_right": 0.1,
    "intron_retention": 0.6, "unspliced_intron_retention": 0.6, "incomplete_intron_retention_left": 0.7, "incomplete_intron_retention_right": 0.7,
    "fake_micro_intron_retention": 0.1, "alt_left_site_known": 1.0, "alt_right_site_known": 1.0, "alt_left_site_novel": 1.0, "alt_right_site_novel": 1.0,
    "extra_intron_novel": 1.0, "extra_intron_known": 1.0, "extra_intron_flanking_left": 1.0, "extra_intron_flanking_right": 1.0,
    "major_exon_elongation_left": 0.6, "major_exon_elongation_right": 0.6, "intron_migration": 1.0, "intron_alternation_novel": 1.0, "intron_alternation_known": 1.0,
    "mutually_exclusive_exons_novel": 0.8, "mutually_exclusive_exons_known": 0.8, "exon_skipping_known": 1.0, "exon_skipping_novel": 1.0,
    "exon_merge_known": 0.75, "exon_merge_novel": 0.75, "exon_gain_known": 1.0, "exon_gain_novel": 1.0, "exon_detach_known": 0.75, "exon_detach_novel": 0.75,
    "terminal_exon_shift_known": 0.5, "terminal_exon_shift_novel": 0.5, "alternative_structure_novel": 1.0, "alternative_structure_known": 1.0,
    "alternative_polya_site_left": 0.6, "alternative_polya_site_right": 0.6, "internal_polya_left": 0.5, "internal_polya_right": 0.5,
    "alternative_tss_left": 0.6, "alternative_tss_right": 0.6,
}
# Events that agree with the isoform, small errors, and events without a part in introns.
CONSISTENT = ["none", "mono_exonic", "mono_exon_match", "fsm", "ism_left", "ism_right", "ism_internal", "correct_polya_site_left", "correct_polya_site_right", "terminal_site_match_left", "terminal_site_match_right", "terminal_site_match_left_precise", "terminal_site_match_right_precise"]
MINOR = ["exon_elongation_left", "exon_elongation_right", "intron_shift", "exon_misalignment", "fake_micro_intron_retention", "fake_terminal_exon_left", "fake_terminal_exon_right", "terminal_exon_misalignment_left", "terminal_exon_misalignment_right"]
TERMINAL = ["alternative_polya_site_left", "alternative_polya_site_right", "alternative_tss_left", "alternative_tss_right", "internal_polya_left", "internal_polya_right", "major_exon_elongation_left", "major_exon_elongation_right"]
NOVEL_SITE = ["extra_intron_flanking_left", "extra_intron_flanking_right", *(k for k in EVENT_COST if k.endswith("_novel"))]
MAJOR = [k for k in EVENT_COST if k not in MINOR]
INTRONIC = [k for k in MAJOR if k not in TERMINAL]

EVENT_TYPE = "array<struct<event:string,iso_lo:int,iso_hi:int,read_lo:int,read_hi:int,info:bigint>>"
ABSENT = -1


def candidates(reads: DataFrame, transcripts: DataFrame, p: Matching = MATCHING["default"], key: str = "aln_id") -> DataFrame:
    """Reads (key, gene block, blocks, introns, span) with the isoforms of their genes that come close: coverage score of at
    least -0.5, and intron distance plus half a point for each overhang within 3 of the read's best."""
    rows = reads.join(transcripts, "gene_id")
    wide = I.iv(F.col("tx_span.s") - p.minor_exon_extension, F.col("tx_span.e") + p.minor_exon_extension)
    rows = rows.withColumn("coverage", I.coverage_fraction(F.col("blocks"), F.col("exons")) - I.outside_fraction(F.col("blocks"), wide)).where("coverage >= -0.5")
    rows = rows.withColumn("common", I.common_length(F.col("blocks"), F.col("exons"))).where("common > 0")
    near = lambda a, b: (F.abs(a["s"] - b["s"]) <= p.delta) & (F.abs(a["e"] - b["e"]) <= p.delta)
    inside = lambda x, span: (x["s"] >= span["s"]) & (x["e"] <= span["e"])
    extra = F.size(F.filter("introns", lambda x: ~F.exists("tx_introns", lambda y: near(x, y))))
    missing = F.size(F.filter("tx_introns", lambda y: inside(y, F.col("span")) & ~F.exists("introns", lambda x: near(x, y))))
    over = F.when(F.col("span.s") + p.delta < F.col("tx_span.s"), 0.5).otherwise(0.0) + F.when(F.col("span.e") - p.delta > F.col("tx_span.e"), 0.5).otherwise(0.0)
    rows = rows.withColumn("distance", extra + missing + over)
    return rows.withColumn("_best", F.min("distance").over(W.partitionBy(key))).where("distance <= _best + 3").drop("_best", "common")


def tie_break(matches: DataFrame, score: Column, key: str = "aln_id", factor: float = 1.5, least: float = -0.5) -> DataFrame:
    """Keeps, per read, matches that score at least `least` and, times `factor`, the best score."""
    rows = matches.withColumn("_s", score)
    return rows.withColumn("_top", F.max("_s").over(W.partitionBy(key))).where((F.col("_s") >= least) & (F.col("_s") * factor >= F.col("_top"))).drop("_s", "_top")


# ---------------------------------------------------------------- events of one (read, isoform) pair, as columns


def _size(x: Column) -> Column:
    return x["e"] - x["s"] + 1


def _meets(a: Column, b: Column, least: Column | int = 1) -> Column:
    """Common part of at least `least` bases, or of the whole shorter one."""
    common = I.intersection_len(a, b)
    return (common >= 1) & ((common >= least) | (common == F.least(_size(a), _size(b))))


def _part(xs: Column, lo: Column, hi: Column) -> Column:
    """Items lo to hi, counted from 0."""
    return F.slice(xs, lo + 1, hi - lo + 1)


def _total(xs: Column) -> Column:
    return I.total_length(xs)


def difference_clusters(introns: Column, tx_introns: Column, delta: int) -> Column:
    """Introns without an equal in the other chain, in groups that overlap: structs of the first and last index on either side
    (null where a side has none). Introns of one chain are disjoint, so a group of one side is a single intron."""
    alone = lambda xs, ys, side: F.filter(F.transform(xs, lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(side).alias("side"), k.alias("k"), F.exists(ys, lambda y: I.equal_ranges(x, y, delta)).alias("hit"))), lambda x: ~x["hit"])
    rest = F.array_sort(F.concat(alone(introns, tx_introns, 0), alone(tx_introns, introns, 1)))
    kind = "array<struct<reach:bigint,r_lo:int,r_hi:int,i_lo:int,i_hi:int>>"
    mine = lambda x, side: F.when(x["side"] == side, x["k"])

    def one(x: Column) -> Column:
        return F.struct(x["e"].alias("reach"), mine(x, 0).alias("r_lo"), mine(x, 0).alias("r_hi"), mine(x, 1).alias("i_lo"), mine(x, 1).alias("i_hi"))

    def grown(last: Column, x: Column) -> Column:
        return F.struct(F.greatest(last["reach"], x["e"]).alias("reach"), F.coalesce(last["r_lo"], mine(x, 0)).alias("r_lo"), F.coalesce(mine(x, 0), last["r_hi"]).alias("r_hi"), F.coalesce(last["i_lo"], mine(x, 1)).alias("i_lo"), F.coalesce(mine(x, 1), last["i_hi"]).alias("i_hi"))

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        apart = F.coalesce(x["s"] > last["reach"], F.lit(True))
        return F.when(apart, F.concat(done, F.array(one(x)))).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown(last, x))))

    return F.aggregate(rest, F.array().cast(kind), step)


def _features(c: Column, p: Matching) -> Column:
    """What the rules ask of a cluster: how its introns lie to those of the other side, to the exons about them, and to known ones."""
    rx, ix, introns, theirs = (F.col(n) for n in ("_rx", "_ix", "introns", "tx_introns"))
    r, i = _part(introns, c["r_lo"], c["r_hi"]), _part(theirs, c["i_lo"], c["i_hi"])
    at = lambda xs, k: F.get(xs, k)
    first, last, i_first, i_last = at(introns, c["r_lo"]), at(introns, c["r_hi"]), at(theirs, c["i_lo"]), at(theirs, c["i_hi"])
    before, after, i_before, i_after = at(rx, c["r_lo"]), at(rx, c["r_hi"] + 1), at(ix, c["i_lo"]), at(ix, c["i_hi"] + 1)
    enough = lambda x: F.greatest(F.lit(1), F.least(F.lit(p.min_abs_exon_overlap), F.round(_size(x) * p.min_rel_exon_overlap).cast("int")))
    around = at(rx, F.size(F.filter(introns, lambda x: x["e"] < i_first["s"])))  # the read's exon where the isoform's intron begins
    inner = F.zip_with(F.slice(i, F.lit(1), F.size(i) - 1), F.slice(i, F.lit(2), F.size(i) - 1), lambda a, b: b["s"] - a["e"] + 1)
    parts = {
        "r_lo": c["r_lo"], "r_hi": c["r_hi"], "i_lo": c["i_lo"], "i_hi": c["i_hi"], "n_read": F.coalesce(F.size(r), F.lit(0)), "n_iso": F.coalesce(F.size(i), F.lit(0)),
        "read_len": _total(r), "iso_len": _total(i), "largest": F.array_max(F.transform(r, _size)), "exons_about": _total(_part(rx, c["r_lo"], c["r_hi"] + 1)),
        "known": F.forall(r, lambda x: F.exists("known", lambda k: I.equal_ranges(x, k, p.delta))), "framed": _meets(before, i_before) & _meets(after, i_after),
        "start_off": first["s"] - i_first["s"], "end_off": last["e"] - i_last["e"], "lost": F.aggregate(inner, F.lit(0).cast("bigint"), lambda a, x: a + x),
        "within": (i_first["s"] - p.delta <= first["s"]) & (last["e"] <= i_last["e"] + p.delta), "around_it": (first["s"] - p.delta <= i_first["s"]) & (i_last["e"] <= last["e"] + p.delta),
        "first_exon": _size(at(rx, F.lit(0))), "last_exon": _size(F.element_at(rx, -1)), "is_first": c["r_lo"] == 0, "is_last": c["r_hi"] == F.size(introns) - 1,
        "both_first": (c["r_lo"] == 0) & (c["i_lo"] == 0), "both_last": (c["r_hi"] == F.size(introns) - 1) & (c["i_hi"] == F.size(theirs) - 1),
        "before_off": F.abs(_size(before) - _size(i_before)), "after_off": F.abs(_size(after) - _size(i_after)), "left_exons": _meets(before, i_before, enough(i_before)), "right_exons": _meets(after, i_after, enough(i_after)),
        "spliced": F.size(introns) > 0, "iso_spliced": F.size(theirs) > 0, "covered": I.contains(F.col("span"), i_first), "micro": (_size(i_first) <= p.micro_intron_length) & I.contains_well_inside(around, i_first, p.minimal_exon_overlap),
        "reached": _meets(F.col("span"), i_first, p.minor_exon_extension), "swallowed": I.contains(i_first, F.col("span")), "starts_left": i_first["s"] <= F.col("span.s"),
        "in_isoform": _meets(F.col("tx_span"), first), "left_of_isoform": first["s"] < F.col("tx_span.s"),
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def _named(f: Column, p: Matching) -> Column:
    """The cluster's event: the first row of the table whose conditions all hold. Names with * end in known or novel."""
    off = F.abs(f["read_len"] - f["iso_len"])
    longer = F.greatest(f["read_len"], f["iso_len"])
    similar = (off <= p.max_intron_abs_diff) & (off <= longer * p.max_intron_rel_diff)
    left, right = F.abs(f["start_off"]) <= 2 * p.delta, F.abs(f["end_off"]) <= 2 * p.delta
    doubtful = (f["largest"] <= p.max_suspicious_intron_abs_len) & (f["read_len"] <= f["exons_about"] * p.max_suspicious_intron_rel_len)
    novel, known = ~f["known"], f["known"]
    lacking, adding, one = f["n_read"] == 0, f["n_iso"] == 0, (f["n_read"] == 1) & (f["n_iso"] == 1)
    swap = one & f["framed"]  # one intron for one, between the same exons
    start_same, end_same = F.abs(f["start_off"]) <= p.delta, F.abs(f["end_off"]) <= p.delta
    tip = one & ~f["framed"] & ~(f["is_first"] & f["is_last"]) & ((f["both_first"] & right) | (f["both_last"] & left))
    tip_off = F.when(f["both_first"], f["before_off"]).otherwise(f["after_off"])
    several = ~one & f["framed"] & ~lacking & ~adding
    fewer, more = several & (f["n_read"] == 1) & f["within"], several & (f["n_iso"] == 1) & (f["n_read"] > 1)
    short_left, short_right = f["is_first"] & (f["first_exon"] <= p.max_fake_terminal_exon_len), f["is_last"] & (f["last_exon"] <= p.max_fake_terminal_exon_len)
    beside = adding & f["iso_spliced"] & ~f["in_isoform"]
    table: list[tuple[str | None, Column]] = [
        ("fake_micro_intron_retention", lacking & f["covered"] & f["micro"]),
        ("intron_retention", lacking & f["covered"] & f["spliced"]),
        ("unspliced_intron_retention", lacking & f["covered"]),
        ("incomplete_intron_retention_left", lacking & f["reached"] & (f["spliced"] | ~f["swallowed"]) & f["starts_left"]),
        ("incomplete_intron_retention_right", lacking & f["reached"] & (f["spliced"] | ~f["swallowed"])),
        (None, lacking),
        ("fake_terminal_exon_left", beside & f["left_of_isoform"] & short_left),
        ("extra_intron_flanking_left", beside & f["left_of_isoform"]),
        ("fake_terminal_exon_right", beside & short_right),
        ("extra_intron_flanking_right", beside),
        ("extra_intron_known", adding & known),
        (None, adding & doubtful),
        ("fake_terminal_exon_left", adding & short_left),
        ("fake_terminal_exon_right", adding & short_right),
        ("extra_intron_novel", adding),
        ("intron_shift", swap & similar & (F.abs(f["start_off"]) <= p.max_intron_shift)),
        ("intron_migration", swap & similar & known),
        ("intron_retention", swap & novel & doubtful),
        ("intron_alternation_novel", swap & similar),
        ("alt_right_site_*", swap & start_same & f["right_exons"]),
        ("alt_left_site_*", swap & ~start_same & end_same & f["left_exons"]),
        ("intron_alternation_*", swap),
        ("terminal_exon_misalignment_left", tip & (tip_off < 2 * p.delta) & f["is_first"]),
        ("terminal_exon_misalignment_right", tip & (tip_off < 2 * p.delta)),
        ("terminal_exon_shift_*", tip),
        ("mutually_exclusive_exons_*", several & left & right & (f["n_read"] == f["n_iso"]) & (off <= 2 * p.delta)),
        ("exon_misalignment", fewer & similar & (f["lost"] <= p.max_missed_exon_len)),
        ("exon_merge_*", fewer & similar),
        ("exon_skipping_*", fewer & left & right),
        ("exon_gain_known", more & left & right & known),
        ("intron_retention", more & left & right & doubtful),
        ("exon_gain_novel", more & left & right),
        ("exon_detach_*", more & similar & f["around_it"]),
        ("alternative_structure_known", known),
        ("intron_retention", f["framed"] & doubtful),
        ("alternative_structure_novel", F.lit(True)),
    ]
    out = None
    for name, holds in table:
        said = F.lit(name) if name is None or "*" not in name else F.concat(F.lit(name[:-1]), F.when(known, "known").otherwise("novel"))
        holds = F.coalesce(holds, F.lit(False))
        out = F.when(holds, said) if out is None else out.when(holds, said)
    return out


def _event(name: Column, info: Column | int = 0, f: Column | None = None) -> Column:
    place = lambda k: F.coalesce(f[k], F.lit(ABSENT)).cast("int") if f is not None else F.lit(ABSENT)
    return F.struct(name.alias("event"), place("i_lo").alias("iso_lo"), place("i_hi").alias("iso_hi"), place("r_lo").alias("read_lo"), place("r_hi").alias("read_hi"), (info if isinstance(info, Column) else F.lit(info)).cast("bigint").alias("info"))


def _end_events(p: Matching) -> Column:
    """Ends of the read where its terminal exons meet the isoform's: a match within the minor limit, an elongation beyond delta."""
    found = []
    for side, own, other, edge in (
        ("left", F.get("_rx", F.lit(0)), F.get("_ix", F.lit(0)), F.col("tx_span.s") - F.col("span.s")),
        ("right", F.element_at("_rx", -1), F.element_at("_ix", -1), F.col("span.e") - F.col("tx_span.e")),
    ):
        met = _meets(own, other)
        match = F.when(F.abs(edge) <= p.delta, f"terminal_site_match_{side}_precise").when(F.abs(edge) <= p.minor_exon_extension, f"terminal_site_match_{side}")
        longer = F.when(edge > p.minor_exon_extension, f"major_exon_elongation_{side}").when(edge > p.delta, f"exon_elongation_{side}")
        found += [_event(F.when(met, match), edge), _event(F.when(met, longer), edge)]
    return F.array(*found)


def with_events(pairs: DataFrame, preset: str = "default") -> DataFrame:
    """Adds events to pairs with columns introns, span (read), tx_introns, tx_span and known (introns of the gene).

    Three steps over one array, each read by the next alone, so that nothing is computed twice: clusters, their features, their names."""
    p = MATCHING[preset]
    rows = pairs.withColumn("_rx", I.exons_from_junctions(F.col("span"), F.col("introns"))).withColumn("_ix", I.exons_from_junctions(F.col("tx_span"), F.col("tx_introns")))
    described = F.transform(difference_clusters(F.col("introns"), F.col("tx_introns"), p.delta), lambda c: _features(c, p))
    changes = F.filter(F.transform(described, lambda f: _event(_named(f, p), 0, f)), lambda e: e["event"].isNotNull())
    chain = I.region(F.col("tx_introns"))
    short_left, short_right = chain["s"] < F.col("span.s"), chain["e"] > F.col("span.e")
    whole = F.when(F.size("tx_introns") == 0, "mono_exon_match").when(F.size("introns") == 0, "mono_exonic")
    whole = whole.when(short_left & short_right, "ism_internal").when(short_left, "ism_left").when(short_right, "ism_right").otherwise("fsm")
    rows = rows.withColumn("_changes", changes)
    agreed = F.when(F.size("_changes") == 0, F.array(_event(whole))).otherwise(F.array().cast(EVENT_TYPE))
    events = F.filter(F.concat("_changes", agreed, _end_events(p)), lambda e: e["event"].isNotNull())
    return rows.withColumn("events", events).drop("_rx", "_ix", "_changes")


# ---------------------------------------------------------------- from events to assignments


def names(events: Column) -> Column:
    return F.transform(events, lambda e: e["event"])


def penalty(events: Column, p: Matching = MATCHING["default"]) -> Column:
    """Sum of event costs; an elongation costs 0.1 up to the minor limit, 0.6 from the major one, linearly between."""
    cost = F.create_map(*[F.lit(v) for k, c in EVENT_COST.items() for v in (k, c)])
    lo, hi = float(p.minor_exon_extension), float(p.major_exon_extension)
    linear = lambda n: F.when(n <= lo, 0.1).when(n >= hi, 0.6).otherwise(F.lit(0.1) + F.lit(0.5) * (n - lo) / (hi - lo))
    one = lambda e: F.when(e["event"].contains("exon_elongation"), linear(e["info"].cast("double"))).otherwise(F.coalesce(cost[e["event"]], F.lit(0.0)))
    return F.aggregate(F.transform(events, one), F.lit(0.0), lambda a, x: a + x)


def has_any(events: Column, kinds: list[str]) -> Column:
    return F.exists(events, lambda e: e["event"].isin(*kinds))


def verify_tails(pairs: DataFrame, preset: str = "default") -> DataFrame:
    """Events with what a read's tail says about the isoform's 3' end. pairs: events, strand (of the isoform), blocks (of the read),
    exons (of the isoform), tail and inner_tail (positions of the tail behind the last block, and within the aligned part; null if none).

    Everything is done on the + strand: on - coordinates are negated and lists reversed. A tail inside a partly retained intron is
    internal priming. Else the tail's place takes that of an elongation: correct within apa_delta, also where it comes short by
    fake terminal exons of the read or by a missed terminal exon of the isoform, and alternative otherwise."""
    p = MATCHING[preset]
    minus = F.col("strand") == "-"
    turn = lambda xs: F.when(minus, F.reverse(F.transform(xs, lambda x: I.iv(-x["e"], -x["s"])))).otherwise(F.transform(xs, lambda x: I.iv(x["s"], x["e"])))
    place = lambda c: F.when(minus, -F.col(c)).otherwise(F.col(c)).cast("bigint")
    side = lambda name: F.concat(F.lit(name + "_"), F.when(minus, "left").otherwise("right"))
    rows = pairs.withColumn("_b", turn(F.col("blocks"))).withColumn("_x", turn(F.col("exons"))).withColumn("_out", place("tail")).withColumn("_in", place("inner_tail"))
    end = F.element_at("_x", -1)["e"]
    is_event = lambda e, name: e["event"] == side(name)
    any_of = lambda name: F.exists("events", lambda e: is_event(e, name))
    primed = F.col("_in").isNotNull() & any_of("incomplete_intron_retention")
    fakes = F.size(F.filter("events", lambda e: is_event(e, "fake_terminal_exon")))
    # A tail that stands in fake exons comes before them: behind the last real exon, as many bases further as the fake exons have up to it.
    some_real = (fakes > 0) & (fakes < F.size("_b"))
    real, unreal = F.slice("_b", F.lit(1), F.size("_b") - fakes), F.slice("_b", F.size("_b") - fakes + 1, fakes)

    def moved(at: Column) -> Column:
        begun = F.filter(unreal, lambda x: x["s"] <= at)
        whole = F.slice(begun, F.lit(1), F.greatest(F.size(begun) - 1, F.lit(0)))
        return F.when(some_real, F.element_at(real, -1)["e"] + I.total_length(whole) + F.coalesce(at - F.try_element_at(begun, F.lit(-1))["s"], F.lit(0))).otherwise(at)

    rows = rows.withColumn("_end", end).withColumn("_primed", primed).withColumn("_aligned", any_of("terminal_exon_misalignment")).withColumn("_out2", F.when(F.col("_out").isNotNull(), moved(F.col("_out")))).withColumn("_in2", F.when(F.col("_in").isNotNull(), moved(F.col("_in"))))
    tail = F.coalesce("_in2", "_out2")
    missed = F.filter("_x", lambda x: x["s"] >= tail)
    rows = rows.withColumn("_missed", missed)
    lost, left = I.total_length(F.col("_missed")), F.get("_x", F.size("_x") - F.size("_missed") - 1)["e"]
    gap = F.least(F.abs(left - F.col("_out2")), F.abs(left - F.col("_in2")))
    short = ((lost <= p.max_fake_terminal_exon_len) & (gap <= p.max_fake_terminal_exon_len)) | ((lost <= p.max_missed_exon_len) & (F.abs(lost - gap) <= p.delta))
    unread = F.when(~F.col("_aligned") & (F.size("_missed") > 0) & (F.size("_missed") < F.size("_x")) & F.coalesce(short, F.lit(False)), F.size("_missed")).otherwise(0)

    def near(out: Column, inner: Column) -> Column:
        a, b = F.abs(F.col("_end") - out), F.abs(F.col("_end") - inner)
        return F.when((b <= p.apa_delta) & (a.isNull() | (b <= a)), inner).when((a <= p.apa_delta) & (b.isNull() | (b > a)), out)

    rows = rows.withColumn("_close", near(F.col("_out"), F.col("_in"))).withColumn("_unread", unread)
    settled = F.when(F.col("_aligned") | (F.col("_unread") > 0), F.col("_end")).otherwise(near(F.col("_out2"), F.col("_in2")))
    site = F.coalesce("_close", settled)
    last = F.coalesce("_in2", "_out2")
    back = lambda at: F.when(minus, -at).otherwise(at)
    said = F.when(site.isNotNull(), _event(side("correct_polya_site"), back(site))).otherwise(_event(F.when(F.abs(last - F.col("_end")) > p.apa_delta, side("alternative_polya_site")).otherwise(side("correct_polya_site")), back(last)))
    kept = F.filter("events", lambda e: ~(is_event(e, "exon_elongation") | is_event(e, "major_exon_elongation")))
    extra = F.when(F.col("_close").isNull() & (F.col("_unread") > 0), F.array_repeat(_event(side("terminal_exon_misalignment")), F.col("_unread"))).otherwise(F.array().cast(EVENT_TYPE))
    some = F.col("_out").isNotNull() | F.col("_in").isNotNull()
    events = F.when(F.col("_primed"), F.concat("events", F.array(_event(side("internal_polya"), back(F.col("_in")))))).when(some, F.concat(kept, extra, F.array(said))).otherwise(F.col("events"))
    return rows.withColumn("events", events).select(*pairs.columns)


# Events of a read that still matches its isoform.
MATCHING_EVENTS = ["none", "fsm", "exon_misalignment", "intron_shift", "terminal_site_match_left", "terminal_site_match_right", "terminal_site_match_left_precise", "terminal_site_match_right_precise", "correct_polya_site_left", "correct_polya_site_right", "exon_elongation_left", "exon_elongation_right"]


def is_matching(kind: Column, events: Column) -> Column:
    """A unique read, or one with minor differences that are all harmless."""
    return F.when(kind == "unique", True).when(kind == "unique_minor_difference", F.forall(events, lambda e: e["event"].isin(*MATCHING_EVENTS))).otherwise(False)


# Events that have another name on either side of a stranded isoform; others keep theirs.
SIDED = ["ism", "exon_elongation", "major_exon_elongation", "fake_terminal_exon", "terminal_exon_misalignment", "incomplete_intron_retention", "extra_intron_flanking", "alt_site", "terminal_site_match"]


def strand_name(event: Column, strand: Column) -> Column:
    """Printed name of an event: left and right become 5 and 3 by strand, the sites of an intron donor and acceptor, the ends of a
    transcript tss and tes. Without a strand the side is left out."""
    side = F.regexp_extract(event, "_(left|right)(_|$)", 1)
    stranded, five = strand.isin("+", "-"), (side == "left") == (strand == "+")
    base, rest = F.regexp_replace(event, "_(left|right)", ""), F.regexp_extract(event, "(_known|_novel|_precise)$", 1)
    kind = F.regexp_replace(base, "(_known|_novel|_precise)$", "")
    pick = lambda a, b, neither: F.when(~stranded, neither).when(five, a).otherwise(b)
    site = F.concat(pick(F.lit("alt_donor_site"), F.lit("alt_acceptor_site"), F.lit("alternative_splice_site")), rest)
    end = F.concat(pick(F.lit("tss_match"), F.lit("tes_match"), F.lit("terminal_position_match")), rest)
    plain = F.concat(F.regexp_replace(kind, "_flanking$", ""), pick(F.lit("_5"), F.lit("_3"), F.lit("")))
    return F.when((side == "") | ~kind.isin(*SIDED), event).when(kind == "alt_site", site).when(kind == "terminal_site_match", end).otherwise(plain)


def sqanti_class(events: Column) -> Column:
    """Full, incomplete or mono-exon match, novel in or not in catalog."""
    return (
        F.when(has_any(events, NOVEL_SITE), "novel_not_in_catalog").when(has_any(events, MAJOR), "novel_in_catalog").when(has_any(events, ["fsm"]), "full_splice_match")
        .when(has_any(events, ["ism_left", "ism_right", "ism_internal", "mono_exonic"]), "incomplete_splice_match").when(has_any(events, ["mono_exon_match"]), "mono_exon_match").otherwise("undefined")
    )


def _resolved(rows: DataFrame, key: str, method: str) -> DataFrame:
    """Of equally good isoforms without inconsistencies, those of most common bases, where the preset resolves such reads."""
    w = W.partitionBy(key)
    mono, full = F.size("introns") == 0, F.max(has_any(F.col("events"), ["fsm"])).over(w)
    wanted = {"none": F.lit(False), "monoexon_only": mono, "monoexon_and_fsm": mono | full, "all": F.lit(True)}[method]
    rows = rows.withColumn("_apply", wanted & ~F.max(has_any(F.col("events"), MAJOR)).over(w)).withColumn("_top", F.max("similarity").over(w))
    close = (F.col("similarity") >= -0.5) & (F.col("similarity") * 1.5 >= F.col("_top"))
    return rows.where(~F.col("_apply") | close).drop("_apply", "_top")


def assign(events: DataFrame, key: str = "aln_id", method: str = "none") -> DataFrame:
    """Per read, the isoforms of least penalty, the assignment type over all their events, and the gene's type. With a method, ties of
    consistent isoforms are broken by similarity (events: also introns and similarity)."""
    w = W.partitionBy(key)
    rows = events.withColumn("penalty", F.round(penalty(F.col("events")), 6)).withColumn("class", sqanti_class(F.col("events")))
    rows = rows.withColumn("_best", F.min("penalty").over(w)).where("penalty = _best").drop("_best")
    if method != "none":
        rows = _resolved(rows, key, method)
    rows = rows.withColumn("n_isoforms", F.count("*").over(w)).withColumn("n_genes", F.size(F.collect_set("gene_id").over(w)))
    flag = lambda kinds: F.max(has_any(F.col("events"), kinds)).over(w)
    rows = rows.withColumn("_major", flag(MAJOR)).withColumn("_intronic", flag(INTRONIC)).withColumn("_minor", flag(MINOR))

    def kind(several: Column) -> Column:
        wrong = F.when(several, "inconsistent_ambiguous").when(F.col("_intronic"), "inconsistent").otherwise("inconsistent_non_intronic")
        return F.when(F.col("_major"), wrong).when(several, "ambiguous").when(F.col("_minor"), "unique_minor_difference").otherwise("unique")

    return rows.withColumn("assignment_type", kind(F.col("n_isoforms") > 1)).withColumn("gene_assignment_type", kind(F.col("n_genes") > 1)).drop("_major", "_intronic", "_minor")


def gene_features(transcripts: DataFrame) -> DataFrame:
    """(gene_id, gene_introns, gene_split): what profiles of a gene's reads are over."""
    from .regions import split_exons

    exons = transcripts.select("gene_id", F.explode("exons").alias("x")).select("gene_id", "x.s", "x.e")
    split = split_exons(exons, ["gene_id"]).groupBy("gene_id").agg(F.array_sort(F.collect_list(I.iv("s", "e"))).alias("gene_split"))
    introns = transcripts.groupBy("gene_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("introns")))).alias("gene_introns"))
    return introns.join(split, "gene_id")


def profiled(reads: DataFrame, transcripts: DataFrame, preset: str = "default") -> DataFrame:
    """reads (gene_id, blocks, introns, span; tail columns polya and polyt if there are any) with their two profiles and their path."""
    p = MATCHING[preset]
    polya, polyt = (F.col(c) if c in reads.columns else None for c in ("polya", "polyt"))
    rows = reads.join(gene_features(transcripts), "gene_id")
    rows = rows.withColumn("intron_profile", Q.intron_profile(F.col("introns"), F.col("span"), F.col("gene_introns"), p, polya, polyt))
    rows = rows.withColumn("exon_profile", Q.exon_profile(F.col("blocks"), F.col("gene_split"), p, polya, polyt))
    meets = I.overlaps(F.col("span"), I.region(F.col("gene_split")))
    return rows.withColumn("path", Q.route(F.col("intron_profile"), F.col("exon_profile"), F.size("gene_split") > 0, meets))


def consistent_isoforms(reads: DataFrame, transcripts: DataFrame, preset: str = "default", key: str = "aln_id") -> DataFrame:
    """Reads of the consistent path with the isoforms that agree with their intron profile; if several do, with those that agree with
    their split-exon profile too, if any does; then, where the preset resolves such reads, with those of most common bases."""
    rows = profiled(reads, transcripts, preset).where("path = 'consistent'")
    tx = transcripts.select("gene_id", "tx_id", "exons", F.col("introns").alias("tx_introns"), F.col("span").alias("tx_span"))
    pairs = rows.join(tx, "gene_id").where(I.common_length(F.col("blocks"), F.col("exons")) > 0)
    fits = Q.agrees(Q.isoform_profile(F.col("tx_introns"), F.col("tx_span"), F.col("gene_introns")), F.col("intron_profile")["gene"])
    exact = Q.agrees(Q.split_profile(F.col("exons"), F.col("gene_split")), F.col("exon_profile")["gene"])
    w = W.partitionBy(key)
    pairs = pairs.where(fits).withColumn("_exact", exact).withColumn("_any", F.max("_exact").over(w)).where("_exact or not _any").withColumn("similarity", I.jaccard(F.col("blocks"), F.col("exons")))
    whole = (F.size("introns") > 0) & I.contains(F.col("span"), I.region(F.col("tx_introns")))
    method = MATCHING[preset].resolve_ambiguous
    wanted = {"none": F.lit(False), "monoexon_only": F.size("introns") == 0, "monoexon_and_fsm": (F.size("introns") == 0) | F.max(F.coalesce(whole, F.lit(False))).over(w), "all": F.lit(True)}[method]
    pairs = pairs.withColumn("_wanted", wanted).withColumn("_top", F.max("similarity").over(w)).where(~F.col("_wanted") | ((F.col("similarity") >= -0.5) & (F.col("similarity") * 1.5 >= F.col("_top"))))
    return pairs.withColumn("n_isoforms", F.count("*").over(w)).drop("_exact", "_any", "_wanted", "_top")


def classify(reads: DataFrame, transcripts: DataFrame, preset: str = "default", key: str = "aln_id") -> DataFrame:
    """The whole chain: candidates, events, tails, ties, assignment. reads: key, gene_id, blocks, introns, span (and tail, inner_tail: the
    site of the tail behind the last block, and one inside the aligned part); transcripts: tx_id, gene_id, exons, introns, span (and strand)."""
    strand = ["strand"] if "strand" in transcripts.columns else []
    tails = [c for c in ("tail", "inner_tail") if c in reads.columns]
    tx = transcripts.select("gene_id", "tx_id", *strand, "exons", F.col("introns").alias("tx_introns"), F.col("span").alias("tx_span"))
    known = transcripts.groupBy("gene_id").agg(F.array_distinct(F.flatten(F.collect_list("introns"))).alias("known"))
    pairs = candidates(reads.select(key, "gene_id", "blocks", "introns", "span", *tails), tx, MATCHING[preset], key).join(known, "gene_id")
    pairs = pairs.withColumn("similarity", I.jaccard(F.col("blocks"), F.col("exons")))
    found = with_events(pairs, preset)
    if strand and tails:
        for c in {"tail", "inner_tail"} - set(tails):
            found = found.withColumn(c, F.lit(None).cast("bigint"))
        found = verify_tails(found, preset)
    return assign(found.drop("exons", "blocks", "tail", "inner_tail"), key, MATCHING[preset].resolve_ambiguous)
