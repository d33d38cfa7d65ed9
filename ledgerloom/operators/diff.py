"""Diffs of two sentence sequences: blocks of context, collapsed, removed and added sentences, and what they amount to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.shared import scratch, stage

KEEP, TOP, SHOWN = 3, 5, 600


def _runs(lines: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Longest runs of equal lines of each pair: keys, i and j where a run begins, its length n."""
    side = lambda name, at: lines[name].select(*keys, F.col("_at").alias(at), "_line")
    equal = side("previous", "i").join(side("latest", "j"), [*keys, "_line"]).select(*keys, "i", "j")
    # equal lines on one diagonal that follow one another are a run
    within = Window.partitionBy(*keys, F.col("j") - F.col("i")).orderBy("i")
    equal = equal.withColumn("_d", F.col("j") - F.col("i")).withColumn("_run", F.col("i") - F.row_number().over(within))
    return equal.groupBy(*keys, "_d", "_run").agg(F.min("i").alias("i"), F.min("j").alias("j"), F.count("*").cast("int").alias("n")).drop("_d", "_run")


def matched(lines: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Runs of equal lines that a pair keeps: keys, i, j, n.

    The longest run of a box is taken, of equally long ones that with the least i, then j; it leaves
    a box before it and one after it, to which other runs are cut, and so on. A round takes one run
    of each box at once. Before that boxes are parted wherever all runs on one side end before all
    on the other begin, so a run that no other crosses takes no round of its own, and pairs need as
    many rounds as their runs are entangled, not as they have runs.
    """
    box = [*keys, "_a", "_b"]
    cut, taken = scratch(lines["latest"].sparkSession, "diff"), []
    zero = F.lit(0).cast("int")
    left = cut(_parted(_runs(lines, keys).withColumns({"_a": zero, "_b": zero}), box))
    while not left.isEmpty():
        best = left.groupBy(box).agg(F.max_by(F.struct("i", "j", "n"), F.struct("n", -F.col("i"), -F.col("j"))).alias("best"))
        best = cut(best.select(*box, "best.*"), keep=True)
        taken.append(best.select(*keys, "i", "j", "n"))
        rest = left.join(best.select(*box, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("n").alias("_n")), box)
        before = F.least("n", F.col("_i") - F.col("i"), F.col("_j") - F.col("j"))
        skip = F.greatest(zero, F.col("_i") + F.col("_n") - F.col("i"), F.col("_j") + F.col("_n") - F.col("j"))
        parts = F.array(
            F.struct("_a", "_b", "i", "j", before.alias("n")),
            F.struct((F.col("_i") + F.col("_n")).alias("_a"), (F.col("_j") + F.col("_n")).alias("_b"), (F.col("i") + skip).alias("i"), (F.col("j") + skip).alias("j"), (F.col("n") - skip).alias("n")),
        )
        rest = rest.select(*keys, F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias("p")).select(*keys, "p.*")
        left = cut(_parted(rest, box))
    none = left.select(*keys, "i", "j", "n").where("false")
    return reduce(DataFrame.union, taken, none)


def _parted(runs: DataFrame, box: list[str]) -> DataFrame:
    """Runs with boxes parted where no run crosses; a box is named by its first run's beginning."""
    order = [F.col("i"), F.col("j")]
    before = Window.partitionBy(box).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(box).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = (F.max(F.col("i") + F.col("n")).over(before) <= F.col("i")) & (F.max(F.col("j") + F.col("n")).over(before) <= F.min("j").over(after))
    runs = runs.withColumn("_cut", F.coalesce(whole, F.lit(True)).cast("int"))
    upto = Window.partitionBy(box).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.last(F.when(F.col("_cut") == 1, F.struct("i", "j")), True).over(upto)
    runs = runs.withColumn("_start", start)
    return runs.drop("_a", "_b", "_cut").withColumns({"_a": F.col("_start.i"), "_b": F.col("_start.j")}).drop("_start")


def blocks(pairs: DataFrame, *keys: str) -> DataFrame:
    """Blocks of each row of pairs(keys, previous, latest): context, collapsed, removed and added lines in order, numbered from 0.

    keys name a pair; of rows with the same keys one stays, and null keys are left out. Between runs
    kept all removed lines come before all added ones; of an equal run of more than 2 * KEEP + 1
    lines only its ends are shown, with a row for what is collapsed. Null sequences are empty, and a
    pair without lines has no blocks. Null lines are equal to one another.

    Lines' hashes of 128 bits are rows and joined; work grows with the equal lines of pairs: a line
    that both have often counts as often as the product. Only a pair's runs go back to its lines,
    which stay in its row, so a task holds the lines of one pair.
    """
    names, keys = keys, [f"_k{n}" for n in range(len(keys))]
    pairs = pairs.select(*(F.col(name).alias(k) for name, k in zip(names, keys)), "previous", "latest").dropna(subset=keys)
    pairs = stage(pairs.withColumn("_row", F.monotonically_increasing_id()), "pairs")
    line = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), F.reverse("text"))).alias("_line")
    told = {side: pairs.select("_row", F.posexplode(side).alias("_at", "text")).select("_row", "_at", line) for side in ("previous", "latest")}
    runs = matched(told, ["_row"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("i", "j", "n"))).alias("_runs"))
    one = pairs.groupBy(*keys).agg(F.min("_row").alias("_row")).select("_row").join(runs, "_row", "left")
    rows = pairs.join(one, "_row").select(*(F.col(k).alias(name) for name, k in zip(names, keys)), F.posexplode(_shown()).alias("block_idx", "_block"))
    return rows.select(*names, "block_idx", "_block.*")


def _shown() -> Column:
    """The blocks of a row's previous and latest lines, given its runs in order: type, text and count."""
    kind = lambda name: lambda x: F.struct(F.lit(name).alias("type"), x.alias("text"), F.lit(None).cast("int").alias("count"))
    none = F.array().cast("array<string>")
    row = F.struct(F.coalesce("previous", none).alias("old"), F.coalesce("latest", none).alias("new"), F.coalesce("_runs", F.array().cast("array<struct<i:int,j:int,n:int>>")).alias("runs"))

    def between(v: Column) -> Column:
        old, new, runs = v["old"], v["new"], v["runs"]
        end = F.struct(F.size(old).alias("i"), F.size(new).alias("j"), F.lit(0).alias("n"))

        def part(r: Column, k: Column) -> Column:
            """Lines between the run before and a run, and what is shown of that run."""
            a, b = (F.coalesce(F.get(runs, k - 1)[at] + F.get(runs, k - 1)["n"], F.lit(0)) for at in "ij")
            same = lambda start, n: F.transform(F.slice(new, start + 1, n), kind("context"))
            hidden = F.struct(F.lit("collapsed").alias("type"), F.lit(None).cast("string").alias("text"), (r["n"] - 2 * KEEP).alias("count"))
            ends = F.concat(same(r["j"], F.lit(KEEP)), F.array(hidden), same(r["j"] + r["n"] - KEEP, F.lit(KEEP)))
            return F.concat(
                F.transform(F.slice(old, a + 1, r["i"] - a), kind("removed")), F.transform(F.slice(new, b + 1, r["j"] - b), kind("added")),
                F.when(r["n"] > 2 * KEEP + 1, ends).otherwise(same(r["j"], r["n"])),
            )

        return F.flatten(F.transform(F.concat(runs, F.array(end)), part))

    return text.let(row, between)


def adjacent(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, latest and previous for each row and the one before it in its group.

    Rows are ordered over all groups by ranges, so that a group of any size is spread over tasks;
    the last row of each range is carried to the next range. Rows without a predecessor have none.
    """
    dealt = rows.select(group, order).repartitionByRange(group, order).withColumn("_p", F.spark_partition_id())
    within = Window.partitionBy("_p").orderBy(group, order)
    own = F.struct(group, order)
    near = dealt.withColumn("_before", F.lag(own).over(within))
    # one row a range: the last row of all ranges before
    last = dealt.groupBy("_p").agg(F.max(own).alias("_last"))
    last = last.select("_p", F.max("_last").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    near = near.join(F.broadcast(last), "_p").withColumn("_before", F.coalesce("_before", "_carried"))
    return near.where(F.col("_before")[group] == F.col(group)).select(group, F.col(order).alias("latest"), F.col("_before")[order].alias("previous"))


def with_severity(found: DataFrame) -> DataFrame:
    """Blocks with the severity of those that changed."""
    return found.withColumn("severity", F.when(F.col("type").isin("added", "removed"), text.severity(F.col("text"))))


def stats(found: DataFrame, *keys: str) -> DataFrame:
    """keys, added, removed and unchanged sentences (shown ones alone), total changes and the overall severity of blocks."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    return found.groupBy(*keys).agg(
        n("added").alias("added_sentences"), n("removed").alias("removed_sentences"), n("context").alias("unchanged_sentences"),
        (n("added") + n("removed")).alias("total_changes"), text.overall(F.col("severity")).alias("severity_score"),
    )


def top_changes(found: DataFrame, *keys: str, most: int = TOP) -> DataFrame:
    """The gravest changed blocks of each pair, earlier ones first among equals: keys, rank, severity, type, text, why."""
    changed = found.where("severity IS NOT NULL")
    place = Window.partitionBy(*keys).orderBy(text.severity_rank(F.col("severity")), "block_idx")
    ranked = changed.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)
    return ranked.select(*keys, "rank", "severity", "type", F.substring("text", 1, SHOWN).alias("text"), text.reason(F.col("text"), F.col("type")).alias("why"))


def payload(pairs: DataFrame, filings: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row a pair of accessions (latest, previous): both filings, severity, stats, top changes and all blocks.

    filings(accession, cik, ticker, company_name, form_type, filing_date, fiscal_year);
    sentences(accession, seq, text), blank ones left out. A pair with an unknown filing has no row; a
    filing without sentences is empty.
    """
    said = sentences.select("accession", "seq", F.trim("text").alias("text")).where("text <> ''")
    lists = said.groupBy("accession").agg(F.array_sort(F.collect_list(F.struct("seq", "text")))["text"].alias("said"))
    none = F.array().cast("array<string>")
    known = pairs.select("latest", "previous").distinct()
    for side in ("latest", "previous"):
        f = filings.select(F.col("accession").alias(side), F.struct(*filings.columns).alias(f"{side}_filing"))
        known = known.join(f, side).join(lists.withColumnsRenamed({"accession": side, "said": f"_{side}"}), side, "left")
    keyed = known.select("latest", "previous", F.coalesce("_previous", none).alias("b"), F.coalesce("_latest", none).alias("a"))
    keyed = keyed.select(F.col("latest").alias("l"), F.col("previous").alias("p"), F.col("b").alias("previous"), F.col("a").alias("latest"))
    found = stage(with_severity(blocks(keyed, "l", "p")), "blocks")
    top = top_changes(found, "l", "p").groupBy("l", "p").agg(F.array_sort(F.collect_list(F.struct("rank", "severity", "type", "text", "why"))).alias("top_changes"))
    every = found.groupBy("l", "p").agg(F.array_sort(F.collect_list(F.struct("block_idx", "type", "text", "count", "severity"))).alias("diff_blocks"))
    out = known.select(F.col("latest").alias("l"), F.col("previous").alias("p"), "latest_filing", "previous_filing")
    for part in (stats(found, "l", "p"), top, every):
        out = out.join(part, ["l", "p"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    counts = [zero(c) for c in ("added_sentences", "removed_sentences", "unchanged_sentences", "total_changes")]
    return out.select(
        F.concat_ws("|", "l", "p").alias("id"), F.col("l").alias("latest"), F.col("p").alias("previous"),
        F.struct(F.col("latest_filing.cik"), F.col("latest_filing.ticker"), F.col("latest_filing.company_name").alias("name")).alias("company"),
        "latest_filing", "previous_filing", F.lit("risk_factors").alias("section"), F.coalesce("severity_score", F.lit("NONE")).alias("severity_score"),
        F.struct(*counts).alias("stats"), "top_changes", "diff_blocks",
    )
