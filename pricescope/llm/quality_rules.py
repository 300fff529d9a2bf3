"""Quality rules whose cutoffs are certified on labelled documents. DataFrame operations only.

A rule rejects a document whose measure lies above its cutoff; a document goes if any rule rejects it. Labelled documents that
pass the base rules are split by a hash of their text, so that copies count once and on one side only:

1. The tuning third orders the candidates. For each stratum (a language) and each of ``BUDGETS`` in turn, every rule tries the
   lowest cutoff of ``GRID`` above which no more than that share of the stratum's good tuning documents lie, and takes it if
   it rejects more bad than good tuning documents beyond those that the rule rejects already. This is a chain of rule sets,
   each rejecting whatever the one before it rejects.
2. The held-out rest certifies. A rule set's *joint* share of rejected good documents is compared with ``alpha`` by the
   exact binomial tail P(Bin(n, alpha) <= k), k being the rejected ones of the stratum's n good documents. The chain is tested
   from its loosest set on and stops at the first failure (fixed-sequence testing: the chain costs no correction); the level
   ``delta`` is divided by the number of strata (Bonferroni). With probability 1 - delta, then, no stratum loses more than
   a share ``alpha`` of its good documents.
3. Of the certified sets, the one that rejects most bad less good held-out documents is in force, the loosest if equal; none,
   if it rejects no more bad than good ones.

A stratum needs log(delta / strata) / log(1 - alpha) good held-out texts for anything to be certified: 86 with four strata
and both levels at 5 %.

Every labelled text that passes the base rules counts, whatever the size of the input. Held-out texts are counted by stratum,
levels and label before they meet the chain, so a large stratum is no hot key.

Defined cases: a null text has no words (it fails the base rules); a null language is a stratum of its own; of several
labels of a document, and of equal texts in a stratum, the lowest counts; labels of null documents and labels that are neither
0 nor 1 are ignored; without labels only the base rules act; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricescope.llm.common import WORD, Scratch, materialize

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
GRID = [0.0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: Shares of good tuning documents that each rule may reject, one for each rule set of the chain.
BUDGETS = [0.0, 0.0025, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04]
#: One text in so many is for tuning.
TUNING = 3
#: The table of strata is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_STRATA = 50_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def count_repeated(words: Column, window: int = 3) -> Column:
    """Words inside windows of consecutive words that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hashes, which are sorted so that equal ones stand side by side.
    """

    def covered(by_hash: Column) -> Column:
        same = lambda i, j: F.get(by_hash, j)["h"] == F.get(by_hash, i)["h"]
        twice = F.filter(by_hash, lambda x, i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(*[x["i"] + k for k in range(window)])))))

    def sorted_pairs(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of_hashes(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(sorted_pairs(hashes), covered))

    def of_words(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - window)
        hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))
        return F.when(F.size(w) < window, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """The base counts of every row of ``docs``, and the measures that the rules compare with their cutoffs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    counted = docs.select(
        "doc_id",
        F.col(stratum).alias("stratum"),
        F.md5(text.cast("binary")).alias("digest"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), count_repeated(w).cast("long").alias("repeated"))).alias("w"),
        without(SPACES).cast("long").alias("word_chars"),
        (F.length(text) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated"))).alias("l"),
        (F.length(text) - without("!")).cast("long").alias("n_exclaims"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"),
    )
    flat = counted.select("doc_id", "stratum", "digest", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.repeated").alias("n_dup_lines"), F.col("w.repeated").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_exclaims", "n_upper")
    return flat.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))


def rules() -> dict[str, Column]:
    """The measures, by the name of their rule."""
    return {
        "symbols": _share("n_symbols", "word_chars"),
        "repeated_lines": _share("n_dup_lines", "n_lines"),
        "repeated_words": _share("n_repeat_words", "n_words"),
        "exclaims": _share("n_exclaims", "n_words"),
        "upper": _share("n_upper", "word_chars"),
    }


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly, in logarithms. 1 where k is the mean or more: nothing is certified there."""
    first = n * F.log1p(F.lit(-p))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p)))
        top, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("total"))

    start = F.struct(first.alias("term"), first.alias("total"))
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(upto, start, step, lambda acc: acc["total"])))


def labelled_levels(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, quality, tuning (or held out), and for each rule how many cutoffs lie below the measure: one row a text."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    one = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumnRenamed("doc_id", "labelled_id")
    level = lambda value: F.size(F.filter(F.array(*[F.lit(c) for c in GRID]), lambda c: value > c))
    levels = F.array(*[level(value) for value in rules().values()])
    joined = measured.where(~F.col("base_failed")).join(one, F.col("doc_id") == F.col("labelled_id")).select("stratum", "digest", "quality", levels.alias("levels"))
    texts = joined.groupBy("stratum", "digest", "levels").agg(F.min("quality").alias("quality"))
    split = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % TUNING == 0
    return texts.select("stratum", "quality", split.alias("tuning"), "levels")


def rule_chain(texts: DataFrame) -> DataFrame:
    """stratum and ``chain``: for each budget, for each rule, the place of its cutoff in GRID (its length: no cutoff)."""
    levels = texts.where("tuning").select("stratum", "quality", F.posexplode("levels").alias("rule", "level"))
    counts = levels.groupBy("stratum", "rule", "level").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    above = lambda what: F.array(*[F.coalesce(F.sum(F.when(F.col("level") > i, F.col(what))), F.lit(0)) for i in range(len(GRID) + 1)])
    table = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n"), above("good").alias("good"), above("bad").alias("bad"))

    def take(places: Column, share: Column) -> Column:
        now = F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(len(GRID)))
        tried = F.size(F.filter("good", lambda k: k > F.col("n") * share))
        gain = (F.get("bad", tried) - F.get("bad", now)) - (F.get("good", tried) - F.get("good", now))
        return F.concat(places, F.array(F.when(gain > 0, tried).otherwise(now)))

    places = F.aggregate(F.array(*[F.lit(b) for b in BUDGETS]), F.array().cast("array<int>"), take)
    by_rule = table.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("rule", places.alias("places")))).alias("by_rule"))
    sets = [F.transform("by_rule", lambda r: r["places"][j]) for j in range(len(BUDGETS))]  # noqa: B023
    return by_rule.select(F.col("stratum").alias("chain_stratum"), F.array(*sets).alias("chain"))


def certify(measured: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """One row for each stratum with rules in force: its cutoffs as a map by rule, and the held-out counts they rest on."""
    scratch = Scratch(measured.sparkSession, "rules")
    texts = scratch.table(labelled_levels(measured, labels), "texts")
    chain = rule_chain(texts)
    counts = texts.where(~F.col("tuning")).groupBy("stratum", "levels").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    joined = counts.join(chain, F.col("stratum").eqNullSafe(F.col("chain_stratum")))
    spared = lambda places: ~F.exists(F.arrays_zip(F.col("levels"), places.alias("places")), lambda x: x["levels"] > x["places"])
    step = F.size(F.filter("chain", spared))
    stepped = joined.groupBy("stratum", step.alias("step")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.first("chain").alias("chain"))
    upto = lambda what, i: F.coalesce(F.sum(F.when(F.col("step") <= i, F.col(what))), F.lit(0))
    tried = F.array(*[F.struct(F.lit(i).alias("step"), upto("good", i).alias("good"), upto("bad", i).alias("bad")) for i in range(len(BUDGETS))])
    table = scratch.table(stepped.groupBy("stratum").agg(F.sum("good").alias("n"), F.first("chain").alias("chain"), tried.alias("tried")), "counts")
    level = delta / max(1, table.count())
    tested = F.transform("tried", lambda t: F.struct(t["step"].alias("step"), t["good"].alias("good"), t["bad"].alias("bad"), binomial_tail(F.col("n"), t["good"], alpha).alias("p_value")))
    first_failed = F.coalesce(F.array_min(F.transform(F.filter("tested", lambda t: t["p_value"] > level), lambda t: t["step"])), F.lit(len(BUDGETS)))
    useful = F.filter("tested", lambda t: (t["step"] < F.col("failed")) & (t["bad"] > t["good"]))
    best = F.array_max(F.transform(useful, lambda t: F.struct((t["bad"] - t["good"]).alias("gain"), (-t["step"]).alias("loose"), t["good"].alias("good"), t["bad"].alias("bad"), t["p_value"].alias("p_value"))))
    chosen = table.withColumn("tested", tested).withColumn("failed", first_failed).select("stratum", "n", "chain", best.alias("best")).where("best IS NOT NULL")
    places = F.get("chain", -F.col("best.loose"))
    pairs = [F.struct(F.lit(name).alias("rule"), F.get(F.array(*[F.lit(c) for c in GRID]), places[i]).alias("cutoff")) for i, name in enumerate(rules())]
    cutoffs = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["cutoff"].isNotNull()))
    rows = chosen.select(F.col("stratum").alias("rule_stratum"), cutoffs.alias("cutoffs"), F.col("n").alias("n_good"), F.col("best.good").alias("good_rejected"), F.col("best.bad").alias("bad_rejected"), F.col("best.p_value").alias("p_value"))
    out = scratch.table(rows, "cutoffs")
    scratch.keep("cutoffs")
    return out


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The counts of every row of ``docs``, whether it fails the base rules, and whether it is kept."""
    measured = materialize(measure(docs, stratum), "rule-measures")
    cutoffs = certify(measured, labels, alpha, delta)
    if cutoffs.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    joined = measured.join(cutoffs, F.col("stratum").eqNullSafe(F.col("rule_stratum")), "left")
    rejected = F.lit(False)
    for name, value in rules().items():
        rejected = rejected | F.coalesce(value > F.try_element_at("cutoffs", F.lit(name)), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("rule_stratum", "cutoffs", "n_good", "good_rejected", "bad_rejected", "p_value", "digest")
