"""Document quality by weak supervision.

Rules on a text's shape vote good (1) or bad (-1) or abstain (0). Expectation-maximisation over the counts of vote
patterns estimates, with no labels, the share of good documents and how each rule votes on good and on bad ones; a
document is kept where its posterior probability of being good is high enough.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gambrel.llm.common import materialise, quoted, shut, without

SPACE = " \t\n\x0b\x0c\r"
#: Frequent function words of English, German, French and Spanish.
STOP = (
    "the of and to in is that for with was on are as it be this from by at or an not have which but "
    "der die das und den von zu mit ist ein nicht auf eine für als auch sich des dem im "
    "le la les et des est dans que une du en pour qui par sur au pas avec ce il "
    "el los y del las se por con para su lo como más al no es un de"
).split()
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ADDED = (*FEATURES, "base_failed", "votes", "quality", "kept")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts of FEATURES and what the rules need, inside each row: no shuffle, no Python."""
    temps = ["__t", "__words", "__lines", "__grams", "__starts"]
    out = without(docs, [*ADDED, *temps, "__n_lines", "__n_upper", "__n_ended", "__n_stop", "__n_distinct"])
    plain = out.columns
    text = F.coalesce(quoted(text_col), F.lit(""))
    out = out.withColumn("__t", F.btrim(text, F.lit(SPACE)))
    out = out.withColumns(
        {
            "__words": F.when(F.col("__t") == "", F.array().cast("array<string>")).otherwise(F.split("__t", r"[ \t-\r]+")),
            "__lines": F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
            "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "__n_upper": F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long"),
        }
    )
    # a run of three words by its hash; 64 bits keep runs of one text apart
    gram = lambda w, i: F.xxhash64(w, F.get("__words", i + 1), F.get("__words", i + 2))
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__n_lines": F.size("__lines").cast("long"),
            "__n_ended": F.size(F.filter("__lines", lambda x: F.rlike(x, F.lit(r"[.!?\"…。][ \t\r]*$")))).cast("long"),
            "__n_stop": F.size(F.array_intersect("__words", F.array(*map(F.lit, STOP)))).cast("long"),
            "__n_distinct": F.size(F.array_distinct("__words")).cast("long"),
            "__grams": F.transform(F.slice("__words", F.lit(1), F.greatest(F.size("__words") - 2, F.lit(0))), gram),
        }
    )
    twice = F.size(F.array_distinct("__grams")) < F.size("__grams")
    out = out.withColumn("__starts", F.when(twice, F.sort_array(F.transform("__grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    beside = lambda p, k: (
        F.coalesce(F.get("__starts", k - 1)["g"] == p["g"], F.lit(False)) | F.coalesce(F.get("__starts", k + 1)["g"] == p["g"], F.lit(False))
    )
    out = out.withColumn("__starts", F.when(F.col("__starts").isNotNull(), F.sort_array(F.transform(F.filter("__starts", beside), lambda p: p["i"]))))
    # words covered: three for each start, less what the start before it covers
    none = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("total"))
    step = lambda acc, s: F.struct(s.alias("last"), (acc["total"] + F.least(F.lit(3), s - acc["last"])).alias("total"))
    covered = F.aggregate(F.coalesce("__starts", F.array().cast("array<int>")), none, step)["total"]
    out = out.withColumn("n_repeat_words", covered)
    return out.select(*map(quoted, plain), *FEATURES, "__n_lines", "__n_upper", "__n_ended", "__n_stop", "__n_distinct")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(bad: Column, good: Column | None = None) -> Column:
    out = F.when(bad, -1)
    return (out if good is None else out.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """What each rule votes. Shares of an empty text are 0, on which all rules but the first abstain or vote bad."""
    symbols, repeats, stop, ended = _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words"), F.col("__n_stop"), _share("__n_ended", "__n_lines")
    mean, upper, distinct = _share("word_chars", "n_words"), _share("__n_upper", "word_chars"), _share("__n_distinct", "n_words")
    return {
        "length": _vote(F.col("n_words") < 20, F.col("n_words") >= 100),
        "symbols": _vote(symbols > 0.1, symbols <= 0.02),
        "symbol_share": _vote(_share("n_symbols", "word_chars") > 0.03, _share("n_symbols", "word_chars") <= 0.005),
        "duplicate_lines": _vote(_share("n_dup_lines", "__n_lines") > 0.3),
        "repeats": _vote(repeats > 0.3, repeats <= 0.15),
        "function_words": _vote(stop == 0, stop >= 3),
        "sentences": _vote(ended < 0.4, ended >= 0.95),
        "word_length": _vote((mean < 3) | (mean > 10)),
        "capitals": _vote(upper > 0.3),
        "variety": _vote((F.col("n_words") >= 50) & (distinct < 0.2), (F.col("n_words") < 2000) & (distinct > 0.5)),
    }


@dataclass(frozen=True)
class LabelModel:
    """The share of good documents; of each rule's votes on good and on bad documents, the share that says good."""

    prior: float
    on_good: dict[str, float]
    on_bad: dict[str, float]

    def log_odds(self) -> Column:
        """Of being good, from the vote columns."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, g in self.on_good.items():
            b = self.on_bad[name]
            vote = F.col(f"__vote_{name}")
            total = total + F.when(vote == 1, math.log(g / b)).when(vote == -1, math.log((1 - g) / (1 - b))).otherwise(0.0)
        return total

    def posterior(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))


def voted(frame: DataFrame) -> DataFrame:
    return frame.withColumns({f"__vote_{name}": vote for name, vote in rules().items()})


def fit(frame: DataFrame, rounds: int = 30, tolerance: float = 1e-4, smooth: float = 2.0) -> LabelModel:
    """Expectation-maximisation over all rows of ``features``. At most 3 to the number of rules patterns are kept.

    Each round is one aggregation of the pattern counts. ``smooth`` votes of either kind are added to every estimate,
    half as the start says. An empty table gives the start.
    """
    names = list(rules())
    patterns = voted(frame).groupBy(*[f"__vote_{n}" for n in names]).agg(F.count(F.lit(1)).alias("__rows"))
    patterns = materialise(patterns, "quality-patterns")
    start = LabelModel(0.7, dict.fromkeys(names, 0.9), dict.fromkeys(names, 0.4))
    model = start
    for _ in range(rounds):
        good = patterns.withColumn("__good", model.posterior() * F.col("__rows")).withColumn("__bad", F.col("__rows") - F.col("__good"))
        sums = [F.sum(c).alias(c) for c in ("__rows", "__good")]
        for n in names:
            for c in ("__good", "__bad"):
                for v, tag in ((1, "for"), (-1, "against")):
                    sums.append(F.sum(F.when(F.col(f"__vote_{n}") == v, F.col(c)).otherwise(0.0)).alias(f"{n}{c}_{tag}"))
        s = good.agg(*sums).first()
        if not s["__rows"]:
            return start
        # both classes keep votes of each kind, or a rule that never says one of them would decide alone
        rate = lambda n, c, first: (s[f"{n}{c}_for"] + smooth * first) / (s[f"{n}{c}_for"] + s[f"{n}{c}_against"] + smooth)
        new = LabelModel(
            min(0.99, max(0.01, (s["__good"] + smooth * start.prior) / (s["__rows"] + smooth))),
            {n: min(0.999, max(0.001, rate(n, "__good", start.on_good[n]))) for n in names},
            {n: min(0.999, max(0.001, rate(n, "__bad", start.on_bad[n]))) for n in names},
        )
        moved = max(abs(new.prior - model.prior), *(abs(new.on_good[n] - model.on_good[n]) + abs(new.on_bad[n] - model.on_bad[n]) for n in names))
        model = new
        if moved < tolerance:
            break
    return model


def score(frame: DataFrame, model: LabelModel, least: float = 0.5) -> DataFrame:
    """Add base_failed, votes (rule to vote), quality (posterior) and kept to rows of ``features``; drop the rest of it."""
    n = F.col("n_words")
    base = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    votes = F.create_map(*[x for name in rules() for x in (F.lit(name), F.col(f"__vote_{name}"))])
    out = voted(frame).withColumns({"base_failed": base, "votes": votes, "quality": model.posterior()})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    return out.drop(*[c for c in out.columns if c.startswith(("__vote_", "__n_"))])


def judge_quality(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Add the columns of ADDED to every document.

    Null texts are empty: no words, and so base_failed. Lines are split at ``\\n``; a line repeats where it equals an
    earlier one that has a word. Repeated rows are judged alike and count each. Input columns named like an added one are
    replaced. The model is fitted on all rows. Texts are read once and never shuffled: rows and their features are
    written, then fitted and judged from there. An empty table stays empty.
    """
    shaped = materialise(features(docs, text_col), "quality-features")
    return score(shaped, fit(shaped), least)


def keep_good(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that ``judge_quality`` keeps, with their own columns, whatever their names: a row travels as one struct.

    Features are written before rows are filtered on what they give, or the optimiser would copy their expressions into the
    filter many times over.
    """
    rows = shut(docs).select("row", quoted(text_col).alias("__text"))
    shaped = materialise(features(rows, "__text").drop("__text"), "quality-features")
    return score(shaped, fit(shaped), least).where("kept").select("row.*")
